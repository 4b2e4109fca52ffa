"""Corrections of projections: beam hardening, scatter, defect pixels; total variation of volumes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import ieee
from latticework.operators.grids import along, stencil
from latticework.operators.interp import bilinear_table

AXES = {"x": ["z", "y"], "y": ["z", "x"], "z": ["y", "x"]}


def hardening_curve(spark: SparkSession, spectrum: DataFrame, longest: float, points: int = 400) -> DataFrame:
    """(k, length, poly, mono): what a spectrum measures behind a length of a material, -ln of the transmission, and what
    one energy with the spectrum's mean attenuation would.

    spectrum (energy, weight, mu) is a short table; weights below 0 count as 0, and they are normalised.
    """
    s = spectrum.select(F.greatest("weight", F.lit(0.0)).alias("_w"), "mu")
    s = s.crossJoin(F.broadcast(s.agg(F.sum("_w").alias("_s"))))
    lengths = spark.range(points).select(F.col("id").alias("k"), (longest * F.col("id") / (points - 1)).alias("length"))
    share = F.col("_w") / F.col("_s")
    out = lengths.crossJoin(F.broadcast(s)).groupBy("k", "length").agg((-F.log(F.sum(share * F.exp(-F.col("mu") * F.col("length"))))).alias("poly"), F.sum(share * F.col("mu")).alias("_m"))
    return out.select("k", "length", "poly", (F.col("_m") * F.col("length")).alias("mono"))


def precorrection(curve: DataFrame, degree: int) -> list[float]:
    """Coefficients, the constant first, of the polynomial from poly to mono; pointwise.horner applies it. The curve is a
    table of a few hundred points."""
    rows = curve.select("poly", "mono").collect()
    return np.polynomial.polynomial.polyfit([r["poly"] for r in rows], [r["mono"] for r in rows], degree).tolist()


def hardening_table(spectrum: list[tuple[float, float, float]], soft: list[float], hard: list[float], low: float = -2.0, high: float = 2.0) -> list[list[float]]:
    """For each corrected value of soft material (rows) and each passed hard one (columns) the factor by which hard
    material counts as soft: spectra behind both, less that share, transmit what the corrected value alone does.

    spectrum: (weight, attenuation of soft, of hard) an energy. Bisection between two bounds; without any hard material
    the limit for little of it.
    """
    w, a, b = np.array(spectrum, float).T
    out = []
    for s in soft:
        seen = w * np.exp(-a * s)
        row = []
        for h in hard:
            if h == 0:
                row.append(float(np.clip((seen * b).sum() / (seen * a).sum(), low, high)))
                continue
            lo, hi = low, high
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if (seen * np.exp(h * (a * mid - b))).sum() < seen.sum() else (lo, mid)
            row.append((lo + hi) / 2)
        out.append(row)
    return out


def weigh_hard_material(v: Column, hard: Column, table: list[list[float]], spacing: float, factor: float, least: float = 0.02) -> Column:
    """v plus (factor - the table's factor) times the hard material; cells with little of it keep v."""
    return v + F.when(hard > least, (factor - bilinear_table(hard, v, table, spacing)) * hard).otherwise(0.0)


def sharpen_scatter(grid: DataFrame, radius: int, sigma: float, weight: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(v + weight * blurred) / (1 - weight), blurred by a Gaussian of a radius, borders replicated."""
    g = [float(np.exp(-d * d / (2 * sigma * sigma))) for d in range(-radius, radius + 1)]
    w = [b * a / sum(g) ** 2 for b in g for a in g]
    blurred = F.aggregate(F.zip_with("n", F.array(*[F.lit(k) for k in w]), lambda n, k: n * k), F.lit(0.0), lambda s, t: s + t)
    return stencil(grid, radius, radius, keys=keys).withColumn("v", (F.col("v") + weight * blurred) / (1 - weight)).drop("n")


def mend_defects(grid: DataFrame, mask: DataFrame, radius: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """Defect cells (m = 0) get the upper median of the sound cells within a radius; those without any keep their value,
    as do cells that the mask does not hold."""
    on = [*keys, "y", "x"]
    known = grid.join(mask.select(*on, F.col("m").alias("_m")), on, "left").withColumn("_kept", F.col("v"))
    sound = known.withColumn("v", F.when(F.coalesce("_m", F.lit(1)) != 0, F.col("v")))
    near = F.sort_array(F.filter("n", lambda c: c.isNotNull()))
    median = F.get(near, F.floor(F.size(near) / 2).cast("int"))
    out = stencil(sound, radius, radius, border="null", keys=keys)
    return out.select(*on, F.when(F.col("_m") == 0, F.coalesce(median, "_kept")).otherwise(F.col("_kept")).alias("v"))


def normalised_improvement(before: DataFrame, after: DataFrame, reference: DataFrame, on: list[str]) -> DataFrame:
    """(improvement): by what share a correction lowers the root mean square error; 1 where nothing of it is left."""
    j = reference.join(before.withColumnRenamed("v", "_b"), on).join(after.withColumnRenamed("v", "_a"), on)
    rms = lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col("v"), 2)))
    return j.agg(ieee.div(rms("_b") - rms("_a"), rms("_b")).alias("improvement"))


def _differences(volume: DataFrame) -> DataFrame:
    """Columns _dx, _dy, _dz: differences to the cells before, 0 at the borders."""
    for axis, others in AXES.items():
        volume = along(volume, axis, others, 1, lambda w, whole, a=axis: {f"_d{a}": F.col("v") - F.coalesce(F.lag("v").over(w), F.col("v"))})
    return volume


def tv_magnitude_3d(volume: DataFrame) -> DataFrame:
    d = _differences(volume)
    return d.select("z", "y", "x", F.sqrt(sum((F.pow(F.col(f"_d{a}"), 2) for a in AXES), F.lit(0.0))).alias("v"))


def tv_gradient_3d(volume: DataFrame, eps: float = 1e-4, weights: DataFrame | None = None) -> DataFrame:
    """The derivative of the total variation by each cell: the negative divergence of the normalised differences. With
    weights (z, y, x, w) that of the weighted total variation."""
    d = _differences(volume)
    k = 1 / F.sqrt(sum((F.pow(F.col(f"_d{a}"), 2) for a in AXES), F.lit(eps)))
    if weights is not None:
        d = d.join(weights.withColumnRenamed("w", "_w"), ["z", "y", "x"])
        k = k * F.col("_w")
    q = d.select("z", "y", "x", *[(F.col(f"_d{a}") * k).alias(f"_q{a}") for a in AXES])
    for axis, others in AXES.items():
        q = along(q, axis, others, 1, lambda w, whole, a=axis: {f"_q{a}": F.col(f"_q{a}") - F.coalesce(F.lead(f"_q{a}").over(w), F.lit(0.0))})
    return q.select("z", "y", "x", sum((F.col(f"_q{a}") for a in AXES), F.lit(0.0)).alias("v"))


def tv_weights_3d(volume: DataFrame, eps: float = 0.01) -> DataFrame:
    """(z, y, x, w): the weights of the next round of a weighted total variation."""
    return tv_magnitude_3d(volume).select("z", "y", "x", (1 / (F.col("v") + eps)).alias("w"))


def levenberg_marquardt(points: DataFrame, y: str, model, start: list[float], rounds: int = 50, damping: float = 1e-3, tolerance: float = 1e-12) -> tuple[list[float], float]:
    """Parameters of least squares and the sum of squares. model(parameters) gives a column; its derivatives are central
    differences. A round is one aggregation of a few sums over all points; the system solved has a row a parameter."""
    n = len(start)

    def sums(p: list[float]):
        r = F.col(y) - model(p)
        steps = [1e-6 * max(1.0, abs(v)) for v in p]
        moved = lambda i, s: model([v + s * steps[i] if i == j else v for j, v in enumerate(p)])
        g = [(moved(i, 1) - moved(i, -1)) / (2 * steps[i]) for i in range(n)]
        row = points.agg(
            F.sum(r * r).alias("s"), *[F.sum(g[i] * r).alias(f"b{i}") for i in range(n)], *[F.sum(g[i] * g[j]).alias(f"a{i}_{j}") for i in range(n) for j in range(i, n)]
        ).first()
        return row["s"], np.array([row[f"b{i}"] for i in range(n)]), np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])

    best = list(map(float, start))
    error, b, a = sums(best)
    for _ in range(rounds):
        step = np.linalg.solve(a + damping * np.diag(np.maximum(np.diag(a), 1e-12)), b)
        tried = [v + float(d) for v, d in zip(best, step, strict=True)]
        new, nb, na = sums(tried)
        if new is not None and new < error:
            done = error - new <= tolerance * max(error, 1e-300)
            best, error, b, a, damping = tried, new, nb, na, damping / 10
            if done:
                break
        else:
            damping *= 10
            if damping > 1e12:
                break
    return best, float(error)
