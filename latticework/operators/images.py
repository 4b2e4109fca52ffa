"""Polar images, votes, clusters, proximal steps and element loops over volumes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators.grids import along
from latticework.operators.interp import sample_linear
from latticework.operators.neighbors import gradient


def polar(grid: DataFrame, spark: SparkSession, radii: int, angles: int, centre: tuple[float, float]) -> DataFrame:
    """(r, t, v): an image along `angles` rays from a centre, at whole radii, linearly interpolated; 0 outside."""
    cy, cx = centre
    spine = spark.range(radii * angles).select((F.col("id") / angles).cast("int").alias("r"), (F.col("id") % angles).cast("int").alias("t"))
    a = F.col("t") * (2 * math.pi / angles)
    return sample_linear(grid, spine.select("r", "t", (cy + F.col("r") * F.sin(a)).alias("y"), (cx + F.col("r") * F.cos(a)).alias("x")), ["r", "t"])


def from_polar(polar_grid: DataFrame, cells: DataFrame, angles: int, centre: tuple[float, float]) -> DataFrame:
    """(y, x, v) for the cells (y, x), linear in the radius, nearest in the angle."""
    cy, cx = centre
    dy, dx = F.col("y") - cy, F.col("x") - cx
    t = F.pmod(F.round(F.atan2(dy, dx) / (2 * math.pi / angles)).cast("int"), F.lit(angles))
    r = F.hypot(dy, dx)
    taps = F.array(F.struct(F.floor(r).cast("int").alias("r"), (1 - (r - F.floor(r))).alias("w")), F.struct((F.floor(r) + 1).cast("int").alias("r"), (r - F.floor(r)).alias("w")))
    long = cells.select("y", "x", t.alias("t"), F.explode(taps).alias("p")).select("y", "x", "t", F.col("p.r").alias("r"), F.col("p.w").alias("_w"))
    return long.join(polar_grid, ["r", "t"], "left").groupBy("y", "x").agg(F.sum(F.col("_w") * F.coalesce("v", F.lit(0.0))).alias("v"))


def ring_map(polar_grid: DataFrame, angles: int, radial: int, azimuthal: int) -> DataFrame:
    """(r, t, v): what a polar image has beyond its median over the radii around, averaged over the angles around.

    The median is the upper one of the cells within `radial` that exist; angles run round, within `azimuthal` both ways.
    """
    around = lambda w, whole: {"_m": F.sort_array(F.collect_list("v").over(w.rowsBetween(-radial, radial)))}
    beyond = along(polar_grid, "r", ["t"], radial, around).withColumn("v", F.col("v") - F.get("_m", F.floor(F.size("_m") / 2).cast("int"))).drop("_m")
    wide = beyond.select("r", "v", F.explode(F.array(F.col("t") - angles, F.col("t"), F.col("t") + angles)).alias("t")).filter(F.col("t").between(-azimuthal, angles + azimuthal - 1))
    mean = along(wide, "t", ["r"], azimuthal, lambda w, whole: {"v": F.avg("v").over(w.rowsBetween(-azimuthal, azimuthal))})
    return mean.filter(F.col("t").between(0, angles - 1)).select("r", "t", "v")


def without_rings(grid: DataFrame, spark: SparkSession, radii: int, angles: int, centre: tuple[float, float], radial: int, azimuthal: int) -> DataFrame:
    """(y, x, v): an image less its rings about a centre, 0 at least."""
    rings = ring_map(polar(grid, spark, radii, angles, centre), angles, radial, azimuthal)
    back = from_polar(rings, grid.select("y", "x"), angles, centre).withColumnRenamed("v", "_ring")
    return grid.join(back, ["y", "x"]).select("y", "x", F.greatest(F.col("v") - F.col("_ring"), F.lit(0.0)).alias("v"))


def radial_symmetry(grid: DataFrame, radius: int, least: float = 0.0) -> DataFrame:
    """(y, x, votes, strength): every cell votes for the cells a radius along its gradient, and against those behind it."""
    g = gradient(grid, "x").withColumnRenamed("v", "gx").join(gradient(grid, "y", keys=("y", "x")).withColumnRenamed("v", "gy"), ["y", "x"])
    n = F.hypot("gx", "gy")
    v = g.withColumn("_n", n).filter(F.col("_n") > least)
    to = F.explode(F.array(F.lit(1), F.lit(-1))).alias("s")
    v = v.select("y", "x", "gx", "gy", "_n", to)
    y = (F.col("y") + F.round(F.col("s") * radius * F.col("gy") / F.col("_n"))).cast("long")
    x = (F.col("x") + F.round(F.col("s") * radius * F.col("gx") / F.col("_n"))).cast("long")
    return v.groupBy(y.alias("y"), x.alias("x")).agg(F.sum("s").alias("votes"), F.sum(F.col("s") * F.col("_n")).alias("strength"))


def structure_tensor(grid: DataFrame, radius: int = 1) -> DataFrame:
    """(y, x, large, small): the eigenvalues of the gradient's outer product, averaged over the cells within a radius in
    y and x that exist."""
    g = gradient(grid, "x").withColumnRenamed("v", "gx").join(gradient(grid, "y", keys=("y", "x")).withColumnRenamed("v", "gy"), ["y", "x"])
    g = g.select("y", "x", (F.col("gx") * F.col("gx")).alias("a"), (F.col("gx") * F.col("gy")).alias("b"), (F.col("gy") * F.col("gy")).alias("c"))
    means = lambda w, whole: {k: F.avg(k).over(w.rowsBetween(-radius, radius)) for k in "abc"}
    g = along(along(g, "x", ["y"], radius, means), "y", ["x"], radius, means)
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    root = F.sqrt(F.pow((a - c) / 2, 2) + b * b)
    return g.select("y", "x", ((a + c) / 2 + root).alias("large"), ((a + c) / 2 - root).alias("small"))


def cluster_centres(points: DataFrame, component: str, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """The mean of each cluster's points; clusters come from graph.threshold_edges and graph.components."""
    return points.groupBy(component).agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in axes])


# proximal operators


def soft_threshold(v: Column, level: float) -> Column:
    return F.signum(v) * F.greatest(F.abs(v) - level, F.lit(0.0))


def group_shrink(parts: list[Column], level: float) -> list[Column]:
    """The proximal step of the norm of several components: all shrink by the same share."""
    n = F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
    scale = F.when(n > level, 1 - level / n).otherwise(0.0)
    return [p * scale for p in parts]


def huber(v: Column, level: float) -> Column:
    return F.when(F.abs(v) <= level, v * v / 2).otherwise(level * (F.abs(v) - level / 2))


def linear_combination(a: DataFrame, b: DataFrame, ka: float, kb: float, on: list[str]) -> DataFrame:
    return a.withColumnRenamed("v", "_a").join(b.withColumnRenamed("v", "_b"), on).select(*on, (ka * F.col("_a") + kb * F.col("_b")).alias("v"))


# frequency weights of volumes, at frequencies in units of the Nyquist frequency


def frequency(index: Column, size: int) -> Column:
    """Of a place in a spectrum whose zero frequency comes first."""
    return F.when(index <= size // 2, index).otherwise(index - size) / (size / 2)


def volume_weight(kind: str, r: Column, cut: float = 0.5) -> Column:
    if kind == "gaussian":
        return F.exp(-(r * r) / (2 * cut * cut))
    if kind == "low_pass":
        return F.when(r <= cut, 1.0).otherwise(0.0)
    if kind == "high_pass":
        return F.when(r > cut, 1.0).otherwise(0.0)
    if kind == "exponential":
        return F.exp(-r / cut)
    if kind == "squared_cosine":
        return F.when(r < 1, F.pow(F.cos(math.pi / 2 * r), 2)).otherwise(0.0)
    raise ValueError(f"no weight {kind!r}")


def sigmoid(v: Column, centre: float, width: float, top: float = 1.0) -> Column:
    return top / (1 + F.exp(-(v - centre) / width))
