"""Interpolation, lookups, windows and time warps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.operators.keys import hand_back


def sample_linear(grid: DataFrame, points: DataFrame, point_id: list[str], border: str = "zero", size: dict[str, int] | None = None) -> DataFrame:
    """Values of a grid (coordinates and v) at real positions with the same coordinate names: linear in each of them.

    Each point goes to its 2^d corners, an equi-join brings their values, and the weighted sum is combined before it is
    shuffled. border "zero": cells outside count as 0; "replicate" (with the sizes): positions are clamped.
    """
    axes = [c for c in ("t", "z", "y", "x") if c in grid.columns]
    p = points.select(*point_id, *[F.col(a).cast("double").alias(f"_{a}") for a in axes])
    if border == "replicate":
        p = p.withColumns({f"_{a}": F.least(F.greatest(F.col(f"_{a}"), F.lit(0.0)), F.lit(float(size[a] - 1))) for a in axes})
    corners, weight = [F.struct(F.lit(1.0).alias("w"))], "w"
    for a in axes:
        low, frac = F.floor(f"_{a}"), F.col(f"_{a}") - F.floor(f"_{a}")
        corners = [
            F.struct(*[c[b].alias(b) for b in axes[: axes.index(a)]], at.cast("long").alias(a), (c[weight] * k).alias("w")) for c in corners for at, k in ((low, 1 - frac), (low + 1, frac))
        ]
    long = p.select(*point_id, F.explode(F.array(*corners)).alias("c")).select(*point_id, *[F.col(f"c.{a}").alias(a) for a in axes], F.col("c.w").alias("_w"))
    got = long.filter("_w > 0").join(grid.withColumns({a: F.col(a).cast("long") for a in axes}), axes, "left")
    sums = got.groupBy(*point_id).agg(F.sum(F.col("_w") * F.coalesce("v", F.lit(0.0))).alias("v"))
    return sums


def scatter_linear(points: DataFrame, value: str = "v") -> DataFrame:
    """The adjoint: each value is dealt over the corners around its real position (y, x) and added up."""
    parts = []
    for dy in (0, 1):
        for dx in (0, 1):
            fy, fx = F.col("y") - F.floor("y"), F.col("x") - F.floor("x")
            w = (fy if dy else 1 - fy) * (fx if dx else 1 - fx)
            parts.append(F.struct((F.floor("y") + dy).cast("long").alias("y"), (F.floor("x") + dx).cast("long").alias("x"), (w * F.col(value)).alias("v"), w.alias("w")))
    long = points.select(F.explode(F.array(*parts)).alias("p")).select("p.*").filter("w > 0")
    return long.groupBy("y", "x").agg(F.sum("v").alias("v"))


def warp(grid: DataFrame, size: tuple[int, int], matrix: list[list[float]], shift: list[float], border: str = "zero") -> DataFrame:
    """A grid resampled at matrix * (x, y) + shift, linearly."""
    h, w = size
    x, y = F.col("x"), F.col("y")
    points = grid.select(
        F.col("y").alias("_oy"), F.col("x").alias("_ox"), (matrix[1][0] * x + matrix[1][1] * y + shift[1]).alias("y"), (matrix[0][0] * x + matrix[0][1] * y + shift[0]).alias("x")
    )
    out = sample_linear(grid, points, ["_oy", "_ox"], border, {"y": h, "x": w})
    return out.select(F.col("_oy").alias("y"), F.col("_ox").alias("x"), "v")


def lookup(queries: DataFrame, knots: DataFrame, key: str, value: str, how: str = "linear") -> DataFrame:
    """value of a table of knots at each query's key: linear, log-lin or log-log between neighbours; NULL outside.

    Of knots with equal keys the largest value counts; knots with a NULL in either column are none. Up to MOST_KNOTS knots
    are broadcast as one sorted array, in which a key is sought in two steps of about the root of their number; more are
    met by a sort of both sides, as in asof_join.
    """
    k = knots.groupBy(F.col(key).cast("double").alias("k")).agg(F.max(F.col(value).cast("double")).alias("val")).filter("k is not null and val is not null")
    n = k.count()
    if n > MOST_KNOTS:
        at = F.col(key).cast("double")
        run = _bracketed(queries.select(at.alias("k")), k.select("k", F.struct("k", "val").alias("_val")), "k", None)
        out = hand_back(queries.withColumn("_k", at), run.withColumnRenamed("k", "_k"), "_k").drop("_k")
    else:
        table = k.agg(F.array_sort(F.collect_list(F.struct("k", "val"))).alias("_t"))
        step = max(1, math.isqrt(n))
        q = queries.crossJoin(F.broadcast(table))
        firsts = F.transform(F.sequence(F.lit(0), F.lit(max(n - 1, 0)), F.lit(step)), lambda i: F.get("_t", i)["k"])
        q = q.withColumn("_i", F.size(F.filter(firsts, lambda f: f <= F.col(key))) - 1)
        q = q.withColumn("_t", F.when(F.col("_i") >= 0, F.slice("_t", F.greatest(F.col("_i"), F.lit(0)) * step + 1, step + 1)))
        below = F.try_element_at(F.filter("_t", lambda s: s["k"] <= F.col(key)), F.lit(-1))
        above = F.get(F.filter("_t", lambda s: s["k"] >= F.col(key)), F.lit(0))
        out = q.withColumn("_lo", below).withColumn("_hi", above).drop("_t", "_i")
    return out.withColumn(value, between(F.col(key), F.col("_lo.k"), F.col("_lo.val"), F.col("_hi.k"), F.col("_hi.val"), how)).drop("_lo", "_hi")


MOST_KNOTS = 10_000
#: Distinct keys of a range of a sort, about, and the ranges at most.
RANGE_KEYS, MOST_RANGES = 1_000_000, 4096


def between(k: Column, k0: Column, v0: Column, k1: Column, v1: Column, how: str = "linear") -> Column:
    if how == "log_log":
        k, k0, k1 = F.log(k), F.log(k0), F.log(k1)
    if how in ("log_lin", "log_log"):
        v0, v1 = F.log(v0), F.log(v1)
    v = F.when(k0 == k1, v0).when(k0.isNotNull() & k1.isNotNull(), v0 + (v1 - v0) * (k - k0) / (k1 - k0))
    return F.exp(v) if how in ("log_lin", "log_log") else v


def asof_join(left: DataFrame, right: DataFrame, on: str, value: str, buckets: Column | None = None) -> DataFrame:
    """The last value of right at or before each row's key; NULL before the first and for a NULL key.

    Of right's rows with equal keys the largest value counts; those with a NULL key or value are none. The distinct keys of
    both sides are sorted together within ranges of the key, so a key with many rows is one row there, and each key's
    answer goes back to its rows. Ranges come from quantiles of all keys, or from `buckets`, which must not fall as the
    key rises; what reaches over a range's border is carried by a table of one row a range.
    """
    known = right.groupBy(on).agg(F.max(value).alias("_val")).filter(F.col(on).isNotNull() & F.col("_val").isNotNull())
    run = _bracketed(left.select(on), known, on, buckets)
    name = value + "_" * max(map(len, left.columns))  # no column of left has this name
    out = hand_back(left, run.select(on, "_n", F.col("_lo").alias(name)), on)
    return out.select(*left.columns, F.col(name).alias(value))


def _ranges(keys: DataFrame, on: str) -> Column:
    """The number of a key's range: bounds are quantiles of the distinct keys, sought in two steps."""
    n = min(MOST_RANGES, -(-keys.count() // RANGE_KEYS))
    if n <= 1:
        return F.lit(0)
    bounds = sorted(set(keys.agg(F.percentile_approx(on, [i / n for i in range(1, n)], 100 * n)).first()[0]))
    step = max(1, math.isqrt(len(bounds)))
    parts = [F.array(*[F.lit(b) for b in bounds[i : i + step]]) for i in range(0, len(bounds), step)]
    upto = lambda a: F.size(F.filter(a, lambda b: b <= F.col(on)))
    part = F.greatest(upto(F.array(*[F.lit(b) for b in bounds[::step]])) - 1, F.lit(0))
    return part * step + upto(F.get(F.array(*parts), part))


def _bracketed(queries: DataFrame, known: DataFrame, on: str, buckets: Column | None) -> DataFrame:
    """(on, _n, _lo, _hi) for each distinct key of queries: its rows, and the values (_val) of the known keys at or before
    it and at or after it. Known keys are distinct."""
    asked = queries.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_n"))
    both = asked.select(on, "_n").join(known.select(on, "_val"), on, "full")
    both = both.withColumn("_b", buckets if buckets is not None else _ranges(both, on))
    ends = both.groupBy("_b").agg(F.max_by("_val", F.when(F.col("_val").isNotNull(), F.col(on))).alias("_t"), F.min_by("_val", F.when(F.col("_val").isNotNull(), F.col(on))).alias("_h"))
    order = Window.orderBy("_b")  # one row a range
    before = F.last("_t", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_h", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    ends = ends.select("_b", before.alias("_before"), after.alias("_after"))
    w = Window.partitionBy("_b").orderBy(on)
    w_down = Window.partitionBy("_b").orderBy(F.desc(on))
    run = both.withColumn("_l", F.last("_val", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("_u", F.last("_val", ignorenulls=True).over(w_down.rowsBetween(Window.unboundedPreceding, 0))).filter("_n is not null")
    return run.join(ends, "_b", "left").select(on, "_n", F.coalesce("_l", "_before").alias("_lo"), F.coalesce("_u", "_after").alias("_hi"))


def closest_index(values: DataFrame, target: Column, index: str, value: str, by: list[str] | None = None) -> DataFrame:
    """The first index with the least distance to a target."""
    return values.groupBy(*(by or [])).agg(F.min(F.struct(F.abs(F.col(value) - target).alias("d"), F.col(index).alias("i")))["i"].alias("closest"))


def bilinear_table(x: Column, y: Column, table: list[list[float]], spacing: float = 1.0) -> Column:
    """A small 2-D table at (x, y), linear in both; positions outside are clamped."""
    h, w = len(table), len(table[0])
    flat = F.array(*[F.lit(float(v)) for row in table for v in row])
    px, py = F.least(F.greatest(x / spacing, F.lit(0.0)), F.lit(w - 1.0)), F.least(F.greatest(y / spacing, F.lit(0.0)), F.lit(h - 1.0))
    x0, y0 = F.least(F.floor(px), F.lit(w - 2)).cast("int"), F.least(F.floor(py), F.lit(h - 2)).cast("int")
    fx, fy = px - x0, py - y0
    at = lambda r, c: F.get(flat, r * w + c)
    return at(y0, x0) * (1 - fx) * (1 - fy) + at(y0, x0 + 1) * fx * (1 - fy) + at(y0 + 1, x0) * (1 - fx) * fy + at(y0 + 1, x0 + 1) * fx * fy


def fft_shift(index: Column, size: int) -> Column:
    """Where a coordinate goes when the half spaces are swapped."""
    return F.pmod(index + size // 2, F.lit(size))


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1)).otherwise(F.pow(2.0, F.ceil(F.log2(n.cast("double")))).cast("long"))


#: The coefficients of the cosine windows, w(i) = sum (-1)^k a_k cos(2 pi k i / (n - 1)). The last of
#: blackman_harris is a tenth of the published one, as users of these windows know it; blackman_harris_textbook has that.
WINDOWS = {
    "hann": (0.5, 0.5),
    "hamming": (0.54, 0.46),
    "blackman": (0.42, 0.5, 0.08),
    "blackman_harris": (0.35875, 0.48829, 0.14128, 0.001168),
    "blackman_harris_textbook": (0.35875, 0.48829, 0.14128, 0.01168),
}


def apodization(kind: str, i: Column, n: int) -> Column:
    """A window's weight at a place; multiply those of both axes for an image."""
    if kind == "welch":
        return 1 - F.pow((i - (n - 1) / 2) / ((n - 1) / 2), 2)
    out = F.lit(0.0)
    for k, a in enumerate(WINDOWS[kind]):
        out = out + F.lit((-1) ** k * a) * F.cos(F.lit(2 * math.pi * k / (n - 1)) * i)
    return out


# time warps: [0, 1] -> [0, 1]


def warp_time(kind: str, t: Column, cycles: float = 1.0, rest: float = 0.3, sharpness: float = 10.0) -> Column:
    if kind == "identity":
        return t
    if kind == "constant":
        return F.lit(0.0)
    if kind == "sigmoid":
        low, high = 1 / (1 + math.exp(sharpness / 2)), 1 / (1 + math.exp(-sharpness / 2))
        return (1 / (1 + F.exp(-sharpness * (t - 0.5))) - low) / (high - low)
    if kind == "cosine":
        return 0.5 - 0.5 * F.cos(2 * math.pi * cycles * t)
    if kind == "harmonic":
        return F.pmod(t * cycles, F.lit(1.0))
    if kind == "rest":
        p = F.pmod(t * cycles, F.lit(1.0))
        return F.when(p < rest, 0.0).otherwise((p - rest) / (1 - rest))
    if kind == "dual_phase":
        p = F.pmod(t * cycles, F.lit(1.0))
        return F.when(p < rest, 0.5 * p / rest).otherwise(0.5 + 0.5 * (p - rest) / (1 - rest))
    raise ValueError(f"no time warp {kind!r}")


def gating_weight(phase: Column, reference: float, width: float, power: float) -> Column:
    """cos^power of the circular distance of phases, over the width of a window; 0 outside it and for negative phases."""
    d = F.least(F.abs(phase - reference), F.abs(phase - reference + 1), F.abs(phase - reference - 1))
    return F.when((phase < 0) | (d >= width / 2), 0.0).otherwise(F.pow(F.cos(d / width * math.pi), power))


def one_per_cycle(views: DataFrame, cycle: str, phase: str, order: str, reference: float, most: float = 0.05) -> DataFrame:
    """Of each heart cycle the view nearest to a phase, if it is within a distance; the first of equals."""
    d = F.abs(F.col(phase) - reference)
    best = views.groupBy(cycle).agg(F.min(F.struct(d.alias("d"), F.col(order).alias("i"))).alias("_b"))
    return best.filter(F.col("_b.d") < most).select(cycle, F.col("_b.i").alias(order), F.col("_b.d").alias("distance"))
