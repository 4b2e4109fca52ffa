"""Aggregations over grids. All combine before they shuffle; none gathers cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import ieee

FLOAT_MAX = 3.4028234663852886e38


def _valid(c: str) -> Column:
    return F.when(ieee.is_valid(c), F.col(c))


#: Of one value column; names as results.
REDUCTIONS: dict[str, object] = {
    "sum": lambda c: F.sum(c),
    "sum_safe": lambda c: F.coalesce(F.sum(_valid(c)), F.lit(0.0)),
    "mean": lambda c: F.avg(c),
    # NaN is ignored; without any number the initial bound is left
    "min": lambda c: F.coalesce(F.min(F.when(~F.isnan(c), F.col(c))), F.lit(FLOAT_MAX)),
    "max": lambda c: F.coalesce(F.max(F.when(~F.isnan(c), F.col(c))), F.lit(-FLOAT_MAX)),
    "norm_l1": lambda c: F.coalesce(F.sum(F.abs(_valid(c))), F.lit(0.0)),
    "norm_l2": lambda c: F.sqrt(F.coalesce(F.sum(_valid(c) * _valid(c)), F.lit(0.0))),
    "count_negative": lambda c: F.count_if(ieee.is_valid(c) & (F.col(c) < 0)),
    "count_invalid": lambda c: F.count_if(~ieee.is_valid(c)),
    # invalid values leave the sum, not the denominator
    "stddev": lambda c: F.sqrt(F.coalesce(F.sum(F.pow(_valid(c) - F.col("_mean"), 2)), F.lit(0.0)) / F.count("*")),
}


def reduce_grid(grid: DataFrame, names: list[str], by: list[str] | None = None, value: str = "v") -> DataFrame:
    return grid.groupBy(*(by or [])).agg(*[REDUCTIONS[n](value).alias(n) for n in names])


def sums(grid: DataFrame, value: str = "v", mask: Column | None = None) -> DataFrame:
    """Sum, sum of squares, number of cells: invalid values are skipped in the sums alone."""
    rows = grid if mask is None else grid.filter(mask)
    return rows.agg(
        F.coalesce(F.sum(_valid(value)), F.lit(0.0)).alias("sum"), F.coalesce(F.sum(_valid(value) * _valid(value)), F.lit(0.0)).alias("sum_sq"), F.count("*").alias("n")
    )


def mean_variance(grid: DataFrame, value: str = "v", mask: Column | None = None) -> DataFrame:
    """E[x] and E[x^2] - E[x]^2."""
    return sums(grid, value, mask).select((F.col("sum") / F.col("n")).alias("mean"), (F.col("sum_sq") / F.col("n") - F.pow(F.col("sum") / F.col("n"), 2)).alias("variance"))


def moments(zipped: DataFrame, mask: Column | None = None) -> DataFrame:
    """Means, variances and covariance of columns a and b, over the cells where a mask holds."""
    rows = zipped if mask is None else zipped.filter(mask)
    m = rows.agg(
        F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.avg(F.col("a") * F.col("a")).alias("aa"), F.avg(F.col("b") * F.col("b")).alias("bb"),
        F.avg(F.col("a") * F.col("b")).alias("ab"), F.count("*").alias("n"),
    )
    return m.select(
        "n", "ma", "mb", (F.col("aa") - F.col("ma") ** 2).alias("va"), (F.col("bb") - F.col("mb") ** 2).alias("vb"), (F.col("ab") - F.col("ma") * F.col("mb")).alias("cov")
    )


def ssim(zipped: DataFrame, bits: int = 1, mask: Column | None = None) -> DataFrame:
    """Structural similarity over the whole grid (k1 = .01, k2 = .03, range 2^bits - 1)."""
    top = 2**bits - 1
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    m = F.col
    return moments(zipped, mask).select(
        (((2 * m("ma") * m("mb") + c1) * (2 * m("cov") + c2)) / ((m("ma") ** 2 + m("mb") ** 2 + c1) * (m("va") + m("vb") + c2))).alias("ssim")
    )


def similarity(zipped: DataFrame, weight: float = 1.0, add: float = 0.0) -> DataFrame:
    """Dot products, weighted sum of squared differences and two root mean squares of columns a and b."""
    a, b = F.col("a"), F.col("b")
    diff = a - b
    return zipped.agg(
        F.sum(a * b).alias("dot"),
        F.sum(a * (b * weight + add)).alias("weighted_dot"),
        F.sum(F.pow(a - (b * weight + add), 2)).alias("weighted_ssd"),
        # invalid differences leave the sum, not the denominator
        F.sqrt(F.coalesce(F.sum(F.when(ieee.is_valid(diff), diff * diff)), F.lit(0.0)) / F.count("*")).alias("rmse"),
        F.avg(F.when(ieee.is_valid(diff), diff * diff)).alias("mse"),
    )


def agreement(zipped: DataFrame) -> DataFrame:
    """Pearson, concordance and universal quality index; zero variances count as 1e-12."""
    m = F.col
    sd = lambda c: F.when(m(c) > 0, F.sqrt(c)).otherwise(1e-12)
    return moments(zipped).select(
        (m("cov") / (sd("va") * sd("vb"))).alias("pearson"),
        (2 * m("cov") / (m("va") + m("vb") + (m("ma") - m("mb")) ** 2)).alias("concordance"),
        ((2 * m("cov") * 2 * m("ma") * m("mb")) / ((m("va") + m("vb")) * (m("ma") ** 2 + m("mb") ** 2))).alias("uqi"),
        # this form divides by n a second time
        (m("cov") / m("n")).alias("covariance_twice"),
    )


def upper_median(values: Column) -> Column:
    """The element at n div 2 of the sorted values: no mean of two."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def temporal_projection(volume: DataFrame) -> DataFrame:
    """Minimum, maximum, mean and upper median over slices for each pixel; a pixel's values are a bounded group."""
    return volume.groupBy("y", "x").agg(
        F.min("v").alias("lowest"), F.max("v").alias("highest"), F.avg("v").alias("mean"), upper_median(F.collect_list("v")).alias("median")
    )


def average_increment(df: DataFrame, partition: list[str], order: str, value: str) -> DataFrame:
    """Mean absolute step between successive angles in degrees; steps over 180 are taken the other way round."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*partition).orderBy(order)))
    return df.withColumn("_step", F.when(step > 180, 360 - step).otherwise(step)).groupBy(*partition).agg(F.avg("_step").alias("average_increment"))


def histogram(grid: DataFrame, low: float, high: float, bins: int = 255, value: str = "v") -> DataFrame:
    """(bin, n); the top of the range is in the last bin."""
    width = (high - low) / bins
    b = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))
    return grid.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def histogram_percentile(hist: DataFrame, share: float, low: float, high: float, bins: int = 255, ignore_first: bool = False) -> DataFrame:
    """The lower edge of the first bin at which the cumulated count reaches a share; over at most `bins` rows."""
    rows = hist.filter("bin > 0") if ignore_first else hist
    w = Window.orderBy("bin")
    done = rows.withColumn("_sum", F.sum("n").over(w)).withColumn("_all", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    width = (high - low) / bins
    return done.filter(F.col("_sum") >= share * F.col("_all")).agg((F.min("bin") * width + low).alias("percentile"))
