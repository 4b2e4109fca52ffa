"""Selecting, moving and joining parts of grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slice_of(volume: DataFrame, z: int) -> DataFrame:
    """One slice; the filter reaches the scan."""
    return volume.filter(F.col("z") == z).select("y", "x", "v")


def set_slice(volume: DataFrame, z: int, grid: DataFrame) -> DataFrame:
    return volume.filter(F.col("z") != z).unionByName(grid.withColumn("z", F.lit(z).cast(volume.schema["z"].dataType)).select(*volume.columns))


def sub_range(grid: DataFrame, start: int, length: int, axis: str = "x") -> DataFrame:
    return grid.filter(F.col(axis).between(start, start + length - 1)).withColumn(axis, F.col(axis) - start)


def flip(grid: DataFrame, size: int, axis: str = "x") -> DataFrame:
    return grid.withColumn(axis, F.lit(size - 1) - F.col(axis))


def rotate_left(grid: DataFrame, width: int) -> DataFrame:
    """By 90 degrees: (x, y) goes to (y, width - 1 - x)."""
    return grid.select((F.lit(width - 1) - F.col("x")).alias("y"), F.col("y").alias("x"), "v")


def transpose(grid: DataFrame) -> DataFrame:
    return grid.select(F.col("x").alias("y"), F.col("y").alias("x"), "v")


def to_channels(volume: DataFrame, channels: int) -> DataFrame:
    """Successive slices become the channels ch0, ch1, ... of one."""
    values = [F.max(F.when(F.col("z") % channels == c, F.col("v"))).alias(f"ch{c}") for c in range(channels)]
    return volume.groupBy(F.floor(F.col("z") / channels).alias("z"), "y", "x").agg(*values)


def from_channels(grid: DataFrame, channels: list[str]) -> DataFrame:
    """Rows (ch, v) of named channels."""
    others = [c for c in grid.columns if c not in channels]
    return grid.select(*others, F.posexplode(F.array(*channels)).alias("ch", "v"))


def points_above(grid: DataFrame, threshold: float) -> DataFrame:
    return grid.filter(F.col("v") > threshold).select("y", "x")


def in_box(limits: dict[str, tuple[float, float]]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, (lo, hi) in limits.items()])


def in_cylinder(a: str, b: str, centre_a: float, centre_b: float, radius: float) -> Column:
    return F.pow(F.col(a) - centre_a, 2) + F.pow(F.col(b) - centre_b, 2) <= radius * radius


def in_half_space(normal: dict[str, float], offset: float) -> Column:
    """n . p <= offset."""
    return reduce(lambda a, b: a + b, [F.col(c) * n for c, n in normal.items()]) <= offset


def in_quadric(squares: dict[str, float], centre: dict[str, float], level: float = 1.0) -> Column:
    return reduce(lambda a, b: a + b, [F.pow(F.col(c) - centre.get(c, 0.0), 2) * k for c, k in squares.items()]) <= level


def normalize(volume: DataFrame, how: str, cut: float = 3.0, by: str = "z") -> DataFrame:
    """Of each slice: "minmax" to 0..1, "zscore", or "cutoff", a z-score clamped to +-cut. A constant slice becomes 0.

    Statistics are aggregated, one row a slice, and joined back: a slice is never gathered.
    """
    stats = volume.groupBy(by).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    out = volume.join(stats, by)
    if how == "minmax":
        v = F.when(F.col("_hi") > F.col("_lo"), (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    else:
        v = F.when(F.col("_s") > 0, (F.col("v") - F.col("_m")) / F.col("_s")).otherwise(0.0)
        if how == "cutoff":
            v = F.least(F.greatest(v, F.lit(-cut)), F.lit(cut))
    return out.withColumn("v", v).select(*volume.columns)


def concat_rows(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """The second grid below the first."""
    height = top.agg((F.max("y") + 1).alias("_h"))
    moved = bottom.crossJoin(F.broadcast(height)).withColumn("y", F.col("y") + F.coalesce("_h", F.lit(0))).drop("_h")
    return top.unionByName(moved)


def split_sweeps(rows: DataFrame, index: str, views: int) -> DataFrame:
    """The sweep of an index and its place in it; odd sweeps run backwards."""
    sweep, pos = F.floor(F.col(index) / views), F.col(index) % views
    return rows.withColumn("sweep", sweep).withColumn("pos", F.when(sweep % 2 == 0, pos).otherwise(views - 1 - pos))


def blocks_with_halo(grid: DataFrame, axis: str, block: int, halo: int, size: int) -> DataFrame:
    """Each cell once for every block that it is in or within `halo` of."""
    last = (size - 1) // block
    first_b, last_b = F.floor((F.col(axis) - halo) / block), F.floor((F.col(axis) + halo) / block)
    return grid.withColumn("b", F.explode(F.sequence(F.greatest(first_b, F.lit(0)), F.least(last_b, F.lit(last)))))


def merge_blocks(blocked: DataFrame, axis: str, block: int) -> DataFrame:
    """The cells that blocks own, without their halos."""
    return blocked.filter(F.floor(F.col(axis) / block) == F.col("b")).drop("b")


def set_difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b.select(*on).distinct(), on, "left_anti")


def set_intersection(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b.select(*on).distinct(), on, "left_semi")
