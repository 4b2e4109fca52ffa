"""Layouts of grids as tables: long (y, x, v), volumes (z, y, x, v), rows (y, row) and slices (z, w, h, px)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block when neighbours across rows are needed; a window never spans more than a block and its halo.
BLOCK = 256


def to_rows(grid: DataFrame, keys: tuple[str, ...] = ("y",), at: str = "x", value: str = "v") -> DataFrame:
    """One array for each row of a long grid, by position; a row is a bounded group."""
    return grid.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda s: s[value]).alias("row"))


def to_long(rows: DataFrame, keys: tuple[str, ...] = ("y",), row: str = "row") -> DataFrame:
    return rows.select(*keys, F.posexplode(row).alias("x", "v"))


def to_slices(volume: DataFrame) -> DataFrame:
    """(z, w, h, px): the reference layout of a projection, row-major."""
    return volume.groupBy("z").agg(
        (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"]).alias("px")
    )


def linear_index(dims: list[tuple[str, int]]) -> Column:
    """Mixed-radix index of coordinates, the first running fastest; right for any number of dimensions."""
    stride, out = 1, F.lit(0).cast("long")
    for name, size in dims:
        out = out + F.col(name) * F.lit(stride)
        stride *= size
    return out


def index_to_physical(index: Column | str, spacing: float, origin: float) -> Column:
    return (F.col(index) if isinstance(index, str) else index) * spacing + origin


def physical_to_index(position: Column | str, spacing: float, origin: float) -> Column:
    return ((F.col(position) if isinstance(position, str) else position) - origin) / spacing


def with_halo(grid: DataFrame, axis: str, radius: int, block: int = BLOCK) -> DataFrame:
    """Each row once for every block along an axis that it belongs to or borders: columns _block and _own."""
    own = F.floor(F.col(axis) / block)
    first, last = F.floor((F.col(axis) - radius) / block), F.floor((F.col(axis) + radius) / block)
    return grid.withColumn("_block", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_block") == own)


def along(grid: DataFrame, axis: str, others: list[str], radius: int, make, block: int = BLOCK) -> DataFrame:
    """Columns from a window along an axis: make(window, whole) gives {name: column}.

    Windows hold a block with a halo of `radius` on each side, so no column of cells ever meets in one task. Where a lag
    within the radius is NULL the cell is at the border of the grid, and the first or last of the window is the border.
    """
    w = Window.partitionBy("_block", *others).orderBy(axis)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return with_halo(grid, axis, radius, block).withColumns(make(w, whole)).filter("_own").drop("_block", "_own")


def _taps(name: str, radius: int, w, whole, border: str) -> Column:
    taps = []
    for d in range(-radius, radius + 1):
        c = F.col(name) if d == 0 else (F.lag(name, -d).over(w) if d < 0 else F.lead(name, d).over(w))
        if border == "replicate" and d:
            c = F.coalesce(c, (F.first(name) if d < 0 else F.last(name)).over(whole))
        taps.append(c)
    return F.array(*taps)


def stencil(grid: DataFrame, rx: int, ry: int, border: str = "replicate", keys: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """The neighbourhood of each cell as an array n, row by row: (2 ry + 1) * (2 rx + 1) values.

    border: "replicate" repeats the outermost cells, "null" leaves NULL outside. keys: further coordinates, such as z.
    """
    out = along(grid, "x", [*keys, "y"], rx, lambda w, whole: {"_n": _taps("v", rx, w, whole, border)}, block)
    if not ry:
        return out.withColumnRenamed("_n", "n")
    if border == "null":
        empty = F.array(*[F.lit(None).cast("double")] * (2 * rx + 1))
        make = lambda w, whole: {"n": F.flatten(F.transform(_taps("_n", ry, w, whole, border), lambda r: F.coalesce(r, empty)))}
    else:
        make = lambda w, whole: {"n": F.flatten(_taps("_n", ry, w, whole, border))}
    return along(out, "y", [*keys, "x"], ry, make, block).drop("_n")


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def array_sum(c: Column | str) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def weighted(n: Column | str, weights: list[float]) -> Column:
    """Sum of an array's elements times fixed weights."""
    c = F.col(n) if isinstance(n, str) else n
    return total([F.get(c, F.lit(i)) * F.lit(float(k)) for i, k in enumerate(weights) if k] or [F.lit(0.0)])
