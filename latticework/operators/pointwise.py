"""Element-wise operators on grids, as column expressions. "Safe" forms treat NaN and infinite operands as stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.functions import ieee

AXES = ("z", "y", "x")


def zip_grids(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Cells of two grids of equal shape side by side; cells that only one has are left out, as the shorter grid decides."""
    on = [c for c in AXES if c in a.columns and c in b.columns]
    return a.withColumnRenamed("v", names[0]).join(b.withColumnRenamed("v", names[1]), on)


#: Of a grid and a grid.
BINARY: dict[str, object] = {
    "add": lambda a, b: a + b,
    "subtract": lambda a, b: a - b,
    "multiply": lambda a, b: a * b,
    "divide": ieee.div,
    # invalid operands count as 0 each by itself
    "add_safe": lambda a, b: ieee.valid_or(a) + ieee.valid_or(b),
    # the second minus the first: the order that users of this operator know
    "subtract_safe": lambda a, b: ieee.valid_or(b) - ieee.valid_or(a),
    # 0 if either is invalid
    "multiply_safe": lambda a, b: F.when(ieee.is_valid(a) & ieee.is_valid(b), a * b).otherwise(0.0),
    # 0 if either is 0 or invalid
    "divide_safe": lambda a, b: F.when(ieee.is_valid(a) & ieee.is_valid(b) & (a != 0) & (b != 0), ieee.div(a, b)).otherwise(0.0),
}

#: Of a grid and a number.
SCALAR: dict[str, object] = {
    "add": lambda v, c: v + F.lit(c),
    "subtract": lambda v, c: v - F.lit(c),
    "multiply": lambda v, c: v * F.lit(c),
    "divide": lambda v, c: ieee.div(v, F.lit(float(c))),
    "add_safe": lambda v, c: ieee.valid_or(v) + F.lit(c),
    "subtract_safe": lambda v, c: ieee.valid_or(v) - F.lit(c),
    "multiply_safe": lambda v, c: F.when(ieee.is_valid(v), v * F.lit(c)).otherwise(0.0),
    "divide_safe": lambda v, c: ieee.div(ieee.valid_or(v), F.lit(float(c))),
    "pow": lambda v, c: F.pow(v, F.lit(float(c))),
    "set_max": ieee.at_most,
    "set_min": ieee.at_least,
    "fill_invalid": lambda v, c: ieee.valid_or(v, c),
    "threshold": lambda v, c: F.when(~F.isnan(v) & (v > c), v).otherwise(0.0),
    "binarize": lambda v, c: F.when(~F.isnan(v) & (v >= c), 1.0).otherwise(0.0),
}

UNARY: dict[str, object] = {
    "abs": F.abs,
    "square": lambda v: v * v,
    "sqrt": F.sqrt,
    "log": ieee.log,
    "exp": F.exp,
    "remove_negative": lambda v: F.when(~F.isnan(v) & (v < 0), 0.0).otherwise(v),
}


def apply_binary(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    zipped = zip_grids(a, b)
    return zipped.select(*[c for c in AXES if c in zipped.columns], BINARY[op](F.col("a"), F.col("b")).alias("v"))


def apply_scalar(grid: DataFrame, op: str, c: float) -> DataFrame:
    return grid.withColumn("v", SCALAR[op](F.col("v"), c))


def apply_unary(grid: DataFrame, op: str) -> DataFrame:
    return grid.withColumn("v", UNARY[op](F.col("v")))


def fill(grid: DataFrame, c: float) -> DataFrame:
    return grid.withColumn("v", F.lit(float(c)))


def copy(a: DataFrame, b: DataFrame) -> DataFrame:
    """The cells of a with the values of b, as far as both reach."""
    return zip_grids(a, b).drop("a").withColumnRenamed("b", "v")


def horner(v: Column, coefficients: list[float]) -> Column:
    """A polynomial, the constant first: the form in which a water precorrection is applied."""
    out = F.lit(float(coefficients[-1]))
    for c in coefficients[-2::-1]:
        out = out * v + F.lit(float(c))
    return out


def hounsfield(v: Column, slope: float, intercept: float) -> Column:
    """A fitted line, cut off at -1024."""
    return F.greatest(v * slope + intercept, F.lit(-1024.0))


def attenuation_factor(v: Column, scale: float, least: float) -> Column:
    """v / scale, and 0 below least / scale."""
    return F.when(v / scale < least / scale, 0.0).otherwise(v / scale)


def truncate_extremes(v: Column, low: float, high: float) -> Column:
    """Clamped to a range; NaN becomes 0 first."""
    return F.least(F.greatest(F.when(F.isnan(v), 0.0).otherwise(v), F.lit(float(low))), F.lit(float(high)))


def replace_value(v: Column, old: float, new: float) -> Column:
    return F.when(v == old, F.lit(float(new))).otherwise(v)


def cosine_weight(u: Column, w: Column, distance: float) -> Column:
    """D / sqrt(D^2 + u^2 + w^2) at a pixel's distance (u, w) from the centre."""
    return F.lit(distance) / F.sqrt(F.lit(distance * distance) + u * u + w * w)


def lookup_gain(v: Column, table: dict[int, float], start: int, end: int) -> Column:
    """Values whose rounded value is in [start, end] and in the table are replaced; others pass."""
    keys = F.create_map(*[F.lit(x) for k in sorted(table) for x in (k, float(table[k]))])
    r = F.round(v).cast("int")
    return F.when(r.between(start, end), F.coalesce(F.try_element_at(keys, r), v)).otherwise(v)


# complex values are structs of re and im


def complex_of(re: Column | float, im: Column | float) -> Column:
    return F.struct((re if isinstance(re, Column) else F.lit(float(re))).alias("re"), (im if isinstance(im, Column) else F.lit(float(im))).alias("im"))


def complex_add(a: Column, b: Column) -> Column:
    return complex_of(a["re"] + b["re"], a["im"] + b["im"])


def complex_subtract(a: Column, b: Column) -> Column:
    return complex_of(a["re"] - b["re"], a["im"] - b["im"])


def complex_multiply(a: Column, b: Column) -> Column:
    return complex_of(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def complex_divide(a: Column, b: Column) -> Column:
    n = b["re"] * b["re"] + b["im"] * b["im"]
    return complex_of(ieee.div(a["re"] * b["re"] + a["im"] * b["im"], n), ieee.div(a["im"] * b["re"] - a["re"] * b["im"], n))


def complex_conjugate(a: Column) -> Column:
    return complex_of(a["re"], -a["im"])


def magnitude(a: Column) -> Column:
    return F.hypot(a["re"], a["im"])


def phase(a: Column) -> Column:
    return F.atan2(a["im"], a["re"])


def from_polar(r: Column, angle: Column) -> Column:
    return complex_of(r * F.cos(angle), r * F.sin(angle))
