"""Arithmetic of IEEE numbers on columns: what ANSI mode rejects or turns to NULL gives Inf and NaN here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def nan() -> Column:
    return F.lit(float("nan"))


def inf() -> Column:
    return F.lit(float("inf"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_valid(c: Column | str) -> Column:
    """Neither NaN nor infinite; NULL is not valid."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < inf())


def valid_or(c: Column | str, other: float = 0.0) -> Column:
    return F.when(is_valid(c), col(c)).otherwise(F.lit(other))


def div(a: Column | str, b: Column | str) -> Column:
    """a / b with x/0 = +-Inf and 0/0 = NaN; the sign of a zero divisor is ignored."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b == 0, F.when((a == 0) | F.isnan(a), nan()).when(a > 0, inf()).otherwise(-inf())).otherwise(a / b)


def log(c: Column | str) -> Column:
    """Natural logarithm with log 0 = -Inf and NaN below."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (c < 0), nan()).when(c == 0, -inf()).otherwise(F.log(c))


def at_most(c: Column | str, top: float) -> Column:
    """The smaller of both; NaN stays NaN."""
    return F.when(~F.isnan(col(c)) & (col(c) > top), F.lit(float(top))).otherwise(col(c))


def at_least(c: Column | str, floor: float) -> Column:
    return F.when(~F.isnan(col(c)) & (col(c) < floor), F.lit(float(floor))).otherwise(col(c))
