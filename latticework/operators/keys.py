"""Joins that no hot key can slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hand_back(rows: DataFrame, answers: DataFrame, on: str) -> DataFrame:
    """rows with the answers (on, _n, ...) to their keys. Keys of more than a thousandth of all rows, fewer than a thousand,
    are broadcast; their rows, and those without a key, are dealt over the tasks of the join of the others."""
    got = [c for c in answers.columns if c not in (on, "_n")]
    heavy = answers.crossJoin(F.broadcast(answers.agg(F.sum("_n").alias("_all")))).filter(F.col("_n") * 1000 > F.col("_all"))
    heavy = heavy.select(on, F.lit(True).alias("_heavy"), *[F.col(c).alias(f"_heavy{i}") for i, c in enumerate(got)])
    dealt = rows.join(F.broadcast(heavy), on, "left")
    dealt = dealt.withColumn("_salt", F.when(F.col("_heavy") | F.col(on).isNull(), 1 + F.monotonically_increasing_id() % 4096).otherwise(F.lit(0).cast("long")))
    out = dealt.join(answers.drop("_n").withColumn("_salt", F.lit(0).cast("long")), [on, "_salt"], "left")
    return out.select(*rows.columns, *[F.coalesce(c, f"_heavy{i}").alias(c) for i, c in enumerate(got)])
