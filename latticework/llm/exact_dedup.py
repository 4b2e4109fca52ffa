"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import hot_join, stored

#: Candidate (length, prefix hash) groups that may be broadcast: 16 bytes each, so 32 MB at most.
BROADCAST_GROUPS = 2_000_000
PREFIX_CHARS = 64


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_GROUPS else df


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, and the columns of `carry` computed from the row.

    Refinement: byte lengths that occur once leave first; of the rest, (length, hash of the first PREFIX_CHARS
    characters) that occur once leave; only for the survivors the whole text is hashed (SHA-256). Of equal texts the
    row with the largest id stays. A null text counts as empty. A null id never wins against another id; a group of
    null ids only keeps them all (keep_id null). Rows that repeat id and text both stay and both count. Other columns
    of the input are ignored, so their names cannot clash. An empty input gives an empty result.

    Candidate lengths and groups are broadcast behind a check of their number, and no text enters a shuffle. Beyond it the
    same joins are shuffled, hot groups salted; rows then carry their texts to the group, and still only those of surviving
    groups are hashed.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("_id"), text.alias("_text"), *[c.alias(f"_carry_{k}") for k, c in (carry or {}).items()]
    ).withColumn("_len", F.octet_length("_text").cast("long"))
    lengths = stored(base.groupBy("_len").agg(F.count("*").alias("_n")).filter("_n > 1").select("_len"), "lengths")
    n_lengths = lengths.count()
    prefix = F.xxhash64(F.substring("_text", 1, PREFIX_CHARS))
    slim = base.select("_len", prefix.alias("_prefix")).join(_sized(lengths, n_lengths), "_len", "left_semi")
    groups = stored(slim.groupBy("_len", "_prefix").agg(F.count("*").alias("_rows")).filter("_rows > 1"), "prefixes")
    rows, groups = base.withColumn("_prefix", prefix), groups.withColumn("_candidate", F.lit(True))
    if groups.count() <= BROADCAST_GROUPS:
        rows = rows.join(F.broadcast(groups.drop("_rows")), ["_len", "_prefix"], "left")
    else:
        rows = hot_join(rows, groups, ["_len", "_prefix"], "_id", "_rows", slim=False)
    rows = rows.withColumn("_full", F.when(F.col("_candidate"), F.sha2("_text", 256))).drop("_text", "_prefix", "_candidate", "_rows")
    equal = stored(
        rows.filter("_full is not null").groupBy("_len", "_full").agg(F.max("_id").alias("_keep"), F.count("*").alias("_n")).filter("_n > 1"), "equal"
    )
    out = hot_join(rows, equal, ["_len", "_full"], "_id", "_n")
    return out.select(
        F.col("_id").alias(id_col),
        F.coalesce("_keep", "_id").alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.coalesce("_keep", "_id")).alias("kept"),
        *[F.col(f"_carry_{k}").alias(k) for k in carry or {}],
    )
