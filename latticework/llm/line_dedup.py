"""Line dedup: explode, hash, count documents per hash, drop, reassemble by position. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import ascii_lower, hot_join, stored

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of docs, the text without its repeated lines, and n_lines, n_dropped (long; before names that clash).

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys of min_chars code points or more
    that stand in min_docs documents or more lose their lines in all documents but the one with the largest id.
    Documents are told apart by id: rows that repeat an id count once for a key, and all of them hold the kept line.
    A null text counts as one empty line and comes back as the empty text; a null id is a document that never wins.

    Keys travel as 128 bits of hash. Counts are combined before the shuffle; a key that stands in a large share of all
    documents is salted. Only hashes and positions are shuffled for them; whole texts once, by id.
    """
    extra = [c for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_dropped")]
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    key = lambda x: ascii_lower(F.btrim(x, F.lit(SPACE)))
    keyed = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("pos"), key(x).alias("key"))), lambda s: F.char_length(s["key"]) >= min_chars
    )
    long_lines = docs.select(F.col(id_col).alias("_id"), F.explode(keyed).alias("l")).select(
        "_id", F.col("l.pos").alias("_pos"), F.xxhash64("l.key").alias("_h1"), F.xxhash64(F.lit(7), F.col("l.key")).alias("_h2")
    )
    # one row for each document and key before keys are counted; both steps combine before they shuffle
    per_doc = long_lines.groupBy("_h1", "_h2", "_id").agg(F.count("*").alias("_rows"))
    counted = per_doc.groupBy("_h1", "_h2").agg(F.count("*").alias("_docs"), F.max("_id").alias("_keep"), F.sum("_rows").alias("_n"))
    repeated = stored(counted.filter(F.col("_docs") >= min_docs).select("_h1", "_h2", "_keep", "_n"), "repeated")
    found = hot_join(long_lines, repeated, ["_h1", "_h2"], "_id", "_n", "inner").filter(~F.col("_id").eqNullSafe(F.col("_keep")))
    dropped = found.groupBy("_id").agg(F.collect_set("_pos").alias("_drop"))
    whole = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_x_{c}") for c in extra])
    joined = whole.join(dropped, whole["_id"].eqNullSafe(dropped["_id"]), "left").drop(dropped["_id"])
    parts = F.split(F.coalesce(F.col("_text"), F.lit("")), "\n", -1)
    gone = F.coalesce(F.col("_drop"), F.array().cast("array<int>"))
    # the lines are bound once, outside the inner lambda; positions are subtracted as a set, which keeps their order
    kept = F.transform(
        F.array(parts),
        lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), gone), lambda p: F.get(ls, p)),
    )[0]
    joined = joined.withColumn("_n", F.size(parts)).withColumn("_kept", F.when(F.col("_drop").isNotNull(), kept))
    text = F.when(F.col("_drop").isNull(), F.coalesce(F.col("_text"), F.lit(""))).otherwise(F.array_join("_kept", "\n"))
    n_lines = F.col("_n").cast("long")
    n_dropped = F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.col("_n") - F.size("_kept")).cast("long")
    out = {id_col: F.col("_id"), text_col: text} | {c: F.col(f"_x_{c}") for c in extra}
    return joined.select(*[out[c].alias(c) for c in docs.columns if c in out], n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
