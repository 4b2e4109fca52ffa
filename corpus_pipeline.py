"""From documents to token ids: quality, repeated lines, near-duplicates, benchmark leaks, byte-level BPE."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.bpe import encode_decode
from latticework.llm.common import crc_mod, stored, table, without
from latticework.llm.decontaminate import find_leaks
from latticework.llm.line_dedup import line_dedup
from latticework.llm.quality import fit_quality, score_quality
from latticework.llm.near import near_duplicates as near_groups

#: Pre-tokens that a worker remembers: fewer than the codec by itself, beside what four stages have left in an executor.
MEMORY = 100_000
#: SQL can express neither the classifier nor the latent space nor the merges.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts, a score of 0.5 or more."""
    net = fit_quality(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    score = "quality" + "_" * max(map(len, docs.columns))  # no column of docs has this name
    return score_quality(docs, net, name=score).filter(F.col(score) >= 0.5).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their repeated lines; n_chars follows."""
    return line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, similar to 0.8 on shingles of five words, the document with the smallest id."""
    dropped = near_groups(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return without(docs, dropped, "doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item and no paraphrase of one."""
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return without(docs, leaks, "doc_id")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests of the ids and of the bytes that they decode to."""

    def rows(keys: list, ids: list, raw: list[bytes]) -> pa.RecordBatch:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(keys, pa.int64()),
                "ids": pa.array(ids, pa.list_(pa.int32())),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": [sha(" ".join(map(str, x.tolist())).encode()) for x in ids],
                "decoded_sha256": [sha(x) for x in raw],
            }
        )

    return encode_decode(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        then=rows, schema="doc_id long, ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string", memory=MEMORY,
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
