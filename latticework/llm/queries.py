"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.bpe import encode_decode
from latticework.llm.common import crc_mod, shared_dir, table
from latticework.llm.decontaminate import find_leaks
from latticework.llm.exact_dedup import exact_dedup
from latticework.llm.langid import fit_languages, identify
from latticework.llm.line_dedup import line_dedup
from latticework.llm.lm_score import score_documents
from latticework.llm.quality import fit_quality, score_quality
from latticework.llm.secrets import scan_secrets
from latticework.llm.sharding import ShardStore
from latticework.llm.simhash import simhash_dedup


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup(docs, carry={"text_sha256": F.sha2(F.coalesce("text", F.lit("")), 256)})


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "flow")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex", "flow")], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def op4_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    def digest(keys: list, ids: list, raw: list[bytes]) -> pa.RecordBatch:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(keys, pa.int64()),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": [sha(" ".join(map(str, x.tolist())).encode()) for x in ids],
                "decoded_sha256": [sha(x) for x in raw],
            }
        )

    return encode_decode(
        table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        then=digest, schema="doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = fit_quality(docs, labels, crc_mod(F.col("doc_id"), 3) != 1)
    out = score_quality(docs, net, keep=["doc_id"])
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents: one row for each document and benchmark item that it leaks."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents appended as small shards and compacted; one row per document, read back from the last version: its shard's
    path, and the size and digest of its text (both null for a null text)."""
    store = ShardStore(spark, shared_dir(spark))
    store.append(table(spark, sf_dir, "documents"))
    version = store.compact()
    return store.read(version).select(
        "doc_id", F.col("_shard").alias("shard"), F.lit(version).cast("long").alias("version"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256")
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs, crc_mod(F.col("doc_id"), 5) != 0)
    out = identify(docs, model)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_lm_score, op3_secret_scan, op4_bpe, op5_quality, op6_line_dedup, op7_decontaminate, op8_sharding, op9_language_id, op10_simhash_dedup,
)}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op6_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          unnest(generate_series(1, len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
             k AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM l),
             r AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
             m AS (SELECT k.*, r.keep IS NOT NULL AND r.keep <> doc_id AS dropped FROM k LEFT JOIN r USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
}
