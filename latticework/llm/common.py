"""What the operators of this subpackage share: inputs, shared storage and skew-proof joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A key is hot if it carries more than one row in HOT_SHARE; there are at most HOT_SHARE such keys.
HOT_SHARE = 1000
SALTS = 64


#: Settings of the session for texts, which are longer than rows usually are: the size of what goes to Python at once. Small
#: batches come from pooled buffers; large ones are allocated anew and leave an executor's memory in pieces.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the registered queries. Where the session has no BATCHES of its own, it gets these."""
    given = spark.sparkContext.getConf()
    for key, value in BATCHES.items():
        if not given.contains(key):
            spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def crc_mod(c: Column, m: int) -> Column:
    """crc32 of the value as text, modulo m; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(m).cast("long"))


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share. Only where none is set (tests) a local one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        found = tempfile.mkdtemp(prefix="latticework-")
        spark.sparkContext.setCheckpointDir(found)
    path = f"{found.rstrip('/')}/latticework-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


#: What this process has written to shared folders.
_WRITTEN: list[str] = []


def sweep(spark: SparkSession) -> int:
    """Delete the intermediate tables of results that are no longer read; returns their number. Call it after results have
    been written: results that are still lazy read these tables."""
    gone = 0
    for path in _WRITTEN:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    _WRITTEN.clear()
    return gone


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a written table in the shared folder: lineage is cut and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Slim rows (a few numbers each) that may be broadcast instead of a shuffle: some 64 bytes each in memory, so 4 MB.
SMALL_ROWS = 65_536


def small(df: DataFrame) -> DataFrame:
    """A written table of slim rows, marked for a broadcast if its rows were counted and are few."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def hot_join(facts: DataFrame, dims: DataFrame, on: list[str], row_id: str, weight: str, how: str = "left", slim: bool = True) -> DataFrame:
    """Join many rows to one row a key where a key may hold a large share of all rows.

    dims is a written table with one row a key and in `weight` the number of rows of facts with it. Up to SMALL_ROWS slim
    rows of it are broadcast, which shuffles nothing. Beyond, the keys with more than one in HOT_SHARE of the rows, at most
    HOT_SHARE by arithmetic, are broadcast; rows with such a key are dealt over SALTS salts taken from row_id, rows with a
    null key over all partitions. The rest is a plain shuffled join.
    """
    n, total = dims.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    if slim and n <= SMALL_ROWS:
        return facts.join(F.broadcast(dims), on, how)
    limit = max(1.0, total / HOT_SHARE)
    hot = dims.filter(F.col(weight) > limit).select(*on).withColumn("_hot", F.lit(True))
    spread = F.xxhash64(F.col(row_id))
    some_null = F.lit(False)
    for k in on:
        some_null = some_null | F.col(k).isNull()
    salted = facts.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(spread, F.lit(SALTS))).when(some_null, spread).otherwise(F.lit(0)).cast("long")
    )
    keyed = dims.withColumn(
        "_salt",
        F.explode(F.when(F.col(weight) > limit, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))),
    )
    return salted.join(keyed, [*on, "_salt"], how).drop("_salt", "_hot")


#: Ids that may be broadcast to drop rows: 8 bytes each, so 16 MB.
BROADCAST_IDS = 2_000_000


def without(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is not among ids; rows with a null id stay. Ids are broadcast behind a check of their number."""
    ids = stored(ids.filter(F.col(id_col).isNotNull()), "ids")
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, id_col, "left_anti").select(*rows.columns)
