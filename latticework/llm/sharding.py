"""Sharding by size-tiered compaction with a versioned manifest. DataFrame functions only; the driver handles metadata: the
names and sizes of files, which it lists for any scan."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 128 << 20
#: Rows of one small shard at arrival.
ARRIVAL_ROWS = 4096
#: Sizes within a factor of RATIO form a tier; FAN_IN shards of a tier are a run that is merged.
RATIO, FAN_IN = 4, 4
#: Bytes that one commit merges at most, so that a job that fails costs no more; one run is always taken.
MERGE_BYTES = 64 << 30
#: Rows of one part of a manifest.
MANIFEST_ROWS = 500_000

MANIFEST = "path string, rows long, bytes long, tier int, added long"


class CommitConflict(RuntimeError):
    """Another writer took the version, and the shards to replace are gone."""


class ShardStore:
    """Immutable shards of one table below a shared path, and a chain of manifests.

    data/<commit>/part-* holds rows, manifests/<commit> a manifest, versions/<number> names a manifest. A version comes
    into being by one rename that fails if the number is taken; readers see a version whole or not at all, and older
    versions stay readable until vacuum(). A writer that dies before the rename leaves files that no version names.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, ratio: int = RATIO, fan_in: int = FAN_IN, merge_bytes: int = MERGE_BYTES):
        self.spark, self.root, self.target, self.ratio, self.fan_in, self.most = spark, root.rstrip("/"), target_bytes, ratio, fan_in, merge_bytes
        self._fs = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self._files = self._fs.FileContext.getFileContext(self._fs.Path(self.root).toUri(), conf)
        self._system = self._fs.Path(self.root).getFileSystem(conf)
        for d in ("versions", "data", "manifests"):
            self._system.mkdirs(self._path(d))

    def _path(self, *parts: str):
        return self._fs.Path("/".join([self.root, *parts]))

    def version(self) -> int:
        """The last committed version, 0 before the first."""
        names = (f.getPath().getName() for f in self._system.listStatus(self._path("versions")))
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """path, rows, bytes, tier and the version that added it, for each shard of a version (the last by default)."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in map(str.split, MANIFEST.split(", "))])
        stream = self._system.open(self._path("versions", f"{version:012d}"))
        try:
            name = stream.readUTF()
        finally:
            stream.close()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{name}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the column _shard: the path of its file below the store (a column of that name is
        replaced). All other columns and their nulls are as they were appended.

        A version without rows gives an empty table, a store without versions none: that raises ValueError."""
        shards = [r["path"] for r in self.manifest(version).select("path").collect()]  # one short row for each file, as a scan lists anyway
        if not shards:
            raise ValueError("this version has no shard")
        # every commit writes the schema that the first one did
        rows = self.spark.read.parquet(*[f"{self.root}/{p}" for p in sorted(shards)])
        path = F.concat(F.lit("data/"), F.regexp_extract(F.col("_metadata.file_path"), r"/data/([^/]+/[^/]+)$", 1))
        return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "_shard"], path.alias("_shard"))

    def append(self, rows: DataFrame, shard_rows: int = ARRIVAL_ROWS) -> int:
        """Commit an arrival as small shards of at most shard_rows rows, each written by the task that read its rows: no
        shuffle. An empty arrival commits an empty version. Columns and their nulls are kept as they are."""
        name = self._name()
        rows.write.option("maxRecordsPerFile", shard_rows).option("compression", "zstd").parquet(f"{self.root}/data/{name}")
        return self._commit(name, [])

    def compact(self) -> int:
        """Merge runs until no tier holds one; returns the version, an old one if there was nothing to merge.

        A tier holds the shards below the target whose sizes are within a factor of `ratio`. A run is fan_in or more of them,
        the oldest first, of MERGE_BYTES at most; it is read and written as files of about the target size, one commit a run;
        the partitions of the scan are put together without a shuffle. Each merge leaves fewer shards, so this ends; shards
        of the target's size are never touched again, so a row is rewritten once a tier at most.
        """
        version = self.version()
        while run := self._run(version):
            name, size = self._name(), sum(b for _, b in run)
            merged = self.spark.read.parquet(*[f"{self.root}/{p}" for p, _ in run]).coalesce(max(1, math.ceil(size / self.target)))
            merged.write.option("compression", "zstd").parquet(f"{self.root}/data/{name}")
            version = self._commit(name, [p for p, _ in run])
        return version

    def vacuum(self) -> int:
        """Delete shards that the last version does not name; returns their number. Older versions are gone with them."""
        kept, gone = {r["path"] for r in self.manifest().select("path").collect()}, 0
        for commit in self._system.listStatus(self._path("data")):
            for f in self._system.listStatus(commit.getPath()):
                path = f"data/{commit.getPath().getName()}/{f.getPath().getName()}"
                if path.endswith(".parquet") and path not in kept:
                    gone += bool(self._system.delete(f.getPath(), False))
        return gone

    def _run(self, version: int) -> list[tuple[str, int]]:
        """The paths and sizes of a run, the oldest of the lowest tier that has one; empty if there is none."""
        small = self.manifest(version).filter(F.col("bytes") < self.target)
        tiers = small.groupBy("tier").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).filter(F.col("n") >= self.fan_in).orderBy("tier").collect()
        for tier, n, size in tiers:  # a few dozen: tiers are powers of the ratio
            if math.ceil(size / self.target) >= n:  # a merge must leave fewer shards
                continue
            run, total = [], 0
            for r in small.filter(F.col("tier") == tier).orderBy("added", "path").select("path", "bytes").toLocalIterator():
                if len(run) >= self.fan_in and total + r["bytes"] > self.most:
                    break
                run.append((r["path"], r["bytes"]))
                total += r["bytes"]
            if math.ceil(total / self.target) < len(run):
                return run
        return []

    def _name(self) -> str:
        return uuid.uuid4().hex

    def _added(self, name: str) -> DataFrame:
        """path, rows, bytes and tier of the files of a commit: sizes from their listing, rows from their footers."""
        path = lambda c: F.concat(F.lit(f"data/{name}/"), F.regexp_extract(c, "([^/]+)$", 1)).alias("path")
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.root}/data/{name}").select(path("path"), F.col("length").alias("bytes"))
        counted = self.spark.read.parquet(f"{self.root}/data/{name}").select(path("_metadata.file_path")).groupBy("path").agg(F.count("*").alias("rows"))
        tier = F.floor(F.log(F.greatest("bytes", F.lit(1)).cast("double")) / math.log(self.ratio)).cast("int")
        return files.join(counted, "path", "left").select("path", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "bytes", tier.alias("tier"))

    def _listed(self, paths: list[str]) -> DataFrame:
        """Paths as a table: a text file that Spark reads."""
        file = self._path("manifests", f"removed-{self._name()}.txt")
        stream = self._system.create(file, False)
        stream.write("\n".join(paths).encode())
        stream.close()
        return self.spark.read.schema("path string").text(f"{self.root}/manifests/{file.getName()}")

    def _commit(self, name: str, removed: list[str]) -> int:
        added, out = self._added(name), self._listed(sorted(removed)) if removed else None
        while True:
            base = self.version()
            old = self.manifest(base)
            if removed:
                if old.join(out, "path", "left_semi").count() != len(removed):
                    raise CommitConflict(f"version {base} no longer has all shards that this merge replaces")
                old = old.join(out, "path", "left_anti")
            manifest = self._name()
            rows = old.unionByName(added.withColumn("added", F.lit(base + 1).cast("long")))
            rows.coalesce(1 + rows.count() // MANIFEST_ROWS).write.parquet(f"{self.root}/manifests/{manifest}")
            ready = self._path("versions", f"_{manifest}")
            stream = self._system.create(ready, False)
            stream.writeUTF(manifest)
            stream.close()
            options = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
            try:
                self._files.rename(ready, self._path("versions", f"{base + 1:012d}"), options)
                return base + 1
            except Exception as e:
                if "FileAlreadyExists" not in str(e):
                    raise
                self._system.delete(ready, False)  # another writer was first: build on its version
