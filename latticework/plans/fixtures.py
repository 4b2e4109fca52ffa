"""Grids read from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Width of the embeddings' rows, and the day at which the series of orders begins.
WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, v): every embedding is a row."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v")).withColumn("v", F.col("v").cast("double"))


def grid_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid_a with its rows reversed."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("y"), F.posexplode(F.reverse("embedding")).alias("x", "v")).withColumn("v", F.col("v").cast("double"))


def grid_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grid_a with invalid values sprinkled in."""
    i = F.col("y") * WIDTH + F.col("x")
    inf = float("inf")
    v = F.when(i % 17 == 0, float("nan")).when(i % 19 == 0, inf).when(i % 23 == 0, -inf).otherwise(F.col("v"))
    return grid_a(spark, sf_dir).withColumn("v", v)


def roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, m): 1 for rows of even labels, else 0."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.when(F.col("label") % 2 == 0, 1.0).otherwise(0.0).alias("m"))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, y, x, v): ten slices, dealt out row by row."""
    return grid_a(spark, sf_dir).select((F.col("y") % 10).alias("z"), F.floor(F.col("y") / 10).alias("y"), "x", "v")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), "label")


def r6(c: Column | str) -> Column:
    """Rounded to six digits, without a negative zero."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6) + F.lit(0.0)


A = "a AS (SELECT vec_id AS y, CAST(x AS BIGINT) AS x, CAST(embedding[x + 1] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS x FROM embeddings))"
B = "b AS (SELECT y, 63 - x AS x, v FROM a)"
DIRTY = (
    "d AS (SELECT y, x, CASE WHEN (y * 64 + x) % 17 = 0 THEN 'nan'::DOUBLE WHEN (y * 64 + x) % 19 = 0 THEN 'inf'::DOUBLE "
    "WHEN (y * 64 + x) % 23 = 0 THEN '-inf'::DOUBLE ELSE v END AS v FROM a)"
)
VALID = "(NOT isnan({0}) AND NOT isinf({0}))"
VOLUME = "vol AS (SELECT y % 10 AS z, y // 10 AS y, x, v FROM a)"
ROI = "roi AS (SELECT vec_id AS y, CASE WHEN label % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS m FROM embeddings)"


def near(rx: int, ry: int, source: str = "a", name: str = "nb") -> str:
    """Neighbours with replicated borders: y, x, v, dy, dx and the neighbour's value n."""
    return (
        f"size_{name} AS (SELECT max(y) AS my, max(x) AS mx FROM {source}), "
        f"off_{name} AS (SELECT dy, dx FROM (SELECT unnest(range({-ry}, {ry} + 1)) AS dy), (SELECT unnest(range({-rx}, {rx} + 1)) AS dx)), "
        f"{name} AS (SELECT c.y, c.x, c.v, o.dy, o.dx, n.v AS n FROM (SELECT s.y, s.x, s.v, dy, dx, "
        f"least(greatest(s.y + dy, 0), my) AS ny, least(greatest(s.x + dx, 0), mx) AS nx FROM {source} s, off_{name}, size_{name}) c "
        f"JOIN off_{name} o ON o.dy = c.dy AND o.dx = c.dx JOIN {source} n ON n.y = c.ny AND n.x = c.nx)"
    )


def r6_sql(c: str) -> str:
    return f"round(CAST({c} AS DOUBLE), 6) + 0.0"
