"""Queries over streams' batch forms, text sources and expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.functions.expressions import parse
from latticework.plans.fixtures import A, grid_a, r6, r6_sql, table
from latticework.plans.registry import Registry
from latticework.sources import text
from latticework.streaming import pipeline

q = Registry()


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in names], *[r6(c).alias(c) for c in names])


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame) -> DataFrame:
    return rounded(df.withColumns({c: F.unix_micros(c) for c in ("start", "end")}), "total")


@q(
    f"""SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS "start", epoch_us(time_bucket(INTERVAL '1 hour', ts)) + 3600000000 AS "end", event_type, count(*) AS n, {r6_sql('sum(value)')} AS total
    FROM events GROUP BY 1, 2, 3"""
)
def event_tumbling(spark, sf_dir):
    return _plain(pipeline.tumbling(_events(spark, sf_dir), "ts", "1 hour", ["event_type"], "value"))


@q(
    f"""WITH e AS (SELECT epoch_us(ts) AS t, event_type, value FROM events), w AS (SELECT t // 1800000000 * 1800000000 - k * 1800000000 AS s, event_type, value FROM e, (VALUES (0), (1)) v(k))
    SELECT s AS "start", s + 3600000000 AS "end", event_type, count(*) AS n, {r6_sql('sum(value)')} AS total FROM w GROUP BY 1, 2, 3"""
)
def event_sliding(spark, sf_dir):
    return _plain(pipeline.sliding(_events(spark, sf_dir), "ts", "1 hour", "30 minutes", ["event_type"], "value"))


@q(
    f"""WITH e AS (SELECT epoch_us(ts) AS t, user_id, value, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p >= 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS k FROM e)
    SELECT min(t) AS "start", max(t) + 7200000000 AS "end", user_id, count(*) AS n, {r6_sql('sum(value)')} AS total FROM s GROUP BY user_id, k"""
)
def event_session(spark, sf_dir):
    return _plain(pipeline.sessions(_events(spark, sf_dir), "ts", "2 hours", ["user_id"], "value"))


@q(
    f"""WITH e AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events)
    SELECT user_id, event_type, event_id, {r6_sql('value')} AS value FROM e WHERE n = 1"""
)
def ordered_dedupe(spark, sf_dir):
    slim = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return rounded(pipeline.last_write_wins(slim, ["user_id", "event_type"], "event_id"), "value")


@q(
    f"""WITH w AS (SELECT event_id, user_id, avg(value) OVER c AS m, count(*) OVER c AS n FROM events WINDOW c AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING))
    SELECT event_id, user_id, {r6_sql('m')} AS m FROM w WHERE n = 4"""
)
def slice_context(spark, sf_dir):
    out = pipeline.with_context(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "event_id", "value", 1, 2, ["user_id"])
    mean = F.aggregate("context", F.lit(0.0), lambda a, v: a + v) / F.size("context")
    return rounded(out.select("event_id", "user_id", mean.alias("m")), "m")


@q(f"WITH {A} SELECT y, x, {r6_sql('greatest(-(v * v) + 0, 0)')} AS v FROM a")
def tool_chain(spark, sf_dir):
    return rounded(pipeline.chain(grid_a(spark, sf_dir), [pipeline.TOOLS[n] for n in ("abs", "square", "negate", "floor_at_zero")]), "v")


@q(f"SELECT user_id, {r6_sql('sum(value)')} AS v FROM events GROUP BY user_id")
def online_sum(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("y"), F.lit(0).alias("x"), F.col("value").alias("v"))
    return rounded(pipeline.online_back_projection(e).select(F.col("y").alias("user_id"), "v"), "v")


@q(f"WITH {A} SELECT y, x, {r6_sql('2 * v - x / 4.0 + sin(v) * sqrt(x + 1.5e0)')} AS left_first, {r6_sql('2 * v - (x / 4.0 + sin(v) * sqrt(x + 1.5e0))')} AS right_first FROM a")
def math_expression(spark, sf_dir):
    source = "2*v - x/4 + SIN(v)*sqrt(x+1.5e0)"
    out = grid_a(spark, sf_dir).select("y", "x", parse(source).alias("left_first"), parse(source, legacy=True).alias("right_first"))
    return rounded(out, "left_first", "right_first")


@q("SELECT p_partkey, p_brand AS name, 'E' || p_size AS symbol, p_size AS z, CAST(p_size AS DOUBLE) * 2 AS a, 1.5::DOUBLE AS density FROM part")
def material_table(spark, sf_dir):
    """Material lines as text tables hold them, parsed."""
    p = table(spark, sf_dir, "part")
    line = F.concat(F.col("p_brand"), F.lit(": S=E"), F.col("p_size"), F.lit("; Z="), F.col("p_size"), F.lit("; A="), F.col("p_size").cast("double") * 2, F.lit("; D=1.5"))
    return p.select("p_partkey", text.parse_material(line).alias("m")).select("p_partkey", "m.*")


@q("SELECT * FROM (VALUES ('H', 0.111::DOUBLE), ('O', 0.889::DOUBLE)) t(element, weight)")
def mixture_table(spark, sf_dir):
    df = spark.createDataFrame([("water 1.0 H[0.111] O[0.889]",)], "l string")
    return df.select(F.explode(text.parse_mixture(F.col("l"))).alias("m")).select("m.*")
