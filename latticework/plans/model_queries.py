"""Queries for interpolation, linear algebra, reconstruction, physics, geometry, graphs and features."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators import features, geometry, graph, grids, interp, linalg, neighbors, phantom, physics, pointwise, recon, spectral
from latticework.plans.fixtures import A, B, VOLUME, WIDTH, grid_a, grid_b, r6, r6_sql, table, volume
from latticework.plans.registry import Registry

q = Registry()


def rounded(df: DataFrame, *values: str) -> DataFrame:
    names = values or ("v",)
    return df.select(*[c for c in df.columns if c not in names], *[r6(c).alias(c) for c in names])


def points3(spark, sf_dir) -> DataFrame:
    """(id, x, y, z, a, b, c): six parts of every embedding."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 100
    return e.select(F.col("vec_id").alias("id"), "label", *[at(i).alias(n) for i, n in enumerate(("x", "y", "z", "a", "b", "c"))])


P3 = "p3 AS (SELECT vec_id AS id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * 100 AS {n}" for i, n in enumerate(("x", "y", "z", "a", "b", "c"))) + " FROM embeddings)"

# interpolation

_SHIFT = "pt AS (SELECT y, x, y + 0.25 AS py, x * 0.9 + 3.5 AS px FROM a)"
_BILINEAR = """c AS (SELECT y, x, floor(py) + dy AS gy, floor(px) + dx AS gx, (CASE dy WHEN 1 THEN py - floor(py) ELSE 1 - py + floor(py) END) * (CASE dx WHEN 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) AS w
    FROM {src}, (VALUES (0), (1)) t1(dy), (VALUES (0), (1)) t2(dx))"""


def _moved(spark, sf_dir) -> DataFrame:
    return grid_a(spark, sf_dir).select(F.col("y").alias("_i"), F.col("x").alias("_j"), (F.col("y") + 0.25).alias("y"), (F.col("x") * 0.9 + 3.5).alias("x"))


@q(f"WITH {A}, {_SHIFT}, {_BILINEAR.format(src='pt')} SELECT c.y, c.x, {r6_sql('sum(w * coalesce(a.v, 0))')} AS v FROM c LEFT JOIN a ON a.y = gy AND a.x = gx GROUP BY c.y, c.x")
def interp2d_zero(spark, sf_dir):
    out = interp.sample_linear(grid_a(spark, sf_dir), _moved(spark, sf_dir), ["_i", "_j"])
    return rounded(out.withColumnsRenamed({"_i": "y", "_j": "x"}))


@q(
    f"WITH {A}, {_SHIFT}, cl AS (SELECT y, x, least(greatest(py, 0), (SELECT max(y) FROM a)) AS py, least(greatest(px, 0), 63) AS px FROM pt), {_BILINEAR.format(src='cl')} "
    f"SELECT c.y, c.x, {r6_sql('sum(w * coalesce(a.v, 0))')} AS v FROM c LEFT JOIN a ON a.y = gy AND a.x = gx WHERE w > 0 GROUP BY c.y, c.x"
)
def interp2d_replicate(spark, sf_dir):
    g = grid_a(spark, sf_dir)
    out = interp.sample_linear(g, _moved(spark, sf_dir), ["_i", "_j"], "replicate", {"y": g.agg(F.max("y")).first()[0] + 1, "x": WIDTH})
    return rounded(out.withColumnsRenamed({"_i": "y", "_j": "x"}))


@q(
    f"WITH {A}, pt AS (SELECT y * 0.5 AS py, x * 0.75 AS px, v FROM a), c AS (SELECT floor(py) + dy AS y, floor(px) + dx AS x, v, "
    "(CASE dy WHEN 1 THEN py - floor(py) ELSE 1 - py + floor(py) END) * (CASE dx WHEN 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) AS w FROM pt, (VALUES (0), (1)) t1(dy), (VALUES (0), (1)) t2(dx)) "
    f"SELECT CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, {r6_sql('sum(w * v)')} AS v FROM c WHERE w > 0 GROUP BY y, x"
)
def scatter2d(spark, sf_dir):
    return rounded(interp.scatter_linear(grid_a(spark, sf_dir).select((F.col("y") * 0.5).alias("y"), (F.col("x") * 0.75).alias("x"), "v")))


@q(
    f"WITH {A}, pt AS (SELECT y, x, 0.1 * x + 0.9 * y + 2.0 AS py, 0.8 * x - 0.05 * y + 1.5 AS px FROM a), {_BILINEAR.format(src='pt')} "
    f"SELECT c.y, c.x, {r6_sql('sum(w * coalesce(a.v, 0))')} AS v FROM c LEFT JOIN a ON a.y = gy AND a.x = gx GROUP BY c.y, c.x"
)
def grid_warp(spark, sf_dir):
    g = grid_a(spark, sf_dir)
    return rounded(interp.warp(g, (g.agg(F.max("y")).first()[0] + 1, WIDTH), [[0.8, -0.05], [0.1, 0.9]], [1.5, 2.0]))


_LUT = "lut AS (SELECT CAST(p_size AS DOUBLE) AS k, avg(p_retailprice) AS val FROM part GROUP BY p_size)"
_LUTQ = """q AS (SELECT DISTINCT round(l_quantity * 0.97 + 1.1, 3) AS k FROM lineitem), br AS (SELECT q.k, (SELECT max(k) FROM lut WHERE lut.k <= q.k) AS k0, (SELECT min(k) FROM lut WHERE lut.k >= q.k) AS k1 FROM q),
    bv AS (SELECT br.*, l0.val AS v0, l1.val AS v1 FROM br LEFT JOIN lut l0 ON l0.k = k0 LEFT JOIN lut l1 ON l1.k = k1)"""


def _lut(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    knots = table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("k")).agg(F.avg("p_retailprice").alias("val"))
    return table(spark, sf_dir, "lineitem").select(F.round(F.col("l_quantity") * 0.97 + 1.1, 3).alias("k")).distinct(), knots


@q(f"WITH {_LUT}, {_LUTQ} SELECT k, {r6_sql('CASE WHEN k0 = k1 THEN v0 ELSE v0 + (v1 - v0) * (k - k0) / (k1 - k0) END')} AS val FROM bv")
def lookup_linear(spark, sf_dir):
    return rounded(interp.lookup(*_lut(spark, sf_dir), "k", "val"), "val")


@q(f"WITH {_LUT}, {_LUTQ} SELECT k, {r6_sql('exp(CASE WHEN k0 = k1 THEN ln(v0) ELSE ln(v0) + (ln(v1) - ln(v0)) * (ln(k) - ln(k0)) / (ln(k1) - ln(k0)) END)')} AS val FROM bv")
def lookup_log_log(spark, sf_dir):
    return rounded(interp.lookup(*_lut(spark, sf_dir), "k", "val", "log_log"), "val")


@q(
    "WITH e AS (SELECT event_id, ts, user_id FROM events), o AS (SELECT CAST(o_orderdate + INTERVAL 7 YEAR AS TIMESTAMP) AS ts, max(o_orderkey) AS k FROM orders GROUP BY 1) "
    "SELECT event_id, k FROM e ASOF LEFT JOIN o ON e.ts >= o.ts"
)
def asof_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    orders = table(spark, sf_dir, "orders").select(F.expr("o_orderdate + INTERVAL 7 YEAR").alias("ts"), F.col("o_orderkey").alias("k")).groupBy("ts").agg(F.max("k").alias("k"))
    month = lambda: F.year("ts") * 12 + F.month("ts")
    return interp.asof_join(events, orders, "ts", "k", month()).select("event_id", "k")


@q(f"WITH {A} SELECT y, min(x) AS closest FROM (SELECT y, x, abs(v - 0.05) AS d, min(abs(v - 0.05)) OVER (PARTITION BY y) AS m FROM a) WHERE d = m GROUP BY y")
def nearest_index(spark, sf_dir):
    return interp.closest_index(grid_a(spark, sf_dir), F.lit(0.05), "x", "v", ["y"]).withColumn("closest", F.col("closest").cast("long"))


_TAB = [[0.0, 1.0, 4.0], [2.0, 3.0, 8.0], [5.0, 7.0, 6.0]]


@q(
    f"WITH {A}, tab(r, c, t) AS (VALUES " + ", ".join(f"({r}, {c}, {v!r}::DOUBLE)" for r, row in enumerate(_TAB) for c, v in enumerate(row)) + "), "
    "pt AS (SELECT y, x, least(greatest(y / 100.0, 0), 2) AS py, least(greatest(x / 30.0, 0), 2) AS px FROM a), "
    "k AS (SELECT y, x, py, px, least(floor(py), 1) AS r0, least(floor(px), 1) AS c0 FROM pt) "
    f"SELECT y, x, {r6_sql('sum(t * (CASE WHEN r = r0 THEN 1 - (py - r0) ELSE py - r0 END) * (CASE WHEN c = c0 THEN 1 - (px - c0) ELSE px - c0 END))')} AS v "
    "FROM k JOIN tab ON r IN (r0, r0 + 1) AND c IN (c0, c0 + 1) GROUP BY y, x"
)
def bilinear_table(spark, sf_dir):
    return rounded(grid_a(spark, sf_dir).select("y", "x", interp.bilinear_table(F.col("x") / 30.0, F.col("y") / 100.0, _TAB).alias("v")))


@q(f"WITH {A} SELECT y, (x + 32) % 64 AS x, {r6_sql('v')} AS v FROM a")
def fft_shift(spark, sf_dir):
    return rounded(grid_a(spark, sf_dir).withColumn("x", interp.fft_shift(F.col("x"), WIDTH)))


@q("SELECT p_partkey, CAST(CASE WHEN p_size <= 1 THEN 1 ELSE pow(2, ceil(log2(p_size))) END AS BIGINT) AS n FROM part")
def next_power_of_two(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", interp.next_power_of_two(F.col("p_size")).alias("n"))


_W = f"{2 * math.pi!r} / 63 * x"


@q(
    f"""WITH {A} SELECT y, x, {r6_sql(f'v * (0.5 - 0.5 * cos({_W}))')} AS hann, {r6_sql(f'v * (0.54 - 0.46 * cos({_W}))')} AS hamming,
    {r6_sql(f'v * (0.42 - 0.5 * cos({_W}) + 0.08 * cos(2 * {_W}))')} AS blackman,
    {r6_sql(f'v * (0.35875 - 0.48829 * cos({_W}) + 0.14128 * cos(2 * {_W}) - 0.001168 * cos(3 * {_W}))')} AS blackman_harris, {r6_sql('v * (1 - pow((x - 31.5) / 31.5, 2))')} AS welch FROM a"""
)
def apodization(spark, sf_dir):
    kinds = ("hann", "hamming", "blackman", "blackman_harris", "welch")
    out = grid_a(spark, sf_dir).select("y", "x", *[(F.col("v") * interp.apodization(k, F.col("x"), WIDTH)).alias(k) for k in kinds])
    return rounded(out, *kinds)


_PHASE = "((epoch_us(ts) % 86400000000) / 86400000000.0)"


def _phases(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "ts", (F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(86_400_000_000)) / 86_400_000_000.0).alias("phase"))


_LO, _HI = 1 / (1 + math.exp(5)), 1 / (1 + math.exp(-5))


@q(
    f"""WITH p AS (SELECT event_id, {_PHASE} AS t FROM events) SELECT event_id, {r6_sql(f'(1 / (1 + exp(-10 * (t - 0.5))) - {_LO!r}) / {_HI - _LO!r}')} AS sigmoid,
    {r6_sql(f'0.5 - 0.5 * cos({4 * math.pi!r} * t)')} AS cosine, {r6_sql('(2 * t) % 1')} AS harmonic, {r6_sql('CASE WHEN (2 * t) % 1 < 0.3 THEN 0 ELSE ((2 * t) % 1 - 0.3) / 0.7 END')} AS rest,
    {r6_sql('CASE WHEN (2 * t) % 1 < 0.3 THEN 0.5 * ((2 * t) % 1) / 0.3 ELSE 0.5 + 0.5 * ((2 * t) % 1 - 0.3) / 0.7 END')} AS dual_phase, {r6_sql('t')} AS identity FROM p"""
)
def time_warps(spark, sf_dir):
    kinds = ("sigmoid", "cosine", "harmonic", "rest", "dual_phase", "identity")
    cycles = lambda k: 2.0 if k != "sigmoid" else 1.0
    out = _phases(spark, sf_dir).select("event_id", *[interp.warp_time(k, F.col("phase"), cycles(k)).alias(k) for k in kinds])
    return rounded(out, *kinds)


_DIST = "least(abs(t - 0.75), abs(t - 0.75 + 1), abs(t - 0.75 - 1))"


@q(f"WITH p AS (SELECT event_id, {_PHASE} AS t FROM events) SELECT event_id, {r6_sql(f'CASE WHEN {_DIST} >= 0.2 THEN 0 ELSE pow(cos({_DIST} / 0.4 * {math.pi!r}), 4) END')} AS w FROM p")
def gating_weights(spark, sf_dir):
    out = _phases(spark, sf_dir).select("event_id", interp.gating_weight(F.col("phase"), 0.75, 0.4, 4.0).alias("w"))
    return rounded(out, "w")


@q(
    f"""WITH p AS (SELECT user_id, event_id, abs({_PHASE} - 0.5) AS d FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d, event_id) AS n FROM p)
    SELECT user_id, event_id, {r6_sql('d')} AS distance FROM r WHERE n = 1 AND d < 0.05"""
)
def one_per_cycle(spark, sf_dir):
    return rounded(interp.one_per_cycle(_phases(spark, sf_dir), "user_id", "phase", "event_id", 0.5), "distance")


# linear algebra


def _labels(spark, sf_dir) -> DataFrame:
    """(i, j, v): labels by positions, the mean of the embeddings."""
    e = grid_a(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), "label"), "y")
    return e.groupBy(F.col("label").alias("i"), F.col("x").alias("j")).agg(F.avg("v").alias("v"))


_M = f"{A}, m AS (SELECT label AS i, x AS j, avg(v) AS v FROM a JOIN (SELECT vec_id AS y, label FROM embeddings) USING (y) GROUP BY label, x)"


@q(f"WITH {_M} SELECT p.i, r.i AS j, {r6_sql('sum(p.v * r.v)')} AS v FROM m p JOIN m r USING (j) GROUP BY p.i, r.i")
def matmul(spark, sf_dir):
    m = _labels(spark, sf_dir)
    return rounded(linalg.matmul(m, linalg.transpose(m)))


@q(f"WITH {_M} SELECT i, {r6_sql('sum(v * (j + 1))')} AS v FROM m GROUP BY i")
def matvec(spark, sf_dir):
    x = spark.range(WIDTH).select(F.col("id").cast("int").alias("i"), (F.col("id") + 1.0).alias("v"))
    return rounded(linalg.matvec(_labels(spark, sf_dir), x))


@q(f"WITH {A} SELECT p.x AS i, r.x AS j, {r6_sql('sum(p.v * r.v)')} AS v FROM a p JOIN a r USING (y) GROUP BY p.x, r.x")
def gram(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("row"))
    return rounded(linalg.gram(rows, WIDTH))


@q(f"WITH {_M}, u AS (SELECT j AS i, v FROM m WHERE i = 0), w AS (SELECT j AS i, v FROM m WHERE i = 1) SELECT u.i, w.i AS j, {r6_sql('u.v * w.v')} AS v FROM u, w")
def outer_product(spark, sf_dir):
    m = _labels(spark, sf_dir)
    pick = lambda k: m.filter(F.col("i") == k).select(F.col("j").alias("i"), "v")
    return rounded(linalg.outer(pick(0), pick(1)))


@q(
    f"WITH {_M}, c AS (SELECT max(s) AS l1 FROM (SELECT sum(abs(v)) AS s FROM m GROUP BY j)), r AS (SELECT max(s) AS linf FROM (SELECT sum(abs(v)) AS s FROM m GROUP BY i)) "
    f"SELECT {r6_sql('l1')} AS l1, {r6_sql('linf')} AS linf, {r6_sql('(SELECT sqrt(sum(v * v)) FROM m)')} AS frobenius FROM c, r"
)
def matrix_norms(spark, sf_dir):
    return rounded(linalg.norms(_labels(spark, sf_dir)), "l1", "linf", "frobenius")


@q(f"WITH {_M} SELECT list_position([3, 1], i) - 1 AS i, list_position([5, 0, 7], j) - 1 AS j, {r6_sql('v')} AS v FROM m WHERE i IN (3, 1) AND j IN (5, 0, 7)")
def sub_matrix(spark, sf_dir):
    return rounded(linalg.sub_matrix(_labels(spark, sf_dir), [3, 1], [5, 0, 7]))


@q("SELECT true AS equal")
def transpose_twice(spark, sf_dir):
    m = _labels(spark, sf_dir)
    return linalg.equal_within(m, linalg.transpose(linalg.transpose(m)), 1e-12)


@q(
    f"""WITH {P3} SELECT id, {r6_sql('x * a + y * b + z * c')} AS dot, {r6_sql('y * c - z * b')} AS cx, {r6_sql('z * a - x * c')} AS cy, {r6_sql('x * b - y * a')} AS cz,
    {r6_sql('sqrt((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2)')} AS distance, {r6_sql('acos((x * a + y * b + z * c) / (sqrt(x * x + y * y + z * z) * sqrt(a * a + b * b + c * c)))')} AS angle FROM p3"""
)
def vector_geometry(spark, sf_dir):
    p, r = linalg.vec(F.col("x"), F.col("y"), F.col("z")), linalg.vec(F.col("a"), F.col("b"), F.col("c"))
    c = linalg.cross3(p, r)
    out = points3(spark, sf_dir).select("id", linalg.dot3(p, r).alias("dot"), c["x"].alias("cx"), c["y"].alias("cy"), c["z"].alias("cz"), linalg.distance3(p, r).alias("distance"), linalg.angle3(p, r).alias("angle"))
    return rounded(out, "dot", "cx", "cy", "cz", "distance", "angle")


@q(
    f"""WITH {P3} SELECT id, {r6_sql('-y * b - z * c')} AS w, {r6_sql('x * 1 + y * c - z * b')} AS qx, {r6_sql('-x * c + y * 1 + 0')} AS qy, {r6_sql('x * b + z * 1')} AS qz FROM p3"""
)
def quaternion_product(spark, sf_dir):
    p = F.struct(F.lit(0.0).alias("w"), "x", "y", "z")
    r = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("x"), F.col("b").alias("y"), F.col("c").alias("z"))
    out = points3(spark, sf_dir).select("id", linalg.quaternion_multiply(p, r).alias("q"))
    return rounded(out.select("id", F.col("q.w").alias("w"), F.col("q.x").alias("qx"), F.col("q.y").alias("qy"), F.col("q.z").alias("qz")), "w", "qx", "qy", "qz")


_C, _S = math.cos(0.3), math.sin(0.3)


@q(f"WITH {P3} SELECT id, {r6_sql(f'{_C!r} * x - {_S!r} * y + 1')} AS rx, {r6_sql(f'{_S!r} * x + {_C!r} * y + 2')} AS ry, {r6_sql('z + 3')} AS rz, {r6_sql('x')} AS ix FROM p3")
def affine_transform(spark, sf_dir):
    m, t = linalg.rotation("z", 0.3), [1.0, 2.0, 3.0]
    moved = linalg.affine3(linalg.vec(F.col("x"), F.col("y"), F.col("z")), m, t)
    out = points3(spark, sf_dir).select("id", moved.alias("m")).select("id", F.col("m.x").alias("rx"), F.col("m.y").alias("ry"), F.col("m.z").alias("rz"), linalg.affine3_inverse(F.col("m"), m, t)["x"].alias("ix"))
    return rounded(out, "rx", "ry", "rz", "ix")


_DET = "x * (b * (z + 50) - c * y) - y * (a * (z + 50) - c * x) + z * (a * y - b * x)"


@q(f"WITH {P3} SELECT id, {r6_sql(_DET)} AS det FROM p3")
def determinant(spark, sf_dir):
    m = F.array(F.array("x", "y", "z"), F.array("a", "b", "c"), F.array(F.col("x"), F.col("y"), F.col("z") + 50))
    return rounded(points3(spark, sf_dir).select("id", linalg.dense("determinant")(m).alias("det")), "det")


@q(f"WITH {P3}, t AS (SELECT id, abs(x) + 200 AS p, y AS q, a AS r, abs(b) + 200 AS s FROM p3) SELECT id, {r6_sql('s / (p * s - q * r)')} AS i00, {r6_sql('-q / (p * s - q * r)')} AS i01, {r6_sql('-r / (p * s - q * r)')} AS i10, {r6_sql('p / (p * s - q * r)')} AS i11 FROM t")
def inverse(spark, sf_dir):
    m = F.array(F.array(F.abs("x") + 200, F.col("y")), F.array(F.col("a"), F.abs("b") + 200))
    out = points3(spark, sf_dir).select("id", linalg.dense("inverse")(m).alias("m"))
    return rounded(out.select("id", *[F.col("m")[i][j].alias(f"i{i}{j}") for i in (0, 1) for j in (0, 1)]), "i00", "i01", "i10", "i11")


@q(f"WITH {P3} SELECT id, 0.0::DOUBLE AS error FROM p3")
def svd_reconstruct(spark, sf_dir):
    """The Frobenius norm against the singular values', and R Q and Q R against the matrix: no difference to six digits."""
    m = F.array(F.array("x", "y", "z"), F.array("a", "b", "c"), F.array(F.col("x") + F.col("b"), F.col("y"), F.col("z") + 50))
    t = points3(spark, sf_dir).select("id", m.alias("m")).select(
        "id", "m", linalg.dense("singular_values")("m").alias("s"), linalg.dense("rq_r")("m").alias("r"), linalg.dense("rq_q")("m").alias("q")
    )
    square = lambda c: F.aggregate(F.flatten(c), F.lit(0.0), lambda a, v: a + v * v)
    values = F.aggregate("s", F.lit(0.0), lambda a, v: a + v * v)
    product = lambda i, j: sum((F.col("r")[i][k] * F.col("q")[k][j] for k in range(3)), F.lit(0.0))
    off = sum((F.abs(product(i, j) - F.col("m")[i][j]) for i in range(3) for j in range(3)), F.lit(0.0))
    return rounded(t.select("id", (F.abs(square("m") - values) / square("m") + off / F.sqrt(square("m"))).alias("error")), "error")


@q(f"""WITH {P3} SELECT id, '[[' || CAST(CAST(round(x) AS BIGINT) AS VARCHAR) || '.0, ' || CAST(CAST(round(y) AS BIGINT) AS VARCHAR) || '.0]; [1.0, 2.0]]' AS text, CAST(CAST(round(x) AS BIGINT) AS DOUBLE) + 2.0 AS trace FROM p3""")
def matrix_text(spark, sf_dir):
    p = points3(spark, sf_dir)
    n = lambda c: F.round(c).cast("long").cast("double")
    text = linalg.print_matrix(F.array(F.array(n("x"), n("y")), F.array(F.lit(1.0), F.lit(2.0))))
    out = p.select("id", text.alias("text")).withColumn("m", linalg.parse_matrix(F.col("text")))
    return out.select("id", "text", (F.col("m")[0][0] + F.col("m")[1][1]).alias("trace"))


@q(
    f"""WITH {A}, mu AS (SELECT x, avg(v) AS m FROM a GROUP BY x) SELECT {r6_sql('sum((v - m) * (v - m)) / (SELECT count(DISTINCT y) FROM a)')} AS total FROM a JOIN mu USING (x)"""
)
def pca_variance(spark, sf_dir):
    """The variances of all components add up to the total."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("row"))
    _, variances, _ = linalg.pca(rows, WIDTH, WIDTH)
    return rounded(spark.createDataFrame([(float(variances.sum()),)], "total double"), "total")


# reconstruction

_N, _VIEWS, _BINS = 32, 60, 47
_ELL = "ell(val, a, b, x0, y0, phi) AS (VALUES " + ", ".join(f"({phantom.MODIFIED[k]!r}::DOUBLE, " + ", ".join(f"{v!r}::DOUBLE" for v in e[1:]) + ")" for k, e in enumerate(phantom.SHEPP_LOGAN)) + ")"
_PIX = f"px AS (SELECT CAST(i // {_N} AS INTEGER) AS y, CAST(i % {_N} AS INTEGER) AS x FROM (SELECT unnest(range({_N * _N})) AS i))"
_C1 = lambda n: f"((({n}) - {(_N - 1) / 2!r}) / {_N / 2!r})"
_IMG = f"""{_ELL}, {_PIX}, loc AS (SELECT px.y, px.x, val, a, b, ({_C1('px.x')} - x0) AS dx, ({_C1('px.y')} - y0) AS dy, radians(phi) AS r FROM px, ell),
    img AS (SELECT y, x, sum(CASE WHEN pow((dx * cos(r) + dy * sin(r)) / a, 2) + pow((-dx * sin(r) + dy * cos(r)) / b, 2) <= 1 THEN val ELSE 0 END) AS v FROM loc GROUP BY y, x)"""
_HALF = _N / math.sqrt(2) + 1
_SINO = f"""vw AS (SELECT CAST(k AS INTEGER) AS view, k * {math.pi / _VIEWS!r} AS angle FROM (SELECT unnest(range({_VIEWS})) AS k)),
    ray AS (SELECT view, u, (u - {(_BINS - 1) / 2!r}) * cos(angle) + {_HALF!r} * sin(angle) + {(_N - 1) / 2!r} AS ox, (u - {(_BINS - 1) / 2!r}) * sin(angle) - {_HALF!r} * cos(angle) + {(_N - 1) / 2!r} AS oy,
        -sin(angle) AS dx, cos(angle) AS dy FROM vw, (SELECT CAST(unnest(range({_BINS})) AS INTEGER) AS u)),
    smp AS (SELECT view, u, ox + dx * (k / 3.0::DOUBLE) AS sx, oy + dy * (k / 3.0::DOUBLE) AS sy FROM ray, (SELECT unnest(range({math.floor(2 * _HALF * 3) + 1})) AS k)),
    cor AS (SELECT view, u, floor(sy) + ey AS y, floor(sx) + ex AS x, (CASE ey WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) * (CASE ex WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) AS w
        FROM smp, (VALUES (0), (1)) t1(ey), (VALUES (0), (1)) t2(ex) WHERE sx BETWEEN -1 AND {_N} AND sy BETWEEN -1 AND {_N}),
    sino AS (SELECT ray.view, ray.u, coalesce(s.v, 0) / 3 AS v FROM ray LEFT JOIN (SELECT view, u, sum(w * img.v) AS v FROM cor JOIN img USING (y, x) GROUP BY view, u) s USING (view, u))"""
_FILT = f"""flt AS (SELECT p.view, p.u, sum(r.v * CASE WHEN p.u = r.u THEN 0.25 WHEN (p.u - r.u) % 2 <> 0 THEN -1 / ({math.pi**2!r}::DOUBLE * (p.u - r.u) * (p.u - r.u)) ELSE 0 END) AS v FROM sino p JOIN sino r USING (view) GROUP BY p.view, p.u)"""
_BACK = f"""pos AS (SELECT y, x, view, (x - {(_N - 1) / 2!r}) * cos(angle) + (y - {(_N - 1) / 2!r}) * sin(angle) + {(_BINS - 1) / 2!r} AS s FROM px, vw),
    tap AS (SELECT y, x, view, CAST(floor(s) + e AS INTEGER) AS u, CASE e WHEN 1 THEN s - floor(s) ELSE 1 - (s - floor(s)) END AS w FROM pos, (VALUES (0), (1)) t(e))"""


def _phantom(spark) -> DataFrame:
    return phantom.rasterize(spark, phantom.shepp_logan(spark), _N)


def _sinogram(spark) -> DataFrame:
    return recon.forward_project(_phantom(spark), recon.parallel_rays(recon.views(spark, _VIEWS), _BINS, _N), (_N, _N))


@q(f"WITH {_IMG} SELECT y, x, {r6_sql('v')} AS v FROM img")
def phantom_voxels(spark, sf_dir):
    return rounded(_phantom(spark))


@q(f"WITH {_IMG}, {_SINO} SELECT view, u, {r6_sql('v')} AS v FROM sino")
def radon_parallel(spark, sf_dir):
    return rounded(_sinogram(spark))


@q(f"WITH {_IMG}, {_SINO}, {_FILT} SELECT view, u, {r6_sql('v')} AS v FROM flt")
def ramlak_spatial(spark, sf_dir):
    return rounded(recon.filter_views(_sinogram(spark), "ram_lak"))


@q(f"WITH {_IMG}, {_SINO}, {_FILT}, {_BACK} SELECT y, x, {r6_sql(f'sum(w * flt.v) * {math.pi / _VIEWS!r}')} AS v FROM tap JOIN flt USING (view, u) GROUP BY y, x")
def fbp_parallel(spark, sf_dir):
    filtered = recon.filter_views(_sinogram(spark), "ram_lak")
    return rounded(recon.back_project(filtered, recon.views(spark, _VIEWS), recon.pixels(spark, _N, _N), _BINS, _N))


@q(
    f"""WITH {_ELL}, vw AS (SELECT CAST(k AS INTEGER) AS view, k * {math.pi / _VIEWS!r} AS angle FROM (SELECT unnest(range({_VIEWS})) AS k)),
    r AS (SELECT view, u, val, a, b, pow(a * cos(angle - radians(phi)), 2) + pow(b * sin(angle - radians(phi)), 2) AS r2, (u - {(_BINS - 1) / 2!r}) / {_N / 2!r} - x0 * cos(angle) - y0 * sin(angle) AS o
        FROM vw, ell, (SELECT CAST(unnest(range({_BINS})) AS INTEGER) AS u))
    SELECT view, u, {r6_sql(f'sum(val * CASE WHEN o * o < r2 THEN 2 * a * b * sqrt(greatest(r2 - o * o, 0)) / r2 ELSE 0 END) * {_N / 2!r}')} AS v FROM r GROUP BY view, u"""
)
def ellipse_projection(spark, sf_dir):
    return rounded(phantom.ellipse_projection(phantom.shepp_logan(spark), recon.views(spark, _VIEWS), _BINS, _N))


@q(
    f"""WITH {_IMG}, {_SINO}, sys AS (SELECT view, u, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, sum(w) / 3 AS w FROM cor WHERE w > 0 AND y BETWEEN 0 AND {_N - 1} AND x BETWEEN 0 AND {_N - 1} GROUP BY view, u, y, x),
    nrm AS (SELECT view, u, sum(w) AS n FROM sys GROUP BY view, u)
    SELECT y, x, {r6_sql('sum(w * (v / n)) / sum(w)')} AS v FROM sys JOIN sino USING (view, u) JOIN nrm USING (view, u) GROUP BY y, x"""
)
def simultaneous_reconstruction_step(spark, sf_dir):
    system = recon.system_matrix(recon.parallel_rays(recon.views(spark, _VIEWS), _BINS, _N), (_N, _N))
    return rounded(recon.simultaneous_step(system, _sinogram(spark), recon.pixels(spark, _N, _N).withColumn("v", F.lit(0.0))))


def _checkpoints(spark) -> None:
    """Iterative queries checkpoint; where no folder is set, as in tests, a local one is made."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="latticework-"))


@q()
def sart_reconstruction(spark, sf_dir):
    """A round over 12 views of a 16 x 16 phantom."""
    _checkpoints(spark)
    n, v, b = 16, 12, 25
    image, rays = phantom.rasterize(spark, phantom.shepp_logan(spark), n), recon.parallel_rays(recon.views(spark, v), b, n)
    system = recon.by_view(recon.system_matrix(rays, (n, n)))
    sino = system.join(image, ["y", "x"]).groupBy("view", "u").agg(F.sum(F.col("w") * F.col("v")).alias("v")).checkpoint()
    return recon.sart(system, sino, recon.pixels(spark, n, n).withColumn("v", F.lit(0.0)), recon.sart_order(v), 1)


@q()
def fan_beam_reconstruction(spark, sf_dir):
    """A disc through fan-beam projection, cosine weights, ramp filter and weighted back projection."""
    n, v, b, src, det = 24, 36, 61, 120.0, 180.0
    angles = recon.views(spark, v, 2 * math.pi)
    sino = recon.forward_project(phantom.disc(spark, n, 0.3), recon.fan_rays(angles, b, n, src, det), (n, n))
    u = F.col("u") - (b - 1) / 2
    weighted = sino.withColumn("v", F.col("v") * pointwise.cosine_weight(u, F.lit(0.0), det))
    filtered = recon.filter_views(weighted, "ram_lak", det / src * src / det)
    return recon.fan_back_project(filtered, angles, recon.pixels(spark, n, n), b, n, src, det)


_DELTA = 0.25


@q(
    f"""WITH g AS (SELECT unnest(range(41)) AS i), h AS (SELECT unnest(range(21)) AS j), t AS (SELECT i, j, i * {(math.pi + 2 * _DELTA) / 40!r} AS b, (j - 10) * {_DELTA * 0.9 / 10!r} AS g FROM g, h)
    SELECT i, j, {r6_sql(f'''CASE WHEN b < {2 * _DELTA} - 2 * g THEN pow(sin({math.pi / 4!r} * b / ({_DELTA} - g)), 2) WHEN b <= {math.pi!r} - 2 * g THEN 1 ELSE pow(sin({math.pi / 4!r} * ({math.pi + 2 * _DELTA!r} - b) / ({_DELTA} + g)), 2) END''')} AS w FROM t"""
)
def parker_weights(spark, sf_dir):
    t = spark.range(41).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("j"))
    beta, gamma = F.col("i") * ((math.pi + 2 * _DELTA) / 40), (F.col("j") - 10) * (_DELTA * 0.9 / 10)
    out = t.select("i", F.col("j").cast("long").alias("j"), recon.parker_weight(beta, gamma, _DELTA).alias("w"))
    # the last view lies on the end of the scan, where rounding decides between 0 and 0
    return rounded(out, "w")


@q(
    f"""WITH t AS (SELECT i, (i - 32) / 32.0::DOUBLE AS f FROM (SELECT unnest(range(65)) AS i)) SELECT i, {r6_sql('abs(f)')} AS ram_lak,
    {r6_sql(f'abs(f) * CASE WHEN f = 0 THEN 1 ELSE sin(abs(f) * {math.pi / 2!r}) / (abs(f) * {math.pi / 2!r}) END')} AS shepp_logan, {r6_sql(f'abs(f) * (0.54 + 0.46 * cos(abs(f) * {math.pi!r}))')} AS hamming,
    {r6_sql(f'abs(f) * (0.5 + 0.5 * cos(abs(f) * {math.pi!r}))')} AS hann, {r6_sql(f'abs(f) * cos(abs(f) * {math.pi / 2!r})')} AS cosine FROM t"""
)
def ramp_responses(spark, sf_dir):
    kinds = ("ram_lak", "shepp_logan", "hamming", "hann", "cosine")
    t = spark.range(65).select(F.col("id").alias("i"), ((F.col("id") - 32) / 32.0).alias("f"))
    return rounded(t.select("i", *[recon.ramp_response(k, F.col("f")).alias(k) for k in kinds]), *kinds)


@q(f"WITH {A}, {B} SELECT p.y, p.x AS u, {r6_sql(f'sum(r.v * (-2 / ({math.pi**2!r}::DOUBLE * (4 * (p.x - r.x) * (p.x - r.x) - 1))))')} AS v FROM a p JOIN a r USING (y) GROUP BY p.y, p.x")
def shepp_logan_kernel_rows(spark, sf_dir):
    return rounded(recon.filter_views(grid_a(spark, sf_dir).withColumnRenamed("x", "u"), "shepp_logan", keys=("y",)))


@q()
def cone_beam_back_projection(spark, sf_dir):
    """Views that hold 1 everywhere, over a circle: every voxel gets the mean of D^2 2 pi / w^2."""
    m = geometry.circular(spark, 12, 100.0, 150.0, 1.0, 33, 33)
    views = m.select("view", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("y")).select("view", "y", F.explode(F.sequence(F.lit(0), F.lit(32))).alias("x")).withColumn("v", F.lit(1.0))
    vox = spark.range(125).select((F.col("id") / 25).cast("int").alias("k"), ((F.col("id") / 5).cast("int") % 5).alias("j"), (F.col("id") % 5).alias("i"))
    vox = vox.select("k", "j", "i", *[((F.col(c) - 2) * 2.0).alias(f"w{a}") for c, a in (("i", "x"), ("j", "y"), ("k", "z"))])
    return rounded(recon.cone_back_project(views, m, vox, 100.0))


# physics

_SEG = "seg AS (SELECT l_orderkey AS ray, min(l_linenumber * 1000 + l_suppkey % 97) AS obj, l_suppkey % 7 AS priority, l_linenumber * 10.0::DOUBLE AS s, l_linenumber * 10.0::DOUBLE + max(l_quantity) AS e FROM lineitem GROUP BY l_orderkey, l_linenumber, l_suppkey % 7)"


def _segments(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("ray"), "l_linenumber", (F.col("l_suppkey") % 7).alias("priority")).agg(
        F.min(F.col("l_linenumber") * 1000 + F.col("l_suppkey") % 97).alias("obj"), F.max("l_quantity").alias("_q")
    ).select("ray", "obj", "priority", (F.col("l_linenumber") * 10.0).alias("start"), (F.col("l_linenumber") * 10.0 + F.col("_q")).alias("end"))


_RES = """cut AS (SELECT DISTINCT ray, c FROM (SELECT ray, s AS c FROM seg UNION ALL SELECT ray, e FROM seg)), iv AS (SELECT ray, c AS s0, lead(c) OVER (PARTITION BY ray ORDER BY c) AS e0 FROM cut),
    rk AS (SELECT iv.ray, s0, e0, obj, priority, row_number() OVER (PARTITION BY iv.ray, s0 ORDER BY priority DESC, obj) AS n FROM iv JOIN seg ON seg.ray = iv.ray AND s <= s0 AND e >= e0 WHERE e0 IS NOT NULL),
    res AS (SELECT ray, s0 AS "start", e0 AS "end", obj, priority FROM rk WHERE n = 1)"""


@q(f"WITH {_SEG}, {_RES} SELECT * FROM res")
def priority_segments(spark, sf_dir):
    return physics.resolve_priorities(_segments(spark, sf_dir), ["ray"])


@q(f'WITH {_SEG}, {_RES} SELECT ray, priority AS material, {r6_sql("""sum("end" - "start")""")} AS length FROM res GROUP BY ray, priority')
def path_lengths(spark, sf_dir):
    res = physics.resolve_priorities(_segments(spark, sf_dir), ["ray"]).withColumnRenamed("priority", "material")
    return rounded(physics.path_lengths(res, ["ray"], "material"), "length")


_LEN = "len AS (SELECT l_orderkey AS ray, l_suppkey % 5 AS material, sum(l_quantity) AS length FROM lineitem GROUP BY 1, 2)"


def _lengths(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ray"), (F.col("l_suppkey") % 5).alias("material")).agg(F.sum("l_quantity").alias("length"))


@q(f"WITH {_LEN} SELECT ray, {r6_sql('greatest(sum((0.1 + 0.05 * material) * length) / 10, 0)')} AS v FROM len GROUP BY ray")
def mono_absorption(spark, sf_dir):
    return rounded(physics.monochromatic(_lengths(spark, sf_dir), ["ray"], 0.1 + 0.05 * F.col("material")))


_SPEC = [(40.0, 0.2), (60.0, 0.4), (80.0, 0.25), (100.0, 0.1), (120.0, 0.05)]


@q(
    f"""WITH {_LEN}, sp(energy, flux) AS (VALUES {", ".join(f"({e}::DOUBLE, {f}::DOUBLE)" for e, f in _SPEC)}), l AS (SELECT ray, energy, flux, sum((2.0 + material) * 10 / energy * length) / 10 AS l FROM len, sp GROUP BY ray, energy, flux)
    SELECT ray, {r6_sql('-ln(sum(flux * exp(-l) * energy) / sum(flux * energy))')} AS v FROM l GROUP BY ray"""
)
def poly_absorption(spark, sf_dir):
    spectrum = spark.createDataFrame(_SPEC, "energy double, flux double")
    mu = spark.createDataFrame([(m, e, (2.0 + m) * 10 / e) for m in range(5) for e, _ in _SPEC], "material long, energy double, mu double")
    return rounded(physics.polychromatic(_lengths(spark, sf_dir), ["ray"], spectrum, mu, "material"))


@q(f"WITH {_LEN} SELECT material, CAST(least(floor(length / 10), 8) AS INTEGER) AS bin, count(*) AS n FROM len GROUP BY 1, 2")
def path_length_histogram(spark, sf_dir):
    return physics.length_histogram(_lengths(spark, sf_dir), "material", 10.0, 8)


_SL, _BASE = physics.ct_line()


@q(f"WITH {A} SELECT y, x, {r6_sql(f'v * 1000 * {_SL!r} + {_BASE!r}')} AS density, {r6_sql('v * 1000')} AS ct FROM a")
def ct_density(spark, sf_dir):
    d = physics.density_of_ct(F.col("v") * 1000)
    return rounded(grid_a(spark, sf_dir).select("y", "x", d.alias("density")).withColumn("ct", physics.ct_of_density(F.col("density"))), "density", "ct")


@q("SELECT * FROM (VALUES ('H2O', 18.015::DOUBLE), ('CaCO3', 100.086::DOUBLE), ('C6H12O6', 180.156::DOUBLE), ('NaCl', 58.44::DOUBLE)) t(formula, mass)")
def molar_mass(spark, sf_dir):
    elements = spark.createDataFrame([("H", 1.008), ("C", 12.011), ("O", 15.999), ("Ca", 40.078), ("Na", 22.99), ("Cl", 35.45)], "element string, mass double")
    formulas = spark.createDataFrame([("H2O",), ("CaCO3",), ("C6H12O6",), ("NaCl",)], "formula string")
    return rounded(physics.molar_mass(formulas, elements), "mass")


@q(
    f"""WITH e AS (SELECT unnest(range(1, 81)) AS e), f AS (SELECT CAST(e AS DOUBLE) AS energy, greatest((80 - e) / CAST(e AS DOUBLE), 0) * exp(-2.5 * 2.7 * pow(18.0 / e, 3) / 10) AS f FROM e)
    SELECT energy, {r6_sql('f / (SELECT sum(f) FROM f)')} AS flux FROM f"""
)
def kramers_spectrum(spark, sf_dir):
    return rounded(physics.kramers_spectrum(spark, 80), "flux")


_LF = f"CASE WHEN p_size < 2 THEN 0 ELSE p_size * ln(p_size) - p_size + 0.5 * ln({2 * math.pi!r} * p_size) + 1 / (12.0 * p_size) - 1 / (360.0 * pow(p_size, 3)) END"


@q(f"SELECT p_partkey, {r6_sql(_LF)} AS log_factorial, {r6_sql(f'exp(p_size * ln(20.0) - 20.0 - ({_LF}))')} AS probability FROM part")
def poisson_terms(spark, sf_dir):
    n = F.col("p_size")
    out = table(spark, sf_dir, "part").select("p_partkey", physics.log_factorial(n).alias("log_factorial"), physics.poisson_probability(n, F.lit(20.0)).alias("probability"))
    return rounded(out, "log_factorial", "probability")


# geometry

_P = (np.array(geometry.projection_matrix(geometry.intrinsics(600.0, 1.0, 128.0, 64.0), np.eye(3), np.array([5.0, -3.0, 400.0])))).ravel().tolist()


@q(f"WITH {P3} SELECT id, 0 AS view, {r6_sql(f'(600 * x + 128 * z + {_P[3]!r}) / (z + 400)')} AS u, {r6_sql(f'(600 * y + 64 * z + {_P[7]!r}) / (z + 400)')} AS v, {r6_sql('z + 400')} AS depth FROM p3")
def camera_projection(spark, sf_dir):
    m = spark.createDataFrame([(0, _P)], "view int, p array<double>")
    out = geometry.project_points(points3(spark, sf_dir).select("id", "x", "y", "z"), m)
    return rounded(out.select("id", "view", "u", "v", "depth"), "u", "v", "depth")


def _rays(spark, sf_dir) -> DataFrame:
    return points3(spark, sf_dir).select("id", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), F.col("a").alias("dx"), F.col("b").alias("dy"), F.col("c").alias("dz"))


_SLAB = ", ".join(f"least((-6 - {o}) / {d}, (8 - {o}) / {d}) AS n{o}, greatest((-6 - {o}) / {d}, (8 - {o}) / {d}) AS f{o}" for o, d in (("x", "a"), ("y", "b"), ("z", "c")))


@q(f"WITH {P3}, s AS (SELECT id, {_SLAB} FROM p3), t AS (SELECT id, greatest(nx, ny, nz) AS n, least(fx, fy, fz) AS f FROM s) SELECT id, {r6_sql('CASE WHEN n <= f THEN n END')} AS near, {r6_sql('CASE WHEN n <= f THEN f END')} AS far FROM t")
def ray_box(spark, sf_dir):
    near, far = geometry.hit_box([F.lit(-6.0)] * 3, [F.lit(8.0)] * 3)
    return rounded(_rays(spark, sf_dir).select("id", near.alias("near"), far.alias("far")), "near", "far")


_SPH = "t AS (SELECT id, a * a + b * b + c * c AS qa, 2 * ((x - 1) * a + (y - 2) * b + (z - 3) * c) AS qb, (x - 1) ** 2 + (y - 2) ** 2 + (z - 3) ** 2 - 100 AS qc FROM p3)"


@q(f"WITH {P3}, {_SPH} SELECT id, {r6_sql('CASE WHEN qb * qb >= 4 * qa * qc THEN (-qb - sqrt(greatest(qb * qb - 4 * qa * qc, 0))) / (2 * qa) END')} AS near, {r6_sql('CASE WHEN qb * qb >= 4 * qa * qc THEN (-qb + sqrt(greatest(qb * qb - 4 * qa * qc, 0))) / (2 * qa) END')} AS far FROM t")
def ray_sphere(spark, sf_dir):
    near, far = geometry.hit_sphere([F.lit(1.0), F.lit(2.0), F.lit(3.0)], F.lit(10.0))
    return rounded(_rays(spark, sf_dir).select("id", near.alias("near"), far.alias("far")), "near", "far")


@q(f"WITH {P3} SELECT id, {r6_sql('(4 - (x * 0.6 + z * 0.8)) / (a * 0.6 + c * 0.8)')} AS t FROM p3")
def ray_plane(spark, sf_dir):
    return rounded(_rays(spark, sf_dir).select("id", geometry.hit_plane([F.lit(0.6), F.lit(0.0), F.lit(0.8)], F.lit(4.0)).alias("t")), "t")


@q()
def ray_cylinder_triangle(spark, sf_dir):
    near, far = geometry.hit_cylinder(F.lit(0.0), F.lit(0.0), F.lit(12.0), F.lit(-10.0), F.lit(10.0))
    tri = geometry.hit_triangle([F.lit(-20.0), F.lit(-20.0), F.lit(0.0)], [F.lit(20.0), F.lit(-20.0), F.lit(0.0)], [F.lit(0.0), F.lit(25.0), F.lit(5.0)])
    return _rays(spark, sf_dir).select("id", near.alias("near"), far.alias("far"), tri.alias("triangle"))


@q(
    f"""WITH {P3}, box AS (SELECT id AS bid, x - 1.5 AS lx, x + 1.5 AS hx, y - 1.5 AS ly, y + 1.5 AS hy, z - 1.5 AS lz, z + 1.5 AS hz FROM p3 WHERE id % 50 = 0)
    SELECT id, bid AS b FROM p3 JOIN box ON x BETWEEN lx AND hx AND y BETWEEN ly AND hy AND z BETWEEN lz AND hz"""
)
def spatial_cell_join(spark, sf_dir):
    """Points in the boxes around a stated query set of points."""
    p = points3(spark, sf_dir).select("id", "x", "y", "z")
    boxes = p.filter("id % 50 = 0").select(F.col("id").alias("b"), *[(F.col(a) + s * 1.5).alias(f"{k}_{a}") for a in "xyz" for k, s in (("lo", -1), ("hi", 1))])
    return geometry.cell_join(p, boxes, 3.0).select("id", "b")


@q("SELECT p_partkey, CAST(sum(((p_size >> k) & 1) << (2 * k)) + sum(((p_partkey >> k) & 1) << (2 * k + 1)) AS BIGINT) AS code FROM part, (SELECT unnest(range(20)) AS k) GROUP BY p_partkey")
def morton_code(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", geometry.morton([F.col("p_size"), F.col("p_partkey")]).alias("code"))


_KNOTS = [0.0, 0.0, 0.0, 0.0, 0.5, 1.0, 1.0, 1.0, 1.0]


@q(f"WITH {A} SELECT x, 1.0::DOUBLE AS total FROM a WHERE y = (SELECT min(y) FROM a)")
def bspline_partition_of_unity(spark, sf_dir):
    t = spark.range(WIDTH).select(F.col("id").cast("int").alias("x"), (F.col("id") / 63.0).alias("t"))
    return rounded(t.select("x", sum((geometry.bspline_basis(i, 3, _KNOTS, F.col("t")) for i in range(5)), F.lit(0.0)).alias("total")), "total")


@q(
    f"""WITH {P3}, m(mx, my, mz, vx, vy, vz) AS (VALUES (0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 2.0::DOUBLE), (10, 5, -5, 0, 3, 1), (-8, 2, 6, -1, 1, 0)),
    w AS (SELECT id, exp(-((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2) / 200.0) AS w, vx, vy, vz FROM p3, m)
    SELECT id, {r6_sql('sum(w * vx) / sum(w)')} AS d_x, {r6_sql('sum(w * vy) / sum(w)')} AS d_y, {r6_sql('sum(w * vz) / sum(w)')} AS d_z FROM w GROUP BY id"""
)
def parzen_motion(spark, sf_dir):
    m = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 0.0, 2.0), (10.0, 5.0, -5.0, 0.0, 3.0, 1.0), (-8.0, 2.0, 6.0, -1.0, 1.0, 0.0)], "m_x double, m_y double, m_z double, d_x double, d_y double, d_z double")
    return rounded(geometry.parzen_motion(points3(spark, sf_dir), m, ["id"], 10.0), "d_x", "d_y", "d_z")


@q(f"WITH {P3} SELECT id, {r6_sql('cos(id * 0.01) * (x - 1) - sin(id * 0.01) * (y - 2) + 1')} AS x, {r6_sql('sin(id * 0.01) * (x - 1) + cos(id * 0.01) * (y - 2) + 2')} AS y, {r6_sql('z')} AS z FROM p3")
def rotation_motion(spark, sf_dir):
    p = {n: F.col(n) for n in "xyz"}
    out = geometry.rotate_about(p, "z", F.col("id") * 0.01, (1.0, 2.0, 0.0))
    return rounded(points3(spark, sf_dir).select("id", *[out[n].alias(n) for n in "xyz"]), "x", "y", "z")


@q(
    f"""WITH {P3}, m AS (SELECT label, avg(x) AS mx, avg(y) AS my, avg(a) AS mu, avg(b) AS mv, covar_pop(x, a) AS xu, covar_pop(y, b) AS yv, covar_pop(x, b) AS xv, covar_pop(y, a) AS yu FROM p3 GROUP BY label),
    t AS (SELECT *, atan2(xv - yu, xu + yv) AS r FROM m) SELECT label, {r6_sql('r')} AS angle, {r6_sql('mu - cos(r) * mx + sin(r) * my')} AS tx, {r6_sql('mv - sin(r) * mx - cos(r) * my')} AS ty FROM t"""
)
def rigid_registration(spark, sf_dir):
    pairs = points3(spark, sf_dir).select("label", "x", "y", F.col("a").alias("u"), F.col("b").alias("v"))
    return rounded(geometry.rigid_fit(pairs, ["label"]), "angle", "tx", "ty")


@q(
    f"""WITH {P3}, p AS (SELECT DISTINCT label, x, y FROM p3), e AS (SELECT label, a.x AS x, a.y AS y FROM p a JOIN p b USING (label) JOIN p c USING (label) WHERE a.x <> b.x OR a.y <> b.y
    GROUP BY label, a.x, a.y, b.x, b.y HAVING bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) >= 0)) SELECT DISTINCT label, {r6_sql('x')} AS x, {r6_sql('y')} AS y FROM e"""
)
def convex_hull(spark, sf_dir):
    return rounded(geometry.hull_2d(points3(spark, sf_dir), ["label"]), "x", "y")


# graphs


def _mask(spark, sf_dir) -> DataFrame:
    return grid_a(spark, sf_dir).filter("v > 0.12")


_CC = f"""WITH RECURSIVE {A}, msk AS (SELECT y * 64 + x AS id, y, x FROM a WHERE v > 0.12),
    edge AS (SELECT p.id AS s, r.id AS d FROM msk p, (VALUES (-1), (0), (1)) t1(dy), (VALUES (-1), (0), (1)) t2(dx) JOIN msk r ON r.y = p.y + dy AND r.x = p.x + dx),
    reach(id, c) AS (SELECT id, id FROM msk UNION SELECT edge.d, reach.c FROM reach JOIN edge ON edge.s = reach.id WHERE reach.c < edge.d),
    lab AS (SELECT id, min(c) AS component FROM reach GROUP BY id)"""


@q(f"{_CC} SELECT id // 64 AS y, id % 64 AS x, component FROM lab")
def connected_components(spark, sf_dir):
    _checkpoints(spark)
    return graph.label_mask(_mask(spark, sf_dir).select("y", "x"), WIDTH)


@q(f"{_CC} SELECT component, count(*) AS size FROM lab GROUP BY component ORDER BY size DESC, component LIMIT 5")
def largest_components(spark, sf_dir):
    _checkpoints(spark)
    return graph.largest_components(graph.label_mask(_mask(spark, sf_dir).select("y", "x"), WIDTH), 5)


@q(
    f"""{_CC}, ht AS (SELECT max(y) AS my FROM a), seed AS (SELECT DISTINCT component FROM lab JOIN a ON a.y = id // 64 AND a.x = id % 64, ht WHERE v >= 0.2 AND x BETWEEN 1 AND 62 AND y BETWEEN 1 AND my - 1)
    SELECT id // 64 AS y, id % 64 AS x FROM lab JOIN seed USING (component) UNION SELECT y, x FROM a WHERE v >= 0.2"""
)
def hysteresis(spark, sf_dir):
    _checkpoints(spark)
    g = grid_a(spark, sf_dir)
    out = graph.hysteresis(g.withColumn("v", F.when(F.col("v") > 0.12, F.col("v")).otherwise(-1.0)), WIDTH, g.agg(F.max("y")).first()[0] + 1, 0.2, 0.12)
    return out


def _plane(spark, sf_dir) -> DataFrame:
    return points3(spark, sf_dir).select("id", "x", "y")


@q(f"WITH {P3} SELECT p.id AS src, r.id AS dst, {r6_sql('sqrt((p.x - r.x) ** 2 + (p.y - r.y) ** 2)')} AS weight FROM p3 p JOIN p3 r ON p.id < r.id AND (p.x - r.x) ** 2 + (p.y - r.y) ** 2 <= 4.0")
def threshold_graph(spark, sf_dir):
    return rounded(graph.threshold_edges(_plane(spark, sf_dir), 2.0), "weight")


@q()
def minimum_spanning_forest(spark, sf_dir):
    _checkpoints(spark)
    p = _plane(spark, sf_dir)
    return graph.minimum_spanning_forest(p.select("id"), graph.threshold_edges(p, 2.0))


@q()
def shortest_paths(spark, sf_dir):
    _checkpoints(spark)
    p = _plane(spark, sf_dir)
    return graph.shortest_paths(graph.threshold_edges(p, 2.0), p.filter("id = 0").select("id"), 60.0)


# features

_LV = f"{A}, lim AS (SELECT min(v) AS lo, max(v) AS hi FROM a), lv AS (SELECT y, x, CAST(least(floor((v - lo) / (hi - lo) * 8), 7) AS INTEGER) AS l FROM a, lim)"
_GL = f"""{_LV}, pr AS (SELECT k, p.l AS i, r.l AS j FROM lv p, (VALUES (0, 0, 1), (1, -1, 1), (2, -1, 0), (3, -1, -1)) t(k, dy, dx) JOIN lv r ON r.y = p.y + dy AND r.x = p.x + dx),
    bo AS (SELECT k, i, j FROM pr UNION ALL SELECT k, j, i FROM pr), ct AS (SELECT k, i, j, count(*) AS n FROM bo GROUP BY k, i, j), gl AS (SELECT k AS direction, i, j, n / sum(n) OVER (PARTITION BY k) AS p FROM ct)"""


def _levels(spark, sf_dir) -> DataFrame:
    g = grid_a(spark, sf_dir)
    low, high = g.agg(F.min("v"), F.max("v")).first()
    return g.select("y", "x", features.quantize(F.col("v"), low, high, 8).alias("level"))


@q(f"WITH {_GL} SELECT direction, i, j, {r6_sql('p')} AS p FROM gl")
def glcm(spark, sf_dir):
    return rounded(features.glcm(_levels(spark, sf_dir)), "p")


@q(
    f"""WITH {_GL}, mo AS (SELECT direction, sum(i * p) AS mu, sum(i * i * p) - pow(sum(i * p), 2) AS var FROM gl GROUP BY direction),
    f AS (SELECT direction, sum(p * p) AS energy, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, -sum(p * ln(p)) AS entropy,
        max(p) AS maximum, max(mu) AS mean, max(var) AS variance, sum(p * (i - mu) * (j - mu) / var) AS correlation FROM gl JOIN mo USING (direction) GROUP BY direction)
    SELECT """
    + ", ".join(f"{r6_sql(f'avg({n})')} AS {n}" for n in ("energy", "contrast", "dissimilarity", "homogeneity", "entropy", "maximum", "mean", "variance", "correlation"))
    + " FROM f"
)
def glcm_features(spark, sf_dir):
    out = features.haralick(features.glcm(_levels(spark, sf_dir)))
    return rounded(out, *out.columns)


@q(
    f"""WITH {A}, h AS (SELECT y, least(greatest(floor((v + 0.4) / 0.8 * 16), 0), 15) AS b, count(*) AS n FROM a GROUP BY 1, 2), t AS (SELECT y, sum(n) AS t, sum(b * n) / sum(n) AS mean FROM h GROUP BY y),
    x AS (SELECT y, mean, n / t AS p, b - mean AS d FROM h JOIN t USING (y)), m AS (SELECT y, max(mean) AS mean, sqrt(sum(p * d * d)) AS sd, -sum(p * ln(p)) AS entropy, sum(p * d ** 3) AS m3, sum(p * d ** 4) AS m4 FROM x GROUP BY y)
    SELECT y, {r6_sql('mean')} AS mean, {r6_sql('sd')} AS sd, {r6_sql('entropy')} AS entropy, {r6_sql('CASE WHEN mean <> 0 THEN sd / mean ELSE 0 END')} AS cv, {r6_sql('CASE WHEN sd > 0 THEN m3 / sd ** 3 ELSE 0 END')} AS skewness,
    {r6_sql('CASE WHEN sd > 0 THEN m4 / sd ** 4 ELSE 0 END')} AS kurtosis FROM m"""
)
def histogram_features(spark, sf_dir):
    return rounded(features.histogram_features(grid_a(spark, sf_dir), ["y"], -0.4, 0.4, 16), "mean", "sd", "entropy", "cv", "skewness", "kurtosis")


def _scored(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("quality", F.col("n_chars").alias("score"))


_SC = "sc AS (SELECT quality AS q, n_chars AS s FROM documents JOIN labels USING (doc_id))"


@q(f"WITH {_SC} SELECT s AS threshold, {r6_sql('(SELECT sum(q) FROM sc k WHERE k.s >= t.s) / (SELECT sum(q) FROM sc)')} AS tpr, {r6_sql('(SELECT sum(1 - q) FROM sc k WHERE k.s >= t.s) / (SELECT sum(1 - q) FROM sc)')} AS fpr FROM (SELECT DISTINCT s FROM sc) t")
def roc_curve(spark, sf_dir):
    return rounded(features.roc_curve(_scored(spark, sf_dir), "quality", "score"), "tpr", "fpr")


@q(f"WITH {_SC} SELECT {r6_sql('avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END)')} AS auc FROM sc p JOIN sc n ON p.q = 1 AND n.q = 0")
def roc_area(spark, sf_dir):
    return rounded(features.auc(_scored(spark, sf_dir), "quality", "score"), "auc")


@q(f"SELECT l_returnflag, {r6_sql('regr_slope(l_extendedprice, l_quantity)')} AS slope, {r6_sql('regr_intercept(l_extendedprice, l_quantity)')} AS intercept, {r6_sql('regr_r2(l_extendedprice, l_quantity)')} AS r2 FROM lineitem GROUP BY l_returnflag")
def linear_fit(spark, sf_dir):
    return rounded(features.line_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), "slope", "intercept", "r2")


@q(f"SELECT {r6_sql('regr_intercept(l_extendedprice, ln(l_quantity))')} AS a, {r6_sql('regr_slope(l_extendedprice, ln(l_quantity))')} AS b FROM lineitem WHERE l_quantity > 0")
def logarithmic_fit(spark, sf_dir):
    return rounded(features.log_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), "a", "b")


@q(
    """WITH s AS (SELECT count(*)::DOUBLE AS s0, sum(p_size)::DOUBLE AS s1, sum(p_size ** 2)::DOUBLE AS s2, sum(p_size ** 3)::DOUBLE AS s3, sum(p_size ** 4)::DOUBLE AS s4,
    sum(p_retailprice) AS t0, sum(p_size * p_retailprice) AS t1, sum(p_size ** 2 * p_retailprice) AS t2 FROM part),
    d AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS d FROM s)
    SELECT 0 AS power, round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / d, 3) AS coefficient FROM d
    UNION ALL SELECT 1, round((s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / d, 3) FROM d
    UNION ALL SELECT 2, round((s0 * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - t1 * s2) + t0 * (s1 * s3 - s2 * s2)) / d, 3) FROM d"""
)
def polynomial_fit(spark, sf_dir):
    c = features.polynomial_fit(table(spark, sf_dir, "part"), "p_size", "p_retailprice", 2)
    return spark.createDataFrame([(k, round(v, 3)) for k, v in enumerate(c)], "power int, coefficient double")


@q()
def ransac_fit(spark, sf_dir):
    r = features.ransac_line(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 5000.0)
    return spark.createDataFrame([tuple(float(r[k]) for k in ("slope", "intercept", "inliers", "eps"))], "slope double, intercept double, inliers double, eps double")


@q(
    """WITH d AS (SELECT q.vec_id AS q, p.vec_id AS p, sqrt(list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda t: pow(CAST(t[1] AS DOUBLE) - CAST(t[2] AS DOUBLE), 2)))) AS d
    FROM embeddings q JOIN embeddings p ON p.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d, 9), p) AS rank FROM d)
    SELECT q, p, round(d, 6) AS distance, rank FROM r WHERE rank <= 5"""
)
def knn_embeddings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = features.knn(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("p"), F.col("embedding").alias("vec")), 5)
    return out.select("q", "p", F.round("distance", 6).alias("distance"), "rank")


_JH = f"""{A}, {B}, jh AS (SELECT least(greatest(floor((a.v + 0.4) / 0.8 * 8), 0), 7) AS i, least(greatest(floor((b.v + 0.4) / 0.8 * 8), 0), 7) AS j, count(*) AS n FROM a JOIN b USING (y, x) GROUP BY 1, 2)"""


@q(
    f"""WITH {_JH}, t AS (SELECT i, j, n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY i) / sum(n) OVER () AS pi, sum(n) OVER (PARTITION BY j) / sum(n) OVER () AS pj FROM jh)
    SELECT {r6_sql('sum(p * ln(p / (pi * pj)))')} AS mutual_information FROM t"""
)
def mutual_information(spark, sf_dir):
    return rounded(features.mutual_information(features.joint_histogram(pointwise.zip_grids(grid_a(spark, sf_dir), grid_b(spark, sf_dir)), -0.4, 0.4, 8)), "mutual_information")


@q(
    f"""WITH {A}, v AS (SELECT round(y + 5 * sin(k * {2 * math.pi / 36!r})) AS y, round(x + 5 * cos(k * {2 * math.pi / 36!r})) AS x FROM a, (SELECT unnest(range(36)) AS k) WHERE v > 0.2)
    SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, count(*) AS votes FROM v GROUP BY y, x"""
)
def hough_votes(spark, sf_dir):
    return features.hough_circles(grid_a(spark, sf_dir).filter("v > 0.2").select("y", "x"), 5.0)


_T = f"({2 * math.pi!r} * (x - 31.5) * (x - 31.5) / 225.0)"


@q(f"WITH {A} SELECT y, {r6_sql(f'sum(v * {math.sqrt(2) / 15!r} * exp(-{math.pi!r} * (x - 31.5) * (x - 31.5) / 225.0) * (1 - 2 * {_T} + {_T} * {_T} / 2))')} AS c FROM a GROUP BY y")
def channel_response(spark, sf_dir):
    w = features.laguerre_gauss(2, F.pow(F.col("x") - 31.5, 2), 15.0)
    return rounded(grid_a(spark, sf_dir).groupBy("y").agg(F.sum(F.col("v") * w).alias("c")), "c")


@q()
def hotelling_template(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("cls"), F.slice("embedding", 1, 8).cast("array<double>").alias("c"))
    t = features.hotelling(e, 8, "cls")
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(t)], "channel int, weight double")


def _determinant(m: list[list[str]]) -> str:
    """SQL for a small determinant, along the first row."""
    if len(m) == 1:
        return m[0][0]
    parts = [f"{'-' if j % 2 else '+'} {m[0][j]} * ({_determinant([[*r[:j], *r[j + 1 :]] for r in m[1:]])})" for j in range(len(m))]
    return " ".join(parts)


_G = [[f"g{min(i, j)}{max(i, j)}" + (" + 1e-3 * greatest(tr, 1e-12)" if i == j else "") for j in range(4)] for i in range(4)]
_G = [[f"({c})" for c in r] for r in _G]
_LLE = ", ".join(f"{_determinant([['1.0'] * 4 if i == k else r for i, r in enumerate(_G)])} AS w{k}" for k in range(4))
_GRAM = ", ".join(f"max(CASE WHEN a.rank = {i + 1} AND b.rank = {j + 1} THEN list_dot_product(a.z, b.z) END) AS g{i}{j}" for i in range(4) for j in range(i, 4))


@q(
    f"""WITH e AS (SELECT vec_id AS p, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT q.p AS q, p.p AS p, list_transform(list_zip(p.v, q.v), lambda t: t[1] - t[2]) AS z FROM e q JOIN e p ON p.p <> q.p),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sqrt(list_dot_product(z, z)), 9), p) AS rank FROM d), n AS (SELECT * FROM r WHERE rank <= 4),
    g AS (SELECT q, {_GRAM} FROM n a JOIN n b USING (q) GROUP BY q), t AS (SELECT *, g00 + g11 + g22 + g33 AS tr FROM g), w AS (SELECT q, {_LLE} FROM t)
    SELECT q, p, round((CASE rank WHEN 1 THEN w0 WHEN 2 THEN w1 WHEN 3 THEN w2 ELSE w3 END) / (w0 + w1 + w2 + w3), 6) + 0.0 AS weight FROM n JOIN w USING (q)"""
)
def lle_weights(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("p"), F.col("embedding").cast("array<double>").alias("vec"))
    near = features.knn(e.withColumnRenamed("p", "q"), e, 4)
    diff = near.join(e, "p").join(e.select(F.col("p").alias("q"), F.col("vec").alias("_o")), "q").select("q", "p", F.zip_with("vec", "_o", lambda a, b: a - b).alias("diff"))
    return rounded(features.lle_weights(diff, "q"), "weight")


# frequency domain


@q(f"WITH {A} SELECT y, {r6_sql('sum(v * v)')} AS energy FROM a GROUP BY y")
def fft_parseval(spark, sf_dir):
    """The energy of each row's spectrum over its length is that of the row."""
    rows = grids.to_rows(grid_a(spark, sf_dir)).select("y", spectral.fft()("row").alias("f"))
    return rounded(rows.select("y", (F.aggregate("f", F.lit(0.0), lambda s, c: s + c["re"] * c["re"] + c["im"] * c["im"]) / F.size("f")).alias("energy")), "energy")


@q(f"WITH {A} SELECT y, x, {r6_sql('v')} AS v FROM a")
def fft_round_trip(spark, sf_dir):
    rows = grids.to_rows(grid_a(spark, sf_dir)).select("y", spectral.inverse_fft()(spectral.fft()("row")).alias("r"))
    return rounded(rows.select("y", F.posexplode(F.transform("r", lambda c: c["re"])).alias("x", "v")))


@q(
    f"""WITH {A}, k AS (SELECT unnest(range(128)) AS k), f AS (SELECT k, CASE WHEN k < 64 THEN k / 64.0 ELSE (k - 128) / 64.0 END AS f FROM k),
    h AS (SELECT m, sum(CASE WHEN f = 0 THEN 0 ELSE sin({math.pi / 2!r} * abs(f)) / {math.pi!r} END * cos({math.pi / 64!r} * k * m)) / 128 AS h FROM f, (SELECT unnest(range(-63, 64)) AS m) GROUP BY m)
    SELECT o.y, o.x, {r6_sql('sum(i.v * h)')} AS v FROM a o JOIN a i ON i.y = o.y JOIN h ON m = o.x - i.x GROUP BY o.y, o.x"""
)
def ramp_filtered_rows(spark, sf_dir):
    return rounded(grids.to_long(grids.to_rows(grid_a(spark, sf_dir)).withColumn("row", spectral.ramp_filter("shepp_logan")("row"))))


@q(
    f"""WITH {A}, k AS (SELECT unnest(range(128)) AS k), f AS (SELECT k, CASE WHEN k < 64 THEN k / 64.0 ELSE (k - 128) / 64.0 END AS f FROM k),
    h AS (SELECT m, sum(sign(f) * sin({math.pi / 64!r} * k * m)) / 128 AS h FROM f, (SELECT unnest(range(-63, 64)) AS m) GROUP BY m)
    SELECT o.y, o.x, {r6_sql('sum(i.v * h)')} AS v FROM a o JOIN a i ON i.y = o.y JOIN h ON m = o.x - i.x GROUP BY o.y, o.x"""
)
def hilbert_rows(spark, sf_dir):
    return rounded(grids.to_long(grids.to_rows(grid_a(spark, sf_dir)).withColumn("row", spectral.hilbert()("row"))))


@q()
def tv_descent(spark, sf_dir):
    _checkpoints(spark)
    image = phantom.rasterize(spark, phantom.shepp_logan(spark), 16)
    return neighbors.tv_value(recon.total_variation_steps(image, 3))


_SCAN = 2.8


@q(
    f"""WITH g AS (SELECT unnest(range(41)) AS i), h AS (SELECT unnest(range(21)) AS j), t AS (SELECT i, j, i * {_SCAN / 40!r} + {(math.pi + 2 * _DELTA - _SCAN) / 2!r} AS b, (j - 10) * {_DELTA * 0.9 / 10!r} AS g FROM g, h)
    SELECT i, j, {r6_sql(f'''{_SCAN / math.pi!r} * CASE WHEN b < {2 * _DELTA} - 2 * g THEN pow(sin({math.pi / 4!r} * b / ({_DELTA} - g)), 2) WHEN b <= {math.pi!r} - 2 * g THEN 1 ELSE pow(sin({math.pi / 4!r} * ({math.pi + 2 * _DELTA!r} - b) / ({_DELTA} + g)), 2) END''')} AS w FROM t"""
)
def parker_weights_short_scan(spark, sf_dir):
    """A scan over less than a half turn and the fan: weights are centred and scaled."""
    t = spark.range(41).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("j"))
    beta, gamma = F.col("i") * (_SCAN / 40), (F.col("j") - 10) * (_DELTA * 0.9 / 10)
    return rounded(t.select("i", F.col("j").cast("long").alias("j"), recon.parker_weight(beta, gamma, _DELTA, _SCAN).alias("w")), "w")


@q(
    f"""WITH {A}, {VOLUME}, w AS (SELECT view, i // 6 AS r, i % 6 AS u, sin(view * {2 * math.pi / 4!r}) AS s, cos(view * {2 * math.pi / 4!r}) AS c FROM (SELECT unnest(range(4)) AS view), (SELECT unnest(range(30)) AS i)),
    e AS (SELECT *, (u - 2.5) * 40 AS a, (r - 2) * 40 AS b, sqrt(pow((u - 2.5) * 40, 2) + pow((r - 2) * 40, 2) + 160000) AS n FROM w),
    d AS (SELECT view, r, u, -300 * s AS ox, 300 * c AS oy, (a * c + 400 * s) / n AS dx, (a * s - 400 * c) / n AS dy, b / n AS dz FROM e),
    t AS (SELECT *, -(ox * dx + oy * dy) AS mid FROM d), l AS (SELECT *, sqrt(greatest(3168.75 - (90000 - mid * mid), 0)) AS half FROM t),
    k AS (SELECT *, unnest(range(CAST(floor(2 * half) AS BIGINT) + 1)) AS k FROM l),
    pt AS (SELECT view, r, u, ox + 31.5 + dx * (mid - half + k) AS px, oy + 31.5 + dy * (mid - half + k) AS py, 31.5 + dz * (mid - half + k) AS pz FROM k),
    cn AS (SELECT view, r, u, floor(pz) + ez AS z, floor(py) + ey AS y, floor(px) + ex AS x, (CASE ez WHEN 1 THEN pz - floor(pz) ELSE 1 - pz + floor(pz) END) * (CASE ey WHEN 1 THEN py - floor(py) ELSE 1 - py + floor(py) END)
    * (CASE ex WHEN 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) AS w FROM pt, (VALUES (0), (1)) t1(ez), (VALUES (0), (1)) t2(ey), (VALUES (0), (1)) t3(ex))
    SELECT CAST(view AS INTEGER) AS view, CAST(r AS INTEGER) AS r, CAST(u AS INTEGER) AS u, {r6_sql('sum(cn.w * coalesce(vol.v, 0))')} AS v FROM cn LEFT JOIN vol ON vol.z = cn.z AND vol.y = cn.y AND vol.x = cn.x GROUP BY view, r, u"""
)
def cone_projection(spark, sf_dir):
    rays = recon.cone_rays(recon.views(spark, 4, 2 * math.pi), (5, 6), WIDTH, 300.0, 400.0, 40.0)
    return rounded(recon.cone_project(volume(spark, sf_dir), rays, None, 1))
