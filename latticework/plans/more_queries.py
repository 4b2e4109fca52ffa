"""Further queries: polar images, proximal steps, volumes, phantoms, trajectories, weights, mixtures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.operators import geometry, images, interp, linalg, phantom, physics, pointwise, recon, selection
from latticework.plans.fixtures import A, B, VOLUME, WIDTH, grid_a, grid_b, r6, r6_sql, table, volume
from latticework.plans.registry import Registry

q = Registry()


def rounded(df: DataFrame, *values: str) -> DataFrame:
    names = values or ("v",)
    return df.select(*[c for c in df.columns if c not in names], *[r6(c).alias(c) for c in names])


_GXY = f"{A}, gx AS (SELECT y, x, coalesce(lead(v) OVER (PARTITION BY y ORDER BY x), v) - v AS gx FROM a), gy AS (SELECT y, x, coalesce(lead(v) OVER (PARTITION BY x ORDER BY y), v) - v AS gy FROM a), g AS (SELECT * FROM gx JOIN gy USING (y, x))"


_MEAN3 = ", ".join(f"avg({c}) OVER (PARTITION BY {{0}} ORDER BY {{1}} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS {c}" for c in "abc")


@q(
    f"""WITH {_GXY}, e0 AS (SELECT y, x, gx * gx AS a, gx * gy AS b, gy * gy AS c FROM g), e1 AS (SELECT y, x, {_MEAN3.format("y", "x")} FROM e0), e AS (SELECT y, x, {_MEAN3.format("x", "y")} FROM e1)
    SELECT y, x, {r6_sql('(a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b)')} AS large, {r6_sql('(a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b)')} AS small FROM e"""
)
def structure_tensor(spark, sf_dir):
    return rounded(images.structure_tensor(grid_a(spark, sf_dir)), "large", "small")


@q(
    f"""WITH {_GXY}, n AS (SELECT *, sqrt(gx * gx + gy * gy) AS n FROM g WHERE gx <> 0 OR gy <> 0), v AS (SELECT CAST(y + round(s * 4 * gy / n) AS BIGINT) AS y, CAST(x + round(s * 4 * gx / n) AS BIGINT) AS x, s, n FROM n, (VALUES (1), (-1)) t(s))
    SELECT y, x, sum(s) AS votes, {r6_sql('sum(s * n)')} AS strength FROM v GROUP BY y, x"""
)
def radial_symmetry(spark, sf_dir):
    return rounded(images.radial_symmetry(grid_a(spark, sf_dir), 4), "strength")


_POL = f"""sp AS (SELECT CAST(i // 36 AS INTEGER) AS r, CAST(i % 36 AS INTEGER) AS t FROM (SELECT unnest(range(20 * 36)) AS i)),
    ps AS (SELECT r, t, 40 + r * sin(t * {2 * math.pi / 36!r}) AS py, 31.5 + r * cos(t * {2 * math.pi / 36!r}) AS px FROM sp),
    pc AS (SELECT r, t, floor(py) + dy AS y, floor(px) + dx AS x, (CASE dy WHEN 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) * (CASE dx WHEN 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) AS w FROM ps, (VALUES (0), (1)) t1(dy), (VALUES (0), (1)) t2(dx)),
    pol AS (SELECT r, t, sum(w * coalesce(a.v, 0)) AS v FROM pc LEFT JOIN a USING (y, x) GROUP BY r, t)"""


@q(f"WITH {A}, {_POL} SELECT r, t, {r6_sql('v')} AS v FROM pol")
def polar_remap(spark, sf_dir):
    return rounded(images.polar(grid_a(spark, sf_dir), spark, 20, 36, (40.0, 31.5)))


@q(
    f"""WITH {A}, {_POL}, md AS (SELECT p.r, p.t, any_value(p.v) AS v, list_sort(list(o.v)) AS l FROM pol p JOIN pol o ON o.t = p.t AND o.r BETWEEN p.r - 2 AND p.r + 2 GROUP BY p.r, p.t),
    df AS (SELECT r, t, v - l[len(l) // 2 + 1] AS d FROM md)
    SELECT p.r, p.t, {r6_sql('avg(o.d)')} AS v FROM df p JOIN df o ON o.r = p.r AND (o.t - p.t + 54) % 36 BETWEEN 15 AND 21 GROUP BY p.r, p.t"""
)
def ring_artefacts(spark, sf_dir):
    return rounded(images.ring_map(images.polar(grid_a(spark, sf_dir), spark, 20, 36, (40.0, 31.5)), 36, 2, 3))


@q(f"WITH {A}, {B}, z AS (SELECT y, x, a.v AS p, b.v AS s FROM a JOIN b USING (y, x)), n AS (SELECT *, sqrt(p * p + s * s) AS n FROM z) SELECT y, x, {r6_sql('CASE WHEN n > 0.1 THEN p * (1 - 0.1 / n) ELSE 0 END')} AS p, {r6_sql('CASE WHEN n > 0.1 THEN s * (1 - 0.1 / n) ELSE 0 END')} AS s FROM n")
def group_shrinkage(spark, sf_dir):
    z = pointwise.zip_grids(grid_a(spark, sf_dir), grid_b(spark, sf_dir))
    p, s = images.group_shrink([F.col("a"), F.col("b")], 0.1)
    return rounded(z.select("y", "x", p.alias("p"), s.alias("s")), "p", "s")


@q(f"WITH {A} SELECT y, x, {r6_sql('sign(v) * greatest(abs(v) - 0.05, 0)')} AS soft, {r6_sql('CASE WHEN abs(v) <= 0.1 THEN v * v / 2 ELSE 0.1 * (abs(v) - 0.05) END')} AS huber, {r6_sql('2 / (1 + exp(-(v - 0.02) / 0.1))')} AS sigmoid FROM a")
def penalties(spark, sf_dir):
    v = F.col("v")
    out = grid_a(spark, sf_dir).select("y", "x", images.soft_threshold(v, 0.05).alias("soft"), images.huber(v, 0.1).alias("huber"), images.sigmoid(v, 0.02, 0.1, 2.0).alias("sigmoid"))
    return rounded(out, "soft", "huber", "sigmoid")


@q(f"WITH {A}, {B} SELECT y, x, {r6_sql('2.5 * a.v - 0.5 * b.v')} AS v FROM a JOIN b USING (y, x)")
def linear_combination(spark, sf_dir):
    return rounded(images.linear_combination(grid_a(spark, sf_dir), grid_b(spark, sf_dir), 2.5, -0.5, ["y", "x"]))


_FR = "f AS (SELECT z, y, x, v, sqrt(pow((CASE WHEN x <= 32 THEN x ELSE x - 64 END) / 32.0, 2) + pow((CASE WHEN z <= 5 THEN z ELSE z - 10 END) / 5.0, 2)) AS r FROM vol)"


@q(
    f"""WITH {A}, {VOLUME}, {_FR} SELECT z, y, x, {r6_sql('v * exp(-(r * r) / 0.5)')} AS gaussian, {r6_sql('v * (CASE WHEN r <= 0.5 THEN 1 ELSE 0 END)')} AS low_pass,
    {r6_sql('v * (CASE WHEN r > 0.5 THEN 1 ELSE 0 END)')} AS high_pass, {r6_sql('v * exp(-r / 0.5)')} AS exponential, {r6_sql(f'v * (CASE WHEN r < 1 THEN pow(cos({math.pi / 2!r} * r), 2) ELSE 0 END)')} AS squared_cosine FROM f"""
)
def volume_weights(spark, sf_dir):
    kinds = ("gaussian", "low_pass", "high_pass", "exponential", "squared_cosine")
    r = F.hypot(images.frequency(F.col("x"), WIDTH), images.frequency(F.col("z"), 10))
    return rounded(volume(spark, sf_dir).select("z", "y", "x", *[(F.col("v") * images.volume_weight(k, r)).alias(k) for k in kinds]), *kinds)


@q(f"WITH {A}, {VOLUME} SELECT z, {r6_sql('min(v)')} AS lowest, {r6_sql('max(v)')} AS highest, {r6_sql('avg(v)')} AS mean FROM vol GROUP BY z")
def slab_statistics(spark, sf_dir):
    return rounded(volume(spark, sf_dir).groupBy("z").agg(F.min("v").alias("lowest"), F.max("v").alias("highest"), F.avg("v").alias("mean")), "lowest", "highest", "mean")


@q(f"WITH {A}, {VOLUME}, m AS (SELECT y, x, v FROM vol WHERE z = 1) SELECT vol.z, y, x, {r6_sql('least(vol.v, m.v)')} AS v FROM vol JOIN m USING (y, x)")
def slab_minimum(spark, sf_dir):
    vol = volume(spark, sf_dir)
    return rounded(vol.join(selection.slice_of(vol, 1).withColumnRenamed("v", "_m"), ["y", "x"]).select("z", "y", "x", F.least("v", "_m").alias("v")))


# scenes


def _count_sql(where: str) -> str:
    return f"""WITH v AS (SELECT (i % 20 - 9.5) * 5 AS x, ((i // 20) % 20 - 9.5) * 5 AS y, (i // 400 - 9.5) * 5 AS z FROM (SELECT unnest(range(8000)) AS i)) SELECT count(*) AS n FROM v WHERE {where}"""


for _name, _where in {
    "sphere": "x * x + y * y + z * z <= 1600", "box": "abs(x) <= 30 AND abs(y) <= 30 AND abs(z) <= 30", "cylinder": "x * x + y * y <= 35 * 35 AND abs(z) <= 40",
    "cone": "sqrt(x * x + y * y) <= 35 * (40 - z) / 80 AND abs(z) <= 40", "ellipsoid": "pow(x / 40, 2) + pow(y / 30, 2) + pow(z / 20, 2) <= 1",
    "pyramid": "greatest(abs(x), abs(y)) <= 30 * (40 - z) / 80 AND abs(z) <= 40",
    "defrise": "x * x + y * y <= 1600 AND (abs(z + 40) <= 2 OR abs(z + 20) <= 2 OR abs(z) <= 2 OR abs(z - 20) <= 2 OR abs(z - 40) <= 2)",
}.items():
    q.add(f"scene_{_name}", (lambda n: lambda spark, sf_dir: phantom.render(spark, phantom.scene(spark, n), 20, 5.0).agg(F.count("*").alias("n")))(_name), _count_sql(_where))


@q(
    """WITH v AS (SELECT (i % 20 - 9.5) * 5 AS x, ((i // 20) % 20 - 9.5) * 5 AS y, (i // 400 - 9.5) * 5 AS z FROM (SELECT unnest(range(8000)) AS i)),
    m AS (SELECT CASE WHEN pow(x + 15, 2) + y * y + z * z <= 100 THEN 'air' WHEN pow(x - 10, 2) + y * y <= 100 AND abs(z) <= 30 THEN 'bone' WHEN x * x + y * y <= 1600 AND abs(z) <= 40 THEN 'water' END AS material FROM v)
    SELECT material, count(*) AS n FROM m WHERE material IS NOT NULL GROUP BY material"""
)
def scene_nested_materials(spark, sf_dir):
    """Of solids that hold a voxel the one of highest priority counts."""
    # scene("nested") places its cylinder's centre at p0, p1
    return phantom.render(spark, phantom.scene(spark, "nested"), 20, 5.0).groupBy("material").agg(F.count("*").alias("n"))


@q(f"WITH p AS (SELECT i // 32 AS y, i % 32 AS x FROM (SELECT unnest(range(1024)) AS i)) SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {r6_sql('CASE WHEN pow(x - 16, 2) + pow(y - 16, 2) <= pow(12.8, 2) THEN 1 ELSE 0 END')} AS v FROM p")
def uniform_disc(spark, sf_dir):
    return rounded(phantom.disc(spark, 32))


# trajectories

_TR = 2 * math.pi / 16


@q(
    f"""WITH t AS (SELECT CAST(k AS INTEGER) AS view, k * {_TR!r} AS a FROM (SELECT unnest(range(16)) AS k)), w AS (SELECT view, a, 400 - (10 * cos(a) + 20 * sin(a)) AS d FROM t)
    SELECT view, {r6_sql('(-10 * sin(a) + 20 * cos(a)) * 800 / 2 / d + 127.5')} AS u, {r6_sql('-5.0 * 800 / 2 / d + 63.5')} AS v, {r6_sql('d')} AS depth FROM w"""
)
def circular_trajectory(spark, sf_dir):
    m = geometry.circular(spark, 16, 400.0, 800.0, 2.0, 256, 128)
    p = spark.createDataFrame([(10.0, 20.0, 5.0)], "x double, y double, z double")
    return rounded(geometry.project_points(p, m).select("view", "u", "v", "depth"), "u", "v", "depth")


@q(
    f"""WITH t AS (SELECT CAST(k AS INTEGER) AS view, k * {_TR!r} AS a FROM (SELECT unnest(range(16)) AS k)), w AS (SELECT view, a, 400 - (10 * cos(a) + 20 * sin(a)) AS d FROM t)
    SELECT view, {r6_sql(f'-(5.0 - 30 * a / {2 * math.pi!r}) * 800 / 2 / d + 63.5')} AS v FROM w"""
)
def helical_trajectory(spark, sf_dir):
    m = geometry.circular(spark, 16, 400.0, 800.0, 2.0, 256, 128, pitch=30.0)
    p = spark.createDataFrame([(10.0, 20.0, 5.0)], "x double, y double, z double")
    return rounded(geometry.project_points(p, m).select("view", "v"), "v")


@q("SELECT CAST(24 AS BIGINT) AS views, 24 AS last")
def circle_plus_line(spark, sf_dir):
    m = geometry.circle_plus_line(spark, 16, 8, 100.0, source_axis=400.0, source_detector=800.0, pixel=2.0, width=256, height=128)
    return m.agg(F.count("*").alias("views"), (F.max("view") + 1).alias("last"))


# weights and kernels


@q(
    f"""WITH t AS (SELECT i, j, i * {(math.pi + 0.5) / 40!r} AS b, (j - 10) * 0.0225::DOUBLE AS g FROM (SELECT unnest(range(41)) AS i), (SELECT unnest(range(21)) AS j))
    SELECT i, j, {r6_sql(f'CASE WHEN b >= 0 AND b <= {math.pi!r} - 2 * g AND b <= {math.pi + 0.5!r} THEN 1 ELSE 0 END')} AS w FROM t"""
)
def binary_weights(spark, sf_dir):
    t = spark.range(41).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(20).cast("long"))).alias("j"))
    return rounded(t.select("i", "j", recon.binary_weight(F.col("i") * ((math.pi + 0.5) / 40), (F.col("j") - 10) * 0.0225, 0.25).alias("w")), "w")


@q(
    f"""WITH n AS (SELECT unnest(range(-20, 21)) AS n) SELECT n, {r6_sql(f'CASE WHEN n = 0 THEN 0.5 WHEN n % 2 <> 0 THEN -1 / ({math.pi**2!r}::DOUBLE * 0.5 * n * n) ELSE 0 END')} AS ram_lak,
    {r6_sql(f'-2 / ({math.pi**2!r}::DOUBLE * 0.5 * (4 * n * n - 1))')} AS shepp_logan, {r6_sql(f'CASE WHEN n % 2 <> 0 THEN 2 / ({math.pi!r}::DOUBLE * 0.5 * n) ELSE 0 END')} AS hilbert,
    {r6_sql('CASE n WHEN 1 THEN -2 WHEN 0 THEN 2 ELSE 0 END')} AS derivative, {r6_sql('CASE WHEN n = 0 THEN 2 WHEN abs(n) = 1 THEN -1 ELSE 0 END')} AS laplace FROM n"""
)
def spatial_kernels(spark, sf_dir):
    kinds = ("ram_lak", "shepp_logan", "hilbert", "derivative", "laplace")
    n = F.col("n")
    t = spark.range(-20, 21).select(F.col("id").alias("n"))
    return rounded(t.select("n", *[F.when(n.isNotNull(), recon.ramp_kernel(k, n, 0.5)).alias(k) for k in kinds]), *kinds)


@q(
    f"""WITH {A}, r AS (SELECT y, list(v ORDER BY x) AS r FROM a GROUP BY y), e AS (SELECT y, r, unnest(range(-4, 68)) AS k FROM r)
    SELECT y, CAST(k + 4 AS INTEGER) AS x, {r6_sql(f'CASE WHEN k < 0 THEN (2 * r[1] - r[-k + 1]) * pow(sin((4 + k) / 4.0 * {math.pi / 2!r}), 0.75) WHEN k > 63 THEN (2 * r[64] - r[64 - (k - 63)]) * pow(sin((4 - (k - 63)) / 4.0 * {math.pi / 2!r}), 0.75) ELSE r[k + 1] END')} AS v FROM e"""
)
def truncation_correction(spark, sf_dir):
    from latticework.operators import grids

    return rounded(grids.to_long(recon.truncation_taper(grids.to_rows(grid_a(spark, sf_dir)), 4)))


@q(
    f"""WITH {A}, d AS (SELECT y AS view, x AS line, v FROM a), p AS (SELECT y AS a, y + 1 AS b, x AS plane, x AS la, 63 - x AS lb FROM a)
    SELECT a, b, {r6_sql('avg(pow(l.v - r.v, 2))')} AS inconsistency FROM p JOIN d l ON l.view = a AND l.line = la JOIN d r ON r.view = b AND r.line = lb GROUP BY a, b"""
)
def epipolar_consistency(spark, sf_dir):
    g = grid_a(spark, sf_dir)
    pairs = g.select(F.col("y").alias("a"), (F.col("y") + 1).alias("b"), F.col("x").alias("plane"), F.col("x").alias("line_a"), (63 - F.col("x")).alias("line_b"))
    out = recon.epipolar_consistency(g.select(F.col("y").alias("view"), F.col("x").alias("line"), "v"), pairs)
    return rounded(out, "inconsistency")


# materials


@q(
    f"""WITH c(material, element, weight) AS (VALUES ('water', 'H', 0.111::DOUBLE), ('water', 'O', 0.889::DOUBLE), ('bone', 'Ca', 0.4::DOUBLE), ('bone', 'O', 0.4::DOUBLE), ('bone', 'H', 0.1::DOUBLE)),
    e AS (SELECT unnest([20.0, 40.0, 80.0])::DOUBLE AS energy), k(element, f) AS (VALUES ('H', 1.0::DOUBLE), ('O', 8.0::DOUBLE), ('Ca', 20.0::DOUBLE))
    SELECT material, energy, {r6_sql('sum(weight * f / energy) / sum(weight)')} AS mu_rho FROM c JOIN k USING (element), e GROUP BY material, energy"""
)
def mixture_attenuation(spark, sf_dir):
    c = spark.createDataFrame([("water", "H", 0.111), ("water", "O", 0.889), ("bone", "Ca", 0.4), ("bone", "O", 0.4), ("bone", "H", 0.1)], "material string, element string, weight double")
    k = spark.createDataFrame([(e, x, f / x) for e, f in (("H", 1.0), ("O", 8.0), ("Ca", 20.0)) for x in (20.0, 40.0, 80.0)], "element string, energy double, mu_rho double")
    return rounded(physics.mixture(c, k), "mu_rho")


@q(f"WITH l AS (SELECT l_orderkey AS ray, sum(l_quantity * (1 + l_suppkey % 3 * 0.5)) AS v FROM lineitem GROUP BY 1) SELECT ray, {r6_sql('v')} AS v FROM l")
def density_absorption(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rounded(li.groupBy(F.col("l_orderkey").alias("ray")).agg(F.sum(F.col("l_quantity") * (1 + F.col("l_suppkey") % 3 * 0.5)).alias("v")))


# vectors


@q(f"WITH p AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS a, CAST(embedding[5] AS DOUBLE) AS b, CAST(embedding[6] AS DOUBLE) AS c FROM embeddings) SELECT id, {r6_sql('a - x')} AS dx, {r6_sql('y * c - z * b')} AS mx, {r6_sql('x * b - y * a')} AS mz FROM p")
def plucker_lines(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate("xyzabc")])
    out = e.select("id", linalg.plucker(linalg.vec(F.col("x"), F.col("y"), F.col("z")), linalg.vec(F.col("a"), F.col("b"), F.col("c"))).alias("l"))
    return rounded(out.select("id", F.col("l")[0].alias("dx"), F.col("l")[3].alias("mx"), F.col("l")[5].alias("mz")), "dx", "mx", "mz")


@q(f"SELECT vec_id, {r6_sql('list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))')} AS v FROM embeddings")
def inner_product(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("r"))
    return rounded(e.select("vec_id", linalg.inner(F.col("r"), F.col("r")).alias("v")))


@q(f"WITH {A} SELECT y, x, {r6_sql('v - 0.6 * (0.6 * v + 0.8 * x)')} AS px, {r6_sql('x - 0.8 * (0.6 * v + 0.8 * x)')} AS pz FROM a")
def planar_motion(spark, sf_dir):
    m = geometry.planar({"x": F.col("v"), "y": F.lit(0.0), "z": F.col("x").cast("double")}, (0.6, 0.0, 0.8))
    return rounded(grid_a(spark, sf_dir).select("y", "x", m["x"].alias("px"), m["z"].alias("pz")), "px", "pz")


@q("SELECT vec_id AS id, 0.25::DOUBLE AS v FROM embeddings")
def uniform_spline_of_a_constant(spark, sf_dir):
    """A spline through equal control values is constant."""
    t = F.abs(F.get("embedding", F.lit(0)).cast("double")) % 1
    return rounded(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), geometry.uniform_cubic(t, [0.25] * 5).alias("v")))


@q(f"WITH {A}, {B} SELECT y, x, {r6_sql('exp(ln(abs(a.v) + 1) + (ln(abs(b.v) + 2) - ln(abs(a.v) + 1)) * 0.25)')} AS v FROM a JOIN b USING (y, x)")
def log_linear_interpolation(spark, sf_dir):
    z = pointwise.zip_grids(grid_a(spark, sf_dir), grid_b(spark, sf_dir))
    return rounded(z.select("y", "x", interp.between(F.lit(0.25), F.lit(0.0), F.abs("a") + 1, F.lit(1.0), F.abs("b") + 2, "log_lin").alias("v")))


@q(f"WITH {A} SELECT y, x, {r6_sql('v')} AS v FROM a WHERE v > 0.2 EXCEPT SELECT y, x, {r6_sql('v')} FROM a WHERE x < 8")
def cell_difference(spark, sf_dir):
    g = grid_a(spark, sf_dir)
    return rounded(selection.set_difference(g.filter("v > 0.2"), g.filter("x < 8"), ["y", "x"]))


@q(f"WITH {A} SELECT y, x, {r6_sql('v')} AS v FROM a WHERE v > 0.2 AND x < 8")
def cell_intersection(spark, sf_dir):
    g = grid_a(spark, sf_dir)
    return rounded(selection.set_intersection(g.filter("v > 0.2"), g.filter("x < 8"), ["y", "x"]))
