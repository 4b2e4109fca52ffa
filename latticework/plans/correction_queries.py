"""Queries for corrections of projections and total variation of volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from latticework.operators import corrections, neighbors, pointwise
from latticework.plans.fixtures import A, B, VOLUME, grid_a, grid_b, near, r6, r6_sql, table, volume
from latticework.plans.registry import Registry

q = Registry()


def rounded(df, *values):
    names = values or ("v",)
    return df.select(*[c for c in df.columns if c not in names], *[r6(c).alias(c) for c in names])


_SPECTRUM = "sp AS (SELECT p_size AS energy, sum(p_retailprice) - 100 AS weight, 0.15 + 8.0 / p_size / p_size AS mu FROM part WHERE p_size >= 10 GROUP BY p_size)"


def _spectrum(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_size >= 10")
    return p.groupBy("p_size").agg((F.sum("p_retailprice") - 100).alias("weight")).select(F.col("p_size").alias("energy"), "weight", (0.15 + 8.0 / F.col("p_size") / F.col("p_size")).alias("mu"))


@q(
    f"""WITH {_SPECTRUM}, w AS (SELECT greatest(weight, 0) / sum(greatest(weight, 0)) OVER () AS w, mu FROM sp), l AS (SELECT k, 30.0 * k / 399 AS length FROM (SELECT unnest(range(400)) AS k))
    SELECT k, {r6_sql('length')} AS length, {r6_sql('-ln(sum(w * exp(-mu * length)))')} AS poly, {r6_sql('sum(w * mu) * length')} AS mono FROM l, w GROUP BY k, length"""
)
def water_hardening_curve(spark, sf_dir):
    return rounded(corrections.hardening_curve(spark, _spectrum(spark, sf_dir), 30.0), "length", "poly", "mono")


_FACTORS = [[1.4, 1.3, 1.25], [1.35, 1.28, 1.2], [1.3, 1.22, 1.18]]


@q(
    f"WITH {A}, {B}, tab(r, c, t) AS (VALUES " + ", ".join(f"({r}, {c}, {v!r}::DOUBLE)" for r, row in enumerate(_FACTORS) for c, v in enumerate(row)) + "), "
    "z AS (SELECT y, x, a.v AS v, b.v AS h FROM a JOIN b USING (y, x)), pt AS (SELECT *, least(greatest(v / 0.1, 0), 2) AS py, least(greatest(h / 0.1, 0), 2) AS px FROM z), "
    "k AS (SELECT *, least(floor(py), 1) AS r0, least(floor(px), 1) AS c0 FROM pt), "
    "f AS (SELECT y, x, v, h, sum(t * (CASE WHEN r = r0 THEN 1 - (py - r0) ELSE py - r0 END) * (CASE WHEN c = c0 THEN 1 - (px - c0) ELSE px - c0 END)) AS f FROM k JOIN tab ON r IN (r0, r0 + 1) AND c IN (c0, c0 + 1) GROUP BY y, x, v, h) "
    f"SELECT y, x, {r6_sql('v + CASE WHEN h > 0.02 THEN (1.32 - f) * h ELSE 0 END')} AS v FROM f"
)
def hard_material_weighting(spark, sf_dir):
    z = pointwise.zip_grids(grid_a(spark, sf_dir), grid_b(spark, sf_dir))
    return rounded(z.select("y", "x", corrections.weigh_hard_material(F.col("a"), F.col("b"), _FACTORS, 0.1, 1.32).alias("v")))


_GAUSS = "exp(-dy * dy / 2.88) * exp(-dx * dx / 2.88)"


@q(f"WITH {A}, {near(2, 2)} SELECT y, x, {r6_sql(f'(any_value(v) + 0.6 * sum(n * {_GAUSS}) / sum({_GAUSS})) / 0.4')} AS v FROM nb GROUP BY y, x")
def scatter_sharpening(spark, sf_dir):
    return rounded(corrections.sharpen_scatter(grid_a(spark, sf_dir), 2, 1.2, 0.6))


_DEFECT = "(y * 7 + x * 3) % 5 IN (0, 1, 2)"


@q(
    f"""WITH {A}, g AS (SELECT s.y, s.x, s.v, list_sort(list(o.v) FILTER (WHERE NOT (o.y * 7 + o.x * 3) % 5 IN (0, 1, 2))) AS l FROM a s JOIN a o ON o.y BETWEEN s.y - 1 AND s.y + 1 AND o.x BETWEEN s.x - 1 AND s.x + 1 GROUP BY s.y, s.x, s.v)
    SELECT y, x, {r6_sql(f'CASE WHEN {_DEFECT} THEN coalesce(l[len(l) // 2 + 1], v) ELSE v END')} AS v FROM g"""
)
def defect_pixels(spark, sf_dir):
    g = grid_a(spark, sf_dir)
    mask = g.select("y", "x", F.when(F.expr(_DEFECT), 0).otherwise(1).alias("m"))
    return rounded(corrections.mend_defects(g, mask))


@q(
    f"""WITH {A}, {B}, {near(1, 1)}, m AS (SELECT y, x, avg(n) AS v FROM nb GROUP BY y, x),
    e AS (SELECT sqrt(avg(pow(b.v - a.v, 2))) AS u, sqrt(avg(pow(m.v - a.v, 2))) AS c FROM a JOIN b USING (y, x) JOIN m USING (y, x)) SELECT {r6_sql('(u - c) / u')} AS improvement FROM e"""
)
def normalised_improvement(spark, sf_dir):
    g = grid_a(spark, sf_dir)
    return rounded(corrections.normalised_improvement(grid_b(spark, sf_dir), neighbors.mean_filter(g), g, ["y", "x"]), "improvement")


_D3 = f"""{A}, {VOLUME}, d AS (SELECT z, y, x, v, v - coalesce(lag(v) OVER (PARTITION BY z, y ORDER BY x), v) AS dx, v - coalesce(lag(v) OVER (PARTITION BY z, x ORDER BY y), v) AS dy,
    v - coalesce(lag(v) OVER (PARTITION BY y, x ORDER BY z), v) AS dz FROM vol)"""


@q(f"WITH {_D3} SELECT z, y, x, {r6_sql('sqrt(dx * dx + dy * dy + dz * dz)')} AS v FROM d")
def tv_magnitude_3d(spark, sf_dir):
    return rounded(corrections.tv_magnitude_3d(volume(spark, sf_dir)))


def _tv3(weight: str) -> str:
    return f"""WITH {_D3}, n AS (SELECT z, y, x, dx, dy, dz, sqrt(1e-4 + dx * dx + dy * dy + dz * dz) / ({weight}) AS n FROM d)
    SELECT c.z, c.y, c.x, {r6_sql('(c.dx + c.dy + c.dz) / c.n - coalesce(e.dx / e.n, 0) - coalesce(s.dy / s.n, 0) - coalesce(t.dz / t.n, 0)')} AS v FROM n c
    LEFT JOIN n e ON e.z = c.z AND e.y = c.y AND e.x = c.x + 1 LEFT JOIN n s ON s.z = c.z AND s.y = c.y + 1 AND s.x = c.x LEFT JOIN n t ON t.z = c.z + 1 AND t.y = c.y AND t.x = c.x"""


@q(_tv3("1.0"))
def tv_gradient_3d(spark, sf_dir):
    return rounded(corrections.tv_gradient_3d(volume(spark, sf_dir)))


@q(_tv3("1.0 / (sqrt(dx * dx + dy * dy + dz * dz) + 0.01)"))
def weighted_tv_gradient_3d(spark, sf_dir):
    v = volume(spark, sf_dir)
    return rounded(corrections.tv_gradient_3d(v, weights=corrections.tv_weights_3d(v)))
