"""Queries over grids: point-wise operators, reductions, restructuring and neighbourhoods."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import ieee
from latticework.operators import grids, neighbors, pointwise
from latticework.operators import reduce as red
from latticework.operators import selection as sel
from latticework.plans.fixtures import A, B, DIRTY, ROI, VALID, VOLUME, WIDTH, grid_a, grid_b, grid_dirty, labelled, near, r6, r6_sql, roi, volume
from latticework.plans.registry import Registry

q = Registry()


def rounded(df: DataFrame, *values: str) -> DataFrame:
    names = values or ("v",)
    return df.select(*[c for c in df.columns if c not in names], *[r6(c).alias(c) for c in names])


def cells(sql_value: str, source: str = "a", ctes: str = A, where: str = "") -> str:
    return f"WITH {ctes} SELECT y, x, {r6_sql(sql_value)} AS v FROM {source} {where}"


@q(f"WITH {A} SELECT y, {r6_sql('sum(v + 2)')} AS s FROM a GROUP BY y")
def grid_sum_by_row(spark, sf_dir):
    return rounded(red.reduce_grid(pointwise.apply_scalar(grid_a(spark, sf_dir), "add", 2.0), ["sum"], ["y"]).withColumnRenamed("sum", "s"), "s")


# point-wise, grid and grid

_OK = lambda c: VALID.format(c)
BINARY_SQL = {
    "add": "a.v + b.v",
    "subtract": "a.v - b.v",
    "multiply": "a.v * b.v",
    "divide": "CASE WHEN b.v = 0 THEN CASE WHEN a.v = 0 OR isnan(a.v) THEN 'nan'::DOUBLE WHEN a.v > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE a.v / b.v END",
    "add_safe": f"CASE WHEN {_OK('a.v')} THEN a.v ELSE 0 END + CASE WHEN {_OK('b.v')} THEN b.v ELSE 0 END",
    "subtract_safe": f"CASE WHEN {_OK('b.v')} THEN b.v ELSE 0 END - CASE WHEN {_OK('a.v')} THEN a.v ELSE 0 END",
    "multiply_safe": f"CASE WHEN {_OK('a.v')} AND {_OK('b.v')} THEN a.v * b.v ELSE 0 END",
    "divide_safe": f"CASE WHEN {_OK('a.v')} AND {_OK('b.v')} AND a.v <> 0 AND b.v <> 0 THEN a.v / b.v ELSE 0 END",
}
_DB = "db AS (SELECT y, 63 - x AS x, v FROM d)"


def _binary(op: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = grid_dirty(spark, sf_dir)
        if not op.endswith("_safe"):
            return rounded(pointwise.apply_binary(grid_a(spark, sf_dir), grid_b(spark, sf_dir), op))
        return rounded(pointwise.apply_binary(d, d.withColumn("x", (F.lit(WIDTH - 1) - F.col("x")).cast("int")), op))

    if op.endswith("_safe"):
        return run, f"WITH {A}, {DIRTY}, {_DB} SELECT y, x, {r6_sql(BINARY_SQL[op])} AS v FROM d a JOIN db b USING (y, x)"
    return run, f"WITH {A}, {B} SELECT y, x, {r6_sql(BINARY_SQL[op])} AS v FROM a JOIN b USING (y, x)"


for _op in pointwise.BINARY:
    q.add(f"grid_{_op}", *_binary(_op))

# point-wise, grid and number

SCALAR_SQL = {
    "add": ("v + {c}", 2.0), "subtract": ("v - {c}", 0.5), "multiply": ("v * {c}", 3.0), "divide": ("v / {c}", 4.0),
    "add_safe": (f"CASE WHEN {_OK('v')} THEN v ELSE 0 END + {{c}}", 2.0), "subtract_safe": (f"CASE WHEN {_OK('v')} THEN v ELSE 0 END - {{c}}", 0.5),
    "multiply_safe": (f"CASE WHEN {_OK('v')} THEN v * {{c}} ELSE 0 END", 3.0), "divide_safe": (f"CASE WHEN {_OK('v')} THEN v / {{c}} ELSE 0 END", 4.0),
    "pow": ("pow(v, {c})", 2.0), "set_max": ("CASE WHEN NOT isnan(v) AND v > {c} THEN {c} ELSE v END", 0.1),
    "set_min": ("CASE WHEN NOT isnan(v) AND v < {c} THEN {c} ELSE v END", -0.1), "fill_invalid": (f"CASE WHEN {_OK('v')} THEN v ELSE {{c}} END", 7.0),
    "threshold": ("CASE WHEN NOT isnan(v) AND v > {c} THEN v ELSE 0 END", 0.05), "binarize": ("CASE WHEN NOT isnan(v) AND v >= {c} THEN 1 ELSE 0 END", 0.05),
}


def _scalar(op: str):
    text, c = SCALAR_SQL[op]
    dirty = op not in ("add", "subtract", "multiply", "divide", "pow")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(pointwise.apply_scalar((grid_dirty if dirty else grid_a)(spark, sf_dir), op, c))

    value = text.format(c=f"{c}::DOUBLE")
    return run, cells(value, "d", f"{A}, {DIRTY}") if dirty else cells(value)


for _op in pointwise.SCALAR:
    q.add(f"scalar_{_op}", *_scalar(_op))

UNARY_SQL = {
    "abs": "abs(v)", "square": "v * v", "sqrt": "CASE WHEN v < 0 THEN 'nan'::DOUBLE ELSE sqrt(v) END",
    "log": "CASE WHEN isnan(v) OR v < 0 THEN 'nan'::DOUBLE WHEN v = 0 THEN '-inf'::DOUBLE ELSE ln(v) END", "exp": "exp(v)",
    "remove_negative": "CASE WHEN NOT isnan(v) AND v < 0 THEN 0 ELSE v END",
}


def _unary(op: str):
    dirty = op in ("abs", "remove_negative")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(pointwise.apply_unary((grid_dirty if dirty else grid_a)(spark, sf_dir), op))

    return run, cells(UNARY_SQL[op], "d", f"{A}, {DIRTY}") if dirty else cells(UNARY_SQL[op])


for _op in pointwise.UNARY:
    q.add(f"pointwise_{_op}", *_unary(_op))


@q(cells("2.5"))
def grid_fill(spark, sf_dir):
    return rounded(pointwise.fill(grid_a(spark, sf_dir), 2.5))


@q(f"WITH {A}, {B} SELECT y, x, {r6_sql('b.v')} AS v FROM a JOIN b USING (y, x)")
def grid_copy(spark, sf_dir):
    return rounded(pointwise.copy(grid_a(spark, sf_dir), grid_b(spark, sf_dir)))


@q(cells("((0.5 * v + 0.25) * v - 1.0) * v + 0.125"))
def water_precorrection(spark, sf_dir):
    return rounded(grid_a(spark, sf_dir).withColumn("v", pointwise.horner(F.col("v"), [0.125, -1.0, 0.25, 0.5])))


@q(cells("greatest(v * 9000 - 500, -1024)"))
def hounsfield_scaling(spark, sf_dir):
    return rounded(grid_a(spark, sf_dir).withColumn("v", pointwise.hounsfield(F.col("v"), 9000.0, -500.0)))


@q(cells("CASE WHEN v / 0.2 < 0.05 / 0.2 THEN 0 ELSE v / 0.2 END"))
def attenuation_factor(spark, sf_dir):
    return rounded(grid_a(spark, sf_dir).withColumn("v", pointwise.attenuation_factor(F.col("v"), 0.2, 0.05)))


@q(cells("least(greatest(CASE WHEN isnan(v) THEN 0 ELSE v END, -0.1), 0.1)", "d", f"{A}, {DIRTY}"))
def extreme_value_truncation(spark, sf_dir):
    return rounded(grid_dirty(spark, sf_dir).withColumn("v", pointwise.truncate_extremes(F.col("v"), -0.1, 0.1)))


@q(cells("CASE WHEN isnan(v) THEN v WHEN isinf(v) AND v > 0 THEN 9 ELSE v END", "d", f"{A}, {DIRTY}"))
def replace_intensity(spark, sf_dir):
    return rounded(grid_dirty(spark, sf_dir).withColumn("v", pointwise.replace_value(F.col("v"), float("inf"), 9.0)))


@q(cells("v * 100.0 / sqrt(10000.0 + (x - 31.5) * (x - 31.5) + (y * 0.01 - 2.0) * (y * 0.01 - 2.0))"))
def cosine_weighting(spark, sf_dir):
    w = pointwise.cosine_weight(F.col("x") - 31.5, F.col("y") * 0.01 - 2.0, 100.0)
    return rounded(grid_a(spark, sf_dir).withColumn("v", F.col("v") * w))


@q(
    f"WITH {A} SELECT y, x, {r6_sql('CASE WHEN round(v * 40) BETWEEN -5 AND 5 THEN coalesce(g, v * 40) ELSE v * 40 END')} AS v FROM a "
    "LEFT JOIN (VALUES (-3, 30.5), (0, 1.5), (2, -7.25), (9, 4.0)) t(k, g) ON k = CAST(round(v * 40) AS INTEGER)"
)
def gain_correction(spark, sf_dir):
    scaled = grid_a(spark, sf_dir).withColumn("v", F.col("v") * 40)
    return rounded(scaled.withColumn("v", pointwise.lookup_gain(F.col("v"), {-3: 30.5, 0: 1.5, 2: -7.25, 9: 4.0}, -5, 5)))


@q(
    f"""WITH {A}, {B}, c AS (SELECT y, x, a.v AS p, b.v AS s, b.v AS t, a.v + 1 AS u FROM a JOIN b USING (y, x))
    SELECT y, x, {r6_sql('p * t - s * u')} AS mul_re, {r6_sql('p * u + s * t')} AS mul_im, {r6_sql('(p * t + s * u) / (t * t + u * u)')} AS div_re,
           {r6_sql('(s * t - p * u) / (t * t + u * u)')} AS div_im, {r6_sql('sqrt(p * p + s * s)')} AS magnitude, {r6_sql('atan2(s, p)')} AS phase,
           {r6_sql('p + t')} AS add_re, {r6_sql('s - u')} AS sub_im, {r6_sql('-s')} AS conj_im FROM c"""
)
def complex_arithmetic(spark, sf_dir):
    z = pointwise.zip_grids(grid_a(spark, sf_dir), grid_b(spark, sf_dir))
    m, n = pointwise.complex_of(F.col("a"), F.col("b")), pointwise.complex_of(F.col("b"), F.col("a") + 1)
    z = z.select("y", "x", m.alias("m"), n.alias("n"))
    m, n = F.col("m"), F.col("n")
    out = z.select(
        "y", "x", pointwise.complex_multiply(m, n).alias("mul"), pointwise.complex_divide(m, n).alias("div"), pointwise.magnitude(m).alias("magnitude"),
        pointwise.phase(m).alias("phase"), pointwise.complex_add(m, n)["re"].alias("add_re"), pointwise.complex_subtract(m, n)["im"].alias("sub_im"),
        pointwise.complex_conjugate(m)["im"].alias("conj_im"),
    )
    out = out.withColumns({f"{k}_{p}": F.col(f"{k}.{p}") for k in ("mul", "div") for p in ("re", "im")}).drop("mul", "div")
    return rounded(out, *[c for c in out.columns if c not in ("y", "x")])


# reductions


@q(
    f"""WITH {A}, {DIRTY} SELECT {r6_sql(f"coalesce(sum(v) FILTER ({_OK('v')}), 0)")} AS sum_safe, {r6_sql('min(v) FILTER (NOT isnan(v))')} AS "min",
    {r6_sql('max(v) FILTER (NOT isnan(v))')} AS "max", {r6_sql(f"coalesce(sum(abs(v)) FILTER ({_OK('v')}), 0)")} AS norm_l1,
    {r6_sql(f"sqrt(sum(v * v) FILTER ({_OK('v')}))")} AS norm_l2, count(*) FILTER ({_OK('v')} AND v < 0) AS count_negative, count(*) FILTER (NOT {_OK('v')}) AS count_invalid FROM d"""
)
def invalid_counts(spark, sf_dir):
    out = red.reduce_grid(grid_dirty(spark, sf_dir), ["sum_safe", "min", "max", "norm_l1", "norm_l2", "count_negative", "count_invalid"])
    return rounded(out, "sum_safe", "min", "max", "norm_l1", "norm_l2")


@q(f'WITH {A} SELECT y, {r6_sql("sum(v)")} AS "sum", {r6_sql("avg(v)")} AS mean, {r6_sql("min(v)")} AS "min", {r6_sql("max(v)")} AS "max" FROM a GROUP BY y')
def row_statistics(spark, sf_dir):
    return rounded(red.reduce_grid(grid_a(spark, sf_dir), ["sum", "mean", "min", "max"], ["y"]), "sum", "mean", "min", "max")


@q(
    f"""WITH {A}, {DIRTY}, m AS (SELECT sum(v) FILTER ({_OK('v')}) / count(*) AS mean FROM d)
    SELECT {r6_sql(f"sqrt(sum((v - mean) * (v - mean)) FILTER ({_OK('v')}) / count(*))")} AS stddev FROM d, m"""
)
def stddev_with_invalid(spark, sf_dir):
    d = grid_dirty(spark, sf_dir)
    mean = red.mean_variance(d).select(F.col("mean").alias("_mean"))
    return rounded(red.reduce_grid(d.crossJoin(F.broadcast(mean)), ["stddev"]), "stddev")


@q(
    f"""WITH {A}, {B}, z AS (SELECT a.v AS p, b.v AS s FROM a JOIN b USING (y, x))
    SELECT {r6_sql('sum(p * s)')} AS dot, {r6_sql('sum(p * (s * 1.5 + 0.25))')} AS weighted_dot, {r6_sql('sum(pow(p - (s * 1.5 + 0.25), 2))')} AS weighted_ssd,
    {r6_sql('sqrt(avg((p - s) * (p - s)))')} AS rmse, {r6_sql('avg((p - s) * (p - s))')} AS mse FROM z"""
)
def grid_similarity(spark, sf_dir):
    out = red.similarity(pointwise.zip_grids(grid_a(spark, sf_dir), grid_b(spark, sf_dir)), 1.5, 0.25)
    return rounded(out, *out.columns)


_ZR = f"{A}, {B}, {ROI}, z AS (SELECT y, x, a.v AS p, b.v AS s, m FROM a JOIN b USING (y, x) JOIN roi USING (y))"


@q(
    f"""WITH {_ZR} SELECT count(*) AS n, {r6_sql('avg(p)')} AS ma, {r6_sql('avg(s)')} AS mb, {r6_sql('avg(p * p) - pow(avg(p), 2)')} AS va,
    {r6_sql('avg(s * s) - pow(avg(s), 2)')} AS vb, {r6_sql('avg(p * s) - avg(p) * avg(s)')} AS cov FROM z WHERE m <> 0"""
)
def roi_stats(spark, sf_dir):
    z = pointwise.zip_grids(grid_a(spark, sf_dir), grid_b(spark, sf_dir)).join(roi(spark, sf_dir), "y")
    return rounded(red.moments(z, F.col("m") != 0), "ma", "mb", "va", "vb", "cov")


@q(
    f"WITH {_ZR} SELECT {r6_sql('sum(p * s) FILTER (m <> 0)')} AS dot_roi, {r6_sql('sqrt(sum((p - s) * (p - s)) FILTER (m <> 0) / count(*) FILTER (m <> 0))')} AS rmse_roi, "
    f"count(*) FILTER (m <> 0) AS roi_cells, {r6_sql('avg(p) FILTER (m <> 0)')} AS mask_mean FROM z"
)
def roi_similarity(spark, sf_dir):
    z = pointwise.zip_grids(grid_a(spark, sf_dir), grid_b(spark, sf_dir)).join(roi(spark, sf_dir), "y").filter("m <> 0")
    out = z.agg(
        F.sum(F.col("a") * F.col("b")).alias("dot_roi"), F.sqrt(F.avg(F.pow(F.col("a") - F.col("b"), 2))).alias("rmse_roi"), F.count("*").alias("roi_cells"), F.avg("a").alias("mask_mean")
    )
    return rounded(out, "dot_roi", "rmse_roi", "mask_mean")


def _ssim_sql(where: str) -> str:
    c1, c2 = 0.01**2, 0.03**2
    return f"""WITH {_ZR}, g AS (SELECT avg(p) AS ma, avg(s) AS mb, avg(p * p) - pow(avg(p), 2) AS va, avg(s * s) - pow(avg(s), 2) AS vb, avg(p * s) - avg(p) * avg(s) AS cov FROM z {where})
    SELECT {r6_sql(f'((2 * ma * mb + {c1}) * (2 * cov + {c2})) / ((ma * ma + mb * mb + {c1}) * (va + vb + {c2}))')} AS ssim FROM g"""


@q(_ssim_sql(""))
def ssim_global(spark, sf_dir):
    return rounded(red.ssim(pointwise.zip_grids(grid_a(spark, sf_dir), grid_b(spark, sf_dir))), "ssim")


@q(_ssim_sql("WHERE m <> 0"))
def ssim_roi(spark, sf_dir):
    z = pointwise.zip_grids(grid_a(spark, sf_dir), grid_b(spark, sf_dir)).join(roi(spark, sf_dir), "y")
    return rounded(red.ssim(z, mask=F.col("m") != 0), "ssim")


@q(
    f"""WITH {A}, z AS (SELECT p_size::DOUBLE AS a, p_retailprice AS b FROM part),
    g AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(a * a) - avg(a) * avg(a) AS va, avg(b * b) - avg(b) * avg(b) AS vb, avg(a * b) - avg(a) * avg(b) AS cov FROM z)
    SELECT {r6_sql('cov / (sqrt(va) * sqrt(vb))')} AS pearson, {r6_sql('2 * cov / (va + vb + (ma - mb) * (ma - mb))')} AS concordance,
    {r6_sql('(2 * cov * 2 * ma * mb) / ((va + vb) * (ma * ma + mb * mb))')} AS uqi, {r6_sql('cov / n')} AS covariance_twice FROM g"""
)
def agreement_measures(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    out = red.agreement(part)
    return rounded(out, *out.columns)


@q(f"WITH {A}, {VOLUME} SELECT y, x, {r6_sql('min(v)')} AS lowest, {r6_sql('max(v)')} AS highest, {r6_sql('avg(v)')} AS mean, {r6_sql('list_sort(list(v))[len(list(v)) // 2 + 1]')} AS median FROM vol GROUP BY y, x")
def temporal_projections(spark, sf_dir):
    return rounded(red.temporal_projection(volume(spark, sf_dir)), "lowest", "highest", "mean", "median")


@q(f"WITH {A}, {VOLUME}, r AS (SELECT y, x, list_sort(list(v))[len(list(v)) // 2 + 1] AS bg FROM vol GROUP BY y, x) SELECT z, y, x, {r6_sql('v - bg')} AS v FROM vol JOIN r USING (y, x)")
def background_subtraction(spark, sf_dir):
    vol = volume(spark, sf_dir)
    bg = red.temporal_projection(vol).select("y", "x", F.col("median").alias("_bg"))
    return rounded(vol.join(bg, ["y", "x"]).select("z", "y", "x", (F.col("v") - F.col("_bg")).alias("v")))


@q(f"WITH {A}, {VOLUME} SELECT vol.z, y, x, {r6_sql('vol.v - r.v')} AS v FROM vol JOIN (SELECT y, x, v FROM vol WHERE z = 0) r USING (y, x)")
def digital_subtraction(spark, sf_dir):
    vol = volume(spark, sf_dir)
    return rounded(vol.join(sel.slice_of(vol, 0).withColumnRenamed("v", "_r"), ["y", "x"]).select("z", "y", "x", (F.col("v") - F.col("_r")).alias("v")))


@q(f"WITH {A}, {VOLUME} SELECT y, x, {r6_sql('max(v)')} AS v FROM vol GROUP BY y, x")
def maximum_intensity_projection(spark, sf_dir):
    return rounded(volume(spark, sf_dir).groupBy("y", "x").agg(F.max("v").alias("v")))


@q(f"WITH {A}, {VOLUME} SELECT z, count(*) FILTER (v > 0.1) AS above, count(*) FILTER (v < 0.1) AS below FROM vol GROUP BY z")
def autofocus_counts(spark, sf_dir):
    return volume(spark, sf_dir).groupBy("z").agg(F.count_if(F.col("v") > 0.1).alias("above"), F.count_if(F.col("v") < 0.1).alias("below"))


@q(
    f"""WITH {A}, r AS (SELECT min(v) AS lo, max(v) AS hi FROM a),
    h AS (SELECT least(floor((v - lo) / ((hi - lo) / 255)), 254) AS bin, count(*) AS n FROM a, r GROUP BY 1),
    c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS s, sum(n) OVER () AS t FROM h)
    SELECT {r6_sql('min(bin) * ((hi - lo) / 255) + lo')} AS percentile FROM c, r WHERE s >= 0.9 * t GROUP BY lo, hi"""
)
def histogram_percentile(spark, sf_dir):
    g = grid_a(spark, sf_dir)
    low, high = g.agg(F.min("v"), F.max("v")).first()
    return rounded(red.histogram_percentile(red.histogram(g, low, high), 0.9, low, high), "percentile")


@q(f"WITH {A}, t AS (SELECT y, x, v * 1000 - lag(v * 1000) OVER (PARTITION BY y ORDER BY x) AS d FROM a) SELECT y, {r6_sql('avg(CASE WHEN abs(d) > 180 THEN 360 - abs(d) ELSE abs(d) END)')} AS average_increment FROM t GROUP BY y")
def average_angular_increment(spark, sf_dir):
    return rounded(red.average_increment(grid_a(spark, sf_dir).withColumn("v", F.col("v") * 1000), ["y"], "x", "v"), "average_increment")


# normalisation


@q(f"WITH {A}, {VOLUME} SELECT z, y, x, {r6_sql('(v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w)')} AS v FROM vol WINDOW w AS (PARTITION BY z)")
def minmax_slice(spark, sf_dir):
    return rounded(sel.normalize(volume(spark, sf_dir), "minmax"))


@q(f"WITH {A}, {VOLUME} SELECT z, y, x, {r6_sql('(v - avg(v) OVER w) / stddev_pop(v) OVER w')} AS v FROM vol WINDOW w AS (PARTITION BY z)")
def zscore_slice(spark, sf_dir):
    return rounded(sel.normalize(volume(spark, sf_dir), "zscore"))


@q(f"WITH {A}, {VOLUME} SELECT z, y, x, {r6_sql('least(greatest((v - avg(v) OVER w) / stddev_pop(v) OVER w, -1.5), 1.5)')} AS v FROM vol WINDOW w AS (PARTITION BY z)")
def cutoff_slice(spark, sf_dir):
    return rounded(sel.normalize(volume(spark, sf_dir), "cutoff", 1.5))


# restructuring


@q(f"WITH {A}, {VOLUME} SELECT y, x, {r6_sql('v')} AS v FROM vol WHERE z = 3")
def slice_select(spark, sf_dir):
    return rounded(sel.slice_of(volume(spark, sf_dir), 3))


@q(f"WITH {A}, {VOLUME} SELECT z, y, x, {r6_sql('CASE WHEN z = 3 THEN -1 ELSE v END')} AS v FROM vol")
def slice_replace(spark, sf_dir):
    vol = volume(spark, sf_dir)
    return rounded(sel.set_slice(vol, 3, pointwise.fill(sel.slice_of(vol, 3), -1.0)))


@q(cells("v", ctes=f"{A}, f AS (SELECT y, 63 - x AS x, v FROM a)", source="f"))
def flip_horizontal(spark, sf_dir):
    return rounded(sel.flip(grid_a(spark, sf_dir), WIDTH))


@q(f"WITH {A} SELECT 63 - x AS y, y AS x, {r6_sql('v')} AS v FROM a")
def rotate_left(spark, sf_dir):
    return rounded(sel.rotate_left(grid_a(spark, sf_dir), WIDTH))


@q(f"WITH {A} SELECT x AS y, y AS x, {r6_sql('v')} AS v FROM a")
def transpose(spark, sf_dir):
    return rounded(sel.transpose(grid_a(spark, sf_dir)))


@q(f"WITH {A} SELECT y, x - 8 AS x, {r6_sql('v')} AS v FROM a WHERE x BETWEEN 8 AND 23")
def sub_range(spark, sf_dir):
    return rounded(sel.sub_range(grid_a(spark, sf_dir), 8, 16))


@q(f"WITH {A}, {VOLUME} SELECT y * 640 + x * 10 + z AS i, {r6_sql('v')} AS v FROM vol")
def linear_index(spark, sf_dir):
    return volume(spark, sf_dir).select(grids.linear_index([("z", 10), ("x", WIDTH), ("y", 1 << 40)]).alias("i"), r6("v").alias("v"))


@q(f"WITH {A}, {VOLUME} SELECT z // 2 AS z, y, x, {r6_sql('max(v) FILTER (z % 2 = 0)')} AS ch0, {r6_sql('max(v) FILTER (z % 2 = 1)')} AS ch1 FROM vol GROUP BY z // 2, y, x")
def multi_channel(spark, sf_dir):
    return rounded(sel.to_channels(volume(spark, sf_dir), 2), "ch0", "ch1")


@q(f"WITH {A} SELECT y, x FROM a WHERE v > 0.15")
def thresholded_points(spark, sf_dir):
    return sel.points_above(grid_a(spark, sf_dir), 0.15)


@q(f"WITH {A} SELECT y, x, {r6_sql('v')} AS v FROM a WHERE x BETWEEN 10 AND 50 AND (x - 31.5) * (x - 31.5) + (y - 100.0) * (y - 100.0) <= 900")
def volume_of_interest(spark, sf_dir):
    inside = sel.in_box({"x": (10, 50)}) & sel.in_cylinder("x", "y", 31.5, 100.0, 30.0)
    return rounded(grid_a(spark, sf_dir).filter(inside))


@q(f"WITH {A} SELECT y, x, x * 0.5 - 15.75 AS wx, CAST(y AS DOUBLE) * 2 + 1 AS wy, ((x * 0.5 - 15.75) + 15.75) / 0.5 AS ix FROM a")
def voxel_to_world(spark, sf_dir):
    wx = grids.index_to_physical(F.col("x"), 0.5, -15.75)
    return grid_a(spark, sf_dir).select("y", "x", wx.alias("wx"), grids.index_to_physical(F.col("y").cast("double"), 2.0, 1.0).alias("wy"), grids.physical_to_index(wx, 0.5, -15.75).alias("ix"))


@q(f"WITH {A} SELECT y, x, {r6_sql('v')} AS v FROM a UNION ALL SELECT y + (SELECT max(y) + 1 FROM a), x, {r6_sql('v')} FROM a")
def vertical_concat(spark, sf_dir):
    return rounded(sel.concat_rows(grid_a(spark, sf_dir), grid_a(spark, sf_dir)))


@q(f"WITH {A} SELECT label, x, {r6_sql('avg(v)')} AS v FROM a JOIN (SELECT vec_id AS y, label FROM embeddings) USING (y) GROUP BY label, x")
def mean_image(spark, sf_dir):
    return rounded(grid_a(spark, sf_dir).join(labelled(spark, sf_dir), "y").groupBy("label", "x").agg(F.avg("v").alias("v")))


@q(f"WITH {A} SELECT y // 100 AS sweep, CASE WHEN (y // 100) % 2 = 0 THEN y % 100 ELSE 99 - y % 100 END AS pos, {r6_sql('sum(v)')} AS v FROM a GROUP BY y")
def sweep_split(spark, sf_dir):
    rows = grid_a(spark, sf_dir).groupBy("y").agg(F.sum("v").alias("v"))
    return rounded(sel.split_sweeps(rows, "y", 100).drop("y"))


@q(f"WITH {A}, blk AS (SELECT unnest(range(0, 4)) AS b) SELECT b, count(*) AS n, {r6_sql('sum(v)')} AS s FROM a, blk WHERE x BETWEEN b * 16 - 2 AND b * 16 + 17 GROUP BY b")
def block_split_with_halo(spark, sf_dir):
    return rounded(sel.blocks_with_halo(grid_a(spark, sf_dir), "x", 16, 2, WIDTH).groupBy("b").agg(F.count("*").alias("n"), F.sum("v").alias("s")), "s")


# neighbourhoods


@q(f"WITH {A} SELECT y, x, {r6_sql('coalesce(lead(v) OVER (PARTITION BY y ORDER BY x), v) - v')} AS v FROM a")
def grad_x(spark, sf_dir):
    return rounded(neighbors.gradient(grid_a(spark, sf_dir), "x"))


@q(f"WITH {A} SELECT y, x, {r6_sql('coalesce(lead(v) OVER (PARTITION BY x ORDER BY y), v) - v')} AS v FROM a")
def grad_y(spark, sf_dir):
    return rounded(neighbors.gradient(grid_a(spark, sf_dir), "y", keys=("y", "x")))


@q(f"WITH {A}, {VOLUME} SELECT z, y, x, {r6_sql('coalesce(lead(v, 2) OVER w, last_value(v) OVER (PARTITION BY y, x ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) - v')} AS v FROM vol WINDOW w AS (PARTITION BY y, x ORDER BY z)")
def grad_z(spark, sf_dir):
    return rounded(neighbors.gradient(volume(spark, sf_dir), "z", 2, keys=("z", "y", "x")))


@q(f"WITH {A} SELECT y, x, {r6_sql('CASE WHEN x = 0 THEN v WHEN x = 63 THEN -lag(v) OVER w ELSE v - lag(v) OVER w END')} AS v FROM a WINDOW w AS (PARTITION BY y ORDER BY x)")
def divergence_x(spark, sf_dir):
    return rounded(neighbors.divergence(grid_a(spark, sf_dir), "x", WIDTH))


@q(f"WITH {A}, {B} SELECT y, x, {r6_sql('coalesce(lead(a.v) OVER (PARTITION BY y ORDER BY x), a.v) - b.v')} AS v FROM a JOIN b USING (y, x)")
def offset_difference(spark, sf_dir):
    return rounded(neighbors.offset_difference(grid_a(spark, sf_dir), grid_b(spark, sf_dir), "x", 1, ("y", "x")))


_N1 = f"WITH {A}, {near(1, 1)}"
_S = "sum(CASE WHEN {} THEN n ELSE 0 END)"


def _at(dy: int, dx: int) -> str:
    return f"max(n) FILTER (dy = {dy} AND dx = {dx})"


def _stencil_sql(value: str, ctes: str = _N1, source: str = "nb") -> str:
    return f"{ctes} SELECT y, x, {r6_sql(value)} AS v FROM {source} GROUP BY y, x, v"


@q(_stencil_sql("sum(n) / 9"))
def mean3x3(spark, sf_dir):
    return rounded(neighbors.mean_filter(grid_a(spark, sf_dir)))


@q(_stencil_sql("CASE WHEN x BETWEEN 1 AND 62 AND y BETWEEN 1 AND (SELECT max(y) FROM a) - 1 THEN list_sort(list(n))[5] ELSE v END"))
def median3x3(spark, sf_dir):
    g = grid_a(spark, sf_dir)
    return rounded(neighbors.median_filter(g, WIDTH, g.agg(F.max("y")).first()[0] + 1))


@q(
    _stencil_sql(
        "CASE WHEN x BETWEEN 2 AND 61 AND y BETWEEN 2 AND (SELECT max(y) FROM a) - 2 THEN sum(n * w) / sum(w) ELSE v END",
        f"WITH {A}, {near(2, 2)}, wt AS (SELECT y, x, v, n, exp(-0.5 * (dx * dx + dy * dy) / 4.0) * exp(-0.5 * pow((n - v) / 0.1, 2)) AS w FROM nb)",
        "wt",
    )
)
def bilateral5(spark, sf_dir):
    g = grid_a(spark, sf_dir)
    return rounded(neighbors.bilateral_filter(g, WIDTH, g.agg(F.max("y")).first()[0] + 1, sigma_r=0.1))


@q(
    f"""WITH {A}, {B}, {near(1, 1)}, {near(1, 1, "b", "nc")},
    wt AS (SELECT y, x, nb.n, exp(-0.5 * (dx * dx + dy * dy) / 4.0) * exp(-0.5 * pow((nc.n - nc.v) / 0.1, 2)) AS w FROM nb JOIN nc USING (y, x, dy, dx))
    SELECT y, x, {r6_sql('sum(n * w) / sum(w)')} AS v FROM wt GROUP BY y, x"""
)
def joint_bilateral3(spark, sf_dir):
    return rounded(neighbors.joint_bilateral_filter(grid_a(spark, sf_dir), grid_b(spark, sf_dir)))


@q(_stencil_sql("sum(CASE WHEN dx = 0 AND dy = 0 THEN -4 * n WHEN dx = 0 OR dy = 0 THEN n ELSE 0 END)"))
def laplace2d(spark, sf_dir):
    return rounded(neighbors.laplace(grid_a(spark, sf_dir)))


@q(_stencil_sql("sum(CASE WHEN dx = 0 THEN -2 * n ELSE n END)", f"WITH {A}, {near(1, 0)}"))
def laplace1d(spark, sf_dir):
    return rounded(neighbors.laplace_1d(grid_a(spark, sf_dir)))


@q(_stencil_sql("sqrt(pow(sum(n * dx * (2 - abs(dy))), 2) + pow(sum(n * dy * (2 - abs(dx))), 2))"))
def sobel_magnitude(spark, sf_dir):
    return rounded(neighbors.sobel_magnitude(grid_a(spark, sf_dir)))


@q(_stencil_sql("sum(n * (CASE WHEN dx = 0 AND dy = 0 THEN 4 WHEN dx = 0 OR dy = 0 THEN 2 ELSE 1 END)) / 16"))
def kernel3x3(spark, sf_dir):
    return rounded(neighbors.convolve(grid_a(spark, sf_dir), [[1.0, 2.0, 1.0], [2.0, 4.0, 2.0], [1.0, 2.0, 1.0]]))


@q(_stencil_sql("sum(n * dx) * 0.25", f"WITH {A}, {near(2, 0)}"))
def numerical_derivative(spark, sf_dir):
    return rounded(neighbors.derivative(grid_a(spark, sf_dir), 5, 2.0))


@q(f"WITH {A}, s AS (SELECT y, x, sum(v) OVER (PARTITION BY y ORDER BY x) AS s FROM a) SELECT y, x, {r6_sql('s - avg(s) OVER (PARTITION BY y)')} AS v FROM s")
def antiderivative_row(spark, sf_dir):
    return rounded(neighbors.antiderivative(grid_a(spark, sf_dir)))


@q(f"WITH {A} SELECT y, x, {r6_sql('avg(v) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS v FROM a")
def mean_filter_1d(spark, sf_dir):
    return rounded(neighbors.mean_filter_1d(grid_a(spark, sf_dir), 5))


_GAUSS = neighbors.gaussian_weights(1.2)


@q(_stencil_sql("sum(n * CASE dx " + " ".join(f"WHEN {i - len(_GAUSS) // 2} THEN {k!r}::DOUBLE" for i, k in enumerate(_GAUSS)) + " END)", f"WITH {A}, {near(len(_GAUSS) // 2, 0)}"))
def gaussian_filter_1d(spark, sf_dir):
    return rounded(neighbors.gaussian_filter_1d(grid_a(spark, sf_dir), 1.2))


@q(f"WITH {A}, {near(1, 0)} SELECT y, x - 1 AS x, {r6_sql('sum(n * (CASE WHEN dx = 0 THEN 2 ELSE 1 END)) / 4')} AS v FROM nb WHERE x BETWEEN 1 AND 62 GROUP BY y, x")
def convolve_1d(spark, sf_dir):
    return rounded(neighbors.convolve_1d(grid_a(spark, sf_dir), [1.0, 2.0, 1.0], WIDTH))


@q(f"WITH {A} SELECT y, x, {r6_sql('max(v) OVER (PARTITION BY y ORDER BY x)')} AS v FROM a")
def monotone_row(spark, sf_dir):
    return rounded(neighbors.force_monotony(grid_a(spark, sf_dir)))


@q(f"WITH {A} SELECT a.y, a.x, {r6_sql('CASE WHEN a.x >= 32 THEN m.v ELSE a.v END')} AS v FROM a JOIN a m ON m.y = a.y AND m.x = 63 - a.x")
def symmetric_row(spark, sf_dir):
    return rounded(neighbors.force_symmetry(grid_a(spark, sf_dir), WIDTH))


@q(f"WITH {A} SELECT y, x, {r6_sql('CASE WHEN abs(x - 32) <= 2 THEN avg(v) FILTER (x IN (29, 35)) OVER (PARTITION BY y) ELSE v END')} AS v FROM a")
def suppress_centre(spark, sf_dir):
    return rounded(neighbors.suppress_centre(grid_a(spark, sf_dir), WIDTH, 2))


@q(
    f"""WITH RECURSIVE {A}, f AS (SELECT y, x, v FROM a WHERE x = 0
    UNION ALL SELECT a.y, a.x, CASE WHEN a.v - f.v > 0.05 THEN f.v + 0.05 WHEN f.v - a.v > 0.05 THEN f.v - 0.05 ELSE a.v END FROM f JOIN a ON a.y = f.y AND a.x = f.x + 1)
    SELECT y, x, {r6_sql('v')} AS v FROM f"""
)
def slew_limit(spark, sf_dir):
    return rounded(grids.to_long(neighbors.limit_slew(grids.to_rows(grid_a(spark, sf_dir)), 0.05)))


@q(f"WITH {A}, {VOLUME} SELECT z, y, x, {r6_sql('(coalesce(lead(v) OVER w, v) - coalesce(lag(v) OVER w, v)) / 2')} AS v FROM vol WINDOW w AS (PARTITION BY y, x ORDER BY z)")
def view_derivative(spark, sf_dir):
    return rounded(neighbors.view_derivative(volume(spark, sf_dir)))


_TVM = f"sqrt(pow(v - {_at(0, -1)}, 2) + pow(v - {_at(-1, 0)}, 2))"


@q(f"{_N1}, g AS (SELECT y, x, {_TVM} AS g FROM nb GROUP BY y, x, v) SELECT {r6_sql('sum(g)')} AS tv FROM g")
def tv_value(spark, sf_dir):
    return rounded(neighbors.tv_value(grid_a(spark, sf_dir)), "tv")


@q(_stencil_sql(f"1 / ({_TVM} + 0.01)"))
def tv_weights(spark, sf_dir):
    return rounded(neighbors.tv_weights(grid_a(spark, sf_dir)))


@q(f"{_N1}, g AS (SELECT y, x, {_TVM} AS g FROM nb GROUP BY y, x, v) SELECT {r6_sql('sum(g / (g + 0.01))')} AS tv FROM g")
def weighted_tv(spark, sf_dir):
    g = grid_a(spark, sf_dir)
    return rounded(neighbors.weighted_tv_value(g, neighbors.tv_weights(g)), "tv")


@q(
    _stencil_sql(
        f"(2 * v - {_at(0, -1)} - {_at(-1, 0)}) / sqrt(0.0001 + pow(v - {_at(0, -1)}, 2) + pow(v - {_at(-1, 0)}, 2))"
        f" - ({_at(0, 1)} - v) / sqrt(0.0001 + pow({_at(0, 1)} - v, 2) + pow({_at(0, 1)} - {_at(-1, 1)}, 2))"
        f" - ({_at(1, 0)} - v) / sqrt(0.0001 + pow({_at(1, 0)} - v, 2) + pow({_at(1, 0)} - {_at(1, -1)}, 2))"
    )
)
def tv_gradient(spark, sf_dir):
    return rounded(neighbors.tv_gradient(grid_a(spark, sf_dir)))


for _name, _f, _v in (("erode3", neighbors.erode, "min(n)"), ("dilate3", neighbors.dilate, "max(n)"), ("morph_gradient", neighbors.morphological_gradient, "max(n) - min(n)")):
    q.add(_name, (lambda f: lambda spark, sf_dir: rounded(f(grid_a(spark, sf_dir))))(_f), _stencil_sql(_v))


def _twice(first: str, second: str, value: str = "w.v") -> str:
    return (
        f"{_N1}, e AS (SELECT y, x, {first}(n) AS v FROM nb GROUP BY y, x), {near(1, 1, 'e', 'ne')}, w AS (SELECT y, x, {second}(n) AS v FROM ne GROUP BY y, x) "
        f"SELECT a.y, a.x, {r6_sql(value)} AS v FROM w JOIN a USING (y, x)"
    )


q.add("open3", lambda spark, sf_dir: rounded(neighbors.opening(grid_a(spark, sf_dir))), _twice("min", "max"))
q.add("close3", lambda spark, sf_dir: rounded(neighbors.closing(grid_a(spark, sf_dir))), _twice("max", "min"))
q.add("tophat3", lambda spark, sf_dir: rounded(neighbors.top_hat(grid_a(spark, sf_dir))), _twice("min", "max", "a.v - w.v"))


@q(_stencil_sql("CASE WHEN bool_and(CASE WHEN dx = 0 AND dy = 0 THEN n > 0 WHEN dx = 0 OR dy = 0 THEN n <= 0 ELSE true END) THEN 1 ELSE 0 END"))
def hit_or_miss3(spark, sf_dir):
    return rounded(neighbors.hit_or_miss(grid_a(spark, sf_dir), [4], [1, 3, 5, 7]))


@q(_stencil_sql("list_sort(list(n))[7]"))
def percentile_filter3(spark, sf_dir):
    return rounded(neighbors.percentile_filter(grid_a(spark, sf_dir), 0.7))


_V3 = (
    "sz AS (SELECT max(y) AS my FROM vol), o AS (SELECT * FROM (SELECT unnest([-1, 0, 1]) AS dz), (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)), "
    "n3 AS (SELECT c.*, n.v AS n FROM (SELECT z, y, x, v, dz, dy, dx, least(greatest(z + dz, 0), 9) AS nz, least(greatest(y + dy, 0), my) AS ny, least(greatest(x + dx, 0), 63) AS nx FROM vol, o, sz) c "
    "JOIN vol n ON n.z = nz AND n.y = ny AND n.x = nx)"
)


@q(f"WITH {A}, {VOLUME}, {_V3} SELECT z, y, x, {r6_sql('max(n)')} AS v FROM n3 GROUP BY z, y, x")
def dilate_3d(spark, sf_dir):
    return rounded(neighbors.morphology_3d(volume(spark, sf_dir), True))


@q(f"WITH {A}, {VOLUME}, {_V3} SELECT z, y, x, {r6_sql('sum(CASE WHEN abs(dz) + abs(dy) + abs(dx) <= 1 THEN n ELSE 0 END) / 7')} AS v FROM n3 GROUP BY z, y, x")
def mean_6_neighbours(spark, sf_dir):
    return rounded(neighbors.mean_6_neighbours(volume(spark, sf_dir), {"z": 10, "x": WIDTH}))


@q(f"WITH {A}, {VOLUME} SELECT z, y, x, {r6_sql('avg(v) OVER (PARTITION BY y, x ORDER BY z ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)')} AS v FROM vol")
def context_mean(spark, sf_dir):
    out = neighbors.context_window(volume(spark, sf_dir), 2, 1)
    return rounded(out.select("z", "y", "x", (grids.array_sum("context") / F.size("context")).alias("v")))


@q(f"WITH {A}, p(py, px) AS (VALUES (3.0, 5.0), (40.0, 60.0), (200.0, 10.0)) SELECT y, x, {r6_sql('min(sqrt((y - py) * (y - py) + (x - px) * (x - px)))')} AS v FROM a, p GROUP BY y, x")
def distance_transform(spark, sf_dir):
    points = spark.createDataFrame([(3.0, 5.0), (40.0, 60.0), (200.0, 10.0)], "y double, x double")
    return rounded(neighbors.distance_transform(grid_a(spark, sf_dir), points))


@q(f"WITH {A}, g AS (SELECT y, x, v, CASE WHEN v > 0.1 THEN 1 ELSE 0 END AS l FROM a) SELECT l AS level, count(*) AS n, {r6_sql('avg(x)')} AS cx, {r6_sql('stddev_pop(x)')} AS sx FROM g GROUP BY l")
def point_centroids(spark, sf_dir):
    g = grid_a(spark, sf_dir).withColumn("level", (F.col("v") > 0.1).cast("int"))
    out = g.groupBy("level").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.stddev_pop("x").alias("sx"))
    return rounded(out, "cx", "sx")
