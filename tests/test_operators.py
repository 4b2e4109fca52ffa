"""Operators that SQL does not express: against NumPy, closed forms and round trips."""

import gzip
import io
import math
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from latticework.functions import ieee
from latticework.functions.expressions import parse
from latticework.operators import corrections, features, geometry, graph, grids, interp, linalg, neighbors, phantom, physics, recon, selection, spectral
from latticework.sources import grids as files
from latticework.sources import text
from latticework.streaming import pipeline


def grid(spark, a):
    return spark.createDataFrame([(y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "y long, x int, v double")


def dense(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r["v"]
    return out


def values(spark, pairs, f):
    df = spark.createDataFrame([tuple(map(float, p)) for p in pairs], ", ".join(f"{c} double" for c in "abc"[: len(pairs[0])]))
    return [r[0] for r in df.select(f).collect()]


def test_ieee(spark):
    inf, nan = math.inf, math.nan
    got = values(spark, [(1, 0), (-1, 0), (0, 0), (6, 3), (nan, 0), (inf, 0), (1, nan)], ieee.div("a", "b").alias("r"))
    assert str(got) == str([inf, -inf, nan, 2.0, nan, inf, nan])
    assert str(values(spark, [(0,), (-1,), (1,), (nan,)], ieee.log("a").alias("r"))) == str([-inf, nan, 0.0, nan])


def test_windows_do_not_depend_on_the_block(spark):
    a = np.random.default_rng(0).random((23, 9))
    want = None
    for block in (4, 7, 64):
        got = dense(grids.stencil(grid(spark, a), 1, 1, block=block).select("y", "x", (grids.array_sum("n") / 9).alias("v")), a.shape)
        want = got if want is None else want
        assert np.allclose(got, want)
    p = np.pad(a, 1, mode="edge")
    assert np.allclose(want, sum(p[i : i + 23, j : j + 9] for i in range(3) for j in range(3)) / 9)


def test_flips_and_layouts_are_their_own_inverse(spark):
    a = np.random.default_rng(1).random((5, 6))
    g = grid(spark, a)
    assert np.allclose(dense(selection.flip(selection.flip(g, 6), 6), a.shape), a)
    assert np.allclose(dense(selection.transpose(selection.transpose(g)), a.shape), a)
    assert np.allclose(dense(grids.to_long(grids.to_rows(g)), a.shape), a)
    blocks = selection.blocks_with_halo(g, "x", 2, 1, 6)
    assert np.allclose(dense(selection.merge_blocks(blocks, "x", 2), a.shape), a)


def test_scatter_is_the_adjoint_of_sampling(spark):
    rng = np.random.default_rng(2)
    a, y = rng.random((6, 7)), rng.random(12)
    pts = [(i, float(rng.uniform(0, 4.9)), float(rng.uniform(0, 5.9)), float(y[i])) for i in range(12)]
    p = spark.createDataFrame(pts, "i int, y double, x double, v double")
    forward = sum(r["v"] * y[r["i"]] for r in interp.sample_linear(grid(spark, a), p, ["i"]).collect())
    back = sum(r["v"] * a[int(r["y"]), int(r["x"])] for r in interp.scatter_linear(p).collect())
    assert math.isclose(forward, back, rel_tol=1e-9)


def test_projection_of_a_disc_is_its_chord(spark):
    disc = spark.createDataFrame([(0, 1.0, 0.6, 0.6, 0.0, 0.0, 0.0)], "k int, val double, a double, b double, x0 double, y0 double, phi double")
    for r in phantom.ellipse_projection(disc, recon.views(spark, 4), 41, 40).collect():
        s = (r["u"] - 20) / 20
        assert math.isclose(r["v"], 2 * math.sqrt(max(0.0, 0.36 - s * s)) * 20, abs_tol=1e-9)


def test_fbp_finds_the_level_of_a_disc(spark):
    n, v, b = 24, 36, 37
    disc = spark.createDataFrame([(0, 1.0, 0.6, 0.6, 0.0, 0.0, 0.0)], "k int, val double, a double, b double, x0 double, y0 double, phi double")
    angles = recon.views(spark, v)
    sino = recon.filter_views(phantom.ellipse_projection(disc, angles, b, n), "ram_lak")
    image = dense(recon.back_project(sino, angles, recon.pixels(spark, n, n), b, n), (n, n))
    assert abs(image[10:14, 10:14].mean() - 1) < 0.05 and abs(image[0, 0]) < 0.1


def test_iterative_methods_lower_the_residual(spark):
    n, v = 8, 6
    image = phantom.disc(spark, n, 0.3)
    system = recon.system_matrix(recon.parallel_rays(recon.views(spark, v), 11, n), (n, n)).checkpoint()
    sino = system.join(image, ["y", "x"]).groupBy("view", "u").agg(F.sum(F.col("w") * F.col("v")).alias("v")).checkpoint()
    zero = recon.pixels(spark, n, n).withColumn("v", F.lit(0.0))

    def miss(x):
        seen = system.join(x, ["y", "x"]).groupBy("view", "u").agg(F.sum(F.col("w") * F.col("v")).alias("p"))
        return sino.join(seen, ["view", "u"]).agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("p"), 2)))).first()[0]

    first = miss(zero)
    assert miss(recon.conjugate_gradient(system, sino, zero, 3)) < 0.2 * first
    assert miss(recon.sart(system, sino, zero, recon.sart_order(v), 1)) < 0.5 * first
    assert sorted(recon.sart_order(7)) == list(range(7))


def test_cone_back_projection_of_ones(spark):
    m = geometry.circular(spark, 4, 100.0, 150.0, 1.0, 33, 33)
    centre = spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double")
    for r in geometry.project_points(centre, m).collect():
        assert math.isclose(r["u"], 16) and math.isclose(r["v"], 16) and math.isclose(r["depth"], 100)
    p = np.array(m.first()["p"]).reshape(3, 4)
    k, rot, t = geometry.decompose(p)
    assert np.allclose(k @ np.c_[rot, t], p) and np.allclose(rot @ rot.T, np.eye(3)) and np.allclose(geometry.source_position(p), [100, 0, 0])


def test_shapes(spark):
    ray = spark.createDataFrame([(-10.0, 0.5, 0.5, 1.0, 0.0, 0.0), (-10.0, 2.0, 0.5, 1.0, 0.0, 0.0)], "ox double, oy double, oz double, dx double, dy double, dz double")
    box = geometry.hit_box([F.lit(0.0)] * 3, [F.lit(1.0)] * 3)
    assert [tuple(r) for r in ray.select(*box).collect()] == [(10.0, 11.0), (None, None)]
    tri = geometry.hit_triangle([F.lit(0.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.lit(1.5), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.5)])
    assert [r[0] for r in ray.select(tri).collect()] == [10.0, None]
    cyl = geometry.hit_cylinder(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.0))
    near, far = ray.select(*cyl).first()
    assert math.isclose(near, 10 - math.sqrt(0.75)) and math.isclose(far, 10 + math.sqrt(0.75))


def test_hull_calibration_and_splines(spark):
    rng = np.random.default_rng(3)
    pts = [(0, float(x), float(y)) for x, y in rng.random((50, 2))] + [(0, -1.0, -1.0), (0, 2.0, -1.0), (0, 2.0, 2.0), (0, -1.0, 2.0)]
    got = geometry.hull_2d(spark.createDataFrame(pts, "g int, x double, y double").repartition(3), ["g"]).collect()
    assert {(r["x"], r["y"]) for r in got} == {(-1.0, -1.0), (2.0, -1.0), (2.0, 2.0), (-1.0, 2.0)}
    p = geometry.projection_matrix(geometry.intrinsics(500, 1, 100, 100), geometry.euler_matrix(0.1, 0.2, 0.3), np.array([1.0, 2.0, 300.0]))
    beads = rng.uniform(-40, 40, (12, 3))
    h = np.c_[beads, np.ones(12)] @ p.T
    assert np.allclose(geometry.calibrate(beads, h[:, :2] / h[:, 2:]), p / p[2, 3], atol=1e-6)
    c, v = rng.random((8, 2)), rng.random(8)
    w, a = geometry.thin_plate(c, v)
    df = spark.createDataFrame([tuple(map(float, x)) for x in c], "x double, y double")
    assert np.allclose([r[0] for r in df.select(geometry.thin_plate_at(F.col("x"), F.col("y"), c, w, a)).collect()], v)


def test_dense_kernels(spark):
    rng = np.random.default_rng(4)
    ms = [rng.random((3, 3)) + np.eye(3) for _ in range(4)]
    df = spark.createDataFrame([([r.tolist() for r in m],) for m in ms], "m array<array<double>>")
    for name, f in (("determinant", np.linalg.det), ("inverse", np.linalg.inv), ("pseudo_inverse", np.linalg.pinv), ("singular_values", lambda m: np.linalg.svd(m)[1])):
        got = [r[0] for r in df.select(linalg.dense(name)("m")).collect()]
        assert all(np.allclose(np.array(g, float), f(m)) for g, m in zip(got, ms, strict=True))
    r = df.select(linalg.dense("rq_r")("m").alias("r"), linalg.dense("rq_q")("m").alias("q"), "m").collect()
    assert all(np.allclose(np.array(x["r"]) @ np.array(x["q"]), np.array(x["m"])) for x in r)
    assert spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]],)], "m array<array<double>>").select(linalg.dense("is_identity")("m")).first()[0]


def test_graphs(spark):
    rng = np.random.default_rng(5)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 6, (40, 2)))]
    p = spark.createDataFrame(pts, "id long, x double, y double")
    edges = graph.threshold_edges(p, 1.2)
    e = sorted((r["weight"], r["src"], r["dst"]) for r in edges.collect())
    want = {(i, j) for i, xi, yi in pts for j, xj, yj in pts if i < j and math.hypot(xi - xj, yi - yj) <= 1.2}
    assert {(s, d) for _, s, d in e} == want
    parent = list(range(40))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total = 0.0
    for w, s, d in e:
        a, b = find(s), find(d)
        if a != b:
            parent[max(a, b)] = min(a, b)
            total += w
    tree = graph.minimum_spanning_forest(p.select("id"), edges).collect()
    assert math.isclose(sum(r["weight"] for r in tree), total)
    got = {r["id"]: r["component"] for r in graph.components(p.select("id"), edges).collect()}
    assert got == {i: min(j for j in range(40) if find(j) == find(i)) for i in range(40)}
    cost = {0: 0.0}
    for _ in range(40):
        for w, s, d in e:
            for a, b in ((s, d), (d, s)):
                if a in cost and cost[a] + w < cost.get(b, math.inf):
                    cost[b] = cost[a] + w
    paths = graph.shortest_paths(edges, p.filter("id = 0").select("id"))
    assert {r["id"]: round(r["cost"], 9) for r in paths.collect()} == {k: round(v, 9) for k, v in cost.items()}


def test_spectra(spark):
    x = [1.0, 2.0, -4.0, 2.0, 1.0, 0.0]
    df = spark.createDataFrame([(x,)], "row array<double>")
    back = df.select(spectral.inverse_fft()(spectral.fft(pad=True)("row"))).first()[0]
    assert np.allclose([c["re"] for c in back], [*x, 0, 0])
    s = spark.createDataFrame([(0, 8, 8, np.random.default_rng(6).random(64).tolist())], "z int, w int, h int, px array<double>")
    for kind in ("gaussian", "low_pass", "high_pass", "exponential", "directional"):
        assert len(spectral.apply_slices(s, spectral.slice_filter(kind)).first()["px"]) == 64
    low, high = (np.array(spectral.apply_slices(s, spectral.slice_filter(k)).first()["px"]) for k in ("low_pass", "high_pass"))
    assert np.allclose(low + high, s.first()["px"])
    flat = s.withColumn("px", F.transform("px", lambda v: F.lit(3.0)))
    for f in (spectral.blur(1.0), spectral.anisotropic_diffusion()):
        assert np.allclose(spectral.apply_slices(flat, f).first()["px"], 3.0)
    noisy = df.select(spectral.poisson_noise(1e6)(F.lit(1), F.transform("row", lambda v: F.abs(v)))).first()[0]
    assert np.allclose(noisy, np.abs(x), atol=0.2)


def test_features(spark):
    r = features.surface_fit(spark.createDataFrame([(float(x), float(y), 1.0 + 2 * x - y + 0.5 * x * y) for x in range(4) for y in range(4)], "x double, y double, z double"), "x", "y", "z")
    assert np.allclose(r, [1, 2, -1, 0, 0.5, 0], atol=1e-8)
    line = spark.createDataFrame([(float(x), 0.5 * x + 1.5) for x in range(200)] + [(float(x), 900.0 - x) for x in range(40)], "x double, y double")
    fit = features.ransac_line(line, "x", "y", 0.01)
    assert math.isclose(fit["slope"], 0.5) and math.isclose(fit["intercept"], 1.5)
    t = features.hotelling(spark.createDataFrame([(i % 2, [float(i % 2) + 0.01 * i, 0.1 * (i % 5)]) for i in range(40)], "k int, c array<double>"), 2, "k")
    assert t[0] > 0
    mean, var, d = linalg.pca(spark.createDataFrame([([float(i), 2.0 * i, 0.0],) for i in range(9)], "row array<double>"), 3, 2)
    assert np.allclose(np.abs(d[0]), np.array([1, 2, 0]) / math.sqrt(5)) and var[1] < 1e-9


def test_slew_and_truncation(spark):
    df = spark.createDataFrame([([0.0, 1.0, 5.0, 2.0],)], "row array<double>")
    assert neighbors.limit_slew(df, 1.5).first()["row"] == [0.0, 1.0, 2.5, 2.0]
    out = recon.truncation_taper(df, 3).first()["row"]
    assert len(out) == 10 and out[3:7] == [0.0, 1.0, 5.0, 2.0]


def test_physics(spark):
    spectrum = physics.kramers_spectrum(spark, 80)
    assert math.isclose(spectrum.agg(F.sum("flux")).first()[0], 1.0)
    one = spark.createDataFrame([(60.0, 1.0)], "energy double, flux double")
    assert math.isclose(physics.half_value_layer(one, F.lit(0.2)), math.log(2) / 0.2 * 10, rel_tol=1e-9)
    seg = spark.createDataFrame([(0, 1, 0, 0.0, 10.0), (0, 2, 5, 4.0, 6.0)], "ray int, obj int, priority int, start double, end double")
    got = sorted((r["start"], r["end"], r["obj"]) for r in physics.resolve_priorities(seg, ["ray"]).collect())
    assert got == [(0.0, 4.0, 1), (4.0, 6.0, 2), (6.0, 10.0, 1)]


@settings(max_examples=10, deadline=None)
@given(st.floats(-5, 5), st.floats(-5, 5), st.floats(0.1, 5))
def test_expressions(spark, a, b, c):
    df = spark.createDataFrame([(a, b, c)], "a double, b double, c double")
    left, right = df.select(parse("a - b + c * 2 / (c + 1)"), parse("a-b+c", legacy=True)).first()
    assert math.isclose(left, a - b + c * 2 / (c + 1), abs_tol=1e-9) and math.isclose(right, a - (b + c), abs_tol=1e-9)


def test_expression_errors():
    for bad in ("a +", "(a", "log(a)", "a $ b", "a b"):
        with pytest.raises(ValueError):
            parse(bad, {})


def test_binary_sources(spark, tmp_path):
    v = np.random.default_rng(7).random((3, 4, 5)).astype("<f4")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.raw", v.tobytes())
    nrrd = files.encode_nrrd(v)
    head = b"NRRD0004\ntype: float\ndimension: 3\nsizes: 5 4 3\nencoding: gzip\nendian: little\n\n"
    mha = b"ObjectType = Image\nNDims = 3\nDimSize = 5 4 3\nElementType = MET_FLOAT\nElementDataFile = LOCAL\n" + v.tobytes()
    for name, data, decoder in (
        ("v.nrrd", nrrd, None), ("g.nrrd", head + gzip.compress(v.tobytes()), None), ("v.mha", mha, None), ("v.viv", files.encode_dennerlein(v), None),
        ("v.raw", v.tobytes(), files.raw(5, 4)), ("b.raw", v.astype(">f4").tobytes(), files.raw(5, 4, little=False)), ("v.zip", buffer.getvalue(), files.zipped(files.raw(5, 4))),
    ):
        (tmp_path / name).write_bytes(data)
        rows = files.read_slices(spark, str(tmp_path / name), decoder).orderBy("z").collect()
        assert [(r["z"], r["w"], r["h"]) for r in rows] == [(0, 5, 4), (1, 5, 4), (2, 5, 4)]
        assert np.allclose([r["px"] for r in rows], v.reshape(3, -1))
    with pytest.raises(ValueError):
        files.read_slices(spark, "x.unknown")


def test_tiff(spark, tmp_path):
    a = np.arange(12, dtype="<f4").reshape(3, 4)
    tags = [(256, 3, 1, 4), (257, 3, 1, 3), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 1, 8), (279, 4, 1, 48), (339, 3, 1, 3)]
    body = b"II*\x00" + (56).to_bytes(4, "little") + a.tobytes() + len(tags).to_bytes(2, "little")
    for t, k, n, x in tags:
        body += t.to_bytes(2, "little") + k.to_bytes(2, "little") + n.to_bytes(4, "little") + x.to_bytes(4, "little")
    (tmp_path / "a.tif").write_bytes(body + bytes(4))
    assert files.read_slices(spark, str(tmp_path / "a.tif")).first()["px"] == a.ravel().tolist()


def test_text_sources(spark, tmp_path):
    (tmp_path / "ecg.txt").write_text("0.1\n0.5\nx\n0.9\n")
    assert [r["v"] for r in text.read_curve(spark, str(tmp_path / "ecg.txt")).orderBy("i").collect()] == [0.1, 0.5, 0.9]
    (tmp_path / "p.txt").write_text(" ".join(str(float(i)) for i in range(24)))
    rows = text.read_projection_matrices(spark, str(tmp_path / "p.txt")).orderBy("view").collect()
    assert [r["p"][0] for r in rows] == [0.0, 12.0] and len(rows[1]["p"]) == 12
    (tmp_path / "e.txt").write_text("1 2 0.5\n2,3\n# no edge\n")
    assert sorted(tuple(r) for r in text.read_edges(spark, str(tmp_path / "e.txt")).collect()) == [(1, 2, 0.5), (2, 3, 1.0)]
    stl = "solid s\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid"
    (tmp_path / "s.stl").write_text(stl)
    r = text.read_stl(spark, str(tmp_path / "s.stl")).first()
    assert (r["a"], r["b"], r["c"]) == ([0, 0, 0], [1, 0, 0], [0, 1, 0])
    (tmp_path / "m.vtk").write_text("# vtk DataFile Version 3.0\nx\nASCII\nDATASET POLYDATA\nPOINTS 2 float\n0 0 1\n2 3 4\nPOLYGONS 1 3\n2 0 1\n")
    assert [(p["x"], p["y"], p["z"]) for p in text.read_vtk_points(spark, str(tmp_path / "m.vtk")).orderBy("i").collect()] == [(0, 0, 1), (2, 3, 4)]
    assert text.read_vtk_polygons(spark, str(tmp_path / "m.vtk")).first()["corners"] == [0, 1]


def test_ordered_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    rows = [("a", 2, 2.0), ("a", 0, 0.0), ("a", 1, 1.0), ("b", 1, 9.0), ("a", 3, 3.0)]
    spark.createDataFrame(rows, "g string, i long, v double").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("g string, i long, v double").parquet(str(src))
    q = pipeline.ordered_buffer(stream, "g", "i", "v").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(out))
    q.awaitTermination(120)
    got = [tuple(r) for r in spark.read.parquet(str(out)).orderBy("g", "i").collect()]
    assert got == [("a", 0, 0.0), ("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0)]


def test_windows_of_a_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "e"))
    schema = spark.read.parquet(str(tmp_path / "e")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "e"))
    q = pipeline.tumbling(stream, "ts", "1 day", ["event_type"], "value").writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = pipeline.tumbling(spark.read.parquet(str(tmp_path / "e")), "ts", "1 day", ["event_type"], "value")
    key = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("tumbled")) == key(batch)


def test_asof_and_lookup_beyond_a_range(spark, monkeypatch):
    """Many ranges, a key with most rows, NULLs and repeated keys, against a loop."""
    monkeypatch.setattr(interp, "RANGE_KEYS", 7)
    monkeypatch.setattr(interp, "MOST_KNOTS", 5)
    rng = np.random.default_rng(3)
    left = [(i, None if i % 11 == 0 else 50.0 if i % 3 == 0 else float(rng.integers(-5, 120))) for i in range(400)]
    right = [(float(rng.integers(0, 100)), None if i % 7 == 0 else float(rng.integers(1, 99))) for i in range(60)] + [(None, 5.0)]
    a, b = spark.createDataFrame(left, "i int, t double"), spark.createDataFrame(right, "t double, v double")
    knots = {}
    for t, v in right:
        if t is not None and v is not None:
            knots[t] = max(v, knots.get(t, v))
    def at_or_before(t):
        return max((k for k in knots if t is not None and k <= t), default=None)
    want = {i: knots.get(at_or_before(t)) for i, t in left}
    assert {r["i"]: r["v"] for r in interp.asof_join(a, b, "t", "v").collect()} == want
    few = {r["i"]: r["v"] for r in interp.asof_join(a, b, "t", "v", F.floor(F.col("t") / 10)).collect()}
    assert few == want and len(few) == 400
    line = {}
    for i, t in left:
        lo, hi = at_or_before(t), min((k for k in knots if t is not None and k >= t), default=None)
        line[i] = None if lo is None or hi is None else knots[lo] if lo == hi else knots[lo] + (knots[hi] - knots[lo]) * (t - lo) / (hi - lo)
    for most in (5, 10_000):
        monkeypatch.setattr(interp, "MOST_KNOTS", most)
        got = {r["i"]: r["v"] for r in interp.lookup(a, b, "t", "v").collect()}
        assert got.keys() == line.keys() and all((got[i] is None) == (line[i] is None) and (line[i] is None or abs(got[i] - line[i]) < 1e-9) for i in line)
    assert interp.asof_join(a.limit(0), b, "t", "v").count() == 0
    assert all(r["v"] is None for r in interp.asof_join(a, b.limit(0), "t", "v").collect())
    assert all(r["v"] is None for r in interp.lookup(a, b.limit(0), "t", "v").collect())


def test_knn_in_blocks(spark, monkeypatch):
    """Blocks of queries and batches of points, equal vectors among them, against all distances."""
    monkeypatch.setattr(features, "QUERY_BLOCK", 25)
    monkeypatch.setattr(features, "DISTANCES", 200)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 6)).round(1)
    x[30:60] = x[30]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    points = spark.createDataFrame([*rows, (None, [0.0] * 6), (99, None)], "p int, vec array<double>")
    got = {(r["q"], r["rank"]): (r["p"], r["distance"]) for r in features.knn(points.withColumnRenamed("p", "q"), points, 4).collect()}
    want = {}
    for i in range(90):
        d = sorted((float(np.sqrt(((x[j] - x[i]) ** 2).sum())), j) for j in range(90) if j != i)[:4]
        want |= {(i, k + 1): (j, e) for k, (e, j) in enumerate(d)}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_fdk_of_a_ball(spark):
    """Projections of a ball are its chords, and reconstruction gives back its density in the middle and 0 outside."""
    n, v, shape, src, det = 16, 24, (25, 27), 80.0, 100.0
    mid, radius = (n - 1) / 2, 5.0
    cells = spark.range(n**3).select((F.col("id") / n**2).cast("int").alias("z"), ((F.col("id") / n).cast("int") % n).alias("y"), (F.col("id") % n).cast("int").alias("x"))
    r2 = F.pow(F.col("z") - mid, 2) + F.pow(F.col("y") - mid, 2) + F.pow(F.col("x") - mid, 2)
    ball = cells.withColumn("v", F.when(r2 <= radius * radius, 1.0).otherwise(0.0))
    angles = recon.views(spark, v, 2 * math.pi)
    sino = recon.cone_project(ball, recon.cone_rays(angles, shape, n, src, det), n).persist()
    assert sino.count() == v * shape[0] * shape[1]
    middle = sino.filter("r = 12 and u = 13").agg(F.min("v"), F.max("v")).first()
    assert 9.0 < middle[0] <= middle[1] < 11.0
    assert sino.filter("r in (0, 24)").agg(F.max("v")).first()[0] == 0
    voxels = cells.select(F.col("z").alias("k"), F.col("y").alias("j"), F.col("x").alias("i"), (F.col("x") - mid).alias("wx"), (F.col("y") - mid).alias("wy"), (F.col("z") - mid).alias("wz"))
    some = voxels.filter(F.col("k").isin(7, 8) & F.col("j").isin(1, 7, 8))
    got = {(r["k"], r["j"], r["i"]): r["v"] for r in recon.fdk(sino, angles, some, shape, src, det).collect()}
    assert all(0.8 < got[k, j, i] < 1.2 for k in (7, 8) for j in (7, 8) for i in (6, 7, 8, 9))
    assert all(abs(got[k, 1, i]) < 0.15 for k in (7, 8) for i in (0, 1, 14, 15))


def test_hardening(spark):
    """The polynomial straightens its own curve, and the table's factors balance the two sides."""
    rows = [(30.0 + 10 * e, 1.0 + e % 3, 0.2 + 4.0 / (1 + e)) for e in range(6)] + [(99.0, -5.0, 7.0)]
    curve = corrections.hardening_curve(spark, spark.createDataFrame(rows, "energy double, weight double, mu double"), 5.0, 100)
    c = corrections.precorrection(curve, 5)
    for r in curve.collect():
        assert abs(sum(k * r["poly"] ** i for i, k in enumerate(c)) - r["mono"]) < 0.05
    spectrum = [(1.0, 0.25, 0.6), (2.0, 0.2, 0.35), (0.5, 0.18, 0.22)]
    soft, hard = [0.0, 1.0, 4.0], [0.0, 0.1, 1.0]
    got = corrections.hardening_table(spectrum, soft, hard, -4.0, 4.0)
    for s, row in zip(soft, got, strict=True):
        for h, f in zip(hard, row, strict=True):
            alone = sum(w * math.exp(-a * s) for w, a, _ in spectrum)
            assert abs(sum(w * math.exp(-a * s + h * (f * a - b)) for w, a, b in spectrum) - alone) < 1e-9
        assert abs(row[0] - row[1]) < 0.1


def test_levenberg_marquardt(spark):
    points = spark.range(200).select((F.col("id") / 40).alias("x")).withColumn("y", 2.5 * F.exp(-1.3 * F.col("x")) + 0.4)
    p, error = corrections.levenberg_marquardt(points, "y", lambda p: p[0] * F.exp(-p[1] * F.col("x")) + p[2], [1.0, 0.5, 0.0])
    assert np.allclose(p, [2.5, 1.3, 0.4], atol=1e-5) and error < 1e-8


def test_distance_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "MOST_POINTS", 3)
    rng = np.random.default_rng(9)
    p = rng.uniform(0, 12, size=(11, 2))
    points = spark.createDataFrame([*map(tuple, p.tolist()), tuple(p[0].tolist()), (None, 1.0)], "y double, x double")
    got = dense(neighbors.distance_transform(grid(spark, np.zeros((9, 13))), points), (9, 13))
    want = np.array([[np.hypot(p[:, 0] - y, p[:, 1] - x).min() for x in range(13)] for y in range(9)])
    assert np.allclose(got, want)
    assert np.isinf(dense(neighbors.distance_transform(grid(spark, np.zeros((2, 2))), points.limit(0)), (2, 2))).all()


def _kruskal(edges):
    parent, out = {}, set()

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for w, s, d in sorted((w, min(s, d), max(s, d)) for s, d, w in edges):
        a, b = find(s), find(d)
        if a != b:
            parent[a] = b
            out.add((s, d, w))
    return out


@pytest.mark.parametrize("most", [None, 40])
def test_spanning_forest_in_few_checkpoints(spark, monkeypatch, most):
    """A chain, parallel edges, ties, loops and islands; with few edges in one task, else in rounds."""
    if most:
        monkeypatch.setattr(graph, "MOST_EDGES", most)
    rng = np.random.default_rng(11)
    edges = [(i, i + 1, float(i)) for i in range(100)] + [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 90, 300), rng.integers(0, 90, 300), rng.integers(1, 60, 300), strict=True)]
    edges += [(200, 201, 1.0), (201, 202, 1.0), (200, 202, 1.0), (201, 200, 0.5), (300, 300, 0.0)]
    taken = []
    cls = type(spark.range(1))
    keep = cls.checkpoint
    monkeypatch.setattr(cls, "checkpoint", lambda self, *a, **k: taken.append(1) or keep(self, *a, **k))
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    got = [(r["src"], r["dst"], r["weight"]) for r in graph.minimum_spanning_forest(df.select(F.col("src").alias("id")), df).collect()]
    assert len(got) == len(set(got)) and set(got) == _kruskal(edges)
    assert len(taken) > 1 if most else len(taken) == 1
    assert graph.minimum_spanning_forest(df.select(F.col("src").alias("id")), df.limit(0)).count() == 0
