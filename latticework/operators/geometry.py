"""Cameras, trajectories, rays and shapes, splines, motion. Points are structs or columns x, y, z."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.functions import ieee
from latticework.operators.linalg import rotation


def intrinsics(focal: float, pixel: float, u0: float, v0: float) -> np.ndarray:
    return np.array([[focal / pixel, 0, u0], [0, focal / pixel, v0], [0, 0, 1.0]])


def projection_matrix(k: np.ndarray, r: np.ndarray, t: np.ndarray) -> np.ndarray:
    """K [R | t], 3 x 4."""
    return k @ np.concatenate([r, np.reshape(t, (3, 1))], axis=1)


def decompose(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K (last element 1, positive diagonal), R and t of a projection matrix."""
    from latticework.operators.linalg import _rq

    k, r = _rq(p[:, :3])
    scale = k[2, 2]
    if np.linalg.det(r) < 0:
        k, r, p = k, -r, -p
    return k / scale, r, np.linalg.solve(k, p[:, 3])


def source_position(p: np.ndarray) -> np.ndarray:
    return -np.linalg.solve(p[:, :3], p[:, 3])


def circular(spark: SparkSession, n: int, source_axis: float, source_detector: float, pixel: float, width: int, height: int, span: float = 2 * math.pi, pitch: float = 0.0) -> DataFrame:
    """(view, angle, p): projection matrices of a circle, or with a pitch in mm a turn of a helix. n is a scan's number of
    views, so the matrices are made on the driver."""
    k = intrinsics(source_detector, pixel, (width - 1) / 2, (height - 1) / 2)
    rows = []
    for v in range(n):
        a = span * v / n
        r = np.array([[-math.sin(a), math.cos(a), 0], [0, 0, -1.0], [-math.cos(a), -math.sin(a), 0]])
        c = np.array([source_axis * math.cos(a), source_axis * math.sin(a), pitch * a / (2 * math.pi)])
        rows.append((v, a, projection_matrix(k, r, -r @ c).ravel().tolist()))
    return spark.createDataFrame(rows, "view int, angle double, p array<double>")


def circle_plus_line(spark: SparkSession, circle: int, line: int, length: float, **scan) -> DataFrame:
    """A circle, then views along a line parallel to the axis at the last angle 0."""
    turn = circular(spark, circle, **scan)
    k = intrinsics(scan["source_detector"], scan["pixel"], (scan["width"] - 1) / 2, (scan["height"] - 1) / 2)
    r = np.array([[0, 1.0, 0], [0, 0, -1.0], [-1.0, 0, 0]])
    rows = []
    for i in range(line):
        c = np.array([scan["source_axis"], 0.0, length * (i / max(1, line - 1) - 0.5)])
        rows.append((circle + i, 0.0, projection_matrix(k, r, -r @ c).ravel().tolist()))
    return turn.unionByName(spark.createDataFrame(rows, turn.schema))


def project_points(points: DataFrame, matrices: DataFrame) -> DataFrame:
    """(..., view, u, v, depth) of every point (x, y, z) in every view; views are broadcast."""
    p = lambda i: F.get("p", F.lit(i))
    row = lambda r: p(4 * r) * F.col("x") + p(4 * r + 1) * F.col("y") + p(4 * r + 2) * F.col("z") + p(4 * r + 3)
    out = points.crossJoin(F.broadcast(matrices)).select(*points.columns, "view", row(0).alias("_a"), row(1).alias("_b"), row(2).alias("depth"))
    return out.select(*points.columns, "view", ieee.div("_a", "depth").alias("u"), ieee.div("_b", "depth").alias("v"), "depth")


# rays: columns ox, oy, oz, dx, dy, dz; results are distances along the ray, NULL where nothing is hit

_O, _D = ("ox", "oy", "oz"), ("dx", "dy", "dz")


def hit_box(low: list[Column], high: list[Column]) -> tuple[Column, Column]:
    """Near and far distance by slabs."""
    near, far = [], []
    for o, d, lo, hi in zip(_O, _D, low, high, strict=True):
        a, b = ieee.div(lo - F.col(o), F.col(d)), ieee.div(hi - F.col(o), F.col(d))
        inside = F.col(o).between(lo, hi)
        near.append(F.when(F.col(d) == 0, F.when(inside, -ieee.inf()).otherwise(ieee.inf())).otherwise(F.least(a, b)))
        far.append(F.when(F.col(d) == 0, F.when(inside, ieee.inf()).otherwise(-ieee.inf())).otherwise(F.greatest(a, b)))
    n, f = F.greatest(*near), F.least(*far)
    return F.when(n <= f, n), F.when(n <= f, f)


def _quadratic(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    disc = b * b - 4 * a * c
    ok = (disc >= 0) & (a != 0)
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    return F.when(ok, ieee.div(-b - root, 2 * a)), F.when(ok, ieee.div(-b + root, 2 * a))


def hit_sphere(centre: list[Column], radius: Column) -> tuple[Column, Column]:
    o = [F.col(n) - c for n, c in zip(_O, centre, strict=True)]
    d = [F.col(n) for n in _D]
    a = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    b = 2 * (o[0] * d[0] + o[1] * d[1] + o[2] * d[2])
    return _quadratic(a, b, o[0] * o[0] + o[1] * o[1] + o[2] * o[2] - radius * radius)


def hit_ellipsoid(centre: list[Column], axes: list[Column]) -> tuple[Column, Column]:
    o = [(F.col(n) - c) / r for n, c, r in zip(_O, centre, axes, strict=True)]
    d = [F.col(n) / r for n, r in zip(_D, axes, strict=True)]
    a = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    b = 2 * (o[0] * d[0] + o[1] * d[1] + o[2] * d[2])
    return _quadratic(a, b, o[0] * o[0] + o[1] * o[1] + o[2] * o[2] - 1)


def hit_cylinder(x0: Column, y0: Column, radius: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """An upright cylinder with its caps."""
    ox, oy, dx, dy = F.col("ox") - x0, F.col("oy") - y0, F.col("dx"), F.col("dy")
    a = dx * dx + dy * dy
    c = ox * ox + oy * oy - radius * radius
    n, f = _quadratic(a, 2 * (ox * dx + oy * dy), c)
    n = F.when(a == 0, F.when(c <= 0, -ieee.inf())).otherwise(n)
    f = F.when(a == 0, F.when(c <= 0, ieee.inf())).otherwise(f)
    z0, z1 = ieee.div(low - F.col("oz"), F.col("dz")), ieee.div(high - F.col("oz"), F.col("dz"))
    level, inside = F.col("dz") == 0, F.col("oz").between(low, high)
    zn = F.when(level, F.when(inside, -ieee.inf()).otherwise(ieee.inf())).otherwise(F.least(z0, z1))
    zf = F.when(level, F.when(inside, ieee.inf()).otherwise(-ieee.inf())).otherwise(F.greatest(z0, z1))
    near, far = F.greatest(n, zn), F.least(f, zf)
    ok = n.isNotNull() & (near <= far)
    return F.when(ok, near), F.when(ok, far)


def hit_plane(normal: list[Column], offset: Column) -> Column:
    """Where n . p = offset."""
    d = sum((F.col(n) * c for n, c in zip(_D, normal, strict=True)), F.lit(0.0))
    o = sum((F.col(n) * c for n, c in zip(_O, normal, strict=True)), F.lit(0.0))
    return F.when(d != 0, ieee.div(offset - o, d))


def hit_triangle(a: list[Column], b: list[Column], c: list[Column]) -> Column:
    """Distance to a triangle, its edges included (Moeller and Trumbore)."""
    sub = lambda p, q: [x - y for x, y in zip(p, q, strict=True)]
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    o, d = [F.col(n) for n in _O], [F.col(n) for n in _D]
    e1, e2 = sub(b, a), sub(c, a)
    h = cross(d, e2)
    det = dot(e1, h)
    s = sub(o, a)
    q = cross(s, e1)
    u, v, t = ieee.div(dot(s, h), det), ieee.div(dot(d, q), det), ieee.div(dot(e2, q), det)
    return F.when((F.abs(det) > 1e-12) & (u >= 0) & (v >= 0) & (u + v <= 1), t)


def cell_join(points: DataFrame, boxes: DataFrame, cell: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Points with the boxes (lo_x, hi_x, ...) that hold them: both sides go to cells of a grid, an equi-join and an exact
    test follow. A box is repeated for the cells that it meets, so cells should be about as large as boxes."""
    here = points.withColumns({f"_c{a}": F.floor(F.col(a) / cell) for a in axes})
    there = boxes
    for a in axes:
        there = there.withColumn(f"_c{a}", F.explode(F.sequence(F.floor(F.col(f"lo_{a}") / cell), F.floor(F.col(f"hi_{a}") / cell))))
    out = here.join(there, [f"_c{a}" for a in axes])
    for a in axes:
        out = out.filter(F.col(a).between(F.col(f"lo_{a}"), F.col(f"hi_{a}")))
    return out.drop(*[f"_c{a}" for a in axes])


def morton(cells: list[Column], bits: int = 20) -> Column:
    """Bits of cell numbers interleaved: near cells have near codes."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for k, c in enumerate(cells):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), b * len(cells) + k))
    return out


def hull_2d(points: DataFrame, by: list[str]) -> DataFrame:
    """The corners of each group's convex hull, anticlockwise from the lowest x.

    Each partition first keeps the hull of its own points, so what meets is small unless all points are corners.
    """
    from collections.abc import Iterator

    import pandas as pd

    schema = ", ".join([*[f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by], "x double, y double"])

    def hull(xy: np.ndarray) -> list[tuple[float, float]]:
        pts = sorted(set(map(tuple, xy)))
        if len(pts) < 3:
            return pts

        def half(seq):
            out = []
            for p in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out

        low, high = half(pts), half(pts[::-1])
        return low[:-1] + high[:-1]

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        if not by:
            return pd.DataFrame(hull(pdf[["x", "y"]].to_numpy()), columns=["x", "y"])
        parts = []
        for key, g in pdf.groupby(by, sort=False, dropna=False):
            h = hull(g[["x", "y"]].to_numpy())
            parts.append(pd.DataFrame({**dict(zip(by, key, strict=True)), "x": [p[0] for p in h], "y": [p[1] for p in h]}))
        return pd.concat(parts) if parts else pdf[[*by, "x", "y"]]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for pdf in batches:
            kept = of(pdf if kept is None else pd.concat([kept, pdf]))
        if kept is not None:
            yield kept

    slim = points.select(*by, F.col("x").cast("double"), F.col("y").cast("double"))
    ends = slim.mapInPandas(partial, schema)
    if not by:
        return ends.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(lambda pdf: of(pdf[["x", "y"]]), schema)
    return ends.groupBy(*by).applyInPandas(of, schema)


# splines and motion


def bspline_basis(i: int, degree: int, knots: list[float], t: Column) -> Column:
    """The basis function N_i of a degree over a knot vector, by the recursion of Cox and de Boor, as one expression."""
    if degree == 0:
        last = knots[i + 1] == knots[-1]
        return F.when((t >= knots[i]) & ((t <= knots[i + 1]) if last else (t < knots[i + 1])) & F.lit(knots[i] < knots[i + 1]), 1.0).otherwise(0.0)
    out = F.lit(0.0)
    if knots[i + degree] > knots[i]:
        out = out + (t - knots[i]) / (knots[i + degree] - knots[i]) * bspline_basis(i, degree - 1, knots, t)
    if knots[i + degree + 1] > knots[i + 1]:
        out = out + (knots[i + degree + 1] - t) / (knots[i + degree + 1] - knots[i + 1]) * bspline_basis(i + 1, degree - 1, knots, t)
    return out


def uniform_cubic(t: Column, control: list[float]) -> Column:
    """A uniform cubic B-spline at t in [0, 1] over a few control values; its ends repeat the outermost."""
    n = len(control)
    pos = t * (n - 1)
    cell = F.least(F.floor(pos), F.lit(n - 2)).cast("int")
    f = pos - cell
    c = F.array(*[F.lit(float(v)) for v in control])
    at = lambda d: F.get(c, F.least(F.greatest(cell + d, F.lit(0)), F.lit(n - 1)))
    w = [F.pow(1 - f, 3) / 6, (3 * F.pow(f, 3) - 6 * f * f + 4) / 6, (-3 * F.pow(f, 3) + 3 * f * f + 3 * f + 1) / 6, F.pow(f, 3) / 6]
    return w[0] * at(-1) + w[1] * at(0) + w[2] * at(1) + w[3] * at(2)


def parzen_motion(points: DataFrame, markers: DataFrame, point_id: list[str], sigma: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Displacement of each point: the mean of the markers' (m_x, ..., d_x, ...) weighted by a Gaussian of the distance.

    Markers are few and broadcast; a point's sums are combined before any shuffle. Where all weights vanish it stays."""
    d2 = sum((F.pow(F.col(a) - F.col(f"m_{a}"), 2) for a in axes), F.lit(0.0))
    j = points.crossJoin(F.broadcast(markers)).withColumn("_w", F.exp(-d2 / (2 * sigma * sigma)))
    total = F.sum("_w")
    return j.groupBy(*point_id).agg(*[F.when(total > 0, F.sum(F.col("_w") * F.col(f"d_{a}")) / total).otherwise(0.0).alias(f"d_{a}") for a in axes])


def rotate_about(p: dict[str, Column], axis: str, angle: Column, centre: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> dict[str, Column]:
    """Rotational motion: points turned about an axis through a centre by an angle that may depend on time."""
    x, y, z = (p[n] - c for n, c in zip("xyz", centre, strict=True))
    c, s = F.cos(angle), F.sin(angle)
    turned = {"x": (x, c * y - s * z, s * y + c * z), "y": (c * x + s * z, y, c * z - s * x), "z": (c * x - s * y, s * x + c * y, z)}[axis]
    return {n: v + o for n, v, o in zip("xyz", turned, centre, strict=True)}


def planar(motion: dict[str, Column], normal: tuple[float, float, float]) -> dict[str, Column]:
    """A displacement without its part along a normal."""
    n = np.array(normal) / np.linalg.norm(normal)
    along = motion["x"] * n[0] + motion["y"] * n[1] + motion["z"] * n[2]
    return {a: motion[a] - along * float(k) for a, k in zip("xyz", n, strict=True)}


def thin_plate(centres: np.ndarray, values: np.ndarray, smooth: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and affine part of a thin-plate spline through a few centres (n x 2), by one small solve."""
    n = len(centres)
    d = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    k = np.where(d > 0, d * d * np.log(np.where(d > 0, d, 1.0)), 0.0) + smooth * np.eye(n)
    p = np.concatenate([np.ones((n, 1)), centres], axis=1)
    full = np.block([[k, p], [p.T, np.zeros((3, 3))]])
    out = np.linalg.solve(full, np.concatenate([values, np.zeros(3)]))
    return out[:n], out[n:]


def thin_plate_at(x: Column, y: Column, centres: np.ndarray, weights: np.ndarray, affine: np.ndarray) -> Column:
    out = F.lit(float(affine[0])) + x * float(affine[1]) + y * float(affine[2])
    for (cx, cy), w in zip(centres, weights, strict=True):
        r2 = F.pow(x - float(cx), 2) + F.pow(y - float(cy), 2)
        out = out + F.when(r2 > 0, r2 * F.log(r2) / 2).otherwise(0.0) * float(w)
    return out


def rigid_fit(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Rotation and shift in the plane that take points (x, y) nearest to (u, v), for each group: closed form of sums."""
    m = pairs.groupBy(*by).agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("u").alias("mu"), F.avg("v").alias("mv"),
        F.covar_pop("x", "u").alias("xu"), F.covar_pop("y", "v").alias("yv"), F.covar_pop("x", "v").alias("xv"), F.covar_pop("y", "u").alias("yu"),
    )
    m = m.withColumn("angle", F.atan2(F.col("xv") - F.col("yu"), F.col("xu") + F.col("yv")))
    c, s = F.cos("angle"), F.sin("angle")
    return m.select(*by, "angle", (F.col("mu") - c * F.col("mx") + s * F.col("my")).alias("tx"), (F.col("mv") - s * F.col("mx") - c * F.col("my")).alias("ty"))


def calibrate(beads: np.ndarray, image: np.ndarray) -> np.ndarray:
    """The projection matrix that takes beads (n x 3) to points (n x 2), n >= 6, by the direct linear transform."""
    rows = []
    for (x, y, z), (u, v) in zip(beads, image, strict=True):
        rows += [[x, y, z, 1, 0, 0, 0, 0, -u * x, -u * y, -u * z, -u], [0, 0, 0, 0, x, y, z, 1, -v * x, -v * y, -v * z, -v]]
    p = np.linalg.svd(np.array(rows))[2][-1].reshape(3, 4)
    return p / p[2, 3] if abs(p[2, 3]) > 1e-12 else p


def euler_matrix(a: float, b: float, c: float) -> np.ndarray:
    return np.array(rotation("z", c)) @ np.array(rotation("y", b)) @ np.array(rotation("x", a))
