"""Projection and reconstruction: rays and pixels are rows, interpolation is a join, line integrals are sums."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.operators.interp import sample_linear


def views(spark: SparkSession, n: int, span: float = math.pi) -> DataFrame:
    """(view, angle): n equal steps over an angle, in radians."""
    return spark.range(n).select(F.col("id").cast("int").alias("view"), (F.col("id") * (span / n)).alias("angle"))


def pixels(spark: SparkSession, height: int, width: int) -> DataFrame:
    return spark.range(height * width).select((F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))


# rays: (view, u, ox, oy, dx, dy, length), in pixels, from an origin along a unit direction


def parallel_rays(angles: DataFrame, bins: int, size: int, spacing: float = 1.0) -> DataFrame:
    """The detector axis is (cos, sin) of the angle; rays run along (-sin, cos) through the square around the image."""
    half, c, s = size / math.sqrt(2) + 1, F.cos("angle"), F.sin("angle")
    mid = (size - 1) / 2
    u = (F.col("u") - (bins - 1) / 2) * spacing
    out = angles.select("view", "angle", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("u"))
    return out.select("view", "u", (u * c + half * s + mid).alias("ox"), (u * s - half * c + mid).alias("oy"), (-s).alias("dx"), c.alias("dy"), F.lit(2 * half).alias("length"))


def fan_rays(angles: DataFrame, bins: int, size: int, source: float, detector: float, spacing: float = 1.0) -> DataFrame:
    """From a source that turns at a distance to a flat detector beyond the centre."""
    mid, c, s = (size - 1) / 2, F.cos("angle"), F.sin("angle")
    u = (F.col("u") - (bins - 1) / 2) * spacing
    out = angles.select("view", "angle", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("u"))
    px, py = u * c - (detector - source) * -s, u * s - (detector - source) * c
    out = out.select("view", "u", (source * -s).alias("sx"), (source * c).alias("sy"), px.alias("px"), py.alias("py"))
    n = F.hypot(F.col("px") - F.col("sx"), F.col("py") - F.col("sy"))
    return out.select("view", "u", (F.col("sx") + mid).alias("ox"), (F.col("sy") + mid).alias("oy"), ((F.col("px") - F.col("sx")) / n).alias("dx"), ((F.col("py") - F.col("sy")) / n).alias("dy"), n.alias("length"))


def ray_samples(rays: DataFrame, per_pixel: int = 3) -> DataFrame:
    steps = F.sequence(F.lit(0), F.floor(F.col("length") * per_pixel).cast("int"))
    out = rays.select("view", "u", "ox", "oy", "dx", "dy", F.explode(steps).alias("k"))
    t = F.col("k") / per_pixel
    return out.select("view", "u", "k", (F.col("ox") + F.col("dx") * t).alias("x"), (F.col("oy") + F.col("dy") * t).alias("y"))


def forward_project(grid: DataFrame, rays: DataFrame, size: tuple[int, int], per_pixel: int = 3) -> DataFrame:
    """(view, u, v): bilinear samples along each ray, added up. Samples off the image are left out before the join."""
    h, w = size
    inside = ray_samples(rays, per_pixel).filter(F.col("x").between(-1, w) & F.col("y").between(-1, h))
    sums = sample_linear(grid, inside, ["view", "u"])
    full = rays.select("view", "u").join(sums, ["view", "u"], "left")
    return full.select("view", "u", (F.coalesce("v", F.lit(0.0)) / per_pixel).alias("v"))


def system_matrix(rays: DataFrame, size: tuple[int, int], per_pixel: int = 3) -> DataFrame:
    """(view, u, y, x, w): the weights by which forward_project adds up pixels."""
    h, w = size
    s = ray_samples(rays, per_pixel).filter(F.col("x").between(-1, w) & F.col("y").between(-1, h))
    fx, fy = F.col("x") - F.floor("x"), F.col("y") - F.floor("y")
    corners = [
        F.struct((F.floor("y") + dy).cast("int").alias("y"), (F.floor("x") + dx).cast("int").alias("x"), ((fy if dy else 1 - fy) * (fx if dx else 1 - fx)).alias("w"))
        for dy in (0, 1) for dx in (0, 1)
    ]
    long = s.select("view", "u", F.explode(F.array(*corners)).alias("c")).select("view", "u", "c.*")
    long = long.filter((F.col("w") > 0) & F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))
    return long.groupBy("view", "u", "y", "x").agg((F.sum("w") / per_pixel).alias("w"))


def interpolate_detector(points: DataFrame, sinogram: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Sum over views of a weight times the sinogram at a real detector position `_s`."""
    low, frac = F.floor("_s"), F.col("_s") - F.floor("_s")
    taps = F.array(F.struct(low.cast("int").alias("u"), (weight * (1 - frac)).alias("w")), F.struct((low + 1).cast("int").alias("u"), (weight * frac).alias("w")))
    long = points.select(*keys, "view", F.explode(taps).alias("t")).select(*keys, "view", F.col("t.u").alias("u"), F.col("t.w").alias("_w"))
    return long.join(sinogram, ["view", "u"]).groupBy(*keys).agg(F.sum(F.col("_w") * F.col("v")).alias("v"))


def back_project(sinogram: DataFrame, angles: DataFrame, image: DataFrame, bins: int, size: int, spacing: float = 1.0, span: float = math.pi) -> DataFrame:
    """Pixel-driven, parallel rays: every pixel meets every view, as the integral asks; views are few and broadcast."""
    mid, n = (size - 1) / 2, angles.count()
    s = ((F.col("x") - mid) * F.cos("angle") + (F.col("y") - mid) * F.sin("angle")) / spacing + (bins - 1) / 2
    points = image.crossJoin(F.broadcast(angles)).select("y", "x", "view", s.alias("_s"))
    return interpolate_detector(points, sinogram, ["y", "x"], F.lit(span / n))


def fan_back_project(sinogram: DataFrame, angles: DataFrame, image: DataFrame, bins: int, size: int, source: float, detector: float, spacing: float = 1.0, span: float = 2 * math.pi) -> DataFrame:
    """With weights 1 / U^2, U the distance from the source along the central ray over that of the centre."""
    mid, n = (size - 1) / 2, angles.count()
    px, py = F.col("x") - mid, F.col("y") - mid
    along = source - (py * F.cos("angle") - px * F.sin("angle"))
    across = px * F.cos("angle") + py * F.sin("angle")
    points = image.crossJoin(F.broadcast(angles)).select("y", "x", "view", (across * detector / along / spacing + (bins - 1) / 2).alias("_s"), (along / source).alias("_U"))
    points = points.withColumn("_w", 1 / (F.col("_U") * F.col("_U")))
    low, frac = F.floor("_s"), F.col("_s") - F.floor("_s")
    taps = F.array(F.struct(low.cast("int").alias("u"), (F.col("_w") * (1 - frac)).alias("k")), F.struct((low + 1).cast("int").alias("u"), (F.col("_w") * frac).alias("k")))
    long = points.select("y", "x", "view", F.explode(taps).alias("t")).select("y", "x", "view", F.col("t.u").alias("u"), F.col("t.k").alias("k"))
    return long.join(sinogram, ["view", "u"]).groupBy("y", "x").agg((F.sum(F.col("k") * F.col("v")) * (span / n / 2)).alias("v"))


def cone_matrices(angles: DataFrame, shape: tuple[int, int], source: float, detector: float, spacing: float = 1.0) -> DataFrame:
    """(view, p): the 3 x 4 matrices of a circular scan about the z axis, the centre at 0, for cone_back_project with the
    distance 1: the last row is the distance along the central ray over that of the centre."""
    h, w = shape
    c, s = F.cos("angle"), F.sin("angle")
    # along = source - (y cos - x sin), across = x cos + y sin; u = across * detector / along / spacing + middle
    depth = [s / source, -c / source, F.lit(0.0), F.lit(1.0)]
    across, up = [c, s, F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)]
    k = detector / source / spacing
    rows = [[a * k + d * ((w - 1) / 2) for a, d in zip(across, depth, strict=True)], [a * k + d * ((h - 1) / 2) for a, d in zip(up, depth, strict=True)], depth]
    return angles.select("view", F.array(*[e for r in rows for e in r]).alias("p"))


def cone_rays(angles: DataFrame, shape: tuple[int, int], size: int, source: float, detector: float, spacing: float = 1.0) -> DataFrame:
    """(view, r, u, ox, oy, oz, dx, dy, dz, near, far): rays from the source to the cells (r, u) of a flat detector, in
    voxels of a cube of a size, and the stretch of each within the ball around it."""
    h, w = shape
    mid, c, s = (size - 1) / 2, F.cos("angle"), F.sin("angle")
    out = angles.select("view", "angle", F.explode(F.sequence(F.lit(0), F.lit(h * w - 1))).alias("_i"))
    r, u = F.floor(F.col("_i") / w), F.col("_i") % w
    across, up = (u - (w - 1) / 2) * spacing, (r - (h - 1) / 2) * spacing
    n = F.sqrt(across * across + up * up + detector * detector)
    out = out.select(
        "view", r.cast("int").alias("r"), u.cast("int").alias("u"), (source * -s).alias("ox"), (source * c).alias("oy"), F.lit(0.0).alias("oz"),
        ((across * c + detector * s) / n).alias("dx"), ((across * s - detector * c) / n).alias("dy"), (up / n).alias("dz"),
    )
    nearest = -(F.col("ox") * F.col("dx") + F.col("oy") * F.col("dy") + F.col("oz") * F.col("dz"))
    miss2 = F.lit(source * source) - nearest * nearest
    half = F.sqrt(F.greatest(F.lit(3 * (mid + 1) ** 2) - miss2, F.lit(0.0)))
    return out.select("view", "r", "u", *[(F.col(f"o{a}") + mid).alias(f"o{a}") for a in "xyz"], "dx", "dy", "dz", (nearest - half).alias("near"), (nearest + half).alias("far"))


def cone_project(volume: DataFrame, rays: DataFrame, size: int | None, per_voxel: int = 2) -> DataFrame:
    """(view, r, u, v): trilinear samples of a volume (z, y, x, v) along each ray, added up; where it has no cell it is 0.

    size: of a cube that holds the volume, so samples off it are left out before the join; None, the volume may reach
    anywhere and all samples are looked up. Cells that no ray comes near are left out too, and sums are combined before
    they are shuffled."""
    at = lambda a, t: F.col(f"o{a}") + F.col(f"d{a}") * t
    ends = {a: (at(a, F.col("near")), at(a, F.col("far"))) for a in "zyx"}
    box = rays.agg(*[c for a, e in ends.items() for c in (F.min(F.least(*e)).alias(f"_l{a}"), F.max(F.greatest(*e)).alias(f"_h{a}"))])
    cells = volume.crossJoin(F.broadcast(box))
    for a in "zyx":
        cells = cells.filter(F.col(a).between(F.col(f"_l{a}") - 2, F.col(f"_h{a}") + 2))
    steps = F.sequence(F.lit(0), F.floor((F.col("far") - F.col("near")) * per_voxel).cast("int"))
    s = rays.select("*", F.explode(steps).alias("_k")).withColumn("_t", F.col("near") + F.col("_k") / per_voxel)
    s = s.select("view", "r", "u", *[at(a, F.col("_t")).alias(a) for a in "zyx"])
    if size is not None:
        s = s.filter(F.col("x").between(-1, size) & F.col("y").between(-1, size) & F.col("z").between(-1, size))
    sums = sample_linear(cells.select("z", "y", "x", "v"), s, ["view", "r", "u"])
    full = rays.select("view", "r", "u").join(sums, ["view", "r", "u"], "left")
    return full.select("view", "r", "u", (F.coalesce("v", F.lit(0.0)) / per_voxel).alias("v"))


def fdk(projections: DataFrame, angles: DataFrame, voxels: DataFrame, shape: tuple[int, int], source: float, detector: float, spacing: float = 1.0, kind: str = "ram_lak") -> DataFrame:
    """(k, j, i, v): cosine weights, ramp filter along the rows and weighted back projection of a full circular scan.

    projections (view, r, u, v); voxels (k, j, i, wx, wy, wz) from the centre, as for cone_back_project.
    """
    h, w = shape
    across, up = (F.col("u") - (w - 1) / 2) * spacing, (F.col("r") - (h - 1) / 2) * spacing
    weighted = projections.withColumn("v", F.col("v") * detector / F.sqrt(across * across + up * up + detector * detector))
    rows = filter_views(weighted, kind, spacing, ("view", "r"))
    matrices = cone_matrices(angles, shape, source, detector, spacing)
    # a distance of 1, as the depth is relative; every ray is seen twice and the detector magnifies
    out = cone_back_project(rows.select("view", F.col("r").alias("y"), F.col("u").alias("x"), "v"), matrices, voxels, 1.0)
    return out.withColumn("v", F.col("v") * (detector / source / 2))


def cone_back_project(projections: DataFrame, matrices: DataFrame, voxels: DataFrame, distance: float) -> DataFrame:
    """Voxel-driven: (u, v, w) = P (x, y, z, 1), bilinear in the view at (u/w, v/w), weighted D^2 2 pi / N / w^2.

    projections (view, y, x, v); matrices (view, p array<double> of 12); voxels (k, j, i, wx, wy, wz).
    """
    n = matrices.count()
    p = lambda i: F.get("p", F.lit(i))
    row = lambda r: p(4 * r) * F.col("wx") + p(4 * r + 1) * F.col("wy") + p(4 * r + 2) * F.col("wz") + p(4 * r + 3)
    pts = voxels.crossJoin(F.broadcast(matrices)).select("k", "j", "i", "view", row(0).alias("a"), row(1).alias("b"), row(2).alias("w"))
    pts = pts.select("k", "j", "i", F.col("view").cast("long").alias("_view"), F.col("view").cast("long").alias("t"), (F.col("b") / F.col("w")).alias("y"), (F.col("a") / F.col("w")).alias("x"), (distance * distance * 2 * math.pi / n / (F.col("w") ** 2)).alias("_k"))
    got = sample_linear(projections.withColumnRenamed("view", "t"), pts, ["k", "j", "i", "_view", "_k"])
    return got.groupBy("k", "j", "i").agg(F.sum(F.col("v") * F.col("_k")).alias("v"))


# filters and weights


def ramp_kernel(kind: str, n: Column, spacing: float = 1.0) -> Column:
    """The spatial kernel at an integer distance."""
    if kind == "ram_lak":
        return F.when(n == 0, 1 / (4 * spacing)).when(n % 2 != 0, -1 / (math.pi**2 * spacing * n * n)).otherwise(0.0)
    if kind == "shepp_logan":
        return -2 / (math.pi**2 * spacing * (4 * n * n - 1))
    if kind == "hilbert":
        return F.when(n % 2 != 0, 2 / (math.pi * spacing * n)).otherwise(0.0)
    if kind == "derivative":
        return F.when(n == 1, -1 / spacing).when(n == 0, 1 / spacing).otherwise(0.0)
    if kind == "laplace":
        return F.when(n == 0, 2.0).when(F.abs(n) == 1, -1.0).otherwise(0.0)
    raise ValueError(f"no kernel {kind!r}")


def filter_views(sinogram: DataFrame, kind: str, spacing: float = 1.0, keys: tuple[str, ...] = ("view",)) -> DataFrame:
    """Convolution along the detector. A row of the detector is a bounded group; products are combined before the shuffle."""
    other = sinogram.select(*keys, F.col("u").alias("_u"), F.col("v").alias("_v"))
    pairs = sinogram.select(*keys, "u").join(other, list(keys))
    k = ramp_kernel(kind, F.col("u") - F.col("_u"), spacing)
    return pairs.groupBy(*keys, "u").agg(F.sum(k * F.col("_v")).alias("v"))


def ramp_response(kind: str, f: Column, cut: float = 1.0) -> Column:
    """The frequency response at a frequency in units of the Nyquist frequency, 0 beyond a cut-off."""
    a = F.abs(f)
    sinc = F.when(a == 0, 1.0).otherwise(F.sin(a * math.pi / 2) / (a * math.pi / 2))
    shape = {
        "ram_lak": F.lit(1.0), "shepp_logan": sinc, "hamming": 0.54 + 0.46 * F.cos(a * math.pi / cut), "hann": 0.5 + 0.5 * F.cos(a * math.pi / cut), "cosine": F.cos(a * math.pi / 2 / cut),
    }[kind]
    return F.when(a > cut, 0.0).otherwise(a * shape)


def parker_weight(beta: Column, gamma: Column, delta: float, scan: float | None = None) -> Column:
    """The redundancy weight of a ray at fan angle gamma in view beta, for a scan over pi + 2 delta.

    scan: the angle really scanned; the weights are centred in it and scaled by its share of a half turn.
    """
    if scan is not None:
        return parker_weight(beta + (math.pi + 2 * delta - scan) / 2, gamma, delta) * (scan / math.pi)
    up, flat = 2 * delta - 2 * gamma, math.pi - 2 * gamma
    rise = F.when(F.abs(delta - gamma) < 1e-12, 1.0).otherwise(F.pow(F.sin(math.pi / 4 * beta / (delta - gamma)), 2))
    fall = F.when(F.abs(delta + gamma) < 1e-12, 1.0).otherwise(F.pow(F.sin(math.pi / 4 * (math.pi + 2 * delta - beta) / (delta + gamma)), 2))
    return F.when((beta < 0) | (beta > math.pi + 2 * delta), 0.0).when(beta < up, rise).when(beta <= flat, 1.0).otherwise(fall)


def silver_weight(beta: Column, gamma: Column, delta: float, over: float) -> Column:
    """Parker weights over a longer scan: the angle by which it exceeds the least one widens the ramps."""
    return parker_weight(beta, gamma, delta + over / 2)


def binary_weight(beta: Column, gamma: Column, delta: float) -> Column:
    """The first of two equal rays counts, the second does not."""
    return F.when((beta >= 0) & (beta <= math.pi - 2 * gamma) & (beta <= math.pi + 2 * delta), 1.0).otherwise(0.0)


def truncation_taper(rows: DataFrame, extra: int, row: str = "row") -> DataFrame:
    """A detector row with `extra` values on each side: mirrored about its end, 2 s - p, and let down by a sine to 0."""
    r, n = F.col(row), F.size(row)
    first, last = F.get(r, F.lit(0)), F.get(r, n - 1)
    fade = lambda i: F.pow(F.sin((F.lit(extra) - i) / extra * (math.pi / 2)), 0.75)
    left = F.transform(F.sequence(F.lit(extra), F.lit(1), F.lit(-1)), lambda i: (2 * first - F.get(r, F.least(i, n - 1))) * fade(i))
    right = F.transform(F.sequence(F.lit(1), F.lit(extra)), lambda i: (2 * last - F.get(r, F.greatest(n - 1 - i, F.lit(0)))) * fade(i))
    return rows.withColumn(row, F.concat(left, r, right))


def epipolar_consistency(derivatives: DataFrame, pairs: DataFrame) -> DataFrame:
    """Mean squared difference of the values that two views hold for the same planes.

    derivatives (view, line, v): the Radon derivative of each view; pairs (a, b, plane, line_a, line_b).
    """
    left = derivatives.select(F.col("view").alias("a"), F.col("line").alias("line_a"), F.col("v").alias("_va"))
    right = derivatives.select(F.col("view").alias("b"), F.col("line").alias("line_b"), F.col("v").alias("_vb"))
    return pairs.join(left, ["a", "line_a"]).join(right, ["b", "line_b"]).groupBy("a", "b").agg(F.avg(F.pow(F.col("_va") - F.col("_vb"), 2)).alias("inconsistency"))


# iterative


def sart(system: DataFrame, sinogram: DataFrame, start: DataFrame, view_order: list[int], rounds: int, relaxation: float = 0.8, minimum: float | None = 0.0) -> DataFrame:
    """Algebraic reconstruction, one view after the other: the mean residual of each ray goes back along it.

    system (view, u, y, x, w) should be a table from by_view, of which a step reads its own view. The image is checkpointed after each view,
    which keeps plans short; a lost executor costs one view at most.
    """
    image = start
    norms = system.groupBy("view", "u").agg(F.sum("w").alias("_n"))
    for _ in range(rounds):
        for view in view_order:
            a = system.filter(F.col("view") == view)
            seen = a.join(image, ["y", "x"]).groupBy("u").agg(F.sum(F.col("w") * F.col("v")).alias("_p"))
            miss = sinogram.filter(F.col("view") == view).join(seen, "u", "left").join(norms.filter(F.col("view") == view).drop("view"), "u")
            miss = miss.select("u", ((F.col("v") - F.coalesce("_p", F.lit(0.0))) / F.col("_n")).alias("_r"))
            step = a.join(miss, "u").groupBy("y", "x").agg((F.sum(F.col("w") * F.col("_r")) / F.sum("w")).alias("_d"))
            v = F.col("v") + relaxation * F.coalesce("_d", F.lit(0.0))
            image = image.join(step, ["y", "x"], "left").select("y", "x", (F.greatest(v, F.lit(minimum)) if minimum is not None else v).alias("v")).checkpoint()
    return image


def by_view(system: DataFrame, tasks: int = 8) -> DataFrame:
    """A system matrix written to the folder of checkpoints, one partition a view, each written by `tasks` tasks."""
    spark = system.sparkSession
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/system-{uuid.uuid4().hex}"
    deal = F.pmod(F.xxhash64("u", "y", "x"), F.lit(tasks))
    system.repartition("view", deal).write.partitionBy("view").parquet(path)
    return spark.read.parquet(path).select(*system.columns)


def sart_order(n: int) -> list[int]:
    """Views a third of the scan apart follow each other."""
    step, seen, out, p = max(1, n // 3), set(), [], 0
    while len(out) < n:
        while p in seen:
            p = (p + 1) % n
        out.append(p)
        seen.add(p)
        p = (p + step) % n
    return out


def simultaneous_step(system: DataFrame, sinogram: DataFrame, image: DataFrame, relaxation: float = 1.0) -> DataFrame:
    """One update by all views at once."""
    seen = system.join(image, ["y", "x"]).groupBy("view", "u").agg(F.sum(F.col("w") * F.col("v")).alias("_p"))
    norms = system.groupBy("view", "u").agg(F.sum("w").alias("_n"))
    miss = sinogram.join(seen, ["view", "u"], "left").join(norms, ["view", "u"]).select("view", "u", ((F.col("v") - F.coalesce("_p", F.lit(0.0))) / F.col("_n")).alias("_r"))
    step = system.join(miss, ["view", "u"]).groupBy("y", "x").agg((F.sum(F.col("w") * F.col("_r")) / F.sum("w")).alias("_d"))
    return image.join(step, ["y", "x"], "left").select("y", "x", (F.col("v") + relaxation * F.coalesce("_d", F.lit(0.0))).alias("v"))


def total_variation_steps(image: DataFrame, steps: int, size: float = 0.3) -> DataFrame:
    """Gradient steps that lower the total variation, each as long as `size` times the gradient's own norm allows. Each is
    checkpointed, as it uses the image three times."""
    from latticework.operators.neighbors import tv_gradient

    for _ in range(steps):
        g = tv_gradient(image).withColumnRenamed("v", "_g")
        norm = g.agg(F.sqrt(F.sum(F.col("_g") ** 2)).alias("_n"))
        image = image.join(g, ["y", "x"]).crossJoin(F.broadcast(norm))
        image = image.select("y", "x", F.when(F.col("_n") > 0, F.col("v") - size * F.col("_g") / F.col("_n")).otherwise(F.col("v")).alias("v")).checkpoint()
    return image


def etv(system: DataFrame, sinogram: DataFrame, start: DataFrame, view_order: list[int], rounds: int, tv_steps: int = 5, mix: float = 0.8, relaxation: float = 0.8) -> DataFrame:
    """Rounds of algebraic reconstruction and of total variation steps: (1 - mix) of the first, mix of the second."""
    image = start
    for _ in range(rounds):
        image = sart(system, sinogram, image, view_order, 1, relaxation)
        smooth = total_variation_steps(image, tv_steps).withColumnRenamed("v", "_t")
        image = image.join(smooth, ["y", "x"]).select("y", "x", ((1 - min(mix, 1.0)) * F.col("v") + min(mix, 1.0) * F.col("_t")).alias("v")).checkpoint()
    return image


def conjugate_gradient(system: DataFrame, sinogram: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """Least squares on the normal equations; tables of the image's and the sinogram's size, scalars on the driver."""
    forward = lambda x: system.join(x, ["y", "x"]).groupBy("view", "u").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    back = lambda p: system.join(p, ["view", "u"]).groupBy("y", "x").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    norm = lambda t: t.agg(F.coalesce(F.sum(F.col("v") ** 2), F.lit(0.0))).first()[0]

    def plus(a: DataFrame, b: DataFrame, k: float, on: list[str]) -> DataFrame:
        return a.join(b.withColumnRenamed("v", "_b"), on, "left").select(*on, (F.col("v") + k * F.coalesce("_b", F.lit(0.0))).alias("v")).checkpoint()

    image = start
    residual = plus(sinogram, forward(image), -1.0, ["view", "u"])
    s = back(residual).checkpoint()
    p, gamma = s, norm(s)
    for _ in range(rounds):
        if gamma <= 1e-20:
            break
        q = forward(p).checkpoint()
        alpha = gamma / norm(q)
        image = plus(image, p, alpha, ["y", "x"])
        residual = plus(residual, q, -alpha, ["view", "u"])
        s = back(residual).checkpoint()
        new = norm(s)
        p, gamma = plus(s, p, new / gamma, ["y", "x"]), new
    return image
