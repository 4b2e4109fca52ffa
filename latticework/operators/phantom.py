"""Phantoms: shapes as rows, voxels as a spine of coordinates, values as sums over the shapes that hold them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ten ellipses of Shepp and Logan as (value, a, b, x0, y0, angle in degrees).
SHEPP_LOGAN = (
    (1.0, 0.69, 0.92, 0.0, 0.0, 0.0),
    (-0.98, 0.6624, 0.874, 0.0, -0.0184, 0.0),
    (-0.02, 0.11, 0.31, 0.22, 0.0, -18.0),
    (-0.02, 0.16, 0.41, -0.22, 0.0, 18.0),
    (0.01, 0.21, 0.25, 0.0, 0.35, 0.0),
    (0.01, 0.046, 0.046, 0.0, 0.1, 0.0),
    (0.01, 0.046, 0.046, 0.0, -0.1, 0.0),
    (0.01, 0.046, 0.023, -0.08, -0.605, 0.0),
    (0.01, 0.023, 0.023, 0.0, -0.606, 0.0),
    (0.01, 0.023, 0.046, 0.06, -0.605, 0.0),
)
#: The contrasts of the modified form.
MODIFIED = (1.0, -0.8, -0.2, -0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1)


def shepp_logan(spark: SparkSession, modified: bool = True) -> DataFrame:
    rows = [(k, MODIFIED[k] if modified else e[0], *e[1:]) for k, e in enumerate(SHEPP_LOGAN)]
    return spark.createDataFrame(rows, "k int, val double, a double, b double, x0 double, y0 double, phi double")


def rasterize(spark: SparkSession, ellipses: DataFrame, size: int) -> DataFrame:
    """(y, x, v) on a square of size x size over [-1, 1]^2: the sum of the values of the ellipses that hold a centre.

    Ellipses are a scene, tens of rows, and broadcast; pixels are the distributed side."""
    c = lambda n: (F.col(n) - (size - 1) / 2) / (size / 2)
    p = spark.range(size * size).select((F.col("id") / size).cast("int").alias("y"), (F.col("id") % size).cast("int").alias("x"))
    phi = F.radians("phi")
    dx, dy = c("x") - F.col("x0"), c("y") - F.col("y0")
    u, w = dx * F.cos(phi) + dy * F.sin(phi), -dx * F.sin(phi) + dy * F.cos(phi)
    inside = F.pow(u / F.col("a"), 2) + F.pow(w / F.col("b"), 2) <= 1
    return p.crossJoin(F.broadcast(ellipses)).groupBy("y", "x").agg(F.sum(F.when(inside, F.col("val")).otherwise(0.0)).alias("v"))


def ellipse_projection(ellipses: DataFrame, angles: DataFrame, bins: int, size: int) -> DataFrame:
    """The exact line integrals of a scene of ellipses along parallel rays, in pixels of `size` to the unit square's 2."""
    rays = angles.select("view", "angle", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("u"))
    s = (F.col("u") - (bins - 1) / 2) / (size / 2)
    t = rays.crossJoin(F.broadcast(ellipses)).withColumn("_t", F.col("angle") - F.radians("phi"))
    r2 = F.pow(F.col("a") * F.cos("_t"), 2) + F.pow(F.col("b") * F.sin("_t"), 2)
    off = s - F.col("x0") * F.cos("angle") - F.col("y0") * F.sin("angle")
    chord = F.when(off * off < r2, 2 * F.col("a") * F.col("b") * F.sqrt(r2 - off * off) / r2).otherwise(0.0)
    return t.groupBy("view", "u").agg((F.sum(F.col("val") * chord) * (size / 2)).alias("v"))


def disc(spark: SparkSession, size: int, radius: float = 0.4, value: float = 1.0) -> DataFrame:
    """A uniform circle of radius * size about the middle."""
    p = spark.range(size * size).select((F.col("id") / size).cast("int").alias("y"), (F.col("id") % size).cast("int").alias("x"))
    d = F.pow(F.col("x") - size / 2, 2) + F.pow(F.col("y") - size / 2, 2)
    return p.withColumn("v", F.when(d <= (radius * size) ** 2, value).otherwise(0.0))


# solids: (obj, priority, material, kind, p array<double>)

SOLIDS = "obj int, priority int, material string, kind string, p array<double>"


def scene(spark: SparkSession, name: str, extent: float = 100.0) -> DataFrame:
    """Analytic scenes: of each shape its kind and parameters, scaled to an extent in mm."""
    e = extent
    shapes = {
        "sphere": [("sphere", "water", [0.0, 0.0, 0.0, 0.4 * e])],
        "box": [("box", "water", [-0.3 * e, -0.3 * e, -0.3 * e, 0.3 * e, 0.3 * e, 0.3 * e])],
        "cylinder": [("cylinder", "water", [0.0, 0.0, 0.35 * e, -0.4 * e, 0.4 * e])],
        "cone": [("cone", "water", [0.0, 0.0, 0.35 * e, -0.4 * e, 0.4 * e])],
        "ellipsoid": [("ellipsoid", "water", [0.0, 0.0, 0.0, 0.4 * e, 0.3 * e, 0.2 * e])],
        "pyramid": [("pyramid", "water", [0.3 * e, -0.4 * e, 0.4 * e])],
        "defrise": [("cylinder", "bone", [0.0, 0.0, 0.4 * e, -0.4 * e + 0.2 * e * k - 2, -0.4 * e + 0.2 * e * k + 2]) for k in range(5)],
        "beads": [("sphere", "teflon", [0.3 * e * math.cos(math.pi / 3 * k), 0.3 * e * math.sin(math.pi / 3 * k), 0.0, 2.0]) for k in range(6)]
        + [("sphere", "teflon", [0.0, 0.0, 0.0, 2.0])],
        "helix": [("sphere", "teflon", [0.35 * e * math.cos(0.5 * k), 0.35 * e * math.sin(0.5 * k), -0.4 * e + 0.02 * e * k, 1.5]) for k in range(40)],
        "nested": [("cylinder", "water", [0.0, 0.0, 0.4 * e, -0.4 * e, 0.4 * e]), ("cylinder", "bone", [0.1 * e, 0.0, 0.1 * e, -0.3 * e, 0.3 * e]), ("sphere", "air", [-0.15 * e, 0.0, 0.0, 0.1 * e])],
    }[name]
    return spark.createDataFrame([(k, k, m, kind, p) for k, (kind, m, p) in enumerate(shapes)], SOLIDS)


def contains(x, y, z):
    """Whether a solid's parameters hold a point."""
    p = lambda i: F.get("p", F.lit(i))
    r2 = F.pow(x - p(0), 2) + F.pow(y - p(1), 2)
    in_z = z.between(p(3), p(4))
    return (
        F.when(F.col("kind") == "sphere", r2 + F.pow(z - p(2), 2) <= p(3) * p(3))
        .when(F.col("kind") == "box", x.between(p(0), p(3)) & y.between(p(1), p(4)) & z.between(p(2), p(5)))
        .when(F.col("kind") == "cylinder", (r2 <= p(2) * p(2)) & in_z)
        .when(F.col("kind") == "cone", (F.sqrt(r2) <= p(2) * (p(4) - z) / (p(4) - p(3))) & in_z)
        .when(F.col("kind") == "ellipsoid", F.pow((x - p(0)) / p(3), 2) + F.pow((y - p(1)) / p(4), 2) + F.pow((z - p(2)) / p(5), 2) <= 1)
        .when(F.col("kind") == "pyramid", (F.greatest(F.abs(x), F.abs(y)) <= p(0) * (p(2) - z) / (p(2) - p(1))) & z.between(p(1), p(2)))
        .otherwise(False)
    )


def render(spark: SparkSession, solids: DataFrame, size: int, spacing: float) -> DataFrame:
    """(z, y, x, obj, material): the solid of highest priority at each voxel's centre; voxels outside all have no row."""
    n = size**3
    w = lambda c: (F.col(c) - (size - 1) / 2) * spacing
    v = spark.range(n).select((F.col("id") / (size * size)).cast("int").alias("z"), ((F.col("id") / size).cast("int") % size).alias("y"), (F.col("id") % size).cast("int").alias("x"))
    held = v.crossJoin(F.broadcast(solids)).filter(contains(w("x"), w("y"), w("z")))
    return held.groupBy("z", "y", "x").agg(F.max(F.struct("priority", "obj", "material")).alias("s")).select("z", "y", "x", "s.obj", "s.material")
