"""Readers and writers of text formats: matrices, curves, graphs, meshes, material tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"


def numbers(text: Column) -> Column:
    """All numbers in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({_NUMBER})"), F.lit(1)), lambda x: x.cast("double"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): each file as one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): the lines of each file with their places; a file is read by one task."""
    return whole_files(spark, path).select("path", F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, v): one number a line, such as heart phases; lines without a number are left out."""
    rows = numbered_lines(spark, path).withColumn("v", F.expr("try_cast(trim(value) as double)")).filter("v is not null")
    return rows.select("path", F.col("line").alias("i"), "v")


def read_projection_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(path, view, p array<double>): every twelve numbers of a file are a matrix, row by row."""
    n = whole_files(spark, path).select("path", numbers(F.col("value")).alias("n"))
    views = n.select("path", "n", F.explode(F.sequence(F.lit(0), F.floor(F.size("n") / 12).cast("int") - 1)).alias("view")).filter(F.size("n") >= 12)
    return views.select("path", "view", F.slice("n", F.col("view") * 12 + 1, 12).alias("p"))


def matrix_text(p: Column) -> Column:
    return F.concat_ws("\n", *[F.array_join(F.slice(p, 4 * r + 1, 4).cast("array<string>"), " ") for r in range(3)])


def read_edges(spark: SparkSession, path: str, separator: str = r"[\s,;]+") -> DataFrame:
    """(src, dst, weight): two numbers a line and maybe a third, 1 otherwise."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), separator).alias("p")).filter(F.size("p") >= 2)
    return parts.select(
        F.expr("try_cast(p[0] as bigint)").alias("src"), F.expr("try_cast(p[1] as bigint)").alias("dst"), F.coalesce(F.expr("try_cast(get(p, 2) as double)"), F.lit(1.0)).alias("weight")
    ).filter("src is not null and dst is not null")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, z, radius): three or four numbers a line; other lines, such as a header's, are left out."""
    n = spark.read.text(path).filter(F.col("value").rlike(rf"^\s*{_NUMBER}([\s,]+{_NUMBER}){{2,3}}\s*$")).select(numbers(F.col("value")).alias("n"))
    return n.select(F.get("n", F.lit(0)).alias("x"), F.get("n", F.lit(1)).alias("y"), F.get("n", F.lit(2)).alias("z"), F.get("n", F.lit(3)).alias("radius"))


def ply_header(n: int) -> str:
    return f"ply\nformat ascii 1.0\nelement vertex {n}\nproperty float x\nproperty float y\nproperty float z\nend_header"


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    """(path, facet, a, b, c): the corners of the triangles of ASCII STL files, as arrays of three numbers."""
    facet = F.regexp_extract_all("value", F.lit(r"(?s)outer loop(.*?)endloop"), F.lit(1))
    rows = whole_files(spark, path).select("path", F.posexplode(facet).alias("facet", "t")).select("path", "facet", numbers(F.col("t")).alias("n"))
    return rows.select("path", "facet", F.slice("n", 1, 3).alias("a"), F.slice("n", 4, 3).alias("b"), F.slice("n", 7, 3).alias("c"))


def stl_text(a: Column, b: Column, c: Column) -> Column:
    corner = lambda p: F.concat(F.lit("vertex "), F.array_join(p.cast("array<string>"), " "))
    return F.concat_ws("\n", F.lit("facet normal 0 0 0"), F.lit("outer loop"), corner(a), corner(b), corner(c), F.lit("endloop"), F.lit("endfacet"))


def read_vtk_points(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, x, y, z): the points of legacy ASCII polydata."""
    block = F.regexp_extract("value", r"(?s)POINTS\s+[0-9]+\s+\w+\s+(.*?)(?:\n\s*[A-Z_]{4,}|\z)", 1)
    n = whole_files(spark, path).select("path", numbers(block).alias("n")).filter(F.size("n") >= 3)
    rows = n.select("path", "n", F.explode(F.sequence(F.lit(0), F.floor(F.size("n") / 3).cast("int") - 1)).alias("i"))
    return rows.select("path", "i", *[F.get("n", F.col("i") * 3 + k).alias(a) for k, a in enumerate("xyz")])


def read_vtk_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(path, polygon, corners array<int>) of legacy ASCII polydata."""
    block = F.regexp_extract("value", r"(?s)POLYGONS\s+[0-9]+\s+[0-9]+\s+(.*?)(?:\n\s*[A-Z_]{4,}|\z)", 1)
    lines = whole_files(spark, path).select("path", F.posexplode(F.split(F.trim(block), r"\s*\n\s*")).alias("polygon", "l")).filter("l <> ''")
    return lines.select("path", "polygon", F.transform(F.slice(F.split("l", r"\s+"), 2, 1_000_000), lambda v: v.cast("int")).alias("corners"))


def vtk_points_text(points: Column) -> Column:
    """Points (an array of arrays of three) as legacy ASCII polydata."""
    rows = F.array_join(F.transform(points, lambda p: F.array_join(p.cast("array<string>"), " ")), "\n")
    return F.concat(F.lit("# vtk DataFile Version 3.0\npoints\nASCII\nDATASET POLYDATA\nPOINTS "), F.size(points).cast("string"), F.lit(" float\n"), rows, F.lit("\n"))


def read_rigid_transforms(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, r array<double> of 9, t array<double> of 3): every twelve numbers."""
    m = read_projection_matrices(spark, path)
    return m.select("path", F.col("view").alias("i"), F.slice("p", 1, 9).alias("r"), F.slice("p", 10, 3).alias("t"))


def parse_material(line: Column) -> Column:
    """`name: S=..; Z=..; A=..; D=..` as a struct; missing parts are NULL."""
    part = lambda k: F.nullif(F.regexp_extract(line, rf"\b{k}\s*=\s*([^;]+)", 1), F.lit(""))
    return F.struct(
        F.trim(F.regexp_extract(line, r"^([^:]*):", 1)).alias("name"), F.trim(part("S")).alias("symbol"), part("Z").cast("int").alias("z"), part("A").cast("double").alias("a"), part("D").cast("double").alias("density")
    )


def parse_mixture(line: Column) -> Column:
    """`Elem[weight]` parts of a line as an array of (element, weight)."""
    parts = F.regexp_extract_all(line, F.lit(r"([A-Z][a-z]?\[[0-9.eE+-]+\])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\w+)", 1).alias("element"), F.regexp_extract(p, r"\[(.*)\]", 1).cast("double").alias("weight")))


def read_materials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.col("value").contains(":")).select(parse_material(F.col("value")).alias("m")).select("m.*")
