"""Matrices and vectors as tables (i, j, v), and dense kernels where rows are whole matrices."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Products are added up before they are shuffled; the join is on the inner index."""
    left, right = a.select(F.col("i"), F.col("j").alias("_k"), F.col("v").alias("_a")), b.select(F.col("i").alias("_k"), "j", F.col("v").alias("_b"))
    return left.join(right, "_k").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def matvec(a: DataFrame, x: DataFrame) -> DataFrame:
    return a.join(x.select(F.col("i").alias("j"), F.col("v").alias("_x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("_x")).alias("v"))


def gram(a: DataFrame, columns: int) -> DataFrame:
    """A'A of a matrix whose rows are arrays of a known, small width: one pass, in which a task adds up the products of its
    batches and sends on one matrix. NULL elements count as 0, NULL rows are none."""

    def products(batches):
        total = None
        for batch in batches:
            if len(batch):
                x = np.stack(batch["row"].to_numpy())
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape, np.int32)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "p": total.ravel()})

    rows = a.filter("row is not null").select(F.transform(F.slice("row", 1, columns), lambda v: F.coalesce(v.cast("double"), F.lit(0.0))).alias("row"))
    return rows.mapInPandas(products, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("v"))


def outer(a: DataFrame, b: DataFrame) -> DataFrame:
    """a b' of two vectors (i, v): its size is the product by definition; the shorter goes to all tasks in blocks."""
    return a.select("i", F.col("v").alias("_a")).crossJoin(b.select(F.col("i").alias("j"), F.col("v").alias("_b"))).select("i", "j", (F.col("_a") * F.col("_b")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def combine(a: DataFrame, b: DataFrame, op: Callable[[Column, Column], Column]) -> DataFrame:
    return a.withColumnRenamed("v", "_a").join(b.withColumnRenamed("v", "_b"), ["i", "j"]).select("i", "j", op(F.col("_a"), F.col("_b")).alias("v"))


def norms(a: DataFrame) -> DataFrame:
    """Largest column sum, largest row sum and Frobenius norm."""
    l1 = a.groupBy("j").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("l1"))
    inf = a.groupBy("i").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("linf"))
    return l1.crossJoin(inf).crossJoin(a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("frobenius")))


def equal_within(a: DataFrame, b: DataFrame, delta: float) -> DataFrame:
    diff = combine(a, b, lambda p, r: F.abs(p - r))
    return diff.agg(F.coalesce(F.bool_and(F.col("v") <= delta), F.lit(True)).alias("equal"))


def sub_matrix(a: DataFrame, rows: list[int], columns: list[int]) -> DataFrame:
    """The chosen rows and columns, numbered anew in the order in which they are listed."""
    new = lambda c, ids: F.array_position(F.array(*[F.lit(i).cast("long") for i in ids]), F.col(c).cast("long")) - 1
    return a.filter(F.col("i").isin(rows) & F.col("j").isin(columns)).select(new("i", rows).alias("i"), new("j", columns).alias("j"), "v")


def concat_columns(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    return a.unionByName(b.withColumn("j", F.col("j") + width))


def parse_matrix(text: Column) -> Column:
    """[[a, b]; [c, d]] as an array of arrays."""
    return F.from_json(F.replace(text, F.lit(";"), F.lit(",")), "array<array<double>>")


def print_matrix(rows: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("["), F.array_join(r.cast("array<string>"), ", "), F.lit("]"))), "; "), F.lit("]"))


# vectors of three as structs x, y, z


def vec(x, y, z) -> Column:
    return F.struct(*[(c if isinstance(c, Column) else F.lit(float(c))).alias(n) for n, c in (("x", x), ("y", y), ("z", z))])


def dot3(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross3(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm3(a: Column) -> Column:
    return F.sqrt(dot3(a, a))


def distance3(a: Column, b: Column) -> Column:
    return norm3(vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"]))


def angle3(a: Column, b: Column) -> Column:
    return F.acos(F.least(F.greatest(dot3(a, b) / (norm3(a) * norm3(b)), F.lit(-1.0)), F.lit(1.0)))


def inner(a: Column, b: Column) -> Column:
    """Of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda p, r: p * r), F.lit(0.0), lambda s, v: s + v)


def rotation(axis: str, angle: float) -> list[list[float]]:
    c, s = float(np.cos(angle)), float(np.sin(angle))
    return {"x": [[1.0, 0.0, 0.0], [0.0, c, -s], [0.0, s, c]], "y": [[c, 0.0, s], [0.0, 1.0, 0.0], [-s, 0.0, c]], "z": [[c, -s, 0.0], [s, c, 0.0], [0.0, 0.0, 1.0]]}[axis]


def euler(a: float, b: float, c: float) -> list[list[float]]:
    """Rotations about x, then y, then z."""
    return (np.array(rotation("z", c)) @ np.array(rotation("y", b)) @ np.array(rotation("x", a))).tolist()


def axis_angle(axis: list[float], angle: float) -> list[list[float]]:
    u = np.array(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
    return (np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * (k @ k)).tolist()


def affine3(p: Column, matrix: list[list[float]], shift: list[float]) -> Column:
    return vec(*[matrix[r][0] * p["x"] + matrix[r][1] * p["y"] + matrix[r][2] * p["z"] + shift[r] for r in range(3)])


def affine3_inverse(p: Column, matrix: list[list[float]], shift: list[float]) -> Column:
    m = np.linalg.inv(np.array(matrix))
    return affine3(p, m.tolist(), (-m @ np.array(shift)).tolist())


def quaternion_multiply(p: Column, q: Column) -> Column:
    """Of structs w, x, y, z."""
    out = {
        "w": p["w"] * q["w"] - p["x"] * q["x"] - p["y"] * q["y"] - p["z"] * q["z"], "x": p["w"] * q["x"] + p["x"] * q["w"] + p["y"] * q["z"] - p["z"] * q["y"],
        "y": p["w"] * q["y"] - p["x"] * q["z"] + p["y"] * q["w"] + p["z"] * q["x"], "z": p["w"] * q["z"] + p["x"] * q["y"] - p["y"] * q["x"] + p["z"] * q["w"],
    }
    return F.struct(*[c.alias(n) for n, c in out.items()])


def plucker(a: Column, b: Column) -> Column:
    """The six coordinates of the line through two points: direction, then moment."""
    d, m = vec(b["x"] - a["x"], b["y"] - a["y"], b["z"] - a["z"]), cross3(a, b)
    return F.array(d["x"], d["y"], d["z"], m["x"], m["y"], m["z"])


# dense kernels: a column holds whole matrices as array<array<double>>

Dense = Callable[[np.ndarray], object]


def _rq(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper triangular R with a positive diagonal, and orthogonal Q, with R Q = m."""
    q, r = np.linalg.qr(np.flipud(m).T)
    r, q = np.fliplr(np.flipud(r.T)), np.flipud(q.T)
    s = np.where(np.diag(r) < 0, -1.0, 1.0)
    return r * s, s[:, None] * q


def _tikhonov(m: np.ndarray, weight: float = 1e-3) -> np.ndarray:
    u, s, vt = np.linalg.svd(m, full_matrices=False)
    return vt.T @ np.diag(s / (s * s + weight * weight)) @ u.T


DENSE: dict[str, tuple[Dense, str]] = {
    "determinant": (lambda m: float(np.linalg.det(m)), "double"),
    "condition": (lambda m: float(np.linalg.norm(m, 2) * np.linalg.norm(np.linalg.inv(m), 2)), "double"),
    "rank": (lambda m: int(np.linalg.matrix_rank(m)), "int"),
    "inverse": (np.linalg.inv, "array<array<double>>"),
    "pseudo_inverse": (np.linalg.pinv, "array<array<double>>"),
    "tikhonov_inverse": (_tikhonov, "array<array<double>>"),
    "singular_values": (lambda m: np.linalg.svd(m, compute_uv=False), "array<double>"),
    "eigenvalues_symmetric": (lambda m: np.linalg.eigvalsh((m + m.T) / 2)[::-1], "array<double>"),
    "qr_q": (lambda m: np.linalg.qr(m)[0], "array<array<double>>"),
    "qr_r": (lambda m: np.linalg.qr(m)[1], "array<array<double>>"),
    "rq_r": (lambda m: _rq(m)[0], "array<array<double>>"),
    "rq_q": (lambda m: _rq(m)[1], "array<array<double>>"),
    "is_identity": (lambda m: bool(np.allclose(m, np.eye(len(m)))), "boolean"),
    "is_singular": (lambda m: bool(abs(np.linalg.det(m)) < 1e-12), "boolean"),
    "is_orthogonal": (lambda m: bool(np.allclose(m @ m.T, np.eye(len(m)))), "boolean"),
    "is_special_orthogonal": (lambda m: bool(np.allclose(m @ m.T, np.eye(len(m))) and np.linalg.det(m) > 0), "boolean"),
    "is_rigid_motion": (lambda m: bool(np.allclose(m[:-1, :-1] @ m[:-1, :-1].T, np.eye(len(m) - 1)) and np.allclose(m[-1], [0] * (len(m) - 1) + [1])), "boolean"),
}


def dense(kind: str) -> Callable[[Column | str], Column]:
    """A vectorised function of a column of matrices; NULL in, NULL out."""
    f, result = DENSE[kind]

    def run(s: pd.Series) -> pd.Series:
        def one(m):
            if m is None:
                return None
            out = f(np.array([list(r) for r in m], float))
            return out.tolist() if isinstance(out, np.ndarray) else out

        return s.map(one)

    return F.pandas_udf(run, result)


def solve(kind: str = "least_squares") -> Callable[[Column, Column], Column]:
    """x with A x = b: least_squares, upper or lower triangular."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(m, v):
            m, v = np.array([list(r) for r in m], float), np.array(v, float)
            if kind == "upper":
                m = np.triu(m)
            elif kind == "lower":
                m = np.tril(m)
            return np.linalg.lstsq(m, v, rcond=None)[0].tolist()

        return pd.Series([one(m, v) for m, v in zip(a, b, strict=True)])

    return F.pandas_udf(run, "array<double>")


def mean_rotation(df: DataFrame, by: list[str], matrix: str) -> DataFrame:
    """The rotation nearest to the mean of rotation matrices: the sums are native, one small SVD a group ends it."""
    cells = [F.avg(F.get(F.get(matrix, F.lit(i)), F.lit(j))) for i in range(3) for j in range(3)]
    means = df.groupBy(*by).agg(F.array(*[F.array(*cells[3 * i : 3 * i + 3]) for i in range(3)]).alias("_m"))

    def nearest(s: pd.Series) -> pd.Series:
        def one(m):
            u, _, vt = np.linalg.svd(np.array([list(r) for r in m], float))
            return (u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt).tolist()

        return s.map(one)

    return means.select(*by, F.pandas_udf(nearest, "array<array<double>>")("_m").alias("rotation"))


def as_text(rows: list[list[float]]) -> str:
    return "[" + "; ".join(json.dumps(r) for r in rows) + "]"


def pca(rows: DataFrame, width: int, components: int, row: str = "row") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, variances and directions of rows of a known width: one pass of partial sums, a small eigenproblem on the
    driver. The largest part of each direction is positive."""
    n = rows.count()
    if not n:
        return np.zeros(width), np.zeros(0), np.zeros((0, width))
    mean = np.array(rows.agg(F.array(*[F.avg(F.get(row, F.lit(i))) for i in range(width)]).alias("m")).first()["m"])
    second = np.zeros((width, width))
    for r in gram(rows.select(F.col(row).alias("row")), width).collect():
        second[r["i"], r["j"]] = r["v"]
    value, vector = np.linalg.eigh(second / n - np.outer(mean, mean))
    order = np.argsort(-value)[:components]
    directions = vector[:, order].T
    signs = np.sign(directions[np.arange(len(order)), np.abs(directions).argmax(axis=1)])
    return mean, np.maximum(value[order], 0), directions * signs[:, None]


def project(rows: DataFrame, mean: np.ndarray, directions: np.ndarray, row: str = "row") -> DataFrame:
    """Scores of rows along directions, as an array."""
    centred = F.zip_with(row, F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b)
    scores = F.array(*[inner(centred, F.array(*[F.lit(float(x)) for x in d])) for d in directions])
    return rows.withColumn("scores", scores)


def components_for(variances: DataFrame, share: float) -> DataFrame:
    """The least number of components whose variances reach a share; over the few rows (k, v) of a spectrum."""
    from pyspark.sql import Window

    w = Window.orderBy("k")
    done = variances.withColumn("_s", F.sum("v").over(w)).withColumn("_t", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return done.filter(F.col("_s") >= share * F.col("_t")).agg(F.min("k").alias("components"))
