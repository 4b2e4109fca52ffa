"""Image features, curves, fits, neighbours and learning."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latticework.functions import ieee

DIRECTIONS = ((0, 1), (-1, 1), (-1, 0), (-1, -1))


def quantize(v: Column, low: float, high: float, levels: int) -> Column:
    return F.least(F.floor((v - low) / (high - low) * levels), F.lit(levels - 1)).cast("int")


def glcm(grid: DataFrame, levels_column: str = "level") -> DataFrame:
    """(direction, i, j, p): how often grey levels stand next to each other, in four directions, both ways round.

    The direction's neighbour comes by an equi-join on the place; counts are combined before they are shuffled.
    """
    near = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate(DIRECTIONS)])).alias("d")
    a = grid.select("y", "x", F.col(levels_column).alias("i"), near).select(F.col("d.k").alias("direction"), (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"), "i")
    pairs = a.join(grid.select("y", "x", F.col(levels_column).alias("j")), ["y", "x"])
    both = pairs.select("direction", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p")).select("direction", "p.i", "p.j")
    counted = both.groupBy("direction", "i", "j").agg(F.count("*").alias("n"))
    total = counted.groupBy("direction").agg(F.sum("n").alias("_t"))
    return counted.join(F.broadcast(total), "direction").select("direction", "i", "j", (F.col("n") / F.col("_t")).alias("p"))


def haralick(matrix: DataFrame) -> DataFrame:
    """Nine texture features, averaged over the directions. Correlation divides by variances, not by their roots."""
    p, i, j = F.col("p"), F.col("i"), F.col("j")
    m = matrix.groupBy("direction").agg(F.sum(i * p).alias("mu"), F.sum(i * i * p).alias("_ii"))
    x = matrix.join(F.broadcast(m.select("direction", "mu", (F.col("_ii") - F.col("mu") ** 2).alias("var"))), "direction")
    mu, var = F.col("mu"), F.col("var")
    per = x.groupBy("direction").agg(
        F.sum(p * p).alias("energy"), F.sum(p * (i - j) ** 2).alias("contrast"), F.sum(p * F.abs(i - j)).alias("dissimilarity"),
        F.sum(p / (1 + (i - j) ** 2)).alias("homogeneity"), (-F.sum(p * F.log(p))).alias("entropy"), F.max(p).alias("maximum"), F.first(mu).alias("mean"),
        F.first(var).alias("variance"), F.sum(F.when(var > 0, p * (i - mu) * (j - mu) / var).otherwise(0.0)).alias("correlation"),
    )
    names = ("energy", "contrast", "dissimilarity", "homogeneity", "entropy", "maximum", "mean", "variance", "correlation")
    return per.agg(*[F.avg(n).alias(n) for n in names])


def histogram_features(grid: DataFrame, by: list[str], low: float, high: float, bins: int) -> DataFrame:
    """Of each group's normalised histogram: mean and deviation of grey levels, entropy, coefficient of variation, skewness
    and kurtosis (textbook forms, over bins)."""
    b = F.least(F.greatest(F.floor((F.col("v") - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    h = grid.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
    t = h.groupBy(*by).agg(F.sum("n").alias("_t"), (F.sum(F.col("bin") * F.col("n")) / F.sum("n")).alias("mean"))
    x = h.join(t, by).withColumn("_p", F.col("n") / F.col("_t")).withColumn("_d", F.col("bin") - F.col("mean"))
    m = x.groupBy(*by).agg(
        F.first("mean").alias("mean"), F.sqrt(F.sum(F.col("_p") * F.col("_d") ** 2)).alias("sd"), (-F.sum(F.col("_p") * F.log("_p"))).alias("entropy"),
        F.sum(F.col("_p") * F.col("_d") ** 3).alias("_m3"), F.sum(F.col("_p") * F.col("_d") ** 4).alias("_m4"),
    )
    ok = F.col("sd") > 0
    return m.select(
        *by, "mean", "sd", "entropy", F.when(F.col("mean") != 0, F.col("sd") / F.col("mean")).otherwise(0.0).alias("cv"),
        F.when(ok, F.col("_m3") / F.col("sd") ** 3).otherwise(0.0).alias("skewness"), F.when(ok, F.col("_m4") / F.col("sd") ** 4).otherwise(0.0).alias("kurtosis"),
    )


def roc_curve(scores: DataFrame, positive: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr) at each distinct score, a score at or above it counting as positive.

    Distinct scores are counted first; running sums over ranges of the scores carry the sums of the ranges above, a few rows.
    """
    c = scores.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum(1 - F.col(positive).cast("long")).alias("n"))
    c = c.withColumn("_b", F.floor(F.log2(F.abs(F.col("threshold").cast("double")) + 1) * 4) * F.signum(F.col("threshold").cast("double")))
    tops = c.groupBy("_b").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select("_b", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_pa"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_na"), F.sum("_p").over(everything).alias("_tp"), F.sum("_n").over(everything).alias("_tn"))
    w = Window.partitionBy("_b").orderBy(F.desc("threshold"))
    out = c.join(F.broadcast(tops), "_b")
    return out.select(
        "threshold", ieee.div(F.sum("p").over(w) + F.col("_pa"), F.col("_tp")).alias("tpr"), ieee.div(F.sum("n").over(w) + F.col("_na"), F.col("_tn")).alias("fpr")
    )


def auc(scores: DataFrame, positive: str, score: str) -> DataFrame:
    """Area under the curve by ranks; equal scores count half."""
    c = scores.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum(1 - F.col(positive).cast("long")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("_u", F.col("p") * (below + F.col("n") / 2)).agg(ieee.div(F.sum("_u"), F.sum("p") * F.sum("n")).alias("auc"))


def line_fit(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Slope, intercept and r^2 by least squares."""
    return df.groupBy(*(by or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def log_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """y = a + b ln x over positive x."""
    rows = df.filter(F.col(x) > 0).withColumn("_l", F.log(x))
    return line_fit(rows, "_l", y).select(F.col("intercept").alias("a"), F.col("slope").alias("b"))


def polynomial_fit(df: DataFrame, x: str, y: str, degree: int) -> list[float]:
    """Coefficients, the constant first: power sums in one pass, a small solve on the driver."""
    powers = [F.sum(F.pow(F.col(x), k)).alias(f"s{k}") for k in range(2 * degree + 1)]
    mixed = [F.sum(F.pow(F.col(x), k) * F.col(y)).alias(f"t{k}") for k in range(degree + 1)]
    r = df.agg(*powers, *mixed).first()
    a = np.array([[r[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)], float)
    return np.linalg.lstsq(a, np.array([r[f"t{k}"] for k in range(degree + 1)], float), rcond=None)[0].tolist()


def surface_fit(df: DataFrame, x: str, y: str, z: str) -> list[float]:
    """z = c0 + c1 x + c2 y + c3 x^2 + c4 x y + c5 y^2 by least squares: 27 sums in one pass."""
    t = [F.lit(1.0), F.col(x), F.col(y), F.col(x) ** 2, F.col(x) * F.col(y), F.col(y) ** 2]
    r = df.agg(*[F.sum(t[i] * t[j]).alias(f"a{i}_{j}") for i in range(6) for j in range(i, 6)], *[F.sum(t[i] * F.col(z)).alias(f"b{i}") for i in range(6)]).first()
    a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(6)] for i in range(6)], float)
    return np.linalg.lstsq(a, np.array([r[f"b{i}"] for i in range(6)], float), rcond=None)[0].tolist()


def ransac_line(df: DataFrame, x: str, y: str, eps: float, models: int = 64, seed: int = 5, tries: int = 20) -> dict[str, float]:
    """The line through two points drawn at random that has the most points within eps, then fitted to those.

    All candidate lines are tested in one pass over all points; without any inliers eps grows by a tenth and it is tried again.
    """
    sample = [(float(r[x]), float(r[y])) for r in df.select(x, y).orderBy(F.xxhash64(F.lit(seed), F.col(x), F.col(y)), x, y).limit(4 * models).collect()]
    lines = [((y1 - y0) / (x1 - x0), y0 - (y1 - y0) / (x1 - x0) * x0) for (x0, y0), (x1, y1) in zip(sample[::2], sample[1::2], strict=False) if x0 != x1][:models]
    if not lines:
        raise ValueError("no two points with different x")
    for _ in range(tries):
        counts = df.agg(*[F.count_if(F.abs(F.col(y) - F.col(x) * m - c) <= eps).alias(f"c{k}") for k, (m, c) in enumerate(lines)]).first()
        best = max(range(len(lines)), key=lambda k: (counts[k], -k))
        if counts[best] > 2:
            m, c = lines[best]
            r = line_fit(df.filter(F.abs(F.col(y) - F.col(x) * m - c) <= eps), x, y).first()
            return {"slope": r["slope"], "intercept": r["intercept"], "inliers": counts[best], "eps": eps}
        eps *= 1.1
    raise ValueError("no line has enough points")


def knn(queries: DataFrame, points: DataFrame, k: int, query_id: str = "q", point_id: str = "p", vector: str = "vec") -> DataFrame:
    """(q, p, distance, rank): the k nearest points of each query, itself left out, ties by the lower id. Ids are keys;
    rows without an id or a vector are neither queries nor points; a vector holds no NULL.

    A stated set of queries against all points, exactly: queries go out in blocks of about QUERY_BLOCK, of which the
    driver holds one at a time; several are checkpointed one by one. A task takes its points in batches, keeps the k best of them for each query and sends only these on. Work is the product of both
    sides, what is shuffled is k rows a query and task.
    """
    kinds = {query_id: queries.schema[query_id].dataType.simpleString(), point_id: points.schema[point_id].dataType.simpleString()}
    q = queries.filter(F.col(query_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(query_id).alias("_q"), F.col(vector).cast("array<double>").alias("_v"))
    p = points.filter(F.col(point_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(point_id).alias("_p"), F.col(vector).cast("array<double>").alias("_v"))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    schema = f"_q {kinds[query_id]}, _p {kinds[point_id]}, _d double"
    near = []
    for b in range(blocks):
        best = p.mapInPandas(_nearest(q.filter(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == b).collect(), k), schema)
        near.append(best.checkpoint() if blocks > 1 else best)
    some = reduce(DataFrame.unionAll, near)
    final = Window.partitionBy("_q").orderBy("_d", "_p")
    out = some.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k)
    return out.select(F.col("_q").alias("q"), F.col("_p").alias("p"), F.col("_d").alias("distance"), "rank")


#: Queries of a block, about, and distances that are held at once.
QUERY_BLOCK, DISTANCES = 10_000, 4_000_000


def _nearest(queries: list, k: int):
    """A function over batches of points (_p, _v): the k nearest of all batches for each query."""
    ids, vectors = np.array([r["_q"] for r in queries], object), np.array([r["_v"] for r in queries], float)

    def run(batches):
        import pandas as pd

        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, object), np.empty(0))] * len(ids)
        squares = (vectors * vectors).sum(axis=-1)
        for batch in batches if len(ids) else ():
            for at in range(0, len(batch), max(1, DISTANCES // len(ids))):
                part = batch.iloc[at : at + max(1, DISTANCES // len(ids))]
                names, x = part["_p"].to_numpy(object), np.stack(part["_v"].to_numpy()).astype(float)
                sizes = (x * x).sum(axis=1)
                rough = squares[:, None] + sizes[None, :] - 2 * (vectors @ x.T)
                slack = 1e-9 * (squares + sizes.max())  # far above what rounding may move a rough square
                for i in range(len(ids)):
                    own = rough[i]
                    if len(own) > k + 1:  # one of them may be the query itself
                        j = np.flatnonzero(own <= np.partition(own, k)[k] + slack[i])
                    else:
                        j = np.arange(len(own))
                    j = j[names[j] != ids[i]]
                    d = np.sqrt(((x[j] - vectors[i]) ** 2).sum(axis=1))
                    p, d = np.concatenate([kept[i][0], names[j]]), np.concatenate([kept[i][1], d])
                    first = np.lexsort((p, d))[:k]
                    kept[i] = (p[first], d[first])
        for at in range(0, len(ids), 1000):
            rows = [(ids[i], p, d) for i in range(at, min(at + 1000, len(ids))) for p, d in zip(*kept[i], strict=True)]
            yield pd.DataFrame(rows, columns=["_q", "_p", "_d"])

    return run


def embedding_stress(pairs: DataFrame, kind: str) -> DataFrame:
    """The objective of an embedding over pairs (d: distance, e: distance embedded, p: inner product, r: embedded)."""
    terms = {
        "sammon": F.sum(F.when(F.col("d") > 0, F.pow(F.col("d") - F.col("e"), 2) / F.col("d"))) / F.sum("d"),
        "distance_square": F.sum(F.pow(F.col("d") ** 2 - F.col("e") ** 2, 2)),
        "distance": F.sum(F.pow(F.col("d") - F.col("e"), 2)),
        "inner_product": F.sum(F.pow(F.col("p") - F.col("r"), 2)),
    }
    return pairs.agg(terms[kind].alias("stress"))


def lle_weights(neighbours: DataFrame, by: str, regularize: float = 1e-3) -> DataFrame:
    """(by, p, weight): the weights, adding up to 1, by which each point's k neighbours rebuild it.

    neighbours (by, p, diff array<double>), diff the neighbour less the point. A group has k rows."""
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in neighbours.schema}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.array([list(d) for d in pdf["diff"]], float)
        g = z @ z.T
        g += np.eye(len(g)) * (regularize * max(np.trace(g), 1e-12))
        w = np.linalg.solve(g, np.ones(len(g)))
        return pd.DataFrame({by: pdf[by], "p": pdf["p"], "weight": w / w.sum()})

    return neighbours.groupBy(by).applyInPandas(solve, f"{by} {kinds[by]}, p {kinds['p']}, weight double")


def laguerre_gauss(order: int, r2: Column, width: float) -> Column:
    """A channel of an observer: sqrt(2)/w exp(-pi r^2/w^2) L_n(2 pi r^2/w^2)."""
    t = 2 * math.pi * r2 / (width * width)
    poly = F.lit(0.0)
    for k in range(order + 1):
        poly = poly + F.lit((-1) ** k * math.comb(order, k) / math.factorial(k)) * F.pow(t, k)
    return math.sqrt(2) / width * F.exp(-math.pi * r2 / (width * width)) * poly


def hotelling(channels: DataFrame, width: int, label: str, response: str = "c") -> np.ndarray:
    """The template S^-1 (m1 - m0) over channel responses (arrays of a known width): moments in one pass, a small solve."""
    c = [F.get(response, F.lit(i)) for i in range(width)]
    rows = channels.groupBy(label).agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(c)], *[F.covar_pop(c[i], c[j]).alias(f"s{i}_{j}") for i in range(width) for j in range(i, width)]).collect()
    by = {r[label]: r for r in rows}
    cov = np.array([[np.mean([r[f"s{min(i, j)}_{max(i, j)}"] for r in by.values()]) for j in range(width)] for i in range(width)])
    mean = {k: np.array([r[f"m{i}"] for i in range(width)]) for k, r in by.items()}
    return np.linalg.solve(cov + 1e-9 * np.trace(cov) * np.eye(width), mean[1] - mean[0])


def joint_histogram(zipped: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    b = lambda c: F.least(F.greatest(F.floor((F.col(c) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return zipped.groupBy(b("a").alias("i"), b("b").alias("j")).agg(F.count("*").alias("n"))


def mutual_information(joint: DataFrame) -> DataFrame:
    """In nats, of a joint histogram of bounded size."""
    t = joint.agg(F.sum("n").alias("_t"))
    i, j = joint.groupBy("i").agg(F.sum("n").alias("_i")), joint.groupBy("j").agg(F.sum("n").alias("_j"))
    x = joint.join(i, "i").join(j, "j").crossJoin(F.broadcast(t))
    p = F.col("n") / F.col("_t")
    return x.agg(F.sum(p * F.log(p / (F.col("_i") / F.col("_t") * (F.col("_j") / F.col("_t"))))).alias("mutual_information"))


def hough_circles(edges: DataFrame, radius: float, steps: int = 36) -> DataFrame:
    """(y, x, votes): each edge point votes for the centres at a radius; votes are combined before the shuffle."""
    angle = F.col("_k") * (2 * math.pi / steps)
    v = edges.select("y", "x", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("_k"))
    return v.groupBy(F.round(F.col("y") + radius * F.sin(angle)).cast("int").alias("y"), F.round(F.col("x") + radius * F.cos(angle)).cast("int").alias("x")).agg(F.count("*").alias("votes"))
