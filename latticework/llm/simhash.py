"""SimHash near-dedup by the generalised pigeonhole principle.

For a distance of at most tau over m groups of bits, thresholds t_1..t_m >= -1 with sum tau - m + 1 lose no pair:
if every group i differed in more than t_i bits, the whole would differ in more than tau. A group with threshold -1 is
never probed. Correlated bits share a group, and a dynamic program deals out the thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import SMALL_ROWS, hot_join, small, stored

BITS = 64
SEED = 42
#: Edges that one task joins: 16 bytes each.
FEW_EDGES = 16_384
#: Buckets with more probes than this are searched by midpoints, not by pairs.
DENSE = 16


def fingerprint(raw: bytes | None, words: int = 3) -> int:
    """The fingerprint of a text in UTF-8, as a signed 64-bit number; of null and of a text without words 0."""
    h = shingles(raw, words)
    if not len(h):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), words) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["_id", "_fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_raw"))
    return slim.mapInArrow(run, "_id long, _fp long")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have bits i and j (the diagonal: bit i) set; 64 x 64 whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            fps = b.column(0).to_numpy().astype("<i8")
            for at in range(0, len(fps), 1 << 14):
                part = fps[at : at + (1 << 14)]
                x = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                both += x.T @ x
                n += len(x)
        i, j = np.indices((BITS, BITS))
        yield pa.RecordBatch.from_pydict({"i": [-1, *i.ravel().tolist()], "j": [-1, *j.ravel().tolist()], "c": [n, *both.ravel().astype(np.int64).tolist()]})

    rows = nodes.select("_fp").mapInArrow(run, "i long, j long, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect()
    both, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r["i"] < 0:
            n = r["c"]
        else:
            both[r["i"], r["j"]] = r["c"]
    return n, both


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of nearly equal width; each is grown from the bit with the most correlation left."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < width:
            group.append(max(left, key=lambda b: (corr[b, group].sum(), -b)))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def flips(bits: list[int], t: int) -> list[int]:
    """The numbers, as signed longs, with at most t of the given bits set."""
    out = [sum(1 << b for b in c) for d in range(t + 1) for c in combinations(bits, d)]
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in out]


def allocate(n: int, both: np.ndarray, groups: list[list[int]], tau: int) -> tuple[float, list[int]]:
    """The least estimated number of probes and candidates, and the thresholds that give it."""
    p = np.diag(both) / max(n, 1)

    def cost(group: list[int], t: int) -> float:
        if t < 0:
            return 0.0
        near = np.array([1.0] + [0.0] * t)  # of differing in 0..t bits, from each bit's share of ones
        for b in group:
            q = 2 * p[b] * (1 - p[b])
            near = near * (1 - q) + np.concatenate([[0.0], near[:-1]]) * q
        return n * len(flips(group, t)) + n * n / 2 * float(near.sum())

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for g in groups:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, tau + 1):
                new = (c + cost(g, t), [*ts, t])
                if used + t not in step or new < step[used + t]:
                    step[used + t] = new
        best = step
    return best[tau - len(groups) + 1]


def plan(n: int, both: np.ndarray, tau: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group that is probed."""
    found = []
    for m in range(2, tau + 3):
        groups = group_bits(n, both, m)
        c, ts = allocate(n, both, groups, tau)
        found.append((c, m, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


def _signed(bits: list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(nodes: DataFrame, tau: int = 2, dense: int = DENSE, kind: str | None = None) -> DataFrame:
    """Edges (u, v) between fingerprints of nodes(_fp), all different, that connect what is within tau of each other.

    With `kind`, nodes have a column of that name too, only fingerprints of the same kind are linked, and edges carry it.

    Buckets with at most `dense` probes are searched by pairs. What probes a larger one is connected by midpoints instead:
    two fingerprints within 2 k bits share one within k bits of both, and of those that share it each is linked to the
    least. So an edge may join two that are 2 k apart at most, with k = tau // 2, and no link is lost. For odd tau, dense
    buckets are searched by pairs.
    """
    n, both = bit_statistics(nodes)
    probed = plan(n, both, tau)

    def of_group(p: int, bits: list[int], t: int):
        own = F.col("_fp").bitwiseAND(F.lit(_signed(bits)).cast("long"))
        ways = F.array(*[F.lit(x).cast("long") for x in flips(bits, t)])
        return F.transform(ways, lambda x: F.struct(F.lit(p).alias("p"), own.bitwiseXOR(x).alias("key"), (x == 0).alias("home")))

    rows = F.array(*[of_group(p, bits, t) for p, (bits, t) in enumerate(probed)])
    own = [kind] if kind else []
    probes = nodes.select(*own, "_fp", F.explode(F.flatten(rows)).alias("r")).select(*own, "_fp", F.col("r.p").alias("_p"), F.col("r.key").alias("_key"), F.col("r.home").alias("_home"))
    spans, on = tau % 2 == 0, [*own, "_p", "_key"]
    sizes = probes.groupBy(*on).agg(F.count("*").alias("_n"), F.count_if("_home").alias("_h"))
    large = stored(sizes.filter((F.col("_n") > dense) & (F.col("_h") > 0) & F.lit(spans)).select(*on, "_n"), "dense")
    if not large.isEmpty():
        tagged = stored(hot_join(probes, large, on, "_fp", "_n"), "probes")
        small = tagged.filter("_n is null")
    else:
        tagged, small = None, probes
    apart = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    home = small.filter("_home").select(*on, F.col("_fp").alias("v"))
    pairs = small.select(*on, F.col("_fp").alias("u")).join(home, on).filter((F.col("u") != F.col("v")) & (apart("u", "v") <= tau))
    edges = pairs.select(*own, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    if tagged is not None:
        around = F.transform(F.array(*[F.lit(x).cast("long") for x in flips(list(range(BITS)), tau // 2)]), lambda x: F.col("_fp").bitwiseXOR(x))
        mids = tagged.filter("_n is not null").select(*own, "_fp").distinct().select(*own, "_fp", F.explode(around).alias("_mid"))
        # a midpoint has as many neighbours as there are flips, 65 for tau 2: the set is bounded
        met = mids.groupBy(*own, "_mid").agg(F.collect_set("_fp").alias("_all")).filter(F.size("_all") > 1)
        star = met.select(*own, F.array_min("_all").alias("u"), F.explode("_all").alias("v")).filter("u != v")
        edges = edges.unionAll(star)
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root): every end of an edge and one end that stands for its component.

    Each round sends a node to the least of itself and its neighbours, in an order drawn anew for the round, and contracts
    the edges; the number of nodes halves or better as expected. All tables stay distributed, rounds are written. What is
    left is joined in one task when it has FEW_EDGES or fewer.
    """

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a, c = top(u), top(v)
                up[max(a, c)] = min(a, c)
        yield pa.RecordBatch.from_arrays([pa.array(up, pa.int64()), pa.array([top(x) for x in up], pa.int64())], ["u", "to"])

    edges, rounds = stored(edges, "edges"), []
    while n := edges.count():
        if n <= FEW_EDGES:
            rounds.append(stored(edges.select("u", "v").coalesce(1).mapInArrow(union, "u long, to long"), "round"))
            break
        order = lambda c, k=len(rounds): F.struct(F.xxhash64(F.lit(k), F.col(c)), F.col(c).alias("v"))
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = stored(
            both.groupBy("u").agg(F.min(order("v")).alias("_near"), F.count("*").alias("_deg")).select("u", F.least("_near", order("u"))["v"].alias("to"), "_deg"), "round"
        )
        half = hot_join(edges, to, ["u"], "v", "_deg", "inner").select(F.col("v").alias("u"), F.col("to").alias("a"))
        moved = hot_join(half, to, ["u"], "a", "_deg", "inner").select(F.least("a", "to").alias("u"), F.greatest("a", "to").alias("v"))
        edges = stored(moved.filter("u != v").distinct(), "edges")
        rounds.append(to.select("u", "to"))
    if not rounds:
        return edges.select("u", F.col("v").alias("root"))
    found = rounds[0].withColumnRenamed("to", "root")
    for to in rounds[1:]:
        step = to.withColumnRenamed("u", "root")
        if step.count() <= SMALL_ROWS:
            found = found.join(F.broadcast(step), "root", "left").select("u", F.coalesce("to", "root").alias("root"))
            continue
        sizes = stored(found.groupBy("root").agg(F.count("*").alias("_w")).join(step, "root"), "roots")
        found = stored(hot_join(found, sizes, ["root"], "u", "_w", slim=False).select("u", F.coalesce("to", "root").alias("root")), "found")
    return stored(found, "found")


def rooted(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """nodes with the root of their component; a node without an edge is its own."""
    return nodes.join(small(components(edges).withColumnRenamed("u", node)), node, "left").withColumn("root", F.coalesce("root", F.col(node)))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, tau: int = 2) -> DataFrame:
    """(id, fp long, component_id, group_size) of every row.

    component_id is the smallest id that is reachable over links between fingerprints with at most tau differing bits.
    Null and empty texts have fingerprint 0 and are linked like any other. Rows that repeat an id stay, with a fingerprint
    each. Null ids are never a component_id unless a component has no other. Other columns are ignored.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = stored(prints.groupBy("_fp").agg(F.min("_id").alias("_least"), F.count("*").alias("_n")), "nodes")
    of = stored(rooted(nodes, links(nodes, tau), "_fp"), "rooted")
    of_root = stored(of.groupBy("root").agg(F.min("_least").alias("component_id"), F.sum("_n").alias("group_size"), F.count("*").alias("_w")), "components")
    classes = stored(hot_join(of, of_root, ["root"], "_fp", "_w", "inner").select("_fp", "_n", "component_id", "group_size"), "classes")
    out = hot_join(prints, classes, ["_fp"], "_id", "_n", "inner")
    return out.select(F.col("_id").alias(id_col), F.col("_fp").alias("fp"), "component_id", "group_size")


def shingles(raw: bytes | None, words: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; of a shorter text the one of all its words."""
    w = (raw or b"").lower().split()  # on bytes: A-Z and \x20\x09-\x0D only
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)] if w else [], np.uint64)
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = [0, *ends[: len(w) - words].tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64)
