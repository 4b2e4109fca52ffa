"""Near-duplicates of whole texts: SimHash links for close copies, and what those miss by shared shingles.

SimHash fingerprints of 64 bits within a few bits find close copies in one probe of a few buckets, but at a similarity of
0.8 two texts differ in about ten bits, and no allocation of thresholds reaches that without probing a large part of all
buckets. So fingerprints collapse the close copies, which may be many, and the pairs of other groups are found exactly, by
a prefix of each text's shingles. Every pair is verified on the sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import hot_join, small, stored
from latticework.llm.simhash import BITS, components, links, rooted, shingles

#: Fingerprints of a document. They save comparisons; what is found does not depend on their number.
SEVERAL = 6
#: Texts that are looked at for shingles that many of them have, and the most such shingles (16 bytes each, broadcast).
SAMPLE, COMMON_SHINGLES = 20_000, 200_000
#: Members of a bucket that are paired with all its members by one salt; there are at most MOST_SALTS.
SALT_ROWS, MOST_SALTS = 64, 64
#: Longs of a text's sketch.
WORDS = 8
#: Buckets of at most so many texts are paired without a leader first.
FEW = 8
#: Pairs a text that may be left when rounds of leaders end. What is left is compared pair by pair.
MOST_PAIRS = 64

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def several_fingerprints(h: np.ndarray, n: int) -> list[int]:
    """n fingerprints of the same shingles under n mixings of their hashes, as signed numbers; 0 without shingles."""
    ones = np.zeros((n, 8, 256), np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        for k in range(n):
            with np.errstate(over="ignore"):
                x = (part ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(32)
            b = x.astype("<u8").view(np.uint8).reshape(-1, 8)
            ones[k] += np.bincount((b + np.arange(0, 2048, 256, dtype=np.uint16)).ravel(), minlength=2048).reshape(8, 256)
    bits = 2 * (ones @ _BYTE_BITS).reshape(n, BITS) > len(h)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel().tolist()


def common_shingles(slim: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of a sample of texts have, ascending, and how many have them. It only sets an order: whatever
    it is, no pair is lost."""
    share = slim.count() // SAMPLE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingles(t.as_py(), words)).view(np.int64))], ["s"])

    some = slim.filter(F.pmod(F.xxhash64("_raw"), F.lit(share)) == 0).select("_raw").mapInArrow(run, "s long")
    top = some.groupBy("s").agg(F.count("*").alias("n")).filter("n >= 3").orderBy(F.desc("n"), "s").limit(COMMON_SHINGLES).collect()
    found = sorted((r["s"] % (1 << 64), r["n"]) for r in top)
    return np.array([x for x, _ in found], np.uint64), np.array([n for _, n in found], np.int64)


def prefix(x: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """The first of a text's different shingles in an order that holds for all texts, common ones last, and how many are
    left. Two texts with the similarity have at least one of these in common. Without shingles: 0."""
    if not len(x):
        return np.zeros(1, np.uint64), 0
    keys, count = common
    often = np.zeros(len(x), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        often = np.where(keys[at] == x, count[at], 0)
    rest = int(np.ceil(similarity * len(x) - 1e-9)) - 1
    return x[np.lexsort((x, often))[: len(x) - rest]], rest


def buckets(texts: DataFrame) -> DataFrame:
    """(_tok, _node, root, _size, _rest, _n, _score): texts(_node, _size, _rest, _prefix) by the shingles of their prefixes
    that several of them have, _n of them. A text's score is the size of all its buckets; its root is itself."""
    probes = texts.select("_node", F.explode("_prefix").alias("_tok"))
    sizes = probes.groupBy("_tok").agg(F.count("*").alias("_n")).filter("_n > 1")
    met = stored(hot_join(probes, stored(sizes, "sizes"), ["_tok"], "_node", "_n", "inner"), "buckets")
    score = met.groupBy("_node").agg(F.sum("_n").alias("_score"))
    facts = stored(score.join(texts.select("_node", "_size", "_rest"), "_node"), "scores")
    return stored(met.join(facts, "_node").withColumn("root", F.col("_node")), "buckets")  # a text has as many rows as its prefix


def unsettled(met: DataFrame, of: DataFrame) -> tuple[DataFrame, int]:
    """The rows of buckets() whose bucket has several roots of(_node, root), with _n, its size; and the number of pairs of
    different roots that meet in them."""
    met = met.drop("_n", "root").join(of, "_node")
    parts = met.groupBy("_tok", "root").agg(F.count("*").alias("_m"))
    sizes = parts.groupBy("_tok").agg(F.sum("_m").alias("_n"), F.sum(F.col("_m") * F.col("_m")).alias("_same"), F.count("*").alias("_roots")).filter("_roots > 1")
    sizes = stored(sizes.select("_tok", "_n", ((F.col("_n") * F.col("_n") - F.col("_same")) / 2).alias("_cross")), "sizes")
    pairs = sizes.agg(F.coalesce(F.sum("_cross"), F.lit(0.0))).first()[0]
    return stored(hot_join(met, sizes.drop("_cross"), ["_tok"], "_node", "_n", "inner"), "unsettled"), int(pairs)


def _can_be_similar(both: DataFrame, similarity: float) -> DataFrame:
    """(_a, _b) of rows (_a, _b, _size_a, _size_b, _rest_a, _rest_b), one for each shared shingle of the prefixes, of the
    pairs that can have the similarity: beyond the shorter prefix they share at most what that text has left."""
    less, more = F.least("_size_a", "_size_b"), F.greatest("_size_a", "_size_b")
    pairs = both.filter(less >= similarity * more - 1e-9).groupBy("_a", "_b").agg(
        F.count("*").alias("_c"), F.first(F.col("_size_a") + F.col("_size_b")).alias("_sum"), F.first(F.greatest("_rest_a", "_rest_b")).alias("_most")
    )
    return pairs.filter(F.col("_c") + F.col("_most") >= similarity / (1 + similarity) * F.col("_sum") - 1e-6).select("_a", "_b")


def merged(of: DataFrame, edges: DataFrame) -> DataFrame:
    """of(_node, root) after the edges (u, v) between nodes have joined their roots."""
    if edges.isEmpty():
        return of
    ends = edges.join(of.select(F.col("_node").alias("u"), F.col("root").alias("_a")), "u").join(of.select(F.col("_node").alias("v"), F.col("root").alias("_b")), "v")
    moved = components(ends.filter("_a <> _b").select(F.least("_a", "_b").alias("u"), F.greatest("_a", "_b").alias("v")).distinct())
    sizes = of.groupBy("root").agg(F.count("*").alias("_w"))
    step = stored(sizes.join(small(moved.select(F.col("u").alias("root"), F.col("root").alias("_to"))), "root"), "step")
    return small(stored(hot_join(of, step, ["root"], "_node", "_w").select("_node", F.coalesce("_to", "root").alias("root")), "rooted"))


def leaders(met: DataFrame, similarity: float, turn: int) -> DataFrame:
    """(_a, _b): each text of unsettled() with the leader of each of its buckets, if of another root.

    The leader is the text with the greatest score in the first turn: in a group of copies, the one that is nearest to most.
    In later turns it is drawn by a hash. Buckets of at most FEW texts are left to prefix_pairs().
    """
    many = met.filter(F.col("_n") > FEW)
    rank = F.struct((F.lit(0) if turn else F.col("_score")).alias("s"), F.xxhash64(F.lit(turn), "_node").alias("h"), F.col("_node").alias("_a"), F.col("_size").alias("_size_a"), F.col("_rest").alias("_rest_a"), F.col("root").alias("_root_a"))
    lead = stored(many.groupBy("_tok").agg(F.max(rank).alias("l"), F.count("*").alias("_w")).select("_tok", "l.*", "_w").drop("s", "h"), "leaders")
    led = many.select("_tok", F.col("_node").alias("_b"), F.col("_size").alias("_size_b"), F.col("_rest").alias("_rest_b"), "root")
    return _can_be_similar(hot_join(led, lead, ["_tok"], "_b", "_w", "inner").filter("root <> _root_a"), similarity)


def sketch(x: np.ndarray) -> np.ndarray:
    """The parities of the numbers of a set's members in 64 * WORDS classes, as signed numbers. Two sets differ in at least as
    many members as their sketches in bits."""
    with np.errstate(over="ignore"):
        of = (x * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(64 * WORDS)
    return np.packbits(np.bincount(of.astype(np.int64), minlength=64 * WORDS) % 2, bitorder="little").view("<i8")


def prefix_pairs(met: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(_a, _b): all pairs of texts of unsettled() of different roots that can have the similarity. They meet in a shingle of
    both prefixes; all pairs of a bucket are tested, in salted blocks, by sketches(_node, _sketch) before they leave it."""
    words = [f"_w{k}" for k in range(WORDS)]
    met = met.join(sketches.select("_node", *[F.col("_sketch")[k].alias(w) for k, w in enumerate(words)]), "_node")
    met = stored(met.withColumn("_blocks", F.least(F.lit(MOST_SALTS), F.ceil(F.col("_n") / SALT_ROWS)).cast("int")), "met")
    side = lambda x, salt: met.select("_tok", salt.alias("_salt"), F.col("_node").alias(f"_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in ("root", "_size", "_rest", *words)])
    left = side("a", F.pmod(F.xxhash64("_node"), F.col("_blocks")).cast("int"))
    right = side("b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    apart = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in words), F.lit(0))
    alike = apart <= (1 - similarity) / (1 + similarity) * (F.col("_size_a") + F.col("_size_b")) + 1e-6
    return _can_be_similar(left.join(right, ["_tok", "_salt"]).filter((F.col("_a") < F.col("_b")) & (F.col("root_a") != F.col("root_b")) & alike), similarity)


def similar(pairs: DataFrame, slim: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, v): the pairs (_a, _b), a written table, of texts whose sets of shingles have the similarity."""
    ends = stored(pairs.select(F.explode(F.array("_a", "_b")).alias("_node")).groupBy("_node").agg(F.count("*").alias("_deg")), "ends")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingles(t.as_py(), words)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), b.column(2)], ["_node", "_set", "_deg"])

    chosen = stored(texts.select("_k1", "_k2", F.col("_rep").alias("_id"), "_node").join(small(ends), "_node"), "chosen")
    # one row of each text: that of its least id, or one of those that repeat it
    same = (slim["_k1"] == chosen["_k1"]) & (slim["_k2"] == chosen["_k2"]) & slim["_id"].eqNullSafe(chosen["_id"])
    held = slim.join(small(chosen), same).select("_node", "_raw", "_deg").mapInArrow(sets, "_node long, _set binary, _deg long")
    held = stored(held.groupBy("_node").agg(F.first("_set").alias("_set"), F.first("_deg").alias("_deg")), "sets")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["u", "v"])

    one = hot_join(pairs.withColumnRenamed("_a", "_node"), held, ["_node"], "_b", "_deg", "inner", slim=False).select(
        F.col("_node").alias("_a"), F.col("_b").alias("_node"), F.col("_set").alias("_x")
    )
    both = hot_join(one, held, ["_node"], "_a", "_deg", "inner", slim=False).select("_a", F.col("_node").alias("_b"), "_x", F.col("_set").alias("_y"))
    return both.mapInArrow(near, "u long, v long")


def print_pairs(texts: DataFrame, tau: int) -> DataFrame:
    """(_a, _b): texts(_node, _fps) of which any two fingerprints of a kind are within tau bits, each with the least of those
    that share a fingerprint, and the least of linked fingerprints with each other."""
    each = texts.select("_node", F.posexplode("_fps").alias("_s", "_fp"))
    nodes = stored(each.groupBy("_s", "_fp").agg(F.min("_node").alias("_least"), F.count("*").alias("_w")), "nodes")
    met = links(nodes.select("_s", "_fp"), tau, kind="_s")
    left, right = nodes.select("_s", F.col("_fp").alias("u"), F.col("_least").alias("_a")), nodes.select("_s", F.col("_fp").alias("v"), F.col("_least").alias("_b"))
    across = met.join(left, ["_s", "u"]).join(right, ["_s", "v"]).select("_a", "_b")
    within = hot_join(each, stored(nodes.filter("_w > 1"), "shared"), ["_s", "_fp"], "_node", "_w", "inner").select(F.col("_least").alias("_a"), F.col("_node").alias("_b"))
    return across.unionAll(within)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, several: int = SEVERAL, tau: int = 2) -> DataFrame:
    """(id, component_id) of every row: texts that are the same or similar share the smallest id of their group.

    Two texts are linked if their sets of five-word shingles have the similarity (Jaccard), and all that have it are in one
    group. Texts of fewer than five words are one shingle. First come close copies, which may be many: texts of which any
    two fingerprints under one of several mixings are within tau bits, and each text with a leader of those that share a
    shingle of its prefix, in rounds; both are a few pairs a text. Then all pairs that are not in a group yet and share a
    shingle of their prefixes are compared, see prefix_pairs().

    Texts are the nodes, so an id that stands on several different texts gets a row for each. Null texts count as empty;
    rows that repeat an id and a text stay rows. Null ids are never a component_id unless a group has no other. Other
    columns are ignored; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints, sizes, rests, prefixes, sketches = [], [], [], [], []
            for t in b.column(1):
                h = shingles(t.as_py(), words)
                prints.append(several_fingerprints(h, several))
                x = np.unique(h)
                first, rest = prefix(x, similarity, common.value)
                sizes.append(len(x))
                rests.append(rest)
                prefixes.append(first.view(np.int64))
                sketches.append(sketch(x))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array(prints, longs), pa.array(sizes, pa.int64()), pa.array(rests, pa.int64()), pa.array(prefixes, longs), pa.array(sketches, longs)],
                ["_id", "_k1", "_k2", "_fps", "_size", "_rest", "_prefix", "_sketch"],
            )

    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_raw"))
    slim = slim.select("_id", "_raw", F.xxhash64("_raw").alias("_k1"), F.xxhash64(F.lit(7), "_raw").alias("_k2"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(slim, words))
    rows = stored(slim.mapInArrow(run, "_id long, _k1 long, _k2 long, _fps array<long>, _size long, _rest long, _prefix array<long>, _sketch array<long>"), "fingerprints")
    # texts get a number when this table is written; it is only read from then on
    texts = rows.groupBy("_k1", "_k2").agg(F.min("_id").alias("_rep"), F.count("*").alias("_n"), *[F.first(c).alias(c) for c in ("_fps", "_size", "_rest", "_prefix", "_sketch")])
    texts = stored(texts.withColumn("_node", F.monotonically_increasing_id()), "texts")
    numbers, met = texts.select("_k1", "_k2", "_node", "_rep", "_n"), buckets(texts)
    ordered = lambda pairs: pairs.filter("_a <> _b").select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct()
    verified = lambda pairs, name: stored(similar(stored(ordered(pairs), "pairs"), slim, texts, words, similarity), name)
    edges = verified(print_pairs(texts, tau).unionAll(leaders(met, similarity, 0)), "edges")
    of, turn, pairs, most = small(stored(rooted(numbers.select("_node"), edges, "_node"), "rooted")), 1, None, MOST_PAIRS * numbers.count()
    while True:
        before = pairs
        unmet, pairs = unsettled(met, of)
        if pairs <= most or before is not None and pairs > 0.75 * before:  # rounds go on while they settle much of what is left
            break
        of = merged(of, verified(leaders(unmet, similarity, turn), "led"))
        turn += 1
    if pairs:
        of = merged(of, verified(prefix_pairs(unmet, texts.select("_node", "_sketch"), similarity), "rest"))
    groups = stored(numbers.join(of, "_node"), "groups")
    least = stored(groups.groupBy("root").agg(F.min("_rep").alias("component_id"), F.count("*").alias("_w")), "components")
    classes = stored(hot_join(groups, least, ["root"], "_node", "_w").select("_k1", "_k2", "_n", "component_id"), "classes")
    return hot_join(rows.select("_id", "_k1", "_k2"), classes, ["_k1", "_k2"], "_id", "_n", "inner").select(F.col("_id").alias(id_col), "component_id")
