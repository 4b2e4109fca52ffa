"""Language-model scoring: bigrams with absolute discounting over add-one unigrams, from a log-frequency Bloom filter.

A bigram's count c is held as its level q = 1 + floor(log2 c): the pairs (bigram, 1) ... (bigram, q) are members of the
filter, so asking for level 1, 2, ... until the first miss gives q. A level stands for the middle of its counts, c(q). With
R(v) and T(v), the sum of c(q) and the number of the bigrams that begin with v,

    p(w | v) = (c(q) - D) / R(v) + D T(v) / R(v) p(w),

which sums to 1 over the words w: what is taken from the bigrams goes to the unigrams. A false answer of the filter raises a
level, by one in most cases and never beyond that of the rarer word; that is all by which the sum can exceed 1.

Counts of words and of what follows them are exact sums. Blocks send sorted hashes, cut at shards of equal ranges of the
hash, and get the sums back in the order of their hashes; no row stands for a word, so no word is a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import shared_dir, stored

#: Documents are worked on in blocks of about so many bytes; a single longer text is a block by itself.
BLOCK_BYTES = 10 << 20
#: Keys that blocks send to a shard, about: the number of shards follows the corpus.
SHARD_KEYS = 1 << 21
BITS_PER_KEY, PROBES = 8, 5
#: What is broadcast at once. A larger filter goes round in segments; every key is looked up in one of them.
SEGMENT_BYTES = 80 << 20
#: D of the module's formula.
DISCOUNT = 0.75
MOST_LEVELS = 48
#: Tokens that are scored at once, for bounded memory.
CHUNK = 1 << 18
#: A bigram's key: TOP bits of the hash of both words, which deal out the shards; CONTEXT bits of the hash of the first word,
#: by which its bigrams are added up; LOW further bits of the hash of both.
TOP, CONTEXT, LOW = 20, 36, 8

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return (x ^ (x >> np.uint64(29))) * _M3


def pair_keys(words: np.ndarray, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A 64-bit key for each pair of words, from the hashes of both."""
    with np.errstate(over="ignore"):
        w, first = words[ids], words[before]
        h = mix(first * _M1 + (w ^ (w >> np.uint64(32))))
    return (h >> np.uint64(64 - TOP) << np.uint64(64 - TOP)) | (first >> np.uint64(64 - CONTEXT) << np.uint64(LOW)) | (h & np.uint64((1 << LOW) - 1))


def keys_of(words: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunks of tokens: the place of the first, the tokens, those before them and the keys of both. Before the first
    token of a document stands the end mark (id 0)."""
    for lo in range(0, len(ids), CHUNK):
        here = ids[lo : lo + CHUNK]
        before = np.empty_like(here)
        before[1:], before[:1] = here[:-1], ids[lo - 1] if lo else 0
        before[starts[np.searchsorted(starts, lo) : np.searchsorted(starts, lo + len(here))] - lo] = 0
        yield lo, here, before, pair_keys(words, before, here)


def planes(a: np.ndarray) -> bytes:
    """An array's bytes by significance, compressed: what is zero in all numbers takes no room."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).data) if len(a) else b""


def from_planes(raw: bytes | pa.Buffer, kind: str) -> np.ndarray:
    if not len(raw):
        return np.zeros(0, kind)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def probes(keys: np.ndarray, level: int, bits: np.ndarray | np.uint64) -> Iterator[np.ndarray]:
    """The places of a (key, level) among so many bits, fewer than 2^32, one probe after the other."""
    with np.errstate(over="ignore"):
        h = mix(keys + np.uint64(level) * _M1)
        step = mix(h ^ _M3) | np.uint64(1)
        for _ in range(PROBES):
            yield ((h >> np.uint64(32)) * bits) >> np.uint64(32)
            h = h + step


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(counts)).astype(np.int64) + 1, MOST_LEVELS)


def twice(levels: np.ndarray) -> np.ndarray:
    """Twice the middle of the counts that have a level; 0 for level 0."""
    return np.where(levels > 0, 3 * (np.int64(1) << np.maximum(levels - 1, 0)) - 1, 0)


def build_shard(keys: np.ndarray, counts: np.ndarray, bits_per_key: int = BITS_PER_KEY) -> np.ndarray:
    """The bits of one shard, as bytes: so many for each (key, level)."""
    levels = levels_of(counts)
    size = max(64, -(-int(levels.sum()) * bits_per_key // 64) * 64)
    bits = np.zeros(size, bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        for at in probes(keys[levels >= q], q, np.uint64(size)):
            bits[at] = True
    return np.packbits(bits, bitorder="little")


class Segment:
    """Some successive shards of the filter; the shard of a key is given by its top bits."""

    def __init__(self, first: int, top: int, shards: list[np.ndarray]):
        self.first, self.top, self.count = first, top, len(shards)
        self.size = np.array([8 * len(s) for s in shards], np.uint64)
        self.start = np.concatenate([[0], np.cumsum([8 * len(s) for s in shards])])[:-1].astype(np.uint64)
        self.bits = np.concatenate(shards) if shards else np.zeros(0, np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, 0 if it is unknown, by probing one level after the other."""
        shard = (keys >> np.uint64(64 - self.top)).astype(np.int64) - self.first if self.top else np.zeros(len(keys), np.int64)
        start, size, out = self.start[shard], self.size[shard], np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        for q in range(1, MOST_LEVELS + 1):
            k, first, n = keys[alive], start[alive], size[alive]
            hit = np.ones(len(alive), bool)
            for at in probes(k, q, n):
                at += first
                hit &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            alive = alive[hit]
            if not len(alive):
                break
            out[alive] = q
        return out


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks(docs: DataFrame, held_out: Column, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents: ids, numbers of tokens, held-out flags, tokens as numbers of the block's words, and for each
    word its 64-bit hash and its number of training tokens. Word 0 is the end mark."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        vocab, keys, held, lengths, tokens, size = _Vocabulary({b"": 0}), [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal vocab, keys, held, lengths, tokens, size, seq
            ids = np.concatenate(tokens).astype("<u4")
            n = np.array(lengths, np.int64)
            train = np.repeat(~np.array(held, bool), n)
            counts = np.bincount(ids[train], minlength=len(vocab)).astype("<i8")
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocab), "<u8", len(vocab))
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array([part * (1 << 24) + seq], pa.int64()), pa.array([keys], pa.list_(id_type)), pa.array([n.tobytes()], pa.binary()),
                    pa.array([np.array(held, np.uint8).tobytes()], pa.binary()), pa.array([planes(ids)], pa.binary()), pa.array([hashes.tobytes()], pa.binary()),
                    pa.array([planes(counts)], pa.binary()), pa.array([int(counts.sum())], pa.int64()), pa.array([len(vocab)], pa.int64()),
                ],
                ["_block", "_ids", "_lengths", "_held", "_tokens", "_words", "_train", "_n", "_v"],
            )
            vocab, keys, held, lengths, tokens, size, seq = _Vocabulary({b"": 0}), [], [], [], [], 0, seq + 1
            return batch

        for b in batches:
            id_type = b.schema.field(0).type
            for k, t, h in zip(b.column(0), b.column(1), b.column(2), strict=True):
                raw = t.as_py()
                w = raw.lower().split()
                w.append(b"")
                tokens.append(np.fromiter(map(vocab.__getitem__, w), np.uint32, len(w)))
                keys.append(k.as_py())
                held.append(h.as_py())
                lengths.append(len(w))
                size += len(raw)
                if size >= block_bytes:
                    yield flush()
        if keys:
            yield flush()

    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_raw"), held_out.alias("_h"))
    return slim.mapInArrow(run, f"_block long, _ids array<{kind}>, _lengths binary, _held binary, _tokens binary, _words binary, _train binary, _n long, _v long")


def _array(batch: pa.RecordBatch, name: str, row: int, kind: str, packed: bool = False) -> np.ndarray:
    raw = batch.column(batch.schema.get_field_index(name))[row].as_buffer()
    return from_planes(raw, kind) if packed else np.frombuffer(raw, kind)


def shard_bits(n: int, most: int = TOP) -> int:
    """The number of top bits that tell shards of about SHARD_KEYS of n keys apart."""
    return min(most, max(0, int(np.ceil(np.log2(max(1, n) / SHARD_KEYS)))))


def cuts(keys: np.ndarray, top: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of the parts of sorted keys of so many bits, by their top ones; empty parts are left out."""
    if not top:
        return [(0, 0, len(keys))] if len(keys) else []
    at = np.searchsorted(keys, np.arange(1 << top, dtype=np.uint64) << np.uint64(bits - top))
    return [(s, lo, hi) for s, (lo, hi) in enumerate(zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=True)) if lo < hi]


def differences(keys: np.ndarray) -> bytes:
    return planes(np.diff(keys, prepend=np.uint64(0)))


def from_differences(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, "<u8"), dtype=np.uint64)


def added(keys: list[np.ndarray], *values: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """The distinct keys, ascending, and the sums of their values."""
    flat = np.concatenate([*keys, np.zeros(0, np.uint64)])
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(np.concatenate([*v, np.zeros(0, np.int64)]).astype(np.int64)[order], first) if len(flat) else np.zeros(0, np.int64) for v in values]
    return flat[first], *sums


def _training_keys(b: pa.RecordBatch, r: int) -> np.ndarray:
    """The sorted keys of a block's training tokens, with repeats."""
    words, ids, n = _array(b, "_words", r, "<u8"), _array(b, "_tokens", r, "<u4", True), _array(b, "_lengths", r, "<i8")
    ends = np.cumsum(n)
    held = _array(b, "_held", r, "u1") != 0
    out, size = np.empty(int(n[~held].sum()), np.uint64), 0
    for lo, here, _, keys in keys_of(words, ids, ends - n):
        keys = keys[~held[np.searchsorted(ends, np.arange(lo, lo + len(here)), side="right")]]
        out[size : size + len(keys)] = keys
        size += len(keys)
    out.sort()
    return out


def build_filter(blocked: DataFrame, top: int, word_top: int, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """(_shard, _bits, _to, _keys, _sums, _numbers): the shards of the filter over the bigrams of training documents, counted
    over all blocks, and for the shards of words (_to) the first words of a shard's bigrams with the sums of c(q) and the
    numbers of bigrams. Each block sends sorted differences of its own distinct keys."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                keys = _training_keys(b, r)
                for shard, lo, hi in cuts(keys, top):
                    k, c = np.unique(keys[lo:hi], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int64()), pa.array([differences(k)], pa.binary()), pa.array([planes(c.astype("<u4"))], pa.binary())], ["_shard", "_keys", "_counts"]
                    )

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["_shard"].iloc[0])
        keys, counts = added([from_differences(k) for k in pdf["_keys"]], [from_planes(c, "<u4") for c in pdf["_counts"]])
        rows = [(shard, build_shard(keys, counts, bits_per_key).tobytes(), None, None, None, None)]
        first = (keys >> np.uint64(LOW)) & np.uint64((1 << CONTEXT) - 1)
        first, sums, numbers = added([first], [twice(levels_of(counts))], [np.ones(len(first), np.int64)])
        rows += [(None, None, to, differences(first[lo:hi]), planes(sums[lo:hi].astype("<i8")), planes(numbers[lo:hi].astype("<i8"))) for to, lo, hi in cuts(first, word_top, CONTEXT)]
        return pd.DataFrame({c: pd.Series(list(v), dtype="object") for c, v in zip(("_shard", "_bits", "_to", "_keys", "_sums", "_numbers"), zip(*rows, strict=True), strict=True)})

    sent = blocked.select("_lengths", "_held", "_tokens", "_words").mapInArrow(send, "_shard long, _keys binary, _counts binary")
    return sent.groupBy("_shard").applyInPandas(build, "_shard long, _bits binary, _to long, _keys binary, _sums binary, _numbers binary")


def word_counts(blocked: DataFrame, built: DataFrame, word_top: int) -> DataFrame:
    """(_block, _shard, _c, _sums, _numbers, _new): what the corpus has of each block's words, shard by shard, in the order of
    their hashes: the count, and R (twice) and T of the module's formula; _new is the number of words with a count in the
    shard, in one row of it (_block null)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                words, counts = _array(b, "_words", r, "<u8"), _array(b, "_train", r, "<i8", True)
                order = np.argsort(words, kind="stable")
                words, counts = words[order], counts[order]
                for shard, lo, hi in cuts(words, word_top):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard], pa.int64()), b.column(b.schema.get_field_index("_block")).slice(r, 1), pa.array([differences(words[lo:hi])], pa.binary()),
                            pa.array([planes(counts[lo:hi])], pa.binary()), pa.array([None], pa.binary()),
                        ],
                        ["_shard", "_block", "_keys", "_sums", "_numbers"],
                    )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, of_block = int(pdf["_shard"].iloc[0]), pdf["_block"].notna()
        own, after = pdf[of_block], pdf[~of_block]
        sent = [from_differences(k) for k in own["_keys"]]
        words, counts = added(sent, [from_planes(c, "<i8") for c in own["_sums"]])
        first, sums, numbers = added(*[[read(x) for x in after[c]] for c, read in (("_keys", from_differences), ("_sums", lambda x: from_planes(x, "<i8")), ("_numbers", lambda x: from_planes(x, "<i8")))])
        at = np.searchsorted(first, words >> np.uint64(64 - CONTEXT))
        found = np.zeros(len(words), bool)
        found[at < len(first)] = first[at[at < len(first)]] == (words >> np.uint64(64 - CONTEXT))[at < len(first)]
        r, t = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        r[found], t[found] = sums[at[found]], numbers[at[found]]
        rows = [(None, shard, None, None, None, int((counts > 0).sum()))]
        for block, keys in zip(own["_block"], sent, strict=True):
            k = np.searchsorted(words, keys)
            rows.append((int(block), shard, *(planes(x[k].astype("<i8")) for x in (counts, r, t)), None))
        return pd.DataFrame({c: pd.Series(list(v), dtype="object") for c, v in zip(("_block", "_shard", "_c", "_sums", "_numbers", "_new"), zip(*rows, strict=True), strict=True)})

    sent = blocked.select("_block", "_words", "_train").mapInArrow(send, "_shard long, _block long, _keys binary, _sums binary, _numbers binary")
    after = built.filter("_to is not null").select(F.col("_to").alias("_shard"), F.lit(None).cast("long").alias("_block"), "_keys", "_sums", "_numbers")
    return sent.unionByName(after).groupBy("_shard").applyInPandas(add, "_block long, _shard long, _c binary, _sums binary, _numbers binary, _new long")


def plan_segments(shards: DataFrame, top: int, limit: int) -> list[int]:
    """The first shard of each segment of at most `limit` bytes, or one shard, and the number of shards."""
    sizes = {r["_shard"]: r["n"] for r in shards.select("_shard", F.octet_length("_bits").alias("n")).collect()}
    starts, size = [0], 0
    for shard in range(1 << top):
        n = sizes.get(shard, 8)
        if size and size + n > limit:
            starts.append(shard)
            size = 0
        size += n
    return [*starts, 1 << top]


def segment(shards: DataFrame, top: int, first: int, end: int) -> Segment:
    found = {r["_shard"]: np.frombuffer(r["_bits"], np.uint8) for r in shards.filter(F.col("_shard").between(first, end - 1)).collect()}
    return Segment(first, top, [found.get(s, np.zeros(8, np.uint8)) for s in range(first, end)])


def _distinct_keys(b: pa.RecordBatch, r: int) -> np.ndarray:
    words, ids, n = _array(b, "_words", r, "<u8"), _array(b, "_tokens", r, "<u4", True), _array(b, "_lengths", r, "<i8")
    return np.unique(np.concatenate([keys for *_, keys in keys_of(words, ids, np.cumsum(n) - n)]))


def levels_by_segment(blocked: DataFrame, shards: DataFrame, top: int, starts: list[int]) -> DataFrame:
    """(_block, _levels): the levels of each block's distinct keys, in pieces by segment. Each block's keys are written once,
    by segment, so that each key is read and looked up once, however many segments there are."""
    spark = blocked.sparkSession
    ends = np.array(starts[1:-1], np.uint64) << np.uint64(64 - top)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                keys = _distinct_keys(b, r)
                at = [0, *np.searchsorted(keys, ends).tolist(), len(keys)]
                for s, (lo, hi) in enumerate(zip(at, at[1:], strict=False)):
                    yield pa.RecordBatch.from_arrays(
                        [b.column(b.schema.get_field_index("_block")).slice(r, 1), pa.array([s], pa.int32()), pa.array([differences(keys[lo:hi])], pa.binary())], ["_block", "_segment", "_keys"]
                    )

    dealt = blocked.select("_block", "_lengths", "_tokens", "_words").mapInArrow(deal, "_block long, _segment int, _keys binary")
    path = f"{shared_dir(spark)}/keys"
    dealt.write.partitionBy("_segment").parquet(path)
    pieces = []
    for s, (first, end) in enumerate(zip(starts, starts[1:], strict=False)):
        shared = spark.sparkContext.broadcast(segment(shards, top, first, end))

        def run(batches: Iterator[pa.RecordBatch], s: int = s, shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [planes(shared.value.levels(from_differences(k.as_py())).astype("u1")) for k in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, s, np.int32)), pa.array(found, pa.binary())], ["_block", "_segment", "_levels"])

        rows = spark.read.schema("_block long, _keys binary").parquet(f"{path}/_segment={s}")
        pieces.append(stored(rows.mapInArrow(run, "_block long, _segment int, _levels binary"), "levels"))
        shared.unpersist()
    found = pieces[0]
    for p in pieces[1:]:
        found = found.unionAll(p)
    return found.groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("_segment", "_levels")))["_levels"].alias("_levels"))


def score_documents(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", discount: float = DISCOUNT, segment_bytes: int = SEGMENT_BYTES,
    bits_per_key: int = BITS_PER_KEY, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are words, A-Z lower-cased, and one end mark a document. base_score adds up log10((c + 1) / (N + V + 1)) with the
    exact count c of the token in the rows that held_out does not mark; words are told apart by 64 bits of hash. score is
    the log10 probability of the text under the module's formula, each text after an end mark; a word that follows a word
    without count has its unigram's probability.

    A null text counts as empty: one end mark. Rows that repeat an id are documents of their own; null ids stay null; other
    columns are ignored; a very long text is a block by itself; an empty table gives an empty one.

    The text is read once into blocks, written to the shared folder. The filter takes bits_per_key bits for each bigram and
    level at every size of the corpus. If it is larger than segment_bytes it is broadcast in segments, see
    levels_by_segment().
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    blocked = stored(blocks(docs, held_out, id_col, text_col, block_bytes), "blocks")
    n, entries = blocked.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_v"), F.lit(0))).first()
    top, word_top = shard_bits(n), shard_bits(entries)
    built = stored(build_filter(blocked, top, word_top, bits_per_key), "filter")
    shards = built.filter("_bits is not null").select("_shard", "_bits")
    words = stored(word_counts(blocked, built, word_top), "words")
    v = words.agg(F.coalesce(F.sum("_new"), F.lit(0))).first()[0]
    back = words.filter("_block is not null").groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("_shard", "_c", "_sums", "_numbers"))).alias("_counts"))
    ready = blocked.drop("_train", "_n", "_v").join(back, "_block")
    starts = plan_segments(shards, top, segment_bytes)
    whole = len(starts) == 2
    if whole:
        shared = spark.sparkContext.broadcast(segment(shards, top, 0, 1 << top))
    else:
        ready = ready.join(levels_by_segment(blocked, shards, top, starts), "_block")
    unigram_base = float(n + v + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                words, ids, lengths = _array(b, "_words", r, "<u8"), _array(b, "_tokens", r, "<u4", True), _array(b, "_lengths", r, "<i8")
                parts = b.column(b.schema.get_field_index("_counts"))[r].as_py()
                order = np.argsort(words, kind="stable")
                count, after, kinds = (np.empty(len(words), np.int64) for _ in range(3))
                for out, c in ((count, "_c"), (after, "_sums"), (kinds, "_numbers")):
                    out[order] = np.concatenate([from_planes(p[c], "<i8") for p in parts])
                if not whole:
                    known_keys = _distinct_keys(b, r)
                    known_levels = np.concatenate([from_planes(x.as_py(), "u1") for x in b.column(b.schema.get_field_index("_levels"))[r].values]).astype(np.int64)
                ends = np.cumsum(lengths)
                most = np.where(count > 0, levels_of(np.maximum(count, 1)), 0)  # a bigram is no more frequent than its words
                single = (count + 1) / unigram_base
                log_single, some = np.log10(single), count > 0
                rest = np.where(after > 0, 2 * discount * kinds / np.maximum(after, 1), 1.0)
                known, base, total = (np.zeros(len(lengths)) for _ in range(3))
                for lo, here, before, keys in keys_of(words, ids, ends - lengths):
                    doc = np.searchsorted(ends, np.arange(lo, lo + len(here)), side="right")
                    levels = shared.value.levels(keys) if whole else known_levels[np.searchsorted(known_keys, keys)]
                    levels = np.minimum(levels, np.minimum(most[here], most[before]))
                    own = np.maximum(twice(levels) - 2 * discount, 0) / np.maximum(after[before], 1)
                    own[after[before] == 0] = 0
                    p = np.minimum(own + rest[before] * single[here], 1.0)
                    known += np.bincount(doc, some[here], len(lengths))
                    base += np.bincount(doc, log_single[here], len(lengths))
                    total += np.bincount(doc, np.log10(p), len(lengths))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(b.schema.get_field_index("_ids"))[r].values, pa.array(_array(b, "_held", r, "u1") != 0), pa.array(lengths),
                        pa.array(known.astype(np.int64)), pa.array(base), pa.array(total),
                    ],
                    ["_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    scored = ready.mapInArrow(score, f"_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
