"""Benchmark decontamination by latent semantic retrieval.

Passages of documents and benchmark items are TF-IDF vectors over the words of the benchmark. A distributed randomised
SVD of the passages gives the leading directions of the corpus and their singular values; the items are folded in, so
that the latent space spans both, and a direction counts the less the more of the corpus lies along it. Passages near an
item, or near a passage of a long item, in that space or in the undamped one are candidates, and so is every run of words
that an item holds; a longest common subsequence, a common run of words and a check of the item's answer decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import stored

#: A passage is two successive steps of STEP words; each step starts one, so every word is in two.
STEP = 16
#: Leading directions of the corpus, and those drawn besides for the sketch.
RANK, OVERSAMPLE = 16, 8
#: Items that are searched for at once; more come in further blocks, each over all documents.
BLOCK = 256
#: Words of the items of a block, but for one that is longer by itself.
BLOCK_WORDS = 50_000
#: Terms in a larger share of all steps weigh nothing, but for items that would have fewer than LEAST_TERMS left.
COMMON, LEAST_TERMS = 0.01, 5
#: A candidate's least cosine. A leak shares LCS of an item's words in order, or RUN words in a row; a paraphrase shares
#: PARAPHRASE of them at a cosine of NEAR, and ANSWER of the words of the item's answer, its last sentence.
COSINE, LCS, RUN, NEAR, PARAPHRASE, ANSWER = 0.3, 0.8, 13, 0.5, 0.6, 0.8
#: Items of fewer words must stand in a document word by word.
SHORT = 8

#: Cosines that are held at once, of passages to vectors of items.
CELLS = 2_000_000

_WORD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-case runs of letters, digits and characters beyond ASCII."""
    return (text or "").lower().encode().translate(_WORD).split()


def lcs_length(masks: dict[int, int], n: int, other: list[int]) -> int:
    """Length of the longest common subsequence; masks has the places of each of the n words of one side as bits."""
    full = (1 << n) - 1
    v = full
    for t in other:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def run_hashes(ids: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """The hashes of all runs of 1, 2, .. `length` words, by their starts."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    h = np.zeros(len(x) + 1, np.uint64)
    for n in range(1, min(length, len(x)) + 1):
        h = h[:-1] * np.uint64(0xBF58476D1CE4E5B9) + x[n - 1 :]
        yield h


def _spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, .. of each range, one range after the other."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Items:
    """A block of benchmark items in the vocabulary of its words."""

    def __init__(self, rows: list[tuple[object, str | None]]):
        kept = [(i, t, w) for i, t in rows if (w := words(t))]
        self.names = [i for i, _, _ in kept]
        self.vocab: dict[bytes, int] = {}
        self.ids = [[self.vocab.setdefault(w, len(self.vocab)) for w in ws] for _, _, ws in kept]
        self.masks, self.runs, self.answers = [], [], []
        for (_, text, _), ids in zip(kept, self.ids, strict=True):
            m: dict[int, int] = {}
            for k, t in enumerate(ids):
                m[t] = m.get(t, 0) | 1 << k
            self.masks.append(m)
            n = len(ids) if len(ids) < SHORT else min(RUN, len(ids))
            self.runs.append((n, {tuple(ids[k : k + n]) for k in range(len(ids) - n + 1)}))
            last = [p for p in re.split(r"[.!?\n]+", text or "") if words(p)][-1]
            self.answers.append({self.vocab[w] for w in words(last)})
        # what passages are compared with: each item whole, and the passages of those that are longer than one
        self.parts, self.owner = [], []
        for k, ids in enumerate(self.ids):
            n = len(ids) - 2 * STEP
            cut = [ids] + [ids[at : at + 2 * STEP] for at in (*range(0, n, STEP), n) if n > 0]
            self.parts += cut
            self.owner += [k] * len(cut)
        self.hashes = {}
        for length in {n for n, _ in self.runs}:
            found = [(h, k) for k, (n, _) in enumerate(self.runs) if n == length for h in set(list(run_hashes(np.array(self.ids[k]), n))[-1].tolist())]
            found.sort()
            self.hashes[length] = np.array([h for h, _ in found], np.uint64), np.array([k for _, k in found], np.int64)

    def common_runs(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) of the runs of a document that seem to be the items' own; hashes may collide, verdict() decides."""
        starts, found = [], []
        known = np.concatenate([[0], np.cumsum(doc != self.unknown)])
        for n, h in enumerate(run_hashes(doc, max(self.hashes)), 1):
            if n not in self.hashes:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            keys, item = self.hashes[n]
            lo, hi = np.searchsorted(keys, h[at]), np.searchsorted(keys, h[at], side="right")
            starts.append(np.repeat(at, hi - lo))
            found.append(item[_spread(lo, hi - lo)])
        return (np.concatenate(starts), np.concatenate(found)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def from_hashes(self, h: np.ndarray) -> np.ndarray:
        """The numbers of words that are given by word_hashes()."""
        if not hasattr(self, "by_hash"):
            found = sorted((xxhash.xxh32_intdigest(w), n) for w, n in self.vocab.items())
            self.by_hash = np.array([x for x, _ in found], np.uint32), np.array([n for _, n in found], self.dtype)
        keys, numbers = self.by_hash
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, numbers[at], np.array(self.unknown, self.dtype))

    @property
    def dtype(self) -> str:
        return "<u2" if len(self.vocab) < 0xFFFF else "<u4"

    @property
    def unknown(self) -> int:
        return int(np.iinfo(self.dtype).max)

    def verdict(self, k: int, region: list[int], cosine: float) -> tuple[bool, float, float]:
        """Whether a region of a document leaks item k, the share of its words in order, and of its answer's words."""
        n, found = len(self.ids[k]), set(region)
        answer = len(self.answers[k] & found) / len(self.answers[k])
        share = lcs_length(self.masks[k], n, region) / n
        length, runs = self.runs[k]
        run = any(tuple(region[j : j + length]) in runs for j in range(len(region) - length + 1))
        if n < SHORT:
            return run, share, answer
        return run or share >= LCS or (cosine >= NEAR and share >= PARAPHRASE and answer >= ANSWER), share, answer


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, size: int = BLOCK) -> Iterator[Items]:
    """Blocks of items by id, of fewer than `size` if they are long; the driver holds one at a time. Items without words find
    nothing."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).orderBy("i", "t").toLocalIterator()
    part, n = [], 0
    for r in rows:
        part.append((r["i"], r["t"]))
        n += len(words(r["t"]))
        if len(part) == size or n >= BLOCK_WORDS:
            if n:
                yield Items(part)
            part, n = [], 0
    if n:
        yield Items(part)


def word_hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _words): each document's words in order, by 32 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1):
                w = words(t.as_py())
                out.append(np.fromiter(map(xxhash.xxh32_intdigest, w), "<u4", len(w)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["_id", "_words"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).mapInArrow(run, f"_id {kind}, _words binary")


def encoded(docs: DataFrame, items: Items) -> DataFrame:
    """(_id, _ids): each document's words as numbers of the vocabulary, in order, others as the largest number. docs has _id
    and _text, or _words of word_hashes()."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    hashed = "_words" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = shared.value
        number, other, kind = it.vocab.get, it.unknown, it.dtype
        for b in batches:
            out = []
            for t in b.column(1):
                if hashed:
                    out.append(it.from_hashes(np.frombuffer(t.as_py(), "<u4")).tobytes())
                else:
                    w = words(t.as_py())
                    out.append(np.fromiter((number(x, other) for x in w), kind, len(w)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["_id", "_ids"])

    return docs.mapInArrow(run, f"_id {docs.schema['_id'].dataType.simpleString()}, _ids binary")


class Passages:
    """The passages of some documents: (window, term) pairs without repeats, by window. A passage starts at every step, or
    with overlap=False at every second one."""

    def __init__(self, docs: list[np.ndarray], weight: np.ndarray, overlap: bool = True):
        lengths = np.array([len(d) for d in docs], np.int64)
        steps = -(-lengths // STEP)
        self.first = np.concatenate([[0], np.cumsum(steps)])
        ids = np.concatenate(docs).astype(np.int64) if docs else np.zeros(0, np.int64)
        at = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        known = ids < len(weight)
        known[known] = weight[ids[known]] > 0
        ids, step, start = ids[known], (np.repeat(self.first[:-1], lengths) + at // STEP)[known], np.repeat(self.first[:-1], lengths)[known]
        if overlap:
            earlier = step > start
            step, ids = np.concatenate([step, step[earlier] - 1]), np.concatenate([ids, ids[earlier]])
        else:
            step = step - (step - start) % 2
        pairs = np.unique(step * len(weight) + ids)
        self.window, self.term = pairs // max(1, len(weight)), pairs % max(1, len(weight))
        self.begin = np.flatnonzero(np.diff(self.window, prepend=-1))
        self.which = self.window[self.begin]
        self.value = weight[self.term]
        if len(pairs):
            self.value = (self.value / np.repeat(np.sqrt(np.add.reduceat(self.value**2, self.begin)), np.diff(np.append(self.begin, len(pairs))))).astype(np.float32)

    def times(self, right: np.ndarray) -> np.ndarray:
        """The rows of windows that have a term, times a matrix with a row for each term."""
        if not len(self.term):
            return np.zeros((0, right.shape[1]), np.float32)
        return np.add.reduceat(right[self.term] * self.value[:, None], self.begin, axis=0)


def _read(batches: Iterator[pa.RecordBatch], kind: str, most: int = 400_000) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Documents by groups of about `most` words."""
    keys, docs, n = [], [], 0
    for b in batches:
        for k, d in zip(b.column(0), b.column(1), strict=True):
            keys.append(k.as_py())
            docs.append(np.frombuffer(d.as_py(), kind))
            n += len(docs[-1])
            if n >= most:
                yield keys, docs
                keys, docs, n = [], [], 0
    if keys:
        yield keys, docs


def _summed(ids: DataFrame, width: int, part) -> dict[int, np.ndarray]:
    """The sum over all partitions of what `part` gives for one: a matrix as {row: array of `width` numbers}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = part(batches)
        rows = np.flatnonzero(np.abs(total).sum(axis=1))
        for lo in range(0, len(rows), 4096):
            r = rows[lo : lo + 4096]
            yield pa.RecordBatch.from_pydict({"r": pa.array(r, pa.int64()), "v": pa.array(list(total[r].astype(np.float64)), pa.list_(pa.float64()))})

    sums = ids.mapInArrow(run, "r long, v array<double>").groupBy("r").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(width)]).alias("v"))
    return {r["r"]: np.array(r["v"]) for r in sums.collect()}


def weights(ids: DataFrame, items: Items) -> np.ndarray:
    """Inverse frequencies of the terms over all steps of all documents; 0 for those that are common."""
    v, kind = len(items.vocab), items.dtype

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((v + 1, 1))
        for _, docs in _read(batches, kind):
            # each document is padded to whole steps with words that are not counted
            flat = np.concatenate([np.append(d.astype(np.int64), np.full(-len(d) % STEP, v)) for d in docs]).reshape(-1, STEP)
            flat = np.sort(np.minimum(flat, v), axis=1)
            new = np.ones(flat.shape, bool)
            new[:, 1:] = flat[:, 1:] != flat[:, :-1]
            total[:v, 0] += np.bincount(flat[new], minlength=v + 1)[:v]
            total[v, 0] += len(flat)
        return total

    found = _summed(ids, 1, part)
    n = found.get(v, np.zeros(1))[0]
    df = np.array([found[t][0] if t in found else 0.0 for t in range(v)])
    idf = np.log((1 + n) / (1 + df)) + 1
    out = np.where(df > COMMON * n, 0.0, idf)
    for part in items.parts:
        if len({t for t in part if out[t] > 0}) < LEAST_TERMS:
            out[part] = idf[part]
    return out.astype(np.float32)


def _item_vectors(items: Items, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, part, value) of the items' parts as vectors of length 1, by term."""
    terms = [np.unique(ids) for ids in items.parts]
    values = [weight[t].astype(np.float64) for t in terms]
    values = [x / max(np.linalg.norm(x), 1e-9) for x in values]
    term, part, value = np.concatenate(terms), np.repeat(np.arange(len(terms)), [len(t) for t in terms]), np.concatenate(values)
    order = np.lexsort((part, term))
    order = order[value[order] > 0]
    return term[order], part[order], value[order]


def latent_space(ids: DataFrame, items: Items, weight: np.ndarray, rank: int = RANK, oversample: int = OVERSAMPLE, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal directions (term x rank) of the passages by a randomised SVD, and their singular values.

    With A the passages by terms and O random: Z = A'(A O) is summed over the partitions, Q = orth(Z); (A Q)'(A Q) is
    summed likewise, and its eigenvectors turn Q to the right singular vectors.
    """
    v, kind = len(weight), items.dtype
    width = min(v, rank + oversample)
    spark = ids.sparkSession
    draw = spark.sparkContext.broadcast((weight, np.random.default_rng(seed).standard_normal((v, width)).astype(np.float32)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        w, omega = draw.value
        total = np.zeros((v, width))
        for _, docs in _read(batches, kind):
            p = Passages(docs, w, overlap=False)
            if not len(p.term):
                continue
            y = np.repeat(p.times(omega), np.diff(np.append(p.begin, len(p.term))), axis=0) * p.value[:, None]
            order = np.argsort(p.term, kind="stable")
            terms = p.term[order]
            first = np.flatnonzero(np.diff(terms, prepend=-1))
            total[terms[first]] += np.add.reduceat(y[order], first, axis=0)
        return total

    z = np.zeros((v, width))
    for r, x in _summed(ids, width, sketch).items():
        z[r] = x
    q = np.linalg.qr(z)[0].astype(np.float32)
    turn = spark.sparkContext.broadcast((weight, q))

    def gram(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        w, right = turn.value
        total = np.zeros((width, width))
        for _, docs in _read(batches, kind):
            b = Passages(docs, w, overlap=False).times(right)
            total += b.T @ b
        return total

    g = np.zeros((width, width))
    for r, x in _summed(ids, width, gram).items():
        g[r] = x
    value, vector = np.linalg.eigh((g + g.T) / 2)
    best = np.argsort(-value)[:rank]
    return (q @ vector[:, best]).astype(np.float32), np.sqrt(np.maximum(value[best], 0))


class LatentItems:
    """What turns passages into cosines to the items in the latent space.

    The space is spanned by the corpus' directions d and the items. Along a direction with singular value s, coordinates are
    scaled by the least singular value over s; what the items add keeps its scale. For an orthonormal basis B and scales L,
    B L^2 B' v = v - d (1 - scale^2) d'v: the item itself, sparse, less a part of low rank.
    """

    def __init__(self, items: Items, weight: np.ndarray, directions: np.ndarray, singular: np.ndarray):
        (term, part, value), d = _item_vectors(items, weight), directions.astype(np.float64)
        scale = np.ones(len(singular))
        if (singular > 0).any():
            scale[singular > 0] = singular[singular > 0].min() / singular[singular > 0]
        self.n = len(items.parts)
        within = np.zeros((self.n, d.shape[1]))
        for k in range(d.shape[1]):
            within[:, k] = np.bincount(part, value * d[term, k], self.n)
        length = np.sqrt(np.maximum(np.bincount(part, value**2, self.n) - (within**2 * (1 - scale**2)).sum(axis=1), 1e-12))
        self.start = np.searchsorted(term, np.arange(len(weight) + 1))
        self.item, self.value = part, (value / length[part]).astype(np.float32)
        self.directions, self.damp = directions.astype(np.float32), (within * (1 - scale**2) / length[:, None]).T.astype(np.float32)
        self.length, self.lost = length.astype(np.float32), (1 - scale**2).astype(np.float32)

    def near(self, p: Passages) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(passage, part of an item, cosine) of all that share a term of some weight, by blocks of passages: the larger of the
        cosine in the latent space, where both sides have their damped length, and of the undamped one. What repeats all over
        the corpus is a leading direction itself; damped, it hardly counts beside the other words of a passage, undamped it
        does."""
        ends = np.append(p.begin, len(p.term))
        step = max(1, CELLS // self.n)
        for lo in range(0, len(p.begin), step):
            rows = min(step, len(p.begin) - lo)
            part = Passages.__new__(Passages)
            part.begin = p.begin[lo : lo + rows] - p.begin[lo]
            part.term, part.value = p.term[ends[lo] : ends[lo + rows]], p.value[ends[lo] : ends[lo + rows]]
            sizes = self.start[part.term + 1] - self.start[part.term]
            at = _spread(self.start[part.term], sizes)
            key = np.repeat(np.repeat(np.arange(rows), np.diff(ends[lo : lo + rows + 1])), sizes) * self.n + self.item[at]
            own = np.bincount(key, np.repeat(part.value, sizes) * self.value[at], rows * self.n)
            met = np.flatnonzero(own)
            own, row, column = own[met], met // self.n, met % self.n
            along = part.times(self.directions)
            left = np.sqrt(np.maximum(1 - (along**2) @ self.lost, 1e-6))
            damped = (own - (along @ self.damp).ravel()[met]) / left[row]
            yield row + lo, column, np.minimum(np.maximum(damped, own * self.length[column]), 1.0)


def candidates(items: Items, space: LatentItems, p: Passages, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, cosine) of the passages near an item, the best over its parts, and of those, whatever their cosine, that
    start a common run."""
    n, owner = len(items.ids), np.array(items.owner)
    runs = [(p.first[d] + at // STEP) * n + k for d, x in enumerate(docs) for at, k in [items.common_runs(x)] if len(at)]
    runs = np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.int64)
    keys, cosines = [runs], [np.zeros(len(runs))]  # at least 0, where no word weighs anything
    for row, part, cosine in space.near(p):
        key = p.which[row] * n + owner[part]
        kept = cosine >= COSINE
        if len(runs):
            at = np.minimum(np.searchsorted(runs, key), len(runs) - 1)
            kept |= runs[at] == key
        keys.append(key[kept])
        cosines.append(cosine[kept])
    key, cosine = np.concatenate(keys), np.concatenate(cosines)
    order = np.lexsort((-cosine, key))
    key, first = np.unique(key[order], return_index=True)
    return key // n, key % n, cosine[order][first].astype(np.float64)


def search(ids: DataFrame, items: Items, weight: np.ndarray, latent: LatentItems) -> DataFrame:
    """(_id, _k, _cosine, _lcs, _answer) for each document and item that it leaks, once for each passage that does."""
    shared = ids.sparkSession.sparkContext.broadcast((items, weight, latent))
    kind = ids.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it, w, space = shared.value
        for keys, docs in _read(batches, it.dtype, 100_000):
            p = Passages(docs, w)
            hits = candidates(it, space, p, docs)
            doc = np.searchsorted(p.first, hits[0], side="right") - 1
            out = []
            for window, k, cosine, d in zip(*(x.tolist() for x in hits), doc.tolist(), strict=True):
                n = len(it.ids[k])
                at = int(window - p.first[d]) * STEP
                region = docs[d][max(0, at - n) : at + 2 * STEP + n].tolist()
                leak, share, answer = it.verdict(k, region, cosine)
                if leak:
                    out.append((keys[d], k, cosine, share, answer))
            if out:
                cols_ = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols_[0], b_type), *map(pa.array, cols_[1:])], ["_id", "_k", "_cosine", "_lcs", "_answer"])

    b_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)
    return ids.mapInArrow(run, f"_id {kind}, _k long, _cosine double, _lcs double, _answer double")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block: int = BLOCK) -> DataFrame:
    """(id, item, cosine, lcs, answer): one row for each document and benchmark item of which it holds the text or a
    paraphrase, with the best values over its passages.

    Null and empty texts hold nothing; items without words are in no document. Rows that repeat an id are taken together.
    A null id gets rows with a null id. Other columns are ignored. No documents or no items: no rows.
    Documents are split into words once; with several blocks of items these are written as hashes, from which each block
    takes its numbers. The passes for frequencies, the sketch, its turn and the search read only numbers. What goes to the
    driver or is broadcast depends on the items of a block, not on documents.
    """
    spark: SparkSession = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    found = spark.createDataFrame([], f"`{id_col}` {kind}, `{item_col}` {item_kind}, cosine double, lcs double, answer double")
    parts = item_blocks(benchmark, item_col, "text", block)
    head = list(islice(parts, 2))
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if len(head) > 1:
        source = stored(word_hashes(docs, id_col, text_col), "hashes")
    for items in chain(head, parts):
        ids = stored(encoded(source, items), "words")
        weight = weights(ids, items)
        directions, singular = latent_space(ids, items, weight)
        hits = search(ids, items, weight, LatentItems(items, weight, directions, singular))
        best = hits.groupBy("_id", "_k").agg(F.max("_cosine").alias("cosine"), F.max("_lcs").alias("lcs"), F.max("_answer").alias("answer"))
        names = spark.createDataFrame(list(enumerate(items.names)), f"_k long, `{item_col}` {item_kind}")
        found = found.unionByName(best.join(F.broadcast(names), "_k").select(F.col("_id").alias(id_col), F.col(item_col), "cosine", "lcs", "answer"))
    return found
