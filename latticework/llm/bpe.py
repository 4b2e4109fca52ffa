"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of each of the two generations of a worker's memory of encoded pre-tokens: when the young one is full it becomes
#: the old one, and what is met again moves on. It changes speed only.
MEMORY = 200_000
#: Bytes of text encoded before a batch is handed on.
BATCH_BYTES = 1_000_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by id."""
    with open(path, "rb") as f:
        pairs = [(int(i), base64.b64decode(t)) for t, i in map(bytes.split, f)]
    out = [b""] * (max(i for i, _ in pairs) + 1)
    for i, t in pairs:
        out[i] = t
    return out


class PerfectHash:
    """Minimal perfect hash over distinct byte strings by hash and displace: n keys, n slots."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 2)
        self.shift = [0] * self.buckets
        self.slots = [-1] * n
        hashes = [xxhash.xxh64_intdigest(k, 1) for k in keys]
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        free = np.ones(n, bool)
        alone = []
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if len(members[b]) < 2:
                alone += [b] * len(members[b])
                continue
            for d in range(1, 1 << 22):
                at = [self._slot(hashes[i], d) for i in members[b]]
                if len(set(at)) == len(at) and free[at].all():
                    break
            else:
                raise ValueError("no displacement found: are the keys distinct?")
            free[at] = False
            self.shift[b] = d
            for i, s in zip(members[b], at, strict=True):
                self.slots[s] = i
        for b, s in zip(alone, np.flatnonzero(free).tolist(), strict=True):
            self.shift[b] = -s - 1  # a bucket of one names its slot
            self.slots[s] = members[b][0]

    def _slot(self, h: int, d: int) -> int:
        if d < 0:
            return -d - 1
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        return ((x * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 31) % self.n

    def find(self, key: bytes) -> int:
        """The index that key would have; the caller compares."""
        h = xxhash.xxh64_intdigest(key, 1)
        return self.slots[self._slot(h, self.shift[h % self.buckets])]


def merge(piece: bytes, rank: Callable[[bytes], int | None]) -> list[int]:
    """The ids of a piece: the adjacent pair of least rank, the leftmost of equals, is merged until none has a rank."""
    n = len(piece)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    own: list[int | None] = [rank(piece[i : i + 2]) if i + 1 < n else None for i in range(n)]
    heap = [r * n + i for i, r in enumerate(own) if r is not None]
    heapify(heap)
    while heap:
        r, i = divmod(heappop(heap), n)
        if own[i] != r:
            continue
        j = after[i]
        k = after[j]
        after[i] = k
        own[j] = None
        if k < n:
            before[k] = i
            own[i] = x = rank(piece[i : after[k]])
            if x is not None:
                heappush(heap, x * n + i)
        else:
            own[i] = None
        p = before[i]
        if p >= 0:
            own[p] = x = rank(piece[p:k])
            if x is not None:
                heappush(heap, x * n + p)
    out, i = [], 0
    while i < n:
        out.append(rank(piece[i : after[i]]))
        i = after[i]
    return out


class Codec:
    """Encodes and decodes by a list of tokens whose index is id and rank. Picklable: rebuilt from the tokens."""

    def __init__(self, tokens: list[bytes], pattern: str, memory: int = MEMORY):
        self.tokens, self.pattern, self.memory = tokens, pattern, memory
        present = [i for i, t in enumerate(tokens) if t]
        self.present = present
        self.whole = PerfectHash([tokens[i] for i in present])
        self.ready = False

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("tokens", "pattern", "memory", "present", "whole")} | {"ready": False}

    def _prepare(self) -> None:
        tokens, present, whole, most = self.tokens, self.present, self.whole, self.memory
        rank = {tokens[i]: i for i in present}.get

        old: dict[str, bytes] = {}

        class Memory(dict):
            def __missing__(self, word: str) -> bytes:
                packed = old.get(word)
                if packed is None:
                    raw = word.encode()
                    i = present[whole.find(raw)]
                    ids = [i] if tokens[i] == raw else merge(raw, rank)
                    packed = np.array(ids, "<i4").tobytes()
                if len(self) >= most:
                    old.clear()
                    old.update(self)
                    self.clear()
                self[word] = packed
                return packed

        self.split = regex.compile(self.pattern).findall
        self.packed = Memory().__getitem__
        self.ready = True

    def encode(self, text: str) -> np.ndarray:
        if not self.ready:
            self._prepare()
        return np.frombuffer(b"".join(map(self.packed, self.split(text))), "<i4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_CODEC: dict[int, Codec] = {}  # a worker keeps its last codec between tasks


def encode_decode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
    then: Callable[[list, list[np.ndarray], list[bytes]], pa.RecordBatch] | None = None, schema: str | None = None, memory: int = MEMORY,
) -> DataFrame:
    """(id, ids array<int>, decoded binary) of every row: the ids of the whole text, and the bytes they decode to.

    Each match of pattern is encoded by itself, by the ranks of the file at path, without special tokens. The file is read
    on the driver; its tokens, a few hundred kB whatever the input, are broadcast. A null text counts as empty: no ids.
    Repeated rows, null ids and other columns do no harm; an empty table gives an empty one. Nothing is shuffled.
    `memory` is the number of pre-tokens that a worker remembers in each of two generations; it changes speed only.
    `then` turns lists of ids of rows, token ids and decoded bytes into a batch of `schema`, in the same pass.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Codec(read_ranks(path), pattern, memory))
    kind = docs.schema[id_col].dataType
    key = shared._jbroadcast.id()

    def plain(keys: list, ids: list[np.ndarray], raw: list[bytes]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        values = pa.array(np.concatenate([*ids, np.zeros(0, "<i4")]), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(raw, pa.binary())], ["id", "ids", "decoded"])

    out = then or plain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _CODEC:
            _CODEC.clear()
            _CODEC[key] = shared.value
        codec = _CODEC[key]
        keys, ids, raw, size = [], [], [], 0
        for b in batches:
            for k, t in zip(b.column(0), b.column(1), strict=True):
                keys.append(k.as_py())
                ids.append(codec.encode(t.as_py() or ""))
                raw.append(codec.decode(ids[-1]))
                size += len(raw[-1])
                if size >= BATCH_BYTES:
                    yield out(keys, ids, raw)
                    keys, ids, raw, size = [], [], [], 0
        if keys:
            yield out(keys, ids, raw)

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, schema or f"id {kind.simpleString()}, ids array<int>, decoded binary")
