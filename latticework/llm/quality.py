"""Quality classifier: a byte-level convolutional network in numpy over overlapping chunks of the whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fit takes at most TRAIN_ROWS labelled rows, chosen by a hash of the id, of at most TRAIN_BYTES bytes each.
TRAIN_ROWS = 4000
TRAIN_BYTES = 32_768
EPOCHS = 8


class ByteConvNet:
    """Embedded bytes; FILTERS over windows of STEP * TAPS bytes, one every STEP bytes; ReLU; the maximum over each chunk of two
    successive blocks of BLOCK windows, so that chunks overlap by half; HIDDEN units over a chunk's maxima; ReLU; the maximum
    over all chunks. Both maxima over the whole text, of the filters and of the units, give one probability.

    All weights are learned. The last chunk ends with the text's last window; a text that is shorter than a chunk is padded
    with zero bytes. Long texts go through in pieces of whole blocks: the result does not depend on their size.
    """

    DIM, STEP, TAPS, FILTERS, BLOCK, HIDDEN, PIECE = 8, 2, 4, 48, 16, 24, 1 << 10

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f, h, span = self.FILTERS, self.HIDDEN, self.STEP * self.DIM
        self.emb = (rng.standard_normal((256, self.DIM)) * 0.5).astype(np.float32)
        self.emb[0] = 0
        self.kernel = (rng.standard_normal((span, self.TAPS * f)) / np.sqrt(span * self.TAPS / 2)).astype(np.float32)
        self.bias = np.zeros(f, np.float32)
        self.mix = (rng.standard_normal((f, h)) / np.sqrt(f)).astype(np.float32)
        self.mix_bias = np.zeros(h, np.float32)
        self.out = (rng.standard_normal(f + h) * 0.1).astype(np.float32)
        self.base = np.zeros(1, np.float32)

    def _steps(self, raw: bytes) -> np.ndarray:
        """(step, byte) of the text, with zero bytes so that every byte is in a window and there is a whole chunk."""
        n = max(-(-len(raw) // self.STEP), 2 * self.BLOCK) + self.TAPS - 1
        b = np.zeros(n * self.STEP, np.uint8)
        b[: len(raw)] = np.frombuffer(raw, np.uint8)
        return b.reshape(n, self.STEP)

    def _responses(self, steps: np.ndarray) -> np.ndarray:
        x = self.emb[steps].reshape(len(steps), -1) @ self.kernel
        f, n = self.FILTERS, len(x) - self.TAPS + 1
        y = x[:n, :f].copy()
        for j in range(1, self.TAPS):
            y += x[j : j + n, j * f : (j + 1) * f]
        return y

    def _chunks(self, y: np.ndarray, last: bool) -> np.ndarray:
        """The filters' maxima over each chunk of responses that start with a block; the last piece has one more, at its end."""
        k = self.BLOCK
        blocks = y[: len(y) // k * k].reshape(-1, k, self.FILTERS).max(axis=1)
        chunks = np.maximum(blocks[:-1], blocks[1:])
        return np.concatenate([chunks, y[-2 * k :].max(axis=0)[None]]) if last else chunks

    def pooled(self, raw: bytes) -> np.ndarray:
        """The maxima over the whole text, before the bias and ReLU of the filters and after those of the units."""
        steps, size, tail = self._steps(raw), self.PIECE * self.BLOCK, self.TAPS - 1
        windows = len(steps) - tail
        top, best = np.full(self.FILTERS, -np.inf, np.float32), np.zeros(self.HIDDEN, np.float32)
        for at in range(0, windows, size):
            # a piece and the block after it, with which its last chunk ends; a short rest goes with the piece before
            end = windows if windows - at < size + 2 * self.BLOCK else at + size + self.BLOCK
            c = self._chunks(self._responses(steps[at : end + tail]), end == windows)
            np.maximum(top, c.max(axis=0), out=top)
            np.maximum(best, (np.maximum(c + self.bias, 0) @ self.mix + self.mix_bias).max(axis=0), out=best)
            if end == windows:
                break
        return np.concatenate([np.maximum(top + self.bias, 0), best])

    def score(self, raw: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.pooled(raw) @ self.out + self.base[0], -30, 30))))

    def _gradients(self, steps: np.ndarray, label: float, weight: float, grads: list[np.ndarray]) -> None:
        """Adds the gradients of the log loss of one text; that of a maximum goes to where it was taken."""
        f, k = self.FILTERS, self.BLOCK
        y = self._responses(steps)
        c = self._chunks(y, True)
        first = np.append(np.arange(len(c) - 1) * k, len(y) - 2 * k)
        act = np.maximum(c + self.bias, 0)
        units = act @ self.mix + self.mix_bias
        where, top = units.argmax(axis=0), act.argmax(axis=0)
        hidden, direct = np.maximum(units[where, np.arange(self.HIDDEN)], 0), act[top, np.arange(f)]
        z = 1 / (1 + np.exp(-np.clip(np.concatenate([direct, hidden]) @ self.out + self.base[0], -30, 30)))
        d = (z - label) * weight
        grads[5] += d * np.concatenate([direct, hidden])
        grads[6] += d
        dh = d * self.out[f:] * (hidden > 0)
        grads[4] += dh
        grads[3] += act[where].T * dh
        # what reaches the filters: (chunk, filter, gradient) from the units and from the maxima over the text
        chunk = np.concatenate([np.repeat(where, f), top])
        which = np.concatenate([np.tile(np.arange(f), self.HIDDEN), np.arange(f)])
        g = np.concatenate([(self.mix * dh).T.ravel(), d * self.out[:f]])
        live = np.flatnonzero((g != 0) & (act[chunk, which] > 0))
        chunk, which, g = chunk[live], which[live], g[live].astype(np.float32)
        key, same = np.unique(chunk * f + which, return_inverse=True)
        g, chunk, which = np.bincount(same, g, len(key)).astype(np.float32), key // f, key % f
        at = first[chunk] + y[first[chunk][:, None] + np.arange(2 * k), which[:, None]].argmax(axis=1)
        grads[2] += np.bincount(which, g, f)
        share = np.zeros((f, len(at)), np.float32)
        share[which, np.arange(len(at))] = g
        for j in range(self.TAPS):
            seen = steps[at + j]
            grads[1][:, j * f : (j + 1) * f] += (share @ self.emb[seen].reshape(len(at), -1)).T
            back = (self.kernel[:, j * f : (j + 1) * f].T[which] * g[:, None]).reshape(-1, self.DIM)
            for q in range(self.DIM):
                grads[0][:, q] += np.bincount(seen.ravel(), back[:, q], 256)

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = 11) -> ByteConvNet:
        """Adam on the log loss, classes weighted equally."""
        rng = np.random.default_rng(seed)
        params = [self.emb, self.kernel, self.bias, self.mix, self.mix_bias, self.out, self.base]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        share = np.clip(labels.mean(), 0.02, 0.98) if len(labels) else 0.5
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        steps = [self._steps(x) for x in texts]
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            step = rate * (1 - epoch / epochs)
            for lo in range(0, len(order), batch):
                grads = [np.zeros_like(p) for p in params]
                for i in order[lo : lo + batch]:
                    self._gradients(steps[i], labels[i], weight[i] / batch, grads)
                grads[0][0] = 0
                t += 1
                for k, (p, g) in enumerate(zip(params, grads, strict=True)):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p -= step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return self


def fit_quality(
    docs: DataFrame, labels: DataFrame, allowed: Column, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> ByteConvNet:
    """A network fitted on a bounded sample: at most `rows` labelled documents that `allowed` (over the id) admits, of at
    most `size` bytes each. Null labels and null ids are left out; a document labelled twice takes the smaller label; of rows
    that repeat an id one teaches, the least text."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & allowed).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    sample = (
        docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_raw"))
        .filter(F.octet_length("_raw") <= size)
        .join(F.broadcast(chosen), "_id")
        .groupBy("_id", "_y")
        .agg(F.min("_raw").alias("_raw"))
        .collect()
    )
    sample.sort(key=lambda r: r["_id"])
    return ByteConvNet().fit([bytes(r["_raw"]) for r in sample], np.array([float(r["_y"] > 0) for r in sample], np.float32))


def score_quality(docs: DataFrame, net: ByteConvNet, text_col: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns `keep` of docs (all by default) and a score of that name (0 to 1, higher is better; replaces a column of
    the same name), over whole texts.

    A null text counts as empty; very long ones go through in pieces. Repeated rows and null ids are scored like any other; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    names = [c for c in (docs.columns if keep is None else keep) if c != name]
    raw = "raw" + "_" * max((len(c) for c in names), default=0)  # longer than any other name
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)
    slim = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias(raw))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            scores = [model.score(t.as_py()) for t in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(scores, pa.float64())], [*names, name])

    return slim.mapInArrow(run, ", ".join(x for x in (schema, f"`{name}` double") if x))
