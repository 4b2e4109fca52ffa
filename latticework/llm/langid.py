"""Language identification: the family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fit takes about TRAIN_PER_LANG documents a language, twice that at most, of at most TRAIN_BYTES bytes each.
TRAIN_PER_LANG = 1200
TRAIN_BYTES = 16_384
#: Languages that are learned: the most frequent ones.
MOST_LANGS = 200
DIM = 2048
EPOCHS = 6

#: Families of common languages; a language that is not listed forms a family by itself.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "hr", "sr"),
    "finnic": ("fi", "et"),
    "sinitic": ("zh", "yue"),
}

# ASCII that is no letter becomes a space; bytes of other characters stay
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def features(text: str) -> np.ndarray:
    """Hashed counts of 1 to 3 successive bytes of the whole lower-cased text, as square roots, of norm 1."""
    b = np.frombuffer(b" " + text.lower().encode().translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:]
    total = np.zeros(DIM)
    for k, grams in enumerate((b, two, three)):
        total += np.bincount(((grams + np.uint32(k * 7919)) * np.uint32(2654435761)) >> np.uint32(21), minlength=DIM)
    x = np.sqrt(total)
    return (x / np.linalg.norm(x)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit_svm(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, reg: float = 1e-4, seed: int = 3) -> tuple[np.ndarray, float, float]:
    """Weights, bias and scale of a linear support vector machine for y of -1 and 1 (stochastic subgradient, averaged)."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    mean_w, mean_b, t = np.zeros_like(w), 0.0, 0
    share = np.clip((y > 0).mean(), 0.01, 0.99)
    for epoch in range(epochs):
        for i in rng.permutation(len(x)):
            t += 1
            step = 1 / (reg * (t + 1 / reg / 5))
            w *= 1 - step * reg
            if y[i] * (x[i] @ w + b) < 1:
                weight = step * (0.5 / share if y[i] > 0 else 0.5 / (1 - share))
                w += weight * y[i] * x[i]
                b += 0.1 * weight * y[i]
            if epoch:
                mean_w += w
                mean_b += b
    n = max(1, t - len(x))
    w, b = mean_w / n, mean_b / n
    spread = np.abs(x @ w + b).mean() if len(x) else 1.0
    return w, b, 4 / max(float(spread), 1e-6)


class LanguageModel:
    """Machines one versus one between families, and one versus one between the languages of each family."""

    def __init__(self, texts: list[str], langs: list[str]):
        family = {lang: name for name, members in FAMILIES.items() for lang in members}
        known = sorted(set(langs))
        self.families: dict[str, list[str]] = {}
        for lang in known:
            self.families.setdefault(family.get(lang, lang), []).append(lang)
        x = np.stack([features(t) for t in texts]) if texts else np.zeros((0, DIM), np.float32)
        lang = np.array(langs, object)
        of = np.array([family.get(v, v) for v in langs], object)
        self.top = self._fit(x, of, sorted(self.families))
        self.within = {f: self._fit(x[of == f], lang[of == f], members) for f, members in self.families.items()}

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, names: list[str]):
        pairs = list(combinations(range(len(names)), 2))
        rows = [fit_svm(x[(m := (y == names[i]) | (y == names[j]))], np.where(y[m] == names[i], 1.0, -1.0)) for i, j in pairs]
        w = np.stack([r[0] for r in rows]) if rows else np.zeros((0, DIM), np.float32)
        return names, pairs, w, np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    @staticmethod
    def _vote(x: np.ndarray, machine) -> tuple[str, float]:
        names, pairs, w, b, scale = machine
        if len(names) == 1:
            return names[0], 1.0
        margin = w @ x + b
        p = 1 / (1 + np.exp(-np.clip(margin * scale, -30, 30)))
        won, belief = np.zeros(len(names)), np.zeros(len(names))
        for (i, j), q in zip(pairs, p, strict=True):
            won[i if q >= 0.5 else j] += 1
            belief[i] += q
            belief[j] += 1 - q
        best = max(range(len(names)), key=lambda k: (won[k], belief[k], -k))
        return names[best], float(belief[best] / (len(names) - 1))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not has_letter(text):
            return "und", 0.0
        x = features(text)
        family, p = self._vote(x, self.top)
        lang, q = self._vote(x, self.within[family])
        return lang, p * q


def fit_languages(
    docs: DataFrame, allowed: Column, per_lang: int = TRAIN_PER_LANG, size: int = TRAIN_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> LanguageModel:
    """A model of the MOST_LANGS most frequent languages of docs, fitted on a bounded sample of the rows that `allowed` admits;
    rows without a language, an id or a letter teach nothing. Rows are chosen by a hash of the id, at a rate for each language that follows its number of ids;
    of rows that repeat an id and a language one teaches, the least text. The sample is cut before it is collected."""
    rows = docs.filter(allowed).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    rows = rows.filter(F.col("_lang").isNotNull() & F.col("_id").isNotNull() & (F.octet_length("_text") <= size))
    top = rows.groupBy("_lang").agg(F.approx_count_distinct("_id").alias("n")).orderBy(F.desc("n"), "_lang").limit(MOST_LANGS).collect()
    counts = {r["_lang"]: r["n"] for r in top}
    if not counts:
        return LanguageModel([], [])
    draw, out_of = F.pmod(F.xxhash64(F.lit(5), F.col("_id")), F.lit(1_000_000)), 1_000_000
    rate = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(out_of, -(-per_lang * out_of // n)))])
    drawn = rows.filter(draw < F.element_at(rate, F.col("_lang"))).groupBy("_id", "_lang").agg(F.min("_text").alias("_text"))
    sample = sorted(drawn.limit(2 * per_lang * len(counts)).collect(), key=lambda r: (r["_id"], r["_lang"]))
    taken: dict[str, int] = {}
    kept = []
    for r in sample:
        taken[r["_lang"]] = taken.get(r["_lang"], 0) + 1
        if taken[r["_lang"]] <= 2 * per_lang and has_letter(r["_text"]):
            kept.append(r)
    return LanguageModel([r["_text"] for r in kept], [r["_lang"] for r in kept])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, from its whole text alone.

    A null text and a text without a letter get `und` and 0, and so does every text where nothing was learned. Repeated
    rows and null ids are treated like any other; other columns are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM floats for each pair of languages of a family
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for b in batches:
            found = [predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [id_col, "lang_pred", "score"]
            )

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
