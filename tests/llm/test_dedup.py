"""Exact, line and SimHash dedup against brute force, over nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from latticework.llm import exact_dedup as exact_dedup_module
from latticework.llm import near, simhash
from latticework.llm.common import hot_join
from latticework.llm.exact_dedup import exact_dedup
from latticework.llm.line_dedup import line_dedup
from latticework.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
LONG = "This line is long enough to be counted as one, again and again."
ODD = "doc_id long, text string, _id long, _text string, _len int, n_lines string, score double, component_id int, _fp string"


def odd(spark):
    texts = [None, "", "", "a", "a", "A b c d", "a B c d", f"  {LONG.upper()}\t\nshort\nshort", f"{LONG}\nx", LONG, f"{LONG}\n{LONG}", f"y\n{LONG} ", "word " * 30_000, "word " * 30_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a"), (9, LONG), (None, "a"), (None, None), (None, f"z\n{LONG}")]
    return spark.createDataFrame([(i, t, 7, "t", 1, "n", 0.5, 3, "f") for i, t in rows], ODD)


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op6_line_dedup"])
def test_sql(spark, name):
    compare(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name])


@pytest.mark.parametrize("bound", [2_000_000, 0])
def test_exact_odd(spark, monkeypatch, bound):
    monkeypatch.setattr(exact_dedup_module, "BROADCAST_GROUPS", bound)
    rows = [(r["doc_id"], r["text"] or "") for r in odd(spark).collect()]
    got = exact_dedup(odd(spark), carry={"sha": F.sha2(F.coalesce("text", F.lit("")), 256)}).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
    for r in got:
        ids = groups[r["sha"]]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(ids), r["doc_id"] == keep)


def test_exact_tells_prefixes_and_lengths_apart(spark):
    p = "x" * 100
    df = spark.createDataFrame([(1, p + "a"), (2, p + "b"), (3, p + "a"), (4, p), (5, "é"), (6, "ab")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup(df).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1), 5: (5, 1), 6: (6, 1)}


def test_lines_odd(spark):
    got = line_dedup(odd(spark))
    assert got.columns == [*[c for c in odd(spark).columns if c != "n_lines"], "n_lines", "n_dropped"]
    rows = [(r["doc_id"], r["text"] or "") for r in odd(spark).collect()]
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(strip))
    held = {}
    for i, t in rows:
        for ln in t.split("\n"):
            if len(key(ln)) >= 40:
                held.setdefault(key(ln), set()).add(i)
    keep = {k: max(i for i in v if i is not None) for k, v in held.items() if len(v) >= 5}
    assert len(keep) == 1
    want = sorted((str(i), "\n".join(ln for ln in t.split("\n") if keep.get(key(ln), i) == i)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == want


def test_empty_tables(spark):
    none = odd(spark).limit(0)
    assert exact_dedup(none).count() == line_dedup(none).count() == simhash.simhash_dedup(none).count() == 0


def test_hot_join_is_a_left_join(spark):
    facts = spark.range(5000).select(F.col("id"), F.when(F.col("id") < 2000, 1).when(F.col("id") < 2100, F.lit(None)).otherwise(F.col("id") % 50).alias("k"))
    dims = facts.filter("k is not null and k <> 7").groupBy("k").agg(F.count("*").alias("n"))
    got = hot_join(facts, dims, ["k"], "id", "n", slim=False)
    assert got.count() == 5000 and got.filter("n is null").count() == facts.filter("k is null or k = 7").count()
    assert hot_join(facts, dims, ["k"], "id", "n", "inner").agg(F.sum("n")).first()[0] == dims.agg(F.sum(F.col("n") * F.col("n"))).first()[0]


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, tau=2):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= tau):
            x, y = find(i), find(i + 1 + int(j))
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_simhash_odd(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd(spark).collect()]
    got = simhash.simhash_dedup(odd(spark)).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(prints)
    least = {c: min((rows[k][0] for k, x in enumerate(roots) if x == c and rows[k][0] is not None), default=None) for c in roots}
    want = sorted((str(i), f, str(least[c])) for (i, _), f, c in zip(rows, prints, roots, strict=True))
    assert sorted((str(r["doc_id"]), r["fp"] % (1 << 64), str(r["component_id"])) for r in got) == want


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = [brute_fingerprint(r["text"]) for r in docs]
    roots = brute_components(prints)
    ids = [r["doc_id"] for r in docs]
    want = {i: (f"{f:016x}", min(ids[k] for k, x in enumerate(roots) if x == c)) for i, f, c in zip(ids, prints, roots, strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op10_simhash_dedup"](spark, SF).collect()} == want


@pytest.mark.parametrize(("tau", "dense"), [(2, 4), (2, 10**9), (3, 4)])
def test_links_lose_nothing_in_dense_clusters(spark, monkeypatch, tau, dense):
    monkeypatch.setattr(simhash, "FEW_EDGES", 50 if dense == 4 else 16_384)  # rounds of contraction, and one task
    rng = np.random.default_rng(9)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 150)}
    for base in rng.integers(0, 1 << 63, 3):
        for _ in range(150):
            x = int(base)
            for b in rng.choice(64, int(rng.integers(0, 4)), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in prints], "_fp long")
    found = {r["u"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.links(nodes, tau, dense)).collect()}
    roots = brute_components(prints, tau)
    classes = lambda label: {frozenset(i for i, x in enumerate(prints) if label(i, x) == c) for c in {label(i, x) for i, x in enumerate(prints)}}
    assert classes(lambda i, x: found.get(x, x)) == classes(lambda i, x: roots[i])


def test_thresholds_sum_up(spark):
    both = np.diag(np.full(64, 500.0)) + 250 * (1 - np.eye(64))
    for m in range(2, 5):
        groups = simhash.group_bits(1000, both, m)
        assert sorted(b for g in groups for b in g) == list(range(64))
        for n in (10**3, 10**6, 10**9):
            assert sum(simhash.allocate(n, both, groups, 2)[1]) == 2 - m + 1


def similarity(a, b, words=5):
    def parts(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}

    x, y = parts(a), parts(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_duplicates(spark):
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))

    def edited(t, n):
        w = t.split()
        for k in rng.choice(len(w), n, replace=False):
            w[k] = str(rng.choice(vocabulary))
        return " ".join(w)

    docs = [(i, text(300)) for i in range(60)]
    docs += [(100 + i, edited(docs[i][1], 1)) for i in range(30)]  # a similarity of about 0.97
    docs += [(200 + i, docs[i][1]) for i in range(20)]
    docs += [(300 + i, edited(docs[59][1], 1)) for i in range(40)]  # many copies of one
    docs += [(400 + i, " ".join(docs[i][1].split()[:150]) + " " + text(150)) for i in range(20)]  # half the same
    docs += [(500, None), (501, ""), (502, "a b"), (503, "A b"), (None, "a b"), (504, "one two three four five six")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, _rep int, component_id string")
    rows = near.near_duplicates(df).collect()
    assert len(rows) == len(docs)
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert all(got[200 + i] == got[i] == i for i in range(20)) and got[501] == 500 and got[503] == got[None] == 502 and got[504] == 504
    assert sum(got[100 + i] == i for i in range(30)) >= 28 and sum(got[300 + i] == 59 for i in range(40)) >= 37
    assert all(got[400 + i] == 400 + i for i in range(20))
    assert near.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_are_complete(spark):
    rng = np.random.default_rng(14)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(3000)]
    docs = [(i, " ".join(rng.choice(vocabulary, 40 + i * 5))) for i in range(60)]
    for i in range(60):  # edits that leave similarities from 0.7 to 1
        w = docs[i][1].split()
        for k in rng.choice(len(w), int(rng.integers(1, max(2, len(w) // 30))), replace=False):
            w[k] = str(rng.choice(vocabulary))
        docs.append((100 + i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    alike = {100 + i: similarity(docs[i][1], docs[60 + i][1]) for i in range(60)}
    assert sum(0.8 <= x < 0.9 for x in alike.values()) >= 10 and sum(x < 0.8 for x in alike.values()) >= 5
    assert got == {i: i if i < 100 or alike[i] < 0.8 else i - 100 for i in got}


def test_texts_with_equal_fingerprints_are_compared_with_each_other(spark):
    rng = np.random.default_rng(15)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    sentence = " ".join([text(9)] * 60)
    own = text(150).split()
    docs = [(1, f"{sentence} {text(150)}"), (2, f"{sentence} {' '.join(own)}"), (3, f"{sentence} {' '.join([*own[:70], 'other', *own[71:]])}")]
    assert similarity(docs[1][1], docs[2][1]) >= 0.9 > 0.1 > similarity(docs[0][1], docs[1][1])
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 2}


def test_near_duplicates_of_a_large_group_and_of_an_id_with_two_texts(spark, monkeypatch):
    monkeypatch.setattr(near, "MOST_PAIRS", 0)  # rounds of leaders until they settle nothing more
    rng = np.random.default_rng(16)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(2000)]
    base = rng.choice(vocabulary, 150)

    def copy():
        w = base.copy()
        for k in rng.choice(150, 2, replace=False):
            w[k] = rng.choice(vocabulary)
        return " ".join(w)

    docs = [(i, copy()) for i in range(120)] + [(500 + i, " ".join(rng.choice(vocabulary, 80))) for i in range(20)]
    docs += [(500, docs[130][1]), (500, docs[0][1]), (None, docs[1][1])]
    got = sorted((str(r[0]), r[1]) for r in near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(docs):
        for j in range(i):
            if (i < 120 or docs[j][1] == a or i > 139 and j < 120) and similarity(a, docs[j][1]) >= 0.8:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    assert got == sorted((str(k), least[find(i)]) for i, (k, _) in enumerate(docs))


def test_sketches_never_differ_more_than_the_sets():
    rng = np.random.default_rng(17)
    bits = lambda a, b: int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
    for n in (0, 1, 5, 100, 3000):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for m in (0, 3, 40):
            y = np.concatenate([x[m:], rng.integers(0, 1 << 63, m).astype(np.uint64)])
            assert bits(near.sketch(x), near.sketch(y)) <= len(np.setxor1d(x, y))
