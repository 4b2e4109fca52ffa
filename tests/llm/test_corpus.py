"""Decontamination, sharding and the pipeline."""

import hashlib
import threading

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from latticework.llm import bpe
from latticework.llm.common import crc_mod, shared_dir
from latticework.llm.decontaminate import find_leaks, lcs_length, words
from latticework.llm.quality import fit_quality
from latticework.llm.queries import QUERIES
from latticework.llm.sharding import CommitConflict, ShardStore
from tests.llm.test_dedup import similarity

SF = "/root/testdata/sf0.001"


def held(docs, items):
    """Pairs of a document and an item that it holds word by word."""
    flat = lambda t: b" " + b" ".join(words(t)) + b" "
    return {(d, i) for d, t in docs for i, x in items if words(x) and flat(x) in flat(t)}


def test_leaks_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op7_decontaminate"](spark, SF).collect()}
    assert held(docs, items) <= got
    assert len(got - held(docs, items)) <= 1


def test_paraphrases_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, text(30) + ". " + text(6) + ".") for k in range(20)] + [(20, None), (21, "..."), (22, "one two")]
    docs = [(i, text(200)) for i in range(100)]

    def changed(x, share):
        w = x.split()
        for k in range(len(w) - 6):
            if rng.random() < share:
                w[k] = str(rng.choice(vocabulary))
        return " ".join(w)

    for k in range(20):
        docs.append((1000 + k, text(300) + " " + changed(items[k][1], 0.15) + " " + text(40)))
    docs += [(2000, None), (2001, ""), (2002, "so one TWO three"), (2003, "one. three two"), (None, items[3][1]), (1000, items[5][1]), (2004, "w " * 50_000 + items[7][1])]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, cosine string, _k int")
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, lcs string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(df, bench).collect()}
    want = {(1000 + k, k) for k in range(20)} | {(2002, 22), (None, 3), (1000, 5), (2004, 7)}
    assert got == want
    assert find_leaks(df.limit(0), bench).count() == find_leaks(df, bench.limit(0)).count() == 0


def test_lcs():
    def plain(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return t[-1, -1]

    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 20)).tolist(), rng.integers(0, 5, rng.integers(0, 30)).tolist()
        masks = {}
        for k, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << k
        assert lcs_length(masks, len(a), b) == plain(a, b)


def test_store(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    store = ShardStore(spark, shared_dir(spark), target_bytes=300_000)
    with pytest.raises(ValueError):
        store.read()
    assert store.version() == 0 and store.append(docs, 50) == 1
    small = store.manifest().collect()
    assert len(small) >= 20 and sum(r["rows"] for r in small) == 1000
    last = store.compact()
    assert last > 1 and store.manifest().count() < len(small)
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    assert rows(store.read()) == rows(docs) == rows(store.read(1))
    assert max(r["bytes"] for r in store.manifest().collect()) < 3 * 300_000
    assert store.compact() == last
    late = ShardStore(spark, store.root, target_bytes=300_000)
    more = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)], docs.schema)
    assert late.append(more) == last + 1 and store.read().count() == 1002
    with pytest.raises(CommitConflict):
        store._commit(store.manifest().first()["path"].split("/")[1], [small[0]["path"]])
    assert store.vacuum() > 0 and store.read().count() == 1002


def test_store_of_nothing_and_of_odd_columns(spark):
    none = spark.createDataFrame([], "doc_id long, text string, _shard string")
    store = ShardStore(spark, shared_dir(spark))
    store.append(none)
    assert store.compact() == 1 and store.read().count() == 0 and store.read().columns == ["doc_id", "text", "_shard"]
    got = QUERIES["op8_sharding"](spark, SF)
    want = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(want) and all(r["text_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest() for r in rows)


def test_versions_race(spark):
    root = shared_dir(spark)
    a, b = ShardStore(spark, root), ShardStore(spark, root)
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    a.append(df)
    real, calls = b.version, []
    b.version = lambda: 0 if not calls and not calls.append(1) else real()  # a reader that saw an old version
    assert b.append(df) == 2 and a.read().count() == 2


def test_runs_are_bounded_and_two_merges_at_once_lose_nothing(spark):
    root = shared_dir(spark)
    a = ShardStore(spark, root, target_bytes=1 << 20, merge_bytes=1)  # the least runs: fan_in shards
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")).repartition(9)
    a.append(df)
    a.append(df.select(F.col("doc_id") + 400, F.lit(None).cast("string")).toDF("doc_id", "text").repartition(8))
    first = a._run(a.version())
    assert len(first) == a.fan_in and {p for p, _ in first} <= {r["path"] for r in a.manifest().filter("added = 1").collect()}
    runs, failed = [], []

    def merge(store):
        try:
            runs.append(store.compact())
        except CommitConflict as e:
            failed.append(e)

    threads = [threading.Thread(target=merge, args=(ShardStore(spark, root, target_bytes=1 << 20, merge_bytes=1),)) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert runs and len(runs) + len(failed) == 2
    late = ShardStore(spark, root, target_bytes=1 << 20, merge_bytes=1)
    last = late.compact()
    assert last == late.compact() and late.manifest().count() < 17
    for version in (2, last):
        rows = late.read(version).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(800)) and sum(r["text"] is None for r in rows) == 400


def test_pipeline(spark):
    import corpus_pipeline

    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    net = fit_quality(table, spark.read.parquet(f"{SF}/labels.parquet"), crc_mod(F.col("doc_id"), 3) != 1)
    docs = {i: t for i, t in docs.items() if net.score(t.encode()) >= 0.5}
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    of = {}
    for i, t in docs.items():
        for ln in t.split("\n"):
            if len(key(ln)) >= 40:
                of.setdefault(key(ln), set()).add(i)
    keep = {k: max(v) for k, v in of.items() if len(v) >= 5}
    docs = {i: "\n".join(ln for ln in t.split("\n") if keep.get(key(ln), i) == i) for i, t in docs.items()}
    first = {}
    for i in sorted(docs):
        first.setdefault(docs[i], i)
    docs = {i: t for t, i in first.items()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {i: t for i, t in docs.items() if i not in {d for d, _ in held(list(docs.items()), items)}}
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))) if t}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) <= set(docs)
    for i in set(docs) - set(got):  # copies that are similar, not equal
        assert any(j < i and similarity(t, docs[i]) >= 0.8 for j, t in docs.items())
    assert all(r["ids"] == library.encode_ordinary(docs[i]) for i, r in got.items())


def test_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("s")).withColumn("_id", F.lit(1))
    for odd in (docs.limit(0), docs.limit(30).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long")))):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, odd, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= odd.count()
        assert corpus_pipeline.STAGES[-1][1](spark, odd, SF).count() == odd.count()


def test_native_operators_plan_no_python(spark):
    from latticework.llm.line_dedup import line_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    store = ShardStore(spark, shared_dir(spark))
    store.append(docs)
    for df in (line_dedup(docs), store.read()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExternalRDD", "ExistingRDD")), plan
    store.compact()
    tables = [store.manifest(), store.manifest(0), store._added(store.manifest().first()["path"].split("/")[1]), store._listed(["a", "b"]), store.read()]
    for df in tables:
        assert not any(x in df._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "ExternalRDD", "ExistingRDD"))
        assert "PythonRDD" not in df._jdf.queryExecution().toRdd().toDebugString()


def test_sweep_deletes_what_was_written(spark):
    from latticework.llm.common import stored, sweep

    sweep(spark)
    t = stored(spark.range(3))
    assert t.count() == 3 and sweep(spark) == 1 and sweep(spark) == 0


def test_an_item_in_a_third_of_the_rows_is_found(spark):
    rng = np.random.default_rng(12)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(2000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, text(30)) for k in range(60)]
    docs = [(i, f"{text(90)} {items[0][1] if i % 3 == 0 else text(30)} {text(90)}") for i in range(600)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(df, bench).collect()}
    assert got == {(i, 0) for i in range(0, 600, 3)}


def test_long_items_are_found(spark):
    rng = np.random.default_rng(13)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(5000)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [(k, text(n)) for k, n in enumerate([100] * 5 + [500] * 5)]
    docs = [(i, text(300)) for i in range(60)]

    def changed(x):  # no run of 13 words is left
        w = x.split()
        w[4::7] = rng.choice(vocabulary, len(w[4::7])).tolist()
        return " ".join(w)

    for k, x in items:
        docs += [(100 + k, f"{text(150)} {x} {text(150)}"), (200 + k, f"{text(150)} {changed(x)} {text(150)}"), (300 + k, f"{text(150)} {' '.join(x.split()[20:40])} {text(150)}")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(100 * j + k, k) for j in (1, 2, 3) for k, _ in items}
    for block in (256, 3):  # one block, and several over the hashes of words
        assert {(r["doc_id"], r["item_id"]) for r in find_leaks(df, bench, block=block).collect()} == want
