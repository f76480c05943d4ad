"""Toxicity: exact neighbours against brute force, held-out accuracy, odd rows."""

import zlib

import numpy as np

from pyspark.sql import functions as F

from twinlens.llm import toxicity

LABELS = "doc_id long, toxic int"


def test_nearest_is_exact():
    rng = np.random.default_rng(2)
    index = toxicity.Index(np.arange(40, dtype=np.uint64), rng.uniform(0.5, 3, 40), 0.1)
    rows = []
    for i in range(500):
        t = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        rows.append((i, int(rng.integers(2)), 1.0, t, rng.integers(1, 4, len(t))))
    index.build(rows)
    dense = np.zeros((500, 40))
    place = {int(d): k for k, d in enumerate(index.ids)}
    for i, _, _, t, u in rows:
        dense[place[i], t] = index.vector(t, u)
    for _ in range(50):
        t = np.sort(rng.choice(40, 4, replace=False))
        q = np.zeros(40)
        q[t] = index.vector(t, np.ones(4))
        who, cosine = index.nearest(t, q[t])
        want = np.sort(dense @ q)[::-1][:toxicity.NEIGHBOURS]
        assert np.allclose(cosine, want[want > 0])
        assert np.allclose(dense[who] @ q, cosine)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1/"
    docs, labels = spark.read.parquet(d + "documents.parquet"), spark.read.parquet(d + "labels.parquet")
    index = toxicity.fit(docs, labels)
    got = toxicity.score(docs.where("lang = 'en'").select("doc_id", "text"), index).join(labels, "doc_id").where(
        toxicity.fold_of(F.col("doc_id")) == toxicity.HELD_OUT).select("score", "predicted", "toxic", "evidence").collect()
    toxic, clean = [r for r in got if r["toxic"]], [r for r in got if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) > 0.85 * len(toxic)
    assert sum(r["predicted"] for r in clean) < 0.02 * len(clean)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["evidence"][0]["cosine"] >= r["evidence"][-1]["cosine"] > 0 for r in toxic if r["evidence"])


def test_rare_words_and_copies(docs_of, spark):
    # a toxic word of 3 texts in 1,000 toxic rows, 900 of which are copies of one text
    rng, rows = np.random.default_rng(5), []
    words = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 400, n))
    texts = ["copied filth again"] * 900 + [words(20) + " vileword" for _ in range(97)] + [words(20) + " rareslur" for _ in range(3)]
    train = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % toxicity.FOLDS != toxicity.HELD_OUT]
    texts += [words(20) for _ in range(5000)]
    rows = list(zip(train, texts))
    labels = spark.createDataFrame([(i, int(k < 1000)) for k, (i, _) in enumerate(rows)], LABELS)
    index = toxicity.fit(docs_of(rows), labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs_of(
        [(1, words(20) + " rareslur"), (2, words(20)), (3, words(20) + " vileword")]), index).collect()}
    assert got == {1: 1, 2: 0, 3: 1}


def test_odd_rows(docs_of, spark):
    words = [f"w{k}" for k in range(50)]
    rows = [(i, " ".join(words[(i * j) % 50] for j in range(30)) + (" vileword" if i % 3 == 0 else "")) for i in range(150)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] + [(None, 1), (7, None), (0, 0), (9999, 1)], LABELS)
    index = toxicity.fit(docs_of(rows), labels)
    odd = [(1, None), (2, ""), (None, "vileword"), (4, "VILEWORD x"), (4, "VILEWORD x"), (5, "clean words here"), (6, "a " * 50_000 + "vileword")]
    d = docs_of(odd).withColumnsRenamed({"lang": "score", "source": "__x", "n_chars": "predicted"})
    out = toxicity.score(d, index)
    got = {(r["doc_id"], r["predicted"]) for r in out.collect()}
    assert got == {(1, 0), (2, 0), (None, 1), (4, 1), (5, 0), (6, 1)} and out.count() == len(odd)
    kept = toxicity.drop_toxic(d, index)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5]
    assert toxicity.score(docs_of([]), index).collect() == []


def test_nothing_to_learn_from(docs_of, spark):
    docs = docs_of([(1, "a b"), (2, None)])
    for labels in ([], [(1, 0)], [(None, None)]):
        index = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
        got = toxicity.score(docs, index).collect()
        assert len(got) == 2 and all(r["predicted"] == 0 for r in got)
    index = toxicity.fit(docs_of([]), spark.createDataFrame([], LABELS))
    assert index.without == 0.5
