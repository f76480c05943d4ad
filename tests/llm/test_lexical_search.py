"""Lexical search against scores of every document, and what the bounds prune."""

import math
from collections import Counter

import numpy as np
import pytest

from twinlens.llm import lexical_search as ls
from twinlens.llm.oracles import ORACLES


def brute(docs, items, k=20):
    """docs: (id, text); items: (id, text), in row order."""
    bags = [(i, ls.terms((t or "").encode())) for i, t in docs]
    bags = [(i, w, Counter(w)) for i, w in bags if w]
    total_docs, total_terms = len(bags), sum(len(w) for _, w, _ in bags)
    df = Counter(t for _, _, bag in bags for t in bag)
    out = []
    for item, text in items:
        query = Counter(t for t in ls.terms((text or "").encode()) if t in df)
        scores = []
        for i, w, bag in bags:
            m = 75 + 25 * len(w) * total_docs // total_terms
            s = sum(q * math.floor(1000 * math.log((2 * total_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * bag[t] // (1000 * bag[t] + 12 * m))
                    for t, q in query.items() if t in bag)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def items_frame(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def result(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (str(r[0]), r[1], r[2] is None, r[2] or 0))


def same(got, want):
    assert got == sorted(want, key=lambda r: (str(r[0]), r[1], r[2] is None, r[2] or 0))


@pytest.mark.parametrize("bucket", [16_384, 7])
def test_random_texts(spark, docs_of, monkeypatch, bucket):
    rng = np.random.default_rng(bucket)
    monkeypatch.setattr(ls, "BUCKET", bucket)
    p = 1 / np.arange(1, 301) ** 1.1
    text = lambda n: " ".join(f"w{x}" for x in rng.choice(300, n, p=p / p.sum()))
    docs = [(i, text(int(rng.integers(0, 80)))) for i in range(400)] + [(1000 + i, "W5 w7, w9") for i in range(60)]
    items = [(i, text(int(rng.integers(1, 40)))) for i in range(30)] + [(90, "w5 w7 w9 w5")]
    same(result(ls.search(docs_of(docs), items_frame(spark, items))), brute(docs, items))
    same(result(ls.search(docs_of(docs), items_frame(spark, items), k=3)), brute(docs, items, 3))


def test_items_in_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(ls, "BLOCK_BYTES", 60)
    docs = [(i, f"alpha beta{i % 5} gamma{i % 7} " * (1 + i % 4)) for i in range(100)]
    items = [(i, f"beta{i % 5} gamma{i % 3} alpha") for i in range(12)]
    same(result(ls.search(docs_of(docs), items_frame(spark, items).repartition(3))), brute(docs, items))


def test_bounds_prune_without_loss():
    """A bucket of short vectors is skipped, and of the others few are scored."""
    rng = np.random.default_rng(3)
    size, width = 5000, 400
    first, term, value = [0], [], []
    for _ in range(size):
        t = np.sort(rng.choice(width, 30, replace=False))
        term.append(t)
        value.append(rng.integers(10_000, 400_000, 30))
        first.append(first[-1] + 30)
    term, value, first = np.concatenate(term), np.concatenate(value), np.array(first)
    norm = np.sqrt(np.add.reduceat(value.astype(float) ** 2, first[:-1]))
    weight = rng.integers(100, 9000, width)
    items = ls.Items([0], [{int(t): 1 for t in rng.choice(width, 25, replace=False)}], weight)
    dense = np.zeros(width, dtype=np.int64)
    dense[items.terms[0]] = items.weights[0]
    scores = np.add.reduceat(dense[term] * value, first[:-1])
    best, tally = ls.Best(1, 20, np.array([np.sort(scores)[-20]])), {}
    ls.search_bucket(items, best, np.arange(size), np.zeros(size, dtype=np.int64), norm, first, term, value, tally)
    order = np.lexsort((np.arange(size), -scores))[:20]
    assert best.rows[0][0].tolist() == scores[order].tolist() and best.rows[0][1].tolist() == order.tolist()
    assert tally["scored"] < size / 4
    none = ls.Best(1, 20, np.array([int(items.rest[0][0] * norm.max() * 1.01)]))
    tally = {}
    ls.search_bucket(items, none, np.arange(size), np.zeros(size, dtype=np.int64), norm, first, term, value, tally)
    assert tally == {}


def test_third_of_all_rows_are_copies(spark, docs_of):
    docs = [(i, "the same old text of a copy" if i % 3 == 0 else f"text number{i} of the row") for i in range(900, 0, -1)]
    items = [(1, "same copy"), (2, "the text"), (3, "number7 row")]
    same(result(ls.search(docs_of(docs), items_frame(spark, items))), brute(docs, items))


def test_query_equals_its_sql(spark):
    import duckdb

    from twinlens.llm.queries import op12_lexical_search
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute("SELECT item_id, rank, doc_id, score FROM (" + ORACLES["op12_lexical_search"] + ") _q").fetchall()
    got = op12_lexical_search(spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and len(want) > 100
    assert result(got) == sorted(want, key=lambda r: (str(r[0]), r[1], r[2] is None, r[2] or 0))


def test_odd_rows(spark, docs_of):
    docs = [(1, None), (2, ""), (3, "...  \x00 --"), (None, "Café au lait"), (None, "cafÉ au Lait"), (4, "café AU lait"), (4, "café AU lait"),
            (5, "a1-b2_c3 " * 50_000), (6, "日本 語"), (-7, "x" * 200_000 + " lait")]
    items = [(1, "café"), (2, "LAIT lait"), (3, None), (4, ""), (None, "日本"), (6, "nothing here"), (6, "b2 c3 a1"), (1, "x" * 200_000)]
    want = brute(docs, items)
    got = result(ls.search(docs_of(docs), items_frame(spark, items).coalesce(1)))
    same(got, want)
    clash = docs_of(docs).withColumnsRenamed({"lang": "norm", "source": "term", "n_chars": "n"})
    same(result(ls.search(clash, items_frame(spark, items).selectExpr("*", "1 key", "2 rank").coalesce(1))), want)
    assert ls.search(docs_of([]), items_frame(spark, items)).collect() == []
    assert ls.search(docs_of(docs), items_frame(spark, [])).collect() == []
