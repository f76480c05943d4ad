"""Periodic runs against a scan of every lag, planted texts against plain code."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from twinlens.llm import periodic_runs as pr


def brute(words, min_length=24, min_repeats=3):
    """Every lag, smallest period of an interval first."""
    seen, out, n = set(), [], len(words)
    for q in range(1, n // min_repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            span = (i, j + q - i)
            if span[1] >= 2 * q and span not in seen:
                seen.add(span)
                if span[1] >= max(min_length, min_repeats * q):
                    out.append((*span, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, spans):
    gone = {i for s, n, p in spans for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def rewritten(doc_id, text):
    words = [w for w in bytes(text or "", "utf8").decode().split(" ") if w] if text else []
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(doc_id, words):
    spans = brute(words)
    best = max(spans, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in spans)
    return (doc_id, len(spans), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, spans).encode()).hexdigest())


def random_words(rng):
    """Runs of random roots between random words over a small alphabet."""
    words = []
    for _ in range(rng.randint(1, 6)):
        alphabet = "abcdefghijkl"[:rng.randint(1, 12)]
        root = [rng.choice(alphabet) for _ in range(rng.randint(1, 14))]
        words += (root * rng.randint(1, 9))[:rng.randint(1, 120)] + [rng.choice(alphabet) for _ in range(rng.randint(0, 9))]
    return words


def test_many_small_texts_at_once():
    rng = random.Random(5)
    texts = [random_words(rng) for _ in range(1500)]
    got = pr.text_runs([" ".join(t).encode() for t in texts])
    assert sum(len(r[1]) for r in got) > 500
    for t, (n, spans, rest) in zip(texts, got, strict=True):
        assert (n, spans, rest.decode()) == (len(t), brute(t), collapsed(t, brute(t)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.integers(1, 14)), max_size=5))
def test_lists_of_powers(parts):
    words = [w for root, k in parts for w in root * k]
    (n, spans, rest), = pr.text_runs([" ".join(words).encode()])
    assert (n, spans, rest.decode()) == (len(words), brute(words), collapsed(words, brute(words)))


def test_other_lengths_and_repeats():
    rng = random.Random(6)
    for _ in range(300):
        words = random_words(rng)
        for length, repeats in ((3, 3), (10, 4), (50, 5)):
            (_, spans, _), = pr.text_runs([" ".join(words).encode()], length, repeats)
            assert spans == brute(words, length, repeats)


def test_splitting_keeps_every_run_and_only_frequent_words():
    rng = random.Random(7)
    for _ in range(300):
        words = random_words(rng)
        number = {w: k for k, w in enumerate(sorted(set(words)))}
        at, seg = pr.survivors(np.array([number[w] for w in words]), np.zeros(len(words), dtype=np.int64), 24, 3)
        assert {i for s, n, _ in brute(words) for i in range(s, s + n)} <= set(at.tolist())
        for k in set(seg.tolist()):
            part = [words[i] for i in at[seg == k]]
            assert len(part) >= 24 and min(part.count(w) for w in part) >= 3


def test_splitting_ended_early_loses_nothing(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(pr, "MAX_ROUNDS", 1)
    for _ in range(300):
        words = random_words(rng)
        (_, spans, _), = pr.text_runs([" ".join(words).encode()])
        assert spans == brute(words)


def test_long_texts_take_no_square_time():
    rng = random.Random(9)
    words = [rng.choice("abcd") for _ in range(300_000)] + ["x", "y"] * 100_000
    root = [rng.choice("abcdefgh") for _ in range(60_000)]
    (n, spans, _), = pr.text_runs([" ".join(words + ["z"] + root * 4).encode()])
    assert n == 740_001 and (300_000, 200_000, 2) in spans and (500_001, 240_000, 60_000) in spans


def test_query_on_whole_documents(spark):
    from twinlens.llm.queries import op13_periodic_runs
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r["doc_id"]: tuple(r) for r in op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    hits = 0
    for r in docs:
        words = [w.decode() for w in " ".join(rewritten(r["doc_id"], " ".join(x.decode() for x in (r["text"] or "").encode().split()))).encode().split()]
        if len(words) <= 2500:
            assert got[r["doc_id"]] == digest(r["doc_id"], words)
            hits += got[r["doc_id"]][1] > 0
    assert hits > 5


def test_planted_texts(spark, docs_of):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 60))) for i in range(600)] + [(None, "a b"), (7, None)]
    got = [(r["doc_id"], r["text"]) for r in pr.planted(docs_of(rows)).collect()]
    for (i, before), (j, after) in zip(rows, got, strict=True):
        assert i == j and (after or "").split() == rewritten(i, before)
    assert sum(a != b for (_, a), (_, b) in zip(rows, got, strict=True)) > 20


def test_odd_rows(spark, docs_of):
    rows = [(1, None), (2, ""), (None, "a " * 30), (4, "x y"), (4, "x y"), (5, "a b " * 12), (6, " \n\t" * 400_000),
            (7, "Ä\x00é 日 " * 9 + "end"), (8, "A a " * 11 + "A A a")]
    got = pr.find(docs_of(rows)).collect()
    assert [(r["n_words"], len(r["runs"])) for r in got] == [(0, 0), (0, 0), (30, 1), (2, 0), (2, 0), (24, 1), (0, 0), (19, 0), (25, 0)]
    assert got[5]["runs"][0].asDict() == {"start": 0, "length": 24, "period": 2} and got[5]["collapsed"] == "a b"
    assert [c for c in pr.find(docs_of(rows)).columns] == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "runs", "collapsed"]
    clash = docs_of(rows).withColumnsRenamed({"lang": "row", "source": "runs", "n_chars": "start"})
    assert [r["collapsed"] for r in pr.find(clash).collect()] == [r["collapsed"] for r in got]
    assert [tuple(r) for r in pr.digest(pr.find(docs_of([(1, None)]))).collect()] == [digest(1, [])]
    assert pr.digest(pr.find(docs_of([]))).collect() == []
