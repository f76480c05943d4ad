"""Sharding: the law of rows, groups together, odd rows."""

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from twinlens.llm import sharding


def check(df, rows, shards=40):
    got = sharding.shard_documents(df, shards=shards).collect()
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got


def spread(got):
    where = defaultdict(Counter)
    for r in got:
        where[r["text_crc32"]][r["shard"]] += 1
    return where


def test_rounds_go_on_until_nothing_moves(docs_of, monkeypatch):
    rounds = []

    def slow(atoms, quota, n_lanes):
        rounds.append(quota)
        return atoms.withColumn("moved", F.lit(len(rounds) < 20))
    monkeypatch.setattr(sharding, "_round", slow)
    rows = [(i, f"text {i % 3}") for i in range(30)]
    check(docs_of(rows), rows, shards=4)
    assert len(rounds) == 20


def test_copies_share_a_shard(small_docs):
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    where = spread(check(small_docs, rows))
    assert all(len(c) == 1 for c in where.values() if 1 < sum(c.values()) <= len(rows) // 40)


def test_a_hot_group_fills_few_shards(docs_of):
    rows = [(i, "hot") for i in range(400)] + [(i, f"pair {i // 2}") for i in range(400, 600)] + [(i, f"own {i}") for i in range(600, 1200)]
    where = spread(check(docs_of(rows), rows))
    hot = where[zlib.crc32(b"hot")]
    # 14 quotas hold it: then a fourteenth of its pairs share a shard, dealt at random a fortieth
    assert sum(n * n for n in hot.values()) >= 0.05 * 400 ** 2
    split = sum(len(where[zlib.crc32(f"pair {i}".encode())]) > 1 for i in range(200, 300))
    assert split <= 10


def test_reruns_agree(small_docs):
    rows = lambda d: sorted(map(str, sharding.shard_documents(d).collect()))
    assert rows(small_docs) == rows(small_docs.repartition(5))


def test_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (None, "x"), (None, "x"), (4, "é" * 50_000), (4, "é" * 50_000), (5, "y")]
    check(docs_of(rows), rows)
    check(docs_of(rows).withColumnsRenamed({"lang": "shard", "source": "g", "n_chars": "label"}), rows, shards=3)
    assert check(docs_of([]), []) == []
