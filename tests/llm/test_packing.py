"""Packing: exact round trip, no padding but in a few tails, odd rows."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from twinlens.llm import packing

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def check(df, rows):
    """Pieces tile every document and every sequence."""
    got = packing.pack(df).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(ids_of(t))
    assert set(pieces) == set(want)
    for i, docs in want.items():
        if len(docs) == 1:
            at = 0
            for r in sorted(pieces[i], key=lambda r: r["start"]):
                part = docs[0][at:at + r["length"]]
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(docs[0])
                at += r["length"]
            assert at == len(docs[0])
        else:
            assert sum(r["length"] for r in pieces[i]) == sum(map(len, docs))
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and at & (at - 1) == 0 and at == s[0]["tier"]
    return got


def test_round_trip(small_docs):
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    got = check(small_docs.repartition(3), rows)
    assert len({r["step_group"] for r in got if r["tier"] == 2048}) >= 3


def test_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (None, "x"), (4, "same"), (4, "same"), (5, "<|endoftext|> in <|endoftext|>"),
            (6, "word " * 60_000), (7, "é\x00日本 \n\n\t  x" * 50), (8, "a" * 5000)]
    check(docs_of(rows), rows)
    check(docs_of(rows).withColumnsRenamed({"lang": "start", "n_chars": "length"}).coalesce(1), rows)
    assert packing.pack(docs_of([])).collect() == []


def test_step_groups_cost_alike():
    rng = np.random.default_rng(1)
    p = packing.Packer(0)
    for i in range(3000):
        p.add(i, np.ones(int(rng.integers(1, 1500)), dtype="<u4"))
    p.finish()
    groups, tier = defaultdict(list), {}
    per_sequence = defaultdict(int)
    for r in p.rows:
        per_sequence[r[5]] += r[2] ** 2
        tier[r[5]] = (r[7], r[8])
    for s, c in per_sequence.items():
        groups[tier[s]].append(c)
    full = [sum(c) / len(c) for (t, _), c in groups.items() if t == 2048 and len(c) >= 32]
    assert len(full) > 3 and max(full) < 1.25 * min(full)
