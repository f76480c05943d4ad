"""Mixing: targets by resharing, copies, odd rows."""

import re

import pytest

from twinlens.llm import mixing


def size(t):
    return len([x for x in re.split("[\x20\x09-\x0d]+", t or "") if x])


def targets(sizes, weights=(5, 2, 1)):
    """Share by weight, cap, share the excess again, until nobody is above."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(order)
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return out | {s: level * w[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return out


def check(df, rows):
    got = mixing.plan(df).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["size"] == size(r["text"]) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        rate = want[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        assert int(rate + 1e-9) <= r["copies"] <= int(rate + 1e-9) + 1 and r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    return taken, want, got


def test_sources_come_near_their_targets(small_docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in small_docs.collect()]
    taken, want, got = check(small_docs, rows)
    largest = max(size(t) for _, t, _ in rows)
    assert all(abs(taken[s] - want[s]) <= max(0.1 * want[s], largest) for s in want)
    assert sum(taken.values()) == pytest.approx(sum(want.values()), rel=0.05)
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(small_docs.repartition(7)).collect()))


def test_mix_repeats_rows(docs_of):
    rows = [(i, "a b c d " * (i % 7 + 1), f"s{i % 3}") for i in range(60)]
    d = docs_of(rows)
    copies = {r["doc_id"]: r["copies"] for r in mixing.plan(d).collect()}
    out = mixing.mix(d)
    assert out.columns == d.columns
    seen = {}
    for r in out.collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {k: v for k, v in copies.items() if v}


def test_odd_rows(docs_of):
    rows = [(1, None, None), (2, "", "a"), (None, "x y", None), (4, "one", "ä"), (4, "one", "ä"), (5, "z " * 50_000, "Z")]
    check(docs_of(rows), rows)
    assert mixing.plan(docs_of([])).collect() == []
    zero = [(1, None, "a"), (2, " ", "b")]
    assert [r["target"] for r in mixing.plan(docs_of(zero)).collect()] == [0.0, 0.0]
    clash = docs_of(rows).withColumnsRenamed({"lang": "rate", "n_chars": "size"})
    assert len(mixing.plan(clash).collect()) == len(rows) and mixing.mix(clash).columns == clash.columns
