"""LM scoring: base by hand, lattice by enumeration, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from twinlens.llm import lm_score


def base(rows):
    words = lambda t: [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, _ in rows]
    c = Counter()
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    out = []
    for (i, t), h in zip(rows, held, strict=True):
        tokens = [*words(t), None]
        out.append((i, h, len(tokens), sum(c[x] > 0 for x in tokens), n,
                    sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens)))
    return out


def check(df, rows, **kw):
    got = sorted(lm_score.score(df, **kw).collect(), key=lambda r: str(r["doc_id"]))
    for r, want in zip(got, sorted(base(rows), key=lambda x: str(x[0])), strict=True):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:5]
        assert r["base_score"] == pytest.approx(want[5], rel=1e-9, abs=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    return got


def test_base_matches_direct_count(small_docs):
    rows = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    got = check(small_docs, rows, rounds=1, frequent_words=2000)       # so that the join takes part
    again = check(small_docs, rows, rounds=1)
    assert [r["score"] for r in got] == pytest.approx([r["score"] for r in again])


def test_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (3, "Zeta zeta"), (4, "x" * 3000), (9, "日本語 \x00 ▁"), (None, "the the")]
    check(docs_of(rows), rows, rounds=1)
    assert lm_score.score(docs_of([]), rounds=1).collect() == []


def segmentations(word, pieces, at=0):
    if at == len(word):
        yield []
    for i, p in enumerate(pieces):
        if p and word.startswith(p, at):
            for rest in segmentations(word, pieces, at + len(p)):
                yield [i, *rest]


def test_forward_recursion_sums_all_segmentations():
    mark = lm_score.MARK
    pieces = [mark, mark + b"a", b"a", b"b", b"ab", b"ba", mark + b"ab", b""]
    w = np.log(np.array([.2, .1, .15, .1, .15, .1, .1, .1]))
    lattice = lm_score.Lattice(pieces, w)
    words = [b"ab", b"aba", b"babab", b"c"]
    want, uses = [], np.zeros(len(pieces))
    for word in words:
        paths = [(math.exp(sum(w[p])), p) for p in segmentations(mark + word, pieces)]
        total = sum(x for x, _ in paths)
        want.append(math.log(total) if paths else -math.inf)
        for x, p in paths:
            for i in p:
                uses[i] += x / total
    assert lattice.score(*lm_score.joined(words)) == pytest.approx(want)
    assert lattice.expected(*lm_score.joined(words[:3]), np.ones(3)) == pytest.approx(uses)


def test_reestimation_raises_the_likelihood(small_docs):
    total = lambda rounds: sum(r["score"] for r in lm_score.score(small_docs, rounds=rounds).collect())
    assert total(0) < total(1) < total(2)
