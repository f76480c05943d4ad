"""Embedding near-duplicates against all pairs; components of odd graphs."""

import math

import numpy as np

from twinlens.llm import components, embed_dedup


def brute(rows, threshold=0.95):
    good = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    link = [[] for _ in range(n)]
    for a in range(n):
        for b in range(n):
            x, y = rows[a][1], rows[b][1]
            if a != b and good(x) and good(y) and len(x) == len(y):
                x, y = np.array(x, float), np.array(y, float)
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                    link[a].append(b)
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            for b in link[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out.append((rows[a][0], len(link[a]), min(rows[b][0] for b in seen)))
    return sorted(out)


def result(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = embed_dedup.near_duplicates(df).collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got)


def test_clusters_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for size, spread in ((300, 0.03), (40, 0.05), (1, 0.0), (1, 0.0)):     # one cluster spans several blocks
        centre = rng.standard_normal(16)
        for _ in range(size):
            rows.append((len(rows), [float(x) for x in np.float32(centre + spread * rng.standard_normal(16))]))
    rows += [(len(rows) + i, rows[0][1]) for i in range(50)]               # copies of one vector
    assert result(spark, rows) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 1.0]),
            (8, [2.0, 2.0]), (9, [1.0, 1.0, 1.0]), (10, [-1.0, -1.0])]
    assert result(spark, rows) == brute(rows)
    assert result(spark, []) == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 400)] + [(5000, i) for i in range(2000, 2300)] + [(1, 1), (None, 3), (7, 8), (8, 7)]
    got = {r["node"]: r["component"] for r in components.connected_components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 401)} | {i: 2000 for i in [*range(2000, 2300), 5000]} | {7: 7, 8: 7}
    assert got == want


def test_miss_probability_sets_tables():
    for bits in (8, 14, 24):
        agree = (1 - math.acos(0.95) / math.pi) ** bits
        assert (1 - agree) ** embed_dedup.n_tables(bits) <= embed_dedup.MISS
