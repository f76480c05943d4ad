"""The neighbour index against brute force, on hot points, outliers and ties."""

import math
import random
import time

import numpy as np
import pytest

from twinlens.operators import neighbours as nb


def brute(rows, k):
    """rows: (src, id, x...); the k nearest real ids of each synthetic row."""
    real = [r for r in rows if r[0] == "real" and None not in r]
    out = {}
    for s in rows:
        if s[0] == "synthetic" and None not in s:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(s[2:], r[2:], strict=True))), r[1]) for r in real)[:k]
            out |= {(s[1], n + 1): (i, d) for n, (d, i) in enumerate(near)}
    return out


def frame(spark, rows):
    names = [f"f{i}" for i in range(len(rows[0]) - 2)]
    return spark.createDataFrame(rows, "src string, row_id long, " + ", ".join(f"{n} double" for n in names)), names


def check(spark, rows, k, **kw):
    df, names = frame(spark, rows)
    got = {(r.row_id, r["rank"]): (r.neighbor_id, r.distance) for r in nb.knn(df, names, k=k, with_ids=True, **kw).collect()}
    want = brute(rows, k)
    assert got.keys() == want.keys()
    for key, (i, d) in want.items():
        assert got[key][0] == i and got[key][1] == pytest.approx(d)


@pytest.mark.parametrize("parts", [False, True])
def test_matches_brute_force(spark, monkeypatch, parts):
    if parts:       # many cells, every cell in several blocks of points and lanes of queries
        monkeypatch.setattr(nb, "PART_POINTS", 3)
        monkeypatch.setattr(nb, "LANE_QUERIES", 5)
    rng = random.Random(1)
    rows = []
    for i in range(600):
        c = rng.choice([0.0, 0.0, 5.0])
        rows.append((rng.choice(["real", "synthetic"]), 1000 - i, *[c + rng.gauss(0, 1) for _ in range(5)]))
    check(spark, rows, 3, target_per_cell=8)


def test_ties_go_by_row_id_and_missing_features_drop_out(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["real", "synthetic"]), i, float(rng.randint(0, 4)), float(rng.randint(0, 4))) for i in rng.sample(range(900), 400)]
    rows += [("real", 1001, None, 1.0), ("synthetic", 1002, 1.0, None), ("real", 1003, -0.0, 0.0), ("synthetic", 1004, 0.0, -0.0)]
    check(spark, rows, 5, target_per_cell=4)


def test_fewer_rows_than_neighbours(spark):
    check(spark, [("real", 1, 0.0), ("synthetic", 2, 1.0), ("synthetic", 3, 4.0)], 3)
    check(spark, [("synthetic", 2, 1.0)], 2)
    check(spark, [("real", 2, 1.0)], 2)


def test_equal_points_take_linear_time(spark):
    """12,000 x 12,000 rows in one place are one pair of points."""
    df = spark.range(24_000).selectExpr("if(id % 2 = 0, 'real', 'synthetic') src", "id row_id", "0.5D a", "0.5D b")
    tally, began = [], time.time()
    got = nb.knn(df, ["a", "b"], k=2, with_ids=True, tally=tally)
    assert got.count() == 24_000 and got.where("distance = 0 AND neighbor_id IN (0, 2)").count() == 24_000
    assert tally == [1] and time.time() - began < 60


def test_a_far_outlier_opens_few_cells(spark):
    rng = np.random.default_rng(3)
    rows = [("real", i, *map(float, rng.normal(0, 1, 2))) for i in range(4000)] + [("synthetic", 9999, 1000.0, 1000.0)]
    tally = []
    df, names = frame(spark, rows)
    got = nb.knn(df, names, k=2, target_per_cell=16, with_ids=True, tally=tally).collect()
    assert {(r.row_id, r["rank"]): r.neighbor_id for r in got} == {k: v[0] for k, v in brute(rows, 2).items()}
    assert sum(tally) < 20          # of about 256 cells


def test_tree_splits_every_feature():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (4096, 6))
    tree = nb.grow(x, 256)
    leaf = tree.leaf(x)
    assert set(tree.axis[tree.axis >= 0].tolist()) == set(range(6))
    assert len(np.unique(leaf)) == 256 and np.bincount(leaf).max() == 16
    assert len(np.unique(nb.grow(np.repeat(x[:3], 50, axis=0), 256).leaf(x))) <= 3


def test_struct_row_ids(spark):
    df = spark.range(200).selectExpr("if(id % 2 = 0, 'real', 'synthetic') src", "named_struct('a', id % 7, 'b', id) row_id",
                                     "cast(id % 10 as double) x")
    got = nb.knn(df, ["x"], k=2, with_ids=True).collect()
    assert len(got) == 200 and all(r.distance == 1.0 for r in got if r["rank"] == 1)
