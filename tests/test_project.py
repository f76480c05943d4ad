"""Sparse encoder and matrix-free projection against dense NumPy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlens.operators import encode as en
from twinlens.operators import project as pj
from twinlens.sources.testdata import Twin

SCHEMA = "src string, row_id long, shop string, kind string, a double, b string"


def rows_of(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        shop = "hot" if i % 3 == 0 else f"s{rng.randint(0, 40):02d}"
        out.append(("real" if i % 4 else "synthetic", i, rng.choice([shop, shop, shop, None]), rng.choice("xyz"),
                    rng.choice([rng.gauss(3, 2), None, float("nan")]), rng.choice(["1.5", "-2", "word", None])))
    return out + [("synthetic", n, "unseen", "new", 1.0, "inf")]


def dense(rows):
    """The encoding by plain code."""
    real = [r for r in rows if r[0] == "real"]
    levels = [sorted({r[c] for r in real if r[c] is not None})[1:] for c in (2, 3)]

    def number(v):
        try:
            v = float(v)
        except (TypeError, ValueError):
            return 0.0
        return 0.0 if np.isnan(v) else float(np.float32(np.clip(v, -np.finfo("f4").max, np.finfo("f4").max)))
    return np.array([[float(r[2] == v) for v in levels[0]] + [float(r[3] == v) for v in levels[1]] + [number(r[4]), number(r[5])] for r in rows])


@pytest.fixture(scope="module")
def twin(spark):
    return Twin(spark.createDataFrame(rows_of(600), SCHEMA), ["a", "b"], ["shop", "kind"])


def test_sparse_rows_equal_dense_rows(twin):
    enc = en.fit_one_hot(twin)
    got = en.encode_one_hot(twin.df, enc).orderBy("row_id").collect()
    want = dense(rows_of(600))
    for r, w in zip(got, want, strict=True):
        assert r["size"] == len(w) and r["indices"] == sorted(r["indices"]) and 0 not in r["values"]
        x = np.zeros(r["size"])
        x[r["indices"]] = r["values"]
        assert np.array_equal(x, w)


def test_components_equal_a_dense_decomposition(spark, twin, tmp_path):
    rows, enc = pj.features(twin)
    model = pj.fit_projection(rows, enc)
    x = dense(rows_of(600))
    x[-1, -1] = 0           # the row of infinite b is synthetic: not part of the fit
    real = np.array([r[0] == "real" for r in rows_of(600)])
    mean = x[real].mean(axis=0)
    u, s, vt = np.linalg.svd(x[real] - mean, full_matrices=False)
    assert model.variances == pytest.approx((s[:2] ** 2 / (real.sum() - 1)).tolist(), rel=1e-9)
    got = np.array([[r.x, r.y] for r in pj.transform(model, rows).orderBy("row_id").collect()])
    want = (x - mean) @ vt[:2].T
    assert np.abs(got[:-1]) == pytest.approx(np.abs(want[:-1]), rel=1e-6, abs=1e-7)
    pj.save(model, str(tmp_path))
    again = pj.load(spark, str(tmp_path))
    back = pj.transform(again, en.encode_one_hot(twin.df, again.encoder)).orderBy("row_id").collect()
    assert np.array([[r.x, r.y] for r in back])[:-1] == pytest.approx(got[:-1])


def test_many_levels_need_no_driver_list_and_no_broadcast_hint(spark):
    df = spark.range(4000).selectExpr("if(id % 2 = 0, 'real', 'synthetic') src", "id row_id", "concat('name', id div 2) name", "1.0D v")
    twin = Twin(df, ["v"], ["name"])
    rows = en.encode_one_hot(df, en.fit_one_hot(twin))
    assert "collect_list" not in rows.select("indices")._jdf.queryExecution().optimizedPlan().toString().replace("collect_list(k", "")
    got = rows.agg(F.max("size"), F.sum(F.size("indices"))).first()
    assert tuple(got) == (2000, 4000 + 2 * 1999)


def test_no_rows_and_no_columns(spark):
    empty = Twin(spark.createDataFrame([], SCHEMA), ["a", "b"], ["shop", "kind"])
    rows, enc = pj.features(empty)
    assert rows.collect() == [] and pj.transform(pj.fit_projection(rows, enc), rows).collect() == []
    one = Twin(spark.createDataFrame(rows_of(50), SCHEMA), ["a"], [])
    rows, enc = pj.features(one)
    got = pj.transform(pj.fit_projection(rows, enc), rows).collect()
    assert len(got) == 51 and all(r.y == 0 for r in got)


def test_small_variances_beside_large_ones():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    size = 10.0 ** -np.arange(0, 16, 2)
    values, axes = pj.principal_axes((q * size) @ q.T)
    assert values[:4] == pytest.approx(size[:4], rel=1e-6)
    graded = np.diag(size) + np.sqrt(np.outer(size, size)) * 1e-3 * (1 - np.eye(8))
    values, axes = pj.principal_axes(graded)
    assert values == pytest.approx(size, rel=1e-4) and axes.T @ axes == pytest.approx(np.eye(8), abs=1e-12)
