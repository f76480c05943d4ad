"""File sources and schema helpers on small written fixtures (FIXTURES F17, F19)."""

import json
import os
import tempfile

import pytest

from twinlens.operators import schema as sc
from twinlens.sources import files as fl


def _tmp(name, text):
    d = tempfile.mkdtemp(prefix="tl-src-", dir="/tmp")
    p = os.path.join(d, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_csv_strings_keep_every_value_as_text(spark):
    p = _tmp("a.csv", "x,y,z\n1,2.5,a\n\n3,,b\n")
    df = fl.read_csv_strings(spark, p)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string"] * 3
    assert df.count() == 2


def test_csv_failfast_on_malformed_row(spark):
    p = _tmp("b.csv", "x,y\n1,2\n3,4,5\n")
    with pytest.raises(Exception):
        fl.read_csv_strings(spark, p).collect()


def test_json_records_and_rows(spark):
    p = _tmp("r.json", json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]))
    assert fl.read_json_records(spark, p).count() == 2
    q = _tmp("rows.json", json.dumps([["a", "b"], ["1", "x"], ["2", "y"]]))
    rows = fl.read_json_rows(spark, q).collect()
    assert sorted(r.record["a"] for r in rows) == ["1", "2"]


def test_header_normalisation():
    # trim, drop empties, first duplicate wins, real order then synthetic
    assert sc.normalize_headers([" a", "b", "", "a"], ["c", "b ", "d"]) == ["a", "b", "c", "d"]


def test_numeric_rescue_only_when_few_numeric(spark):
    r = spark.createDataFrame([("1", "x"), ("2", "y")], "p string, q string")
    s = spark.createDataFrame([("3", "z")], "p string, q string")
    r2, s2, rescued = sc.numeric_rescue(r, s)
    assert rescued == ["p"]
    assert dict(r2.dtypes)["p"] == "double" and dict(s2.dtypes)["p"] == "double"


def test_alignment_falls_back_to_positional(spark):
    # no shared names -> first min(n) columns renamed col_i
    r = spark.createDataFrame([(1, 2)], "col1 long, col2 long")
    s = spark.createDataFrame([(3, 4)], "different long, headers long")
    out = sc.align(r, s, "intersect")
    assert out.columns == ["src", "col_0", "col_1"]
    assert out.count() == 2


def test_polygon_filter(spark):
    sq = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    df = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (0.2, 0.9)], "x double, y double")
    from pyspark.sql import functions as F
    assert df.where(F.expr(sc.in_polygon("x", "y", sq))).count() == 2


def test_csv_typed_drops_index_column(spark):
    p = _tmp("t.csv", "idx,a,b\n0,1,x\n1,2.5,y\n")
    df = fl.read_csv_typed(spark, p, index_col="idx")
    assert df.columns == ["a", "b"] and dict(df.dtypes)["a"] == "double"


def test_float_matrix_cells(spark):
    from pyspark.sql import functions as F

    from twinlens.operators.encode import FLOAT32_MAX, finite_float
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (1.5,)], "v double")
    got = [r[0] for r in df.select(finite_float(F.col("v"))).collect()]
    assert got[0] == 0.0 and got[3] == 0.0 and got[4] == 1.5
    assert got[1] == pytest.approx(FLOAT32_MAX, rel=1e-6) and got[2] == pytest.approx(-FLOAT32_MAX, rel=1e-6)
