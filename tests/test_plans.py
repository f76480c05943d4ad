"""Physical-plan properties (the no-Cartesian-product check runs for every
registered query inside test_oracle.py, on the same DataFrame)."""

import re

import __spark_entry__ as E


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_scan_prunes_columns(spark):
    plan = _plan(E.entry(spark))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all("l_shipdate" not in s for s in schemas)


def test_top_k_lists_use_group_limits(spark):
    from .conftest import SF_SMALL
    for name in ("r4_first_outliers", "a2_categorical_range", "m1_sample_per_side"):
        assert "WindowGroupLimit" in _plan(E.queries()[name](spark, SF_SMALL))


def test_first_rows_of_a_side_and_column_sort_no_table(spark):
    from twinlens.plans.q_extra import _pair_firsts
    from .conftest import SF_SMALL
    plan = _plan(E.queries()["p7b_p7c_pair_plot_discreteness"](spark, SF_SMALL))
    assert "Window" not in plan and plan.count("TakeOrderedAndProject(limit=400") == 8
    schema = ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, "
              "l_quantity double, l_discount double, l_tax double")
    rows = [(None if k == 9 else k, 1, 1, 1, "R" if k % 2 else None, None if k == 3 else float(k), 0.0, None)
            for k in range(9, -1, -1)]
    got = {}
    for r in _pair_firsts(spark.createDataFrame(rows, schema), 3).collect():
        got.setdefault((r["src"], r["column_name"]), []).append(r["row_id"]["l_orderkey"])
    assert {k: sorted(v, key=str) for k, v in got.items()} == {
        (src, c): keys for src, c, keys in [
            ("real", "l_quantity", [1, 5, None]), ("real", "l_linenumber", [1, 3, None]), ("real", "l_discount", [1, 3, None]),
            ("synthetic", "l_quantity", [0, 2, 4]), ("synthetic", "l_linenumber", [0, 2, 4]),
            ("synthetic", "l_discount", [0, 2, 4])]}
