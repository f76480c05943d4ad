"""Registered alignment, type-inference, coercion and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as en
from ..operators import sample as sm
from ..operators import schema as sc
from ..sources.testdata import (CUSTOMER_SQL, ORDERS_SQL, SUPPLIER_SQL, Twin, table, customer_real, embedding_sql,
                                embedding_twin, orders_twin, supplier_synth, table)
from .registry import register

CUST_COLS = ["custkey", "name", "nationkey", "acctbal", "mktsegment"]
SUPP_COLS = ["suppkey", "name", "nationkey", "acctbal"]


def _tag(rel, src, cols):
    return f"SELECT '{src}' AS src, {', '.join(cols)} FROM ({rel}) _t"


@register("p1_align_intersect", sql=lambda: (
    _tag(CUSTOMER_SQL, "real", ["name", "nationkey", "acctbal"]) + " UNION ALL "
    + _tag(SUPPLIER_SQL, "synthetic", ["name", "nationkey", "acctbal"])), dbl=("acctbal",))
def q_p1(spark, sf_dir):
    return sc.align(customer_real(spark, sf_dir), supplier_synth(spark, sf_dir), "intersect")


@register("p2_align_union", sql=lambda: (
    "SELECT 'real' AS src, custkey, name, nationkey, acctbal, mktsegment, CAST(NULL AS BIGINT) AS suppkey "
    f"FROM ({CUSTOMER_SQL}) _c UNION ALL SELECT 'synthetic' AS src, CAST(NULL AS BIGINT) AS custkey, name, nationkey, "
    f"acctbal, CAST(NULL AS VARCHAR) AS mktsegment, suppkey FROM ({SUPPLIER_SQL}) _s"), dbl=("acctbal",))
def q_p2(spark, sf_dir):
    return sc.align(customer_real(spark, sf_dir), supplier_synth(spark, sf_dir), "union")


@register("p3_align_positional", sql=lambda: (
    "SELECT 'real' AS src, custkey AS col_0, name AS col_1, nationkey AS col_2, acctbal AS col_3 "
    f"FROM ({CUSTOMER_SQL}) _c UNION ALL SELECT 'synthetic' AS src, suppkey AS col_0, name AS col_1, "
    f"nationkey AS col_2, acctbal AS col_3 FROM ({SUPPLIER_SQL}) _s"), dbl=("col_3",))
def q_p3(spark, sf_dir):
    return sc.align(customer_real(spark, sf_dir), supplier_synth(spark, sf_dir), "positional")


@register("p4_align_none", sql=lambda: (
    "SELECT 'real' AS src, custkey, name, nationkey, acctbal, mktsegment, CAST(NULL AS BIGINT) AS suppkey "
    f"FROM ({CUSTOMER_SQL}) _c UNION ALL SELECT 'synthetic' AS src, CAST(NULL AS BIGINT) AS custkey, name, nationkey, "
    f"acctbal, CAST(NULL AS VARCHAR) AS mktsegment, suppkey FROM ({SUPPLIER_SQL}) _s"), dbl=("acctbal",))
def q_p4(spark, sf_dir):
    return sc.align(customer_real(spark, sf_dir), supplier_synth(spark, sf_dir), "none")


@register("p5_header_normalisation", dbl=("acctbal",), sql=lambda: (
    f"SELECT custkey, name, nationkey, acctbal FROM ({CUSTOMER_SQL}) _c"))
def q_p5(spark, sf_dir):
    """Headers with blanks, a blank one and a repeated one: trimmed, dropped, first wins."""
    raw = customer_real(spark, sf_dir).withColumn("extra", F.lit(1)).toDF(
        " custkey", "name ", "nationkey", " acctbal ", " name", "  ")
    return sc.apply_header_normalization(raw)


def _hdr_sql() -> str:
    side = lambda rel, cols, n: " UNION ALL ".join(
        f"SELECT '{c}' AS header, count({c}) AS {n}, count(*) - count({c}) AS {n}_missing FROM ({rel}) _t" for c in cols)
    return ("SELECT header, CASE WHEN real_values IS NULL THEN 'synthetic_only' WHEN synthetic_values IS NULL THEN 'real_only' "
            "ELSE 'common' END AS status, real_values, real_values_missing, synthetic_values, synthetic_values_missing "
            f"FROM ({side(CUSTOMER_SQL, CUST_COLS, 'real_values')}) r "
            f"FULL JOIN ({side(SUPPLIER_SQL, SUPP_COLS, 'synthetic_values')}) s USING (header)")


@register("p17_header_diff", sql=_hdr_sql)
def q_p17(spark, sf_dir):
    return sc.header_values(customer_real(spark, sf_dir), supplier_synth(spark, sf_dir))


def _strings(spark, sf_dir):
    """customer vs supplier as all-string columns (a raw CSV-like ingest)."""
    r = customer_real(spark, sf_dir)
    s = supplier_synth(spark, sf_dir)
    shared = ["name", "nationkey", "acctbal"]
    return (r.select(F.lit("real").alias("src"), *[F.col(c).cast("string").alias(c) for c in shared])
             .unionByName(s.select(F.lit("synthetic").alias("src"), *[F.col(c).cast("string").alias(c) for c in shared])))


def _types_sql(by_side: bool) -> str:
    shared = ["name", "nationkey", "acctbal"]
    u = (f"SELECT 'real' AS src, {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in shared)} FROM ({CUSTOMER_SQL}) _c "
         f"UNION ALL SELECT 'synthetic' AS src, {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in shared)} "
         f"FROM ({SUPPLIER_SQL}) _s")
    parts = []
    for c in shared:
        fr = f"avg(CASE WHEN TRY_CAST({c} AS DOUBLE) IS NULL THEN 1.0E0 ELSE 0.0E0 END)"
        ap = f"bool_and({c} IS NULL OR TRY_CAST({c} AS DOUBLE) IS NOT NULL)"
        if by_side:
            parts.append(f"SELECT '{c}' AS column_name, {fr} FILTER (WHERE src = 'real') AS fail_ratio_real, "
                         f"{fr} FILTER (WHERE src = 'synthetic') AS fail_ratio_synthetic, {ap} AS all_parse FROM ({u}) _u")
        else:
            parts.append(f"SELECT '{c}' AS column_name, {fr} AS fail_ratio, {ap} AS all_parse FROM ({u}) _u "
                         f"WHERE src = 'real'")
    body = " UNION ALL ".join(parts)
    if by_side:
        return (f"SELECT *, CASE WHEN fail_ratio_real <= 0.5 AND fail_ratio_synthetic <= 0.5 THEN 'numeric' "
                f"ELSE 'categorical' END AS inferred_type FROM ({body}) _b")
    return f"SELECT *, CASE WHEN fail_ratio > 0.5 THEN 'categorical' ELSE 'numeric' END AS inferred_type FROM ({body}) _b"


@register("p6a_infer_types_real", sql=lambda: _types_sql(False), dbl=("fail_ratio",))
def q_p6a(spark, sf_dir):
    df = _strings(spark, sf_dir).where(F.col("src") == "real")
    return sc.infer_types(df, ["name", "nationkey", "acctbal"])


@register("p6b_infer_types_both", sql=lambda: _types_sql(True), dbl=("fail_ratio_real", "fail_ratio_synthetic"))
def q_p6b(spark, sf_dir):
    return sc.infer_types(_strings(spark, sf_dir), ["name", "nationkey", "acctbal"], by_side=True)


LI_DISC_SQL = ("SELECT CASE WHEN l_returnflag = 'R' THEN 'real' ELSE 'synthetic' END AS src, "
               "l_quantity, l_linenumber, l_discount FROM lineitem")


def _disc_sql() -> str:
    parts = []
    for c in ("l_quantity", "l_linenumber", "l_discount"):
        parts.append(f"SELECT src, '{c}' AS column_name, bool_and(CAST({c} AS DOUBLE) = floor(CAST({c} AS DOUBLE))) AS _whole, "
                     f"count(DISTINCT CAST({c} AS DOUBLE)) AS _k FROM ({LI_DISC_SQL}) _l WHERE {c} IS NOT NULL GROUP BY src")
    u = " UNION ALL ".join(parts)
    return (f"SELECT column_name, bool_and(_whole AND _k <= 20) AS is_discrete, max(_k) AS max_distinct "
            f"FROM ({u}) _u GROUP BY column_name")


@register("p7_discrete_columns", sql=_disc_sql)
def q_p7(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    df = li.select(F.when(F.col("l_returnflag") == "R", "real").otherwise("synthetic").alias("src"),
                   "l_quantity", "l_linenumber", "l_discount")
    return sc.discrete_columns(df, ["l_quantity", "l_linenumber", "l_discount"])


@register("p9_coerce_numeric_zero", dbl=("custkey", "name", "nationkey", "acctbal", "mktsegment"), sql=lambda: (
    "SELECT " + ", ".join(f"coalesce(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE), 0.0E0) AS {c}" for c in CUST_COLS)
    + f" FROM ({CUSTOMER_SQL}) _c"))
def q_p9(spark, sf_dir):
    return en.coerce_numeric_zero(customer_real(spark, sf_dir), CUST_COLS)


def _onehot_sql() -> str:
    lv = lambda c: (f"(SELECT list_sort(list(DISTINCT CAST({c} AS VARCHAR))) FROM ({ORDERS_SQL}) _r "  # noqa: E731
                    f"WHERE src = 'real' AND {c} IS NOT NULL)")
    cols = []
    for c, k in (("o_orderpriority", 5), ("o_orderstatus", 3)):
        for i in range(2, k + 1):
            cols.append(f"CAST(CAST(CAST({c} AS VARCHAR) = {lv(c)}[{i}] AS INTEGER) AS FLOAT) AS {c}_{i - 1}")
    cols.append("CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS o_totalprice")
    return f"SELECT src, row_id, {', '.join(cols)} FROM ({ORDERS_SQL}) _o"


@register("p10_one_hot_drop_first", sql=_onehot_sql, dbl=(
    "o_orderpriority_1", "o_orderpriority_2", "o_orderpriority_3", "o_orderpriority_4",
    "o_orderstatus_1", "o_orderstatus_2", "o_totalprice"))
def q_p10(spark, sf_dir):
    t = orders_twin(spark, sf_dir)
    rows = en.encode_one_hot(t.df, en.fit_one_hot(t))
    return rows.select("src", "row_id", *[en.value_at(i).alias(f"o_orderpriority_{i + 1}") for i in range(4)],
                       *[en.value_at(4 + i).alias(f"o_orderstatus_{i + 1}") for i in range(2)],
                       en.value_at(6).cast("double").alias("o_totalprice"))


CUST_TWIN_SQL = ("SELECT CASE WHEN c_custkey % 3 > 0 THEN 'real' ELSE 'synthetic' END AS src, c_custkey AS row_id, "
                 "c_name, CAST(c_custkey // 5 AS VARCHAR) AS household, c_mktsegment FROM customer")


def _codes_sql() -> str:
    names = ("c_name", "household", "c_mktsegment")
    lv = " UNION ALL ".join(f"SELECT {p} AS position, {c} AS value FROM ({CUST_TWIN_SQL}) _t WHERE src = 'real'" for p, c in enumerate(names))
    lv = (f"SELECT position, value, row_number() OVER (ORDER BY position, value) - 1 AS index FROM (SELECT DISTINCT position, value, "
          f"min(value) OVER (PARTITION BY position) AS _first FROM ({lv}) _l) _d WHERE value <> _first")
    rows = " UNION ALL ".join(f"SELECT src, row_id, {p} AS position, {c} AS value FROM ({CUST_TWIN_SQL}) _t" for p, c in enumerate(names))
    return (f"SELECT src, row_id, CAST(index AS INT) AS index, CAST((SELECT count(*) FROM ({lv}) _n) AS INT) AS size "
            f"FROM ({rows}) r JOIN ({lv}) l USING (position, value)")


@register("p10b_sparse_many_levels", sql=_codes_sql)
def q_p10b(spark, sf_dir):
    """P10 on columns with as many levels as rows: the dictionary is a joined table."""
    c = table(spark, sf_dir, "customer")
    df = c.select(F.when(F.col("c_custkey") % 3 > 0, "real").otherwise("synthetic").alias("src"), F.col("c_custkey").alias("row_id"),
                  "c_name", F.expr("cast(c_custkey div 5 as string)").alias("household"), "c_mktsegment")
    rows = en.encode_one_hot(df, en.fit_one_hot(Twin(df, [], ["c_name", "household", "c_mktsegment"])))
    return rows.select("src", "row_id", F.explode("indices").alias("index"), "size")


@register("p20_categorical_coercion", sql=(
    "SELECT src, row_id, coalesce(nullif(CAST(nullif(o_orderstatus, 'P') AS VARCHAR), ''), 'NA') AS o_orderstatus "
    f"FROM ({ORDERS_SQL}) _o"))
def q_p20(spark, sf_dir):
    t = orders_twin(spark, sf_dir).df
    # missing injected in the query (the tables have none): status P -> null
    df = t.select("src", "row_id", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"))
    return sc.categorical_coercion(df, ["o_orderstatus"])


# ------------------------------------------------------------------ sampling
def _key_sql(seed=42):
    return f"md5('{seed}|' || CAST(row_id AS VARCHAR))"


@register("m1_sample_per_side", sql=(
    f"SELECT src, row_id, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY {_key_sql()}, row_id) "
    f"AS _k FROM ({ORDERS_SQL}) _o) _s WHERE _k <= 100"), dbl=("o_totalprice",))
def q_m1(spark, sf_dir):
    return sm.sample_per_side(orders_twin(spark, sf_dir).df, 100).select("src", "row_id", "o_totalprice")


@register("m2_head_per_side", sql=(
    f"SELECT src, row_id FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY row_id) AS _k "
    f"FROM ({ORDERS_SQL}) _o) _s WHERE _k <= 50"))
def q_m2(spark, sf_dir):
    return sm.head_per_side(orders_twin(spark, sf_dir).df, 50).select("src", "row_id")


@register("m3_plot_sample", sql=(
    f"SELECT src, row_id FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY {_key_sql()}, row_id) AS _k, "
    f"count(*) OVER () AS _t FROM ({ORDERS_SQL}) _o) _s WHERE _t <= 10000 OR _k <= 5000"))
def q_m3(spark, sf_dir):
    return sm.plot_sample(orders_twin(spark, sf_dir).df).select("src", "row_id")


@register("m4_stratified_equal", sql=(
    f"SELECT label, row_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_key_sql()}, row_id) AS _k, "
    f"(SELECT count(DISTINCT label) FROM ({embedding_sql(2)}) _g) AS _g FROM ({embedding_sql(2)}) _e) _s "
    f"WHERE _k <= floor(200 / _g)"))
def q_m4(spark, sf_dir):
    return sm.stratified_equal(embedding_twin(spark, sf_dir, 2).df, "label", 200).select("label", "row_id")


@register("m6_fraction_subset", sql=(
    "SELECT src, row_id, coalesce(_k <= _n, false) AS injected FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY src ORDER BY ('0x' || substr({_key_sql()}, 1, 15))::BIGINT) AS _k, "
    f"floor(count(*) OVER (PARTITION BY src) * 0.05) AS _n FROM ({ORDERS_SQL}) _o) _s"))
def q_m6(spark, sf_dir):
    return sm.fraction_subset(orders_twin(spark, sf_dir).df, 0.05).select("src", "row_id", "injected")
