"""Registered score queries (T19-T26) on customer (real) vs supplier
(synthetic), prefixes stripped: shared name / nationkey / acctbal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dist_tests as dt
from ..operators import grid as g
from ..operators import scores as scx
from ..operators.reshape import categorical_long, numeric_long
from ..sources.testdata import (CUSTOMER_SQL, LI_CATEGORICAL, LI_NUMERIC, LINEITEM_SQL, SUPPLIER_SQL,
                                customer_real, lineitem_twin, supplier_synth)
from .q_assoc import shares_dist_sql, v_sql
from .q_distribution import welch_sql
from .q_grid import detect_sql
from .registry import register
from .sqltext import ecdf_sql, long_sql, value_counts_sql

NUM = ["nationkey", "acctbal"]
NUM_LONG = " UNION ALL ".join(
    f"SELECT '{s}' AS src, '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM ({rel}) _t"
    for s, rel in (("real", CUSTOMER_SQL), ("synthetic", SUPPLIER_SQL)) for c in NUM)
CAT_LONG = (f"SELECT 'real' AS src, 'name' AS column_name, name AS value FROM ({CUSTOMER_SQL}) _c UNION ALL "
            f"SELECT 'synthetic' AS src, 'name' AS column_name, name AS value FROM ({SUPPLIER_SQL}) _s")


def _clamp(x):
    return f"least(1.0E0, greatest(0.0E0, {x}))"


def struct_sql() -> str:
    cat = (f"SELECT count(*) AS checked_categorical_values, count_if(value NOT IN (SELECT value FROM ({CAT_LONG}) _r "
           f"WHERE src = 'real')) AS invalid_category_values FROM ({CAT_LONG}) _s WHERE src = 'synthetic'")
    rng = (f"SELECT column_name, min(value) AS _lo, max(value) AS _hi FROM ({NUM_LONG}) _r WHERE src = 'real' "
           "GROUP BY column_name")
    num = (f"SELECT count(*) AS checked_numeric_values, count_if(value < _lo OR value > _hi) AS out_of_range_values "
           f"FROM ({NUM_LONG}) s JOIN ({rng}) r USING (column_name) WHERE s.src = 'synthetic'")
    fixed = 0.25 * 2 / 5 + 0.20 * 1 / 5 + 0.25 * 0
    d = _clamp(f"{fixed!r} + 0.15 * CASE WHEN checked_categorical_values > 0 THEN invalid_category_values / "
               "checked_categorical_values ELSE 0.0E0 END + 0.15 * CASE WHEN checked_numeric_values > 0 THEN "
               "out_of_range_values / checked_numeric_values ELSE 0.0E0 END")
    return ("SELECT 2 AS missing_columns, 1 AS extra_columns, 3 AS shared_columns, 0 AS type_mismatches, "
            "invalid_category_values, checked_categorical_values, out_of_range_values, checked_numeric_values, "
            f"{d} AS structural_discrepancy, 100.0E0 * (1 - {d}) AS structural_score FROM ({cat}) _c CROSS JOIN ({num}) _n")


def _struct(spark, sf_dir):
    return scx.structural(customer_real(spark, sf_dir), supplier_synth(spark, sf_dir))


S_DBL = ("structural_discrepancy", "structural_score")


@register("t20_structural_score", sql=struct_sql, dbl=S_DBL)
def q_t20(spark, sf_dir):
    """Structural score from missing / extra columns, type mismatches, invalid categories, out-of-range values."""
    return _struct(spark, sf_dir)[0]


def uni_terms_sql() -> str:
    cdf = ecdf_sql(value_counts_sql(NUM_LONG))
    ks = ("SELECT column_name, max(tot_n_real) AS n_real, max(tot_n_synth) AS n_synthetic, "
          "max(abs(cum_n_real / nullif(tot_n_real, 0) - cum_n_synth / nullif(tot_n_synth, 0))) AS statistic "
          f"FROM ({cdf}) _c GROUP BY column_name")
    m = ("SELECT column_name, avg(value) FILTER (WHERE src = 'real') AS _mr, avg(value) FILTER (WHERE src = 'synthetic') AS _ms, "
         "stddev_pop(value) FILTER (WHERE src = 'real') AS _sr, stddev_pop(value) FILTER (WHERE src = 'synthetic') AS _ss, "
         "quantile_cont(value, 0.25) FILTER (WHERE src = 'real') AS _q1, quantile_cont(value, 0.75) FILTER (WHERE src = 'real') AS _q3, "
         "quantile_cont(value, 0.5) FILTER (WHERE src = 'real') AS _medr, "
         "quantile_cont(value, 0.5) FILTER (WHERE src = 'synthetic') AS _meds "
         f"FROM ({NUM_LONG}) _l GROUP BY column_name")
    s = "greatest(_q3 - _q1, 1e-9)"
    d = _clamp(f"(statistic + {_clamp(f'abs(_mr - _ms) / {s}')} + {_clamp(f'abs(_sr - _ss) / {s}')} + "
               f"{_clamp(f'abs(_medr - _meds) / {s}')}) / 4.0E0")
    num = (f"SELECT column_name, 'numeric' AS kind, {d} AS discrepancy FROM ({ks}) k JOIN ({m}) m USING (column_name) "
           "WHERE n_real >= 3 AND n_synthetic >= 3")
    cat = f"SELECT column_name, 'categorical' AS kind, tvd AS discrepancy FROM ({shares_dist_sql(CAT_LONG)}) _t"
    return f"{num} UNION ALL {cat}"


def _uni_terms(spark, sf_dir):
    r, s = customer_real(spark, sf_dir), supplier_synth(spark, sf_dir)
    num, cat = scx.shared_long(r, s, NUM, ["name"])
    return scx.univariate_terms(num, cat)


@register("t21_univariate_terms", sql=uni_terms_sql, dbl=("discrepancy",))
def q_t21t(spark, sf_dir):
    """T21 terms: per-column numeric (KS + IQR-scaled gaps) or categorical (TVD) discrepancy."""
    return _uni_terms(spark, sf_dir)


def uni_sql() -> str:
    return (f"SELECT count_if(kind = 'numeric') AS numeric_variables, count_if(kind = 'categorical') AS categorical_variables, "
            f"{_clamp('avg(discrepancy)')} AS univariate_discrepancy, 100.0E0 * (1 - {_clamp('avg(discrepancy)')}) "
            f"AS univariate_score FROM ({uni_terms_sql()}) _u")


@register("t21_univariate_score", sql=uni_sql, dbl=("univariate_discrepancy", "univariate_score"))
def q_t21(spark, sf_dir):
    """Univariate score: mean of per-column discrepancies."""
    return scx.univariate(_uni_terms(spark, sf_dir))


def bi_sql() -> str:
    d = (f"SELECT CAST(1 AS BIGINT) AS pairs, abs((SELECT corr(nationkey, acctbal) FROM ({CUSTOMER_SQL}) _c) - "
         f"(SELECT corr(nationkey, acctbal) FROM ({SUPPLIER_SQL}) _s)) AS bivariate_distance")
    return f"SELECT pairs, bivariate_distance, 100.0E0 * (1 - bivariate_distance) AS bivariate_score FROM ({d}) _d"


@register("t22b_bivariate_customer_supplier", sql=bi_sql, dbl=("bivariate_distance", "bivariate_score"))
def q_t22b(spark, sf_dir):
    return scx.bivariate_from(customer_real(spark, sf_dir), supplier_synth(spark, sf_dir), NUM)


CS_POINTS_SQL = (f"SELECT 'real' AS src, custkey AS row_id, CAST(nationkey AS DOUBLE) AS x, acctbal AS y "
                 f"FROM ({CUSTOMER_SQL}) _c UNION ALL SELECT 'synthetic' AS src, suppkey AS row_id, "
                 f"CAST(nationkey AS DOUBLE) AS x, acctbal AS y FROM ({SUPPLIER_SQL}) _s")


def _cs_points(spark, sf_dir):
    r = customer_real(spark, sf_dir).select(F.lit("real").alias("src"), F.col("custkey").alias("row_id"),
                                            F.col("nationkey").cast("double").alias("x"), F.col("acctbal").alias("y"))
    s = supplier_synth(spark, sf_dir).select(F.lit("synthetic").alias("src"), F.col("suppkey").alias("row_id"),
                                             F.col("nationkey").cast("double").alias("x"), F.col("acctbal").alias("y"))
    return r.unionByName(s)


def overall_sql() -> str:
    burden = (f"SELECT coalesce((SELECT sum(abs(real_count - synthetic_count)) FROM ({detect_sql(CS_POINTS_SQL)}) _c "
              f"WHERE is_significant) / (SELECT count(*) FROM ({CS_POINTS_SQL}) _p), 0.0E0) AS anomaly_burden")
    j = (f"SELECT structural_score, univariate_score, bivariate_score, 100.0E0 * (1 - anomaly_burden) AS anomaly_score "
         f"FROM ({struct_sql()}) a CROSS JOIN ({uni_sql()}) b CROSS JOIN ({bi_sql()}) c CROSS JOIN ({burden}) d")
    return ("SELECT *, 0.25 * structural_score + 0.30 * univariate_score + 0.30 * bivariate_score + 0.15 * anomaly_score "
            "AS overall_score, (0.30 * bivariate_score + 0.15 * anomaly_score) / 0.45 AS multi_variable_score "
            f"FROM ({j}) _j")


@register("t24_overall_score", sql=overall_sql, dbl=(
    "structural_score", "univariate_score", "bivariate_score", "anomaly_score", "overall_score", "multi_variable_score"))
def q_t24(spark, sf_dir):
    r, s = customer_real(spark, sf_dir), supplier_synth(spark, sf_dir)
    st, _, _ = scx.structural(r, s)
    uni = scx.univariate(_uni_terms(spark, sf_dir))
    bi = scx.bivariate_from(r, s, NUM)
    pts = _cs_points(spark, sf_dir)
    burden = g.anomaly_burden(g.detect_anomalies(pts), pts.agg(F.count("*").alias("n_points")))
    return scx.overall(st, uni, bi, burden)


# --------------------------------------------------- per-column differences
LI_LONG = long_sql(LINEITEM_SQL, LI_NUMERIC)
LI_CAT_LONG = long_sql(LINEITEM_SQL, LI_CATEGORICAL, cast="VARCHAR")


def diffs_sql() -> str:
    cdf = ecdf_sql(value_counts_sql(LI_LONG))
    ks = ("SELECT column_name, 'ks' AS metric, max(abs(cum_n_real / nullif(tot_n_real, 0) - cum_n_synth / "
          f"nullif(tot_n_synth, 0))) AS value FROM ({cdf}) _c GROUP BY column_name")
    aggs = ", ".join(f"{f}(value) FILTER (WHERE src = '{side}') AS {n}_{lab}"
                     for side, lab in (("real", "r"), ("synthetic", "s"))
                     for f, n in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"),
                                  ("median", "median")))
    st = f"SELECT column_name, {aggs} FROM ({LI_LONG}) _l GROUP BY column_name"
    rows = " UNION ALL ".join(f"SELECT column_name, '{m}' AS metric, abs({m}_r - {m}_s) AS value FROM ({st}) _s"
                              for m in ("mean", "std", "median", "min", "max"))
    v = f"SELECT column_name, 'cramers_v' AS metric, cramers_v AS value FROM ({v_sql(LI_CAT_LONG, 'value', 'src', 'column_name')}) _v"
    sd = shares_dist_sql(LI_CAT_LONG)
    cats = " UNION ALL ".join(f"SELECT column_name, '{m}' AS metric, {m} AS value FROM ({sd}) _d"
                              for m in ("tvd", "jsd", "wasserstein"))
    return f"{ks} UNION ALL {rows} UNION ALL {v} UNION ALL {cats}"


def _diffs(spark, sf_dir):
    t = lineitem_twin(spark, sf_dir)
    return scx.column_differences(numeric_long(t), categorical_long(t))


@register("t19_column_differences", sql=diffs_sql, dbl=("value",))
def q_t19(spark, sf_dir):
    """Per-column differences: KS, |d mean|, |d std|, |d median|, |d min|, |d max|; V, TVD, JSD, Wasserstein."""
    return _diffs(spark, sf_dir)


@register("t25_filtered_summary", dbl=("normalised_mean",), sql=lambda: (
    "SELECT count(*) AS columns, avg(" + _clamp("CASE WHEN _mx > 0 THEN value / _mx ELSE 0.0E0 END")
    + f") AS normalised_mean FROM (SELECT * FROM ({diffs_sql()}) _d WHERE metric = 'ks') d CROSS JOIN "
    f"(SELECT max(value) AS _mx FROM ({diffs_sql()}) _e WHERE metric = 'ks') m"))
def q_t25(spark, sf_dir):
    return scx.filtered_summary(_diffs(spark, sf_dir), "ks")


@register("a20_metric_domains", dbl=("domain_min", "domain_max"), sql=lambda: (
    f"SELECT metric, min(value) AS domain_min, max(value) AS domain_max FROM ({diffs_sql()}) _d GROUP BY metric"))
def q_a20(spark, sf_dir):
    """[min, max] of each per-column difference metric."""
    from ..operators.profile import metric_domains
    return metric_domains(_diffs(spark, sf_dir))


@register("t26_pvalue_wording", dbl=("p_value",), sql=lambda: (
    "SELECT column_name, p_value, CASE WHEN p_value IS NULL OR isnan(p_value) THEN 'N/A' WHEN p_value < 0.001 "
    "THEN 'Highly significant' WHEN p_value < 0.01 THEN 'Very significant' WHEN p_value < 0.05 THEN 'Significant' "
    f"ELSE 'Not significant' END AS interpretation FROM ({welch_sql()}) _w"))
def q_t26(spark, sf_dir):
    w = dt.welch_t_test(numeric_long(lineitem_twin(spark, sf_dir)))
    return w.select("column_name", "p_value", scx.pvalue_wording().alias("interpretation"))
