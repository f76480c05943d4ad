"""Registered full report (T32), its tally (A28), dataset info (A3) and the
single-purpose entry points (T33)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.testdata import (CUSTOMER_SQL, LI_CATEGORICAL, LI_NUMERIC, LI_POINTS_SQL, LINEITEM_SQL,
                                SUPPLIER_SQL, customer_real, lineitem_twin, supplier_synth)
from . import q_distribution as qd
from . import q_grid as qg
from . import q_privacy as qp
from . import q_profile as qpr
from .registry import register
from .report import CATEGORIES, tally, validation_report
from .sqltext import FDR_RESULT_SQL, bh_sql, long_sql

LI_CAT_LONG = long_sql(LINEITEM_SQL, LI_CATEGORICAL, cast="VARCHAR")


def _r(rel, cat, tt, col="NULL", stat="NULL", p="NULL", res="NULL"):
    return (f"SELECT {CATEGORIES.index(cat)} AS category_order, '{cat}' AS category, {tt} AS test_type, "
            f"CAST({col} AS VARCHAR) AS column_name, CAST({stat} AS DOUBLE) AS statistic, CAST({p} AS DOUBLE) AS p_value, "
            f"CAST({res} AS VARCHAR) AS result FROM ({rel}) _x")


def report_sql() -> str:
    parts = [
        _r(qpr._range_sql(), "Range Validation", "'range_test'", "column_name", "range_diff"),
        _r(qpr._cat_range_sql(LI_CAT_LONG), "Range Validation", "'categorical_range_test'", "column_name",
           "overlap_ratio"),
        _r(qd.ks_sql(), "Distribution Tests", "'ks_test'", "column_name", "statistic", "p_value", "result"),
        _r(qd.chi2_sql(), "Distribution Tests", "'chi_square_test'", "column_name", "statistic", "p_value", "result"),
        _r("SELECT CASE WHEN count(*) > 0 THEN count_if(abs(real_r - synthetic_r) > 0.3) / count(*) * 100.0E0 "
           f"ELSE 0.0E0 END AS pct FROM ({qg.pairs_sql()}) _p", "Correlation Validation",
           "'correlation_comparison'", "NULL", "pct", "NULL", "'SUCCESS'"),
        _r(qd.welch_sql(), "Statistical Tests", "'welch_t_test'", "column_name", "statistic", "p_value", "result"),
        _r("SELECT column_name, abs(max(CASE WHEN src = 'synthetic' THEN outlier_percentage END) - "
           f"max(CASE WHEN src = 'real' THEN outlier_percentage END)) AS d FROM ({qpr._iqr_sql()}) _o GROUP BY column_name",
           "Outlier Detection", "'outlier_test'", "column_name", "d"),
    ]
    nulls = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in LI_NUMERIC + LI_CATEGORICAL)
    k = float(len(LI_NUMERIC + LI_CATEGORICAL))
    comp = (f"SELECT CASE WHEN rc > 0 THEN sc / rc ELSE 0.0E0 END AS ratio FROM (SELECT "
            f"1 - sum(CASE WHEN src = 'real' THEN {nulls} END) / (count_if(src = 'real') * {k!r}) AS rc, "
            f"1 - sum(CASE WHEN src = 'synthetic' THEN {nulls} END) / (count_if(src = 'synthetic') * {k!r}) AS sc "
            f"FROM ({LINEITEM_SQL}) _l) _c")
    parts += [
        _r(comp, "Quality Metrics", "'completeness_test'", "NULL", "ratio", "NULL",
           "CASE WHEN ratio >= 0.95 THEN 'ACCEPT' ELSE 'REJECT' END"),
        _r("SELECT 1.0E0 AS ratio", "Quality Metrics", "'consistency_test'", "NULL", "ratio", "NULL", "'ACCEPT'"),
        _r(qp.match_sql(), "Quality Metrics", "'ExactMatchRate'", "NULL", "rate", "NULL", "result"),
        _r(f"SELECT avg(energy_distance) AS e FROM ({qd.energy_sql()}) _e", "Multivariate Tests", "'energy_test'",
           "NULL", "e", "NULL", "CASE WHEN e > 0.1 THEN 'REJECT' ELSE 'ACCEPT' END"),
        _r(f"SELECT 0.5E0 * sum(abs(p_real - p_synthetic)) AS s FROM ({qg.hist2d_sql(LI_POINTS_SQL)}) _h",
           "Multivariate Tests", "'total_variation_test'", "NULL", "s", "NULL",
           "CASE WHEN s > 0.1 THEN 'REJECT' ELSE 'ACCEPT' END"),
        _r(f"SELECT sum(p_real * ln((p_real + 1e-10) / (p_synthetic + 1e-10))) AS s FROM ({qg.hist2d_sql(LI_POINTS_SQL)}) _h",
           "Multivariate Tests", "'kl_divergence_test'", "NULL", "s", "NULL",
           "CASE WHEN s > 0.1 THEN 'REJECT' ELSE 'ACCEPT' END"),
        _r(f"SELECT sqrt(2.0E0 * sum(pow(real_r - synthetic_r, 2))) AS s FROM ({qg.pairs_sql()}) _p",
           "Multivariate Tests", "'jennrich_test'", "NULL", "s", "NULL",
           "CASE WHEN s > 0.1 THEN 'REJECT' ELSE 'ACCEPT' END"),
    ]
    u = " UNION ALL ".join(parts)
    sig = f"SELECT *, p_value < 0.05 AS significant FROM ({u}) _u"
    adj = bh_sql(sig, "p_value", ["test_type"], 0.05, tiebreak=["column_name"])
    return (f"SELECT category_order, category, test_type, column_name, statistic, p_value, result, p_value_corrected, "
            f"fdr_rejected, {FDR_RESULT_SQL} AS final_result FROM ({adj}) _a")


REPORT_DBL = ("statistic", "p_value", "p_value_corrected")


def _report(spark, sf_dir):
    return validation_report(lineitem_twin(spark, sf_dir))


@register("t32_validation_report", sql=report_sql, dbl=REPORT_DBL)
def q_t32(spark, sf_dir):
    """The full validation report in seven categories with per-type BH correction."""
    return _report(spark, sf_dir)


def tally_sql() -> str:
    r = "final_result"
    a = (f"SELECT category, count(*) AS total, count_if(coalesce({r} IN ('ACCEPT', 'SUCCESS'), false)) AS passed, "
         f"count_if(coalesce({r} = 'REJECT', false)) AS failed, count_if(coalesce({r} = 'WARNING', false)) AS warnings, "
         f"count_if(coalesce({r} = 'CRITICAL', false)) AS critical FROM ({report_sql()}) _r GROUP BY ROLLUP (category)")
    rate = "CASE WHEN total > 0 THEN passed / total END"
    return (f"SELECT *, {rate} AS pass_rate, CASE WHEN {rate} >= 0.9 THEN 'excellent' WHEN {rate} >= 0.75 THEN 'good' "
            f"WHEN {rate} >= 0.6 THEN 'fair' ELSE 'poor' END AS grade FROM ({a}) _a")


@register("a28_report_tally", sql=tally_sql, dbl=("pass_rate",))
def q_a28(spark, sf_dir):
    """Verdict tally of the full report per category and overall, with pass-rate grade."""
    return tally(_report(spark, sf_dir))


@register("t33_distribution_only", sql=lambda: (
    f"SELECT * FROM ({report_sql()}) _r WHERE category = 'Distribution Tests'"), dbl=REPORT_DBL)
def q_t33(spark, sf_dir):
    """The distribution tests of the report only."""
    return _report(spark, sf_dir).where(F.col("category") == "Distribution Tests")


def info_sql() -> str:
    return ("SELECT r.n AS real_rows, s.n AS synthetic_rows, 5 AS real_columns, 4 AS synthetic_columns, "
            "false AS same_column_count, false AS same_headers, "
            "abs(r.n - s.n) / greatest(r.n, s.n) AS size_difference "
            f"FROM (SELECT count(*) AS n FROM ({CUSTOMER_SQL}) _c) r CROSS JOIN (SELECT count(*) AS n FROM ({SUPPLIER_SQL}) _s) s")


@register("a3_dataset_info", sql=info_sql, dbl=("size_difference",))
def q_a3(spark, sf_dir):
    """A3: dataset info: rows and columns per side, same count / headers, size difference."""
    r, s = customer_real(spark, sf_dir), supplier_synth(spark, sf_dir)
    rc, sc = r.columns, s.columns
    rn = r.agg(F.count("*").alias("real_rows"))
    sn = s.agg(F.count("*").alias("synthetic_rows"))
    j = rn.crossJoin(sn)
    return j.select("real_rows", "synthetic_rows", F.lit(len(rc)).alias("real_columns"),
                    F.lit(len(sc)).alias("synthetic_columns"), F.lit(len(rc) == len(sc)).alias("same_column_count"),
                    F.lit(rc == sc).alias("same_headers"),
                    (F.abs(F.col("real_rows") - F.col("synthetic_rows"))
                     / F.greatest("real_rows", "synthetic_rows")).alias("size_difference"))


@register("a28b_family_counts", sql=lambda: (
    "SELECT test_type, count(*) AS tests, count_if(coalesce(final_result IN ('ACCEPT', 'SUCCESS'), false)) AS passed, "
    f"count_if(coalesce(final_result = 'REJECT', false)) AS failed FROM ({report_sql()}) _r GROUP BY test_type"))
def q_a28b(spark, sf_dir):
    """Verdict counts per test family of the full report."""
    r = F.col("final_result")
    return _report(spark, sf_dir).groupBy("test_type").agg(
        F.count("*").alias("tests"), F.count_if(r.isin("ACCEPT", "SUCCESS")).alias("passed"),
        F.count_if(r == "REJECT").alias("failed"))


@register("a28c_issue_list", dbl=("statistic", "p_value"), sql=lambda: (
    "SELECT category, test_type, column_name, statistic, p_value, final_result, CASE WHEN final_result = 'CRITICAL' "
    "THEN 'high' WHEN final_result = 'REJECT' THEN 'medium' ELSE 'low' END AS severity "
    f"FROM ({report_sql()}) _r WHERE final_result IN ('REJECT', 'WARNING', 'CRITICAL')"))
def q_a28c(spark, sf_dir):
    """The issue list - tests whose final verdict is not a pass, with a severity."""
    r = F.col("final_result")
    return (_report(spark, sf_dir).where(r.isin("REJECT", "WARNING", "CRITICAL"))
            .select("category", "test_type", "column_name", "statistic", "p_value", "final_result",
                    F.when(r == "CRITICAL", "high").when(r == "REJECT", "medium").otherwise("low").alias("severity")))
