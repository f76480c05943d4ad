"""Full validation report (T32, T33) and its verdict tally.

Seven categories in a fixed order, every test one row of a common long
schema; BH is applied per test type across the whole report (families with
at least two p-values), flipping verdicts both ways.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import correlation as co
from ..operators import dist_tests as dt
from ..operators import grid as g
from ..operators import privacy as pv
from ..operators import profile as pr
from ..operators.fdr import bh_adjust, fdr_result
from ..operators.reshape import categorical_long, numeric_long
from ..sources.testdata import Twin

CATEGORIES = ["Range Validation", "Distribution Tests", "Correlation Validation", "Statistical Tests",
              "Outlier Detection", "Quality Metrics", "Multivariate Tests"]
REPORT_COLS = ["category_order", "category", "test_type", "column_name", "statistic", "p_value", "result"]


def _row(df: DataFrame, category: str, test_type: str | Column, column: Column | None,
         statistic: Column | None, p: Column | None, result: Column | None) -> DataFrame:
    tt = test_type if isinstance(test_type, Column) else F.lit(test_type)
    return df.select(F.lit(CATEGORIES.index(category)).alias("category_order"), F.lit(category).alias("category"),
                     tt.alias("test_type"),
                     (column if column is not None else F.lit(None)).cast("string").alias("column_name"),
                     (statistic if statistic is not None else F.lit(None)).cast("double").alias("statistic"),
                     (p if p is not None else F.lit(None)).cast("double").alias("p_value"),
                     (result if result is not None else F.lit(None)).cast("string").alias("result"))


def validation_report(twin: Twin, alpha: float = 0.05) -> DataFrame:
    """The seven categories as one long frame.

    The three relations most tests read - the per-value ECDF, per-column
    moments and categorical side counts - are computed once and cut from the
    lineage with a reliable checkpoint (``spark.checkpoint.dir``), at every
    size, so the raw data is scanned a handful of times instead of once per test.
    """
    from ..operators.reshape import side_moments, side_value_counts
    from ..session import cut_lineage
    num = numeric_long(twin)
    cat = categorical_long(twin) if twin.categorical else None
    cdf, mom = dt.ecdf(num), side_moments(num)
    cvc = side_value_counts(cat) if cat is not None else None
    cdf, mom = cut_lineage(cdf), cut_lineage(mom)
    cvc = cut_lineage(cvc) if cvc is not None else None
    parts = []
    rng = pr.numeric_range(num, moments=mom)
    parts.append(_row(rng, "Range Validation", "range_test", F.col("column_name"), F.col("range_diff"), None, None))
    if cat is not None:
        cr = pr.categorical_range(cat, vc=cvc)
        parts.append(_row(cr, "Range Validation", "categorical_range_test", F.col("column_name"),
                          F.col("overlap_ratio"), None, None))
    ks = dt.ks_test(num, alpha=alpha, fdr=False, cdf=cdf)
    parts.append(_row(ks, "Distribution Tests", "ks_test", F.col("column_name"), F.col("statistic"),
                      F.col("p_value"), F.col("result")))
    if cat is not None:
        ch = dt.chi_square_test(cat, alpha, vc=cvc)
        parts.append(_row(ch, "Distribution Tests", "chi_square_test", F.col("column_name"), F.col("statistic"),
                          F.col("p_value"), F.col("result")))
    pairs = co.pearson_pairs(twin)
    cmp = co.compare_summary(pairs)
    parts.append(_row(cmp, "Correlation Validation", "correlation_comparison", None,
                      F.col("percentage_significant"), None, F.lit("SUCCESS")))
    wt = dt.welch_t_test(num, alpha=alpha, moments=mom)
    parts.append(_row(wt, "Statistical Tests", "welch_t_test", F.col("column_name"), F.col("statistic"),
                      F.col("p_value"), F.col("result")))
    ot = pr.iqr_outliers(num, cdf=cdf)
    op = ot.groupBy("column_name").agg(
        F.max(F.when(F.col("src") == "real", F.col("outlier_percentage"))).alias("_r"),
        F.max(F.when(F.col("src") == "synthetic", F.col("outlier_percentage"))).alias("_s"))
    parts.append(_row(op, "Outlier Detection", "outlier_test", F.col("column_name"),
                      F.abs(F.col("_s") - F.col("_r")), None, None))
    comp = pr.completeness(twin)
    parts.append(_row(comp, "Quality Metrics", "completeness_test", None, F.col("ratio"), None, F.col("result")))
    cons = comp.select(F.lit(1.0).alias("ratio"))  # both sides share one schema in a twin frame
    parts.append(_row(cons, "Quality Metrics", "consistency_test", None, F.col("ratio"), None,
                      F.when(F.col("ratio") >= 0.95, "ACCEPT").otherwise("REJECT")))
    em = pv.exact_matches(twin.side("real"), twin.side("synthetic"), twin.columns)
    parts.append(_row(em, "Quality Metrics", "ExactMatchRate", None, F.col("rate"), None, F.col("result")))
    en = dt.energy_distance_1d(num, cdf=cdf).agg(F.avg("energy_distance").alias("e"))
    parts.append(_row(en, "Multivariate Tests", "energy_test", None, F.col("e"), None,
                      F.when(F.col("e") > 0.1, "REJECT").otherwise("ACCEPT")))
    pts = twin.df.select("src", "row_id", F.col(twin.numeric[0]).cast("double").alias("x"),
                         F.col(twin.numeric[1]).cast("double").alias("y"))
    h = g.hist2d_real_edges(pts)
    for name, res in (("total_variation_test", g.total_variation_2d(h)), ("kl_divergence_test", g.kl_divergence_2d(h))):
        parts.append(_row(res, "Multivariate Tests", name, None, F.col("statistic"), None, F.col("result")))
    jn = co.jennrich(pairs)
    parts.append(_row(jn, "Multivariate Tests", "jennrich_test", None, F.col("statistic"), None, F.col("result")))
    rep = parts[0]
    for p in parts[1:]:
        rep = rep.unionByName(p)
    rep = rep.withColumn("significant", F.col("p_value") < alpha)
    adj = bh_adjust(rep, "p_value", ["test_type"], alpha, tiebreak=["column_name"])
    return adj.select(*REPORT_COLS, "p_value_corrected", "fdr_rejected",
                      fdr_result().alias("final_result"))


def tally(report: DataFrame) -> DataFrame:
    """Verdict counts per category and overall (rollup row, category
    null); SUCCESS counts as passed (the reference's privacy rows otherwise
    fall through its tally)."""
    r = F.col("final_result")
    a = report.rollup("category").agg(
        F.count("*").alias("total"), F.count_if(r.isin("ACCEPT", "SUCCESS")).alias("passed"),
        F.count_if(r == "REJECT").alias("failed"), F.count_if(r == "WARNING").alias("warnings"),
        F.count_if(r == "CRITICAL").alias("critical"))
    rate = F.when(F.col("total") > 0, F.col("passed") / F.col("total"))
    grade = (F.when(rate >= 0.9, "excellent").when(rate >= 0.75, "good").when(rate >= 0.6, "fair")
              .otherwise("poor"))
    return a.select("*", rate.alias("pass_rate"), grade.alias("grade"))
