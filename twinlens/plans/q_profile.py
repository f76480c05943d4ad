"""Registered profiles (A1-A12, A19, A21, R4) on the lineitem / orders bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as pr
from ..operators.reshape import categorical_long, numeric_long
from ..sources.testdata import (LI_NUMERIC, LINEITEM_SQL, OR_CATEGORICAL, ORDERS_SQL, Twin,
                                lineitem_twin, orders_twin)
from .registry import register
from .sqltext import long_sql

LI_LONG = long_sql(LINEITEM_SQL, LI_NUMERIC)
OR_CAT_LONG = long_sql(ORDERS_SQL, OR_CATEGORICAL, cast="VARCHAR")


def _range_sql() -> str:
    aggs = []
    for lab, side in (("real", "real"), ("synthetic", "synthetic")):
        for f, n in (("min", "min"), ("max", "max"), ("avg", "mean"), ("stddev_samp", "std")):
            aggs.append(f"{f}(CASE WHEN src = '{side}' THEN value END) AS {n}_{lab}")
    a = (f"SELECT column_name, count_if(src = 'real') AS n_real, count_if(src = 'synthetic') AS n_synthetic, "
         f"{', '.join(aggs)} FROM ({LI_LONG}) _l GROUP BY column_name")
    return ("SELECT column_name, min_real, max_real, mean_real, std_real, min_synthetic, max_synthetic, "
            "mean_synthetic, std_synthetic, CASE WHEN max_real - min_real <> 0 THEN "
            "abs((max_real - min_real) - (max_synthetic - min_synthetic)) / (max_real - min_real) ELSE 0.0E0 END "
            "AS range_diff, abs(mean_real - mean_synthetic) AS mean_diff, abs(std_real - std_synthetic) AS std_diff "
            f"FROM ({a}) _a WHERE n_real > 0 AND n_synthetic > 0")


@register("a1_numeric_range", sql=_range_sql,
          dbl=("min_real", "max_real", "mean_real", "std_real", "min_synthetic", "max_synthetic",
               "mean_synthetic", "std_synthetic", "range_diff", "mean_diff", "std_diff"))
def q_a1(spark, sf_dir):
    return pr.numeric_range(numeric_long(lineitem_twin(spark, sf_dir)))


def _cat_range_sql(long_rel: str = OR_CAT_LONG, show: int = 10) -> str:
    vc = (f"SELECT column_name, value, count_if(src = 'real') AS n_real, count_if(src = 'synthetic') AS n_synth "
          f"FROM ({long_rel}) _l GROUP BY column_name, value")
    ranked = (f"SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY CASE WHEN n_real > 0 THEN 0 ELSE 1 END, value) AS _rr, "
              f"row_number() OVER (PARTITION BY column_name ORDER BY CASE WHEN n_synth > 0 THEN 0 ELSE 1 END, value) AS _rs "
              f"FROM ({vc}) _v")
    a = ("SELECT column_name, count_if(n_real > 0) AS real_unique, count_if(n_synth > 0) AS synthetic_unique, "
         "count_if(n_synth > 0 AND NOT n_real > 0) AS new_categories, "
         "count_if(n_real > 0 AND NOT n_synth > 0) AS missing_categories, "
         "count_if(n_real > 0 AND n_synth > 0) AS _shared, "
         f"array_to_string(list_sort(list(value) FILTER (WHERE n_real > 0 AND _rr <= {show})), '|') AS real_values, "
         f"array_to_string(list_sort(list(value) FILTER (WHERE n_synth > 0 AND _rs <= {show})), '|') AS synthetic_values "
         f"FROM ({ranked}) _r GROUP BY column_name")
    return ("SELECT column_name, real_unique, synthetic_unique, new_categories, missing_categories, "
            "CASE WHEN real_unique > 0 THEN _shared / real_unique ELSE 0.0E0 END AS overlap_ratio, "
            f"real_values, synthetic_values FROM ({a}) _a")


@register("a2_categorical_range", sql=_cat_range_sql, dbl=("overlap_ratio",))
def q_a2(spark, sf_dir):
    return pr.categorical_range(categorical_long(orders_twin(spark, sf_dir)))


def _desc_sql(pop: bool = False) -> str:
    std = "stddev_pop" if pop else "stddev_samp"
    return (f"SELECT src, column_name, count(value) AS count, avg(value) AS mean, {std}(value) AS std, "
            f"min(value) AS min, quantile_cont(value, 0.5) AS median, max(value) AS max "
            f"FROM ({LI_LONG}) _l GROUP BY src, column_name")


@register("a4_descriptive", sql=lambda: _desc_sql(False), dbl=("mean", "std", "min", "median", "max"))
def q_a4(spark, sf_dir):
    return pr.descriptive(numeric_long(lineitem_twin(spark, sf_dir)))


@register("a19_summary_population", sql=lambda: _desc_sql(True), dbl=("mean", "std", "min", "median", "max"))
def q_a19(spark, sf_dir):
    return pr.descriptive(numeric_long(lineitem_twin(spark, sf_dir)), population_std=True)


# nulls injected in the query (the tables have none): zero discount / tax -> missing
def _li_with_nulls(spark, sf_dir) -> Twin:
    t = lineitem_twin(spark, sf_dir)
    df = t.df.select("src", "row_id", "l_quantity", "l_extendedprice",
                     F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"),
                     F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"), "l_linestatus")
    return Twin(df, t.numeric, t.categorical)


LI_NULLS_SQL = ("SELECT src, row_id, l_quantity, l_extendedprice, nullif(l_discount, 0.0E0) AS l_discount, "
                f"nullif(l_tax, 0.0E0) AS l_tax, l_linestatus FROM ({LINEITEM_SQL}) _li")


def _completeness_sql() -> str:
    nulls = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END"
                       for c in LI_NUMERIC + ["l_linestatus"])
    per = (f"SELECT sum(CASE WHEN src = 'real' THEN {nulls} END) AS _nr, count_if(src = 'real') AS _rr, "
           f"sum(CASE WHEN src = 'synthetic' THEN {nulls} END) AS _ns, count_if(src = 'synthetic') AS _rs "
           f"FROM ({LI_NULLS_SQL}) _t")
    out = (f"SELECT 1 - _nr / (_rr * 5.0E0) AS real_completeness, 1 - _ns / (_rs * 5.0E0) AS synthetic_completeness "
           f"FROM ({per}) _p")
    r = (f"SELECT *, CASE WHEN real_completeness > 0 THEN synthetic_completeness / real_completeness "
         f"ELSE 0.0E0 END AS ratio FROM ({out}) _o")
    return f"SELECT *, CASE WHEN ratio >= 0.95 THEN 'ACCEPT' ELSE 'REJECT' END AS result FROM ({r}) _r"


@register("a5_completeness", sql=_completeness_sql,
          dbl=("real_completeness", "synthetic_completeness", "ratio"))
def q_a5(spark, sf_dir):
    return pr.completeness(_li_with_nulls(spark, sf_dir))


def _fences_sql(k: float = 1.5) -> str:
    q = (f"SELECT src, column_name, count(*) AS n, quantile_cont(value, 0.25) AS q1, "
         f"quantile_cont(value, 0.75) AS q3 FROM ({LI_LONG}) _l GROUP BY src, column_name")
    return (f"SELECT *, q3 - q1 AS iqr, q1 - {k} * (q3 - q1) AS lower_fence, q3 + {k} * (q3 - q1) AS upper_fence "
            f"FROM ({q}) _q")


def _iqr_sql() -> str:
    f = _fences_sql()
    cnt = (f"SELECT l.src, l.column_name, count_if(l.value < f.lower_fence OR l.value > f.upper_fence) AS oc "
           f"FROM ({LI_LONG}) l JOIN ({f}) f USING (src, column_name) GROUP BY l.src, l.column_name")
    return ("SELECT f.src, f.column_name, f.n, q1, q3, iqr, lower_fence, upper_fence, "
            "coalesce(oc, 0) AS outlier_count, coalesce(oc, 0) / f.n * 100.0E0 AS outlier_percentage "
            f"FROM ({f}) f LEFT JOIN ({cnt}) c USING (src, column_name) WHERE f.n >= 4")


@register("a7_iqr_outliers", sql=_iqr_sql,
          dbl=("q1", "q3", "iqr", "lower_fence", "upper_fence", "outlier_percentage"))
def q_a7(spark, sf_dir):
    return pr.iqr_outliers(numeric_long(lineitem_twin(spark, sf_dir)))


def _first_outliers_sql() -> str:
    f = _fences_sql()
    j = (f"SELECT l.src, l.column_name, l.row_id, l.value, row_number() OVER "
         f"(PARTITION BY l.src, l.column_name ORDER BY l.row_id) AS ordinal FROM ({LI_LONG}) l "
         f"JOIN ({f}) f USING (src, column_name) WHERE l.value < f.lower_fence OR l.value > f.upper_fence")
    return f"SELECT src, column_name, ordinal, value FROM ({j}) _j WHERE ordinal <= 5"


@register("r4_first_outliers", sql=_first_outliers_sql, dbl=("value",))
def q_r4(spark, sf_dir):
    return pr.first_outliers(numeric_long(lineitem_twin(spark, sf_dir)))


def _shares_sql() -> str:
    vc = (f"SELECT column_name, value, count_if(src = 'real') AS n_real, count_if(src = 'synthetic') AS n_synth "
          f"FROM ({OR_CAT_LONG}) _l GROUP BY column_name, value")
    return ("SELECT column_name, value AS category, n_real AS real_count, n_synth AS synthetic_count, "
            "round(n_real * 100.0E0 / sum(n_real) OVER (PARTITION BY column_name), 2) AS real_pct, "
            "round(n_synth * 100.0E0 / sum(n_synth) OVER (PARTITION BY column_name), 2) AS synthetic_pct "
            f"FROM ({vc}) _v")


@register("a8_category_shares", sql=_shares_sql, dbl=("real_pct", "synthetic_pct"))
def q_a8(spark, sf_dir):
    return pr.category_shares(categorical_long(orders_twin(spark, sf_dir)))


def _bar_sql() -> str:
    return (f"SELECT column_name, value AS category, count_if(src = 'real') AS real_count, "
            f"count_if(src = 'synthetic') AS synthetic_count FROM ({OR_CAT_LONG}) _l "
            f"GROUP BY column_name, value")


@register("a9_bar_counts", sql=_bar_sql)
def q_a9(spark, sf_dir):
    vc = pr.category_shares(categorical_long(orders_twin(spark, sf_dir)))
    return vc.select("column_name", "category", "real_count", "synthetic_count").orderBy("column_name", "category")


def _hist_sql(fixed: int | None = None) -> str:
    b = ("SELECT column_name, min(value) AS _lo, max(value) AS _hi, count(*) AS _n, "
         "count_if(src = 'real') AS _nr, count_if(src = 'synthetic') AS _ns "
         f"FROM ({LI_LONG}) _l GROUP BY column_name")
    nb = str(fixed) if fixed else "least(30, CAST(ceil(sqrt(_n)) AS INTEGER))"
    b2 = f"SELECT *, CASE WHEN _hi - _lo = 0 THEN 1 ELSE {nb} END AS bins FROM ({b}) _b"
    b3 = (f"SELECT *, CASE WHEN _hi - _lo = 0 THEN 1.0E0 ELSE (_hi - _lo) / bins END AS bin_size FROM ({b2}) _b2")
    b4 = (f"SELECT *, CASE WHEN _hi - _lo = 0 THEN _lo - 0.5E0 ELSE _lo - bin_size * 0.1E0 END AS start "
          f"FROM ({b3}) _b3")
    idx = ("CAST(least(floor((l.value - b.start) / b.bin_size), b.bins - 1 + "
           "CASE WHEN b._hi - b._lo = 0 THEN 0 ELSE 1 END) AS INTEGER)")
    h = (f"SELECT l.column_name, {idx} AS bin, count_if(l.src = 'real') AS real_count, "
         f"count_if(l.src = 'synthetic') AS synthetic_count, any_value(b.start) AS _start, "
         f"any_value(b.bin_size) AS bin_size, any_value(b._nr) AS _nr, any_value(b._ns) AS _ns "
         f"FROM ({LI_LONG}) l JOIN ({b4}) b USING (column_name) GROUP BY l.column_name, {idx}")
    return ("SELECT column_name, bin, _start + bin * bin_size AS bin_start, _start + (bin + 1) * bin_size AS bin_end, "
            "real_count, synthetic_count, real_count / (_nr * bin_size) AS real_density, "
            f"synthetic_count / (_ns * bin_size) AS synthetic_density FROM ({h}) _h")


HIST_DBL = ("bin_start", "bin_end", "real_density", "synthetic_density")


@register("a11_histogram", sql=lambda: _hist_sql(None), dbl=HIST_DBL)
def q_a11(spark, sf_dir):
    return pr.histogram(numeric_long(lineitem_twin(spark, sf_dir)))


@register("a11b_histogram_30", sql=lambda: _hist_sql(30), dbl=HIST_DBL)
def q_a11b(spark, sf_dir):
    return pr.histogram(numeric_long(lineitem_twin(spark, sf_dir)), fixed_bins=30)


def _disc_sql() -> str:
    vc = (f"SELECT column_name, value, count_if(src = 'real') AS n_real, count_if(src = 'synthetic') AS n_synth "
          f"FROM ({OR_CAT_LONG}) _l GROUP BY column_name, value")
    return ("SELECT column_name, value, n_real AS real_count, n_synth AS synthetic_count, "
            "n_real / sum(n_real) OVER (PARTITION BY column_name) AS real_share, "
            f"n_synth / sum(n_synth) OVER (PARTITION BY column_name) AS synthetic_share FROM ({vc}) _v")


@register("a11c_discrete_histogram", sql=_disc_sql, dbl=("real_share", "synthetic_share"))
def q_a11c(spark, sf_dir):
    return pr.discrete_histogram(categorical_long(orders_twin(spark, sf_dir)))


def _five_sql() -> str:
    return ("SELECT src, column_name, count(*) AS n, quantile_cont(value, 0.0) AS min, "
            "quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, "
            "quantile_cont(value, 0.75) AS q3, quantile_cont(value, 1.0) AS max "
            f"FROM ({LI_LONG}) _l GROUP BY src, column_name")


@register("a12_five_number", sql=_five_sql, dbl=("min", "q1", "median", "q3", "max"))
def q_a12(spark, sf_dir):
    return pr.five_number(numeric_long(lineitem_twin(spark, sf_dir)))


@register("a21_side_totals", sql=f"SELECT src, count(*) AS rows FROM ({LINEITEM_SQL}) _l GROUP BY src")
def q_a21(spark, sf_dir):
    return pr.side_totals(lineitem_twin(spark, sf_dir))
