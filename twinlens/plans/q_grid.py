"""Registered grid anomaly and correlation-structure queries."""

from __future__ import annotations

from itertools import combinations

from ..functions import distributions as D
from ..operators import correlation as co
from ..operators import grid as g
from ..sources.testdata import (embedding_sql, embedding_twin, EMB_POINTS_SQL, LI_NUMERIC, LI_POINTS_SQL, LINEITEM_SQL,
                                embedding_points, lineitem_points, lineitem_twin)
from .registry import register
from .sqltext import bh_sql

DK = "duckdb"


def bounds_sql(points: str, xb: int = 20, yb: int = 20, pad: float = 0.01) -> str:
    a = (f"SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, count(*) AS n_points "
         f"FROM ({points}) _p")
    cols = []
    for ax, b in (("x", xb), ("y", yb)):
        lo, hi = f"{ax}_min", f"{ax}_max"
        start = f"(CASE WHEN {hi} = {lo} THEN {lo} - 0.5E0 ELSE {lo} END)"
        stop = f"(CASE WHEN {hi} = {lo} THEN {lo} + 0.5E0 ELSE {hi} END)"
        cols += [f"{start} AS {ax}_start", f"{stop} AS {ax}_stop", f"({stop} - {start}) / {b} AS {ax}_step",
                 f"{b} AS {ax}_bins", f"least({start}, {lo} - ({hi} - {lo}) * {pad}) AS {ax}_lo_edge",
                 f"greatest({stop}, {hi} + ({hi} - {lo}) * {pad}) AS {ax}_hi_edge"]
    return f"SELECT n_points, {', '.join(cols)} FROM ({a}) _a"


def edges_sql(points: str) -> str:
    b = bounds_sql(points)
    parts = []
    for ax in ("x", "y"):
        parts.append(
            f"SELECT '{ax}' AS axis, CAST(i.idx AS INTEGER) AS idx, CASE WHEN i.idx = 0 THEN {ax}_lo_edge "
            f"WHEN i.idx = {ax}_bins THEN {ax}_hi_edge ELSE i.idx * {ax}_step + {ax}_start END AS edge "
            f"FROM ({b}) _b, generate_series(0, {ax}_bins) AS i(idx)")
    return " UNION ALL ".join(parts)


def _cell_sql(ax: str) -> str:
    i0 = f"least(greatest(floor(({ax} - {ax}_start) / {ax}_step), 0), {ax}_bins - 1)"
    return (f"CAST(CASE WHEN {i0} > 0 AND {ax} < {i0} * {ax}_step + {ax}_start THEN {i0} - 1 "
            f"WHEN {i0} < {ax}_bins - 1 AND {ax} >= ({i0} + 1) * {ax}_step + {ax}_start THEN {i0} + 1 "
            f"ELSE {i0} END AS INTEGER)")


def cells_sql(points: str) -> str:
    return (f"SELECT src, row_id, x, y, {_cell_sql('x')} AS cell_x, {_cell_sql('y')} AS cell_y "
            f"FROM ({points}) _p CROSS JOIN ({bounds_sql(points)}) _b")


def counts_sql(points: str) -> str:
    return (f"SELECT cell_x, cell_y, count_if(src = 'real') AS real_count, count_if(src = 'synthetic') AS synthetic_count "
            f"FROM ({cells_sql(points)}) _c GROUP BY cell_x, cell_y")


def binom_sql(points: str, min_points: int = 5) -> str:
    c = counts_sql(points)
    gp = f"SELECT sum(real_count) / (sum(real_count) + sum(synthetic_count)) AS global_proportion FROM ({c}) _c"
    t = (f"SELECT cell_x, cell_y, CAST(real_count AS BIGINT) AS real_count, CAST(synthetic_count AS BIGINT) AS synthetic_count, "
         f"CAST(real_count + synthetic_count AS BIGINT) AS total_count, global_proportion FROM ({c}) _c CROSS JOIN ({gp}) _g "
         f"WHERE real_count + synthetic_count >= {min_points}")
    t2 = f"SELECT *, real_count / total_count AS cell_proportion FROM ({t}) _t"
    t3 = (f"SELECT *, cell_proportion - global_proportion AS proportion_diff, CASE WHEN cell_proportion > global_proportion "
          f"THEN '{g.REAL_OVER}' WHEN cell_proportion < global_proportion THEN '{g.SYNTH_OVER}' END AS test_type FROM ({t2}) _t2")
    p = (f"CASE WHEN test_type = '{g.REAL_OVER}' THEN {D.binom_sf_ge('real_count', 'total_count', 'global_proportion', DK)} "
         f"ELSE {D.binom_cdf('real_count', 'total_count', 'global_proportion', DK)} END")
    return (f"SELECT cell_x, cell_y, real_count, synthetic_count, total_count, cell_proportion, global_proportion, "
            f"proportion_diff, {p} AS p_value, test_type FROM ({t3}) _t3 WHERE test_type IS NOT NULL")


def detect_sql(points: str, alpha: float = 0.05) -> str:
    adj = bh_sql(binom_sql(points), "p_value", ["test_type"], alpha, min_tests=1,
                 tiebreak=["cell_x", "cell_y"], adjusted="p_value_adjusted", rejected="is_significant")
    return (f"SELECT *, CASE WHEN NOT is_significant THEN NULL WHEN test_type = '{g.REAL_OVER}' THEN '{g.REAL_COLOR}' "
            f"ELSE '{g.SYNTH_COLOR}' END AS color FROM ({adj}) _a")


CELL_DBL = ("cell_proportion", "global_proportion", "proportion_diff", "p_value", "p_value_adjusted")


@register("a13_grid_edges", sql=lambda: edges_sql(LI_POINTS_SQL), dbl=("edge",))
def q_a13(spark, sf_dir):
    return g.grid_edges(g.grid_bounds(lineitem_points(spark, sf_dir)))


@register("a14_cell_counts", sql=lambda: counts_sql(LI_POINTS_SQL))
def q_a14(spark, sf_dir):
    p = lineitem_points(spark, sf_dir)
    return g.cell_counts(g.assign_cells(p, g.grid_bounds(p)))


@register("t12_binomial_cells", sql=lambda: binom_sql(LI_POINTS_SQL), dbl=CELL_DBL[:-1])
def q_t12(spark, sf_dir):
    p = lineitem_points(spark, sf_dir)
    return g.binomial_cells(g.cell_counts(g.assign_cells(p, g.grid_bounds(p))))


@register("d1_grid_anomalies", sql=lambda: detect_sql(LI_POINTS_SQL), dbl=CELL_DBL)
def q_d1(spark, sf_dir):
    return g.detect_anomalies(lineitem_points(spark, sf_dir))


@register("d1_grid_anomalies_embeddings", sql=lambda: detect_sql(EMB_POINTS_SQL), dbl=CELL_DBL)
def q_d1e(spark, sf_dir):
    return g.detect_anomalies(embedding_points(spark, sf_dir))


def flags_sql(points: str) -> str:
    sig = f"SELECT cell_x, cell_y, test_type FROM ({detect_sql(points)}) _d WHERE is_significant"
    j = f"SELECT c.src, s.test_type FROM ({cells_sql(points)}) c LEFT JOIN ({sig}) s USING (cell_x, cell_y)"
    a = (f"SELECT src, count(*) AS n_points, count_if(coalesce(test_type = '{g.REAL_OVER}', false)) AS in_real_overpopulated, "
         f"count_if(coalesce(test_type = '{g.SYNTH_OVER}', false)) AS in_synthetic_overpopulated FROM ({j}) _j GROUP BY src")
    return f"SELECT *, (in_real_overpopulated + in_synthetic_overpopulated) / n_points AS anomaly_rate FROM ({a}) _a"


@register("j2_point_flags", sql=lambda: flags_sql(EMB_POINTS_SQL), dbl=("anomaly_rate",))
def q_j2(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    return g.point_flags(p, g.detect_anomalies(p))


def burden_sql(points: str) -> str:
    s = f"SELECT sum(abs(real_count - synthetic_count)) AS _d FROM ({detect_sql(points)}) _c WHERE is_significant"
    t = f"SELECT count(*) AS n_points FROM ({points}) _p"
    return f"SELECT coalesce(_d / n_points, 0.0E0) AS anomaly_burden FROM ({s}) _s CROSS JOIN ({t}) _t"


@register("t23_anomaly_burden", sql=lambda: burden_sql(EMB_POINTS_SQL), dbl=("anomaly_burden",))
def q_t23(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    return g.anomaly_burden(g.detect_anomalies(p), p.agg({"*": "count"}).withColumnRenamed("count(1)", "n_points"))


def hist2d_sql(points: str, bins: int = 10) -> str:
    r = (f"SELECT min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi FROM ({points}) _p "
         f"WHERE src = 'real'")

    def b(ax):
        lo, hi = f"{ax}_lo", f"{ax}_hi"
        start = f"(CASE WHEN {hi} = {lo} THEN {lo} - 0.5E0 ELSE {lo} END)"
        stop = f"(CASE WHEN {hi} = {lo} THEN {lo} + 0.5E0 ELSE {hi} END)"
        step = f"(({stop} - {start}) / {bins})"
        i0 = f"least(greatest(floor(({ax} - {start}) / {step}), 0), {bins - 1})"
        i = (f"CASE WHEN {i0} > 0 AND {ax} < {i0} * {step} + {start} THEN {i0} - 1 "
             f"WHEN {i0} < {bins - 1} AND {ax} >= ({i0} + 1) * {step} + {start} THEN {i0} + 1 ELSE {i0} END")
        return f"CAST(CASE WHEN {ax} >= {start} AND {ax} <= {stop} THEN {i} END AS INTEGER)"
    j = f"SELECT src, {b('x')} AS bin_x, {b('y')} AS bin_y FROM ({points}) _p CROSS JOIN ({r}) _r"
    c = (f"SELECT bin_x, bin_y, count_if(src = 'real') AS _r, count_if(src = 'synthetic') AS _s FROM ({j}) _j "
         f"WHERE bin_x IS NOT NULL AND bin_y IS NOT NULL GROUP BY bin_x, bin_y")
    return (f"SELECT bin_x, bin_y, _r / _tr AS p_real, _s / _ts AS p_synthetic FROM ({c}) _c CROSS JOIN "
            f"(SELECT sum(_r) AS _tr, sum(_s) AS _ts FROM ({c}) _c2) _t")


@register("a15_hist2d_real_edges", sql=lambda: hist2d_sql(LI_POINTS_SQL), dbl=("p_real", "p_synthetic"))
def q_a15(spark, sf_dir):
    return g.hist2d_real_edges(lineitem_points(spark, sf_dir))


@register("t8_total_variation_2d", dbl=("statistic",), sql=lambda: (
    "SELECT statistic, CASE WHEN statistic > 0.1 THEN 'REJECT' ELSE 'ACCEPT' END AS result FROM "
    f"(SELECT 0.5E0 * sum(abs(p_real - p_synthetic)) AS statistic FROM ({hist2d_sql(LI_POINTS_SQL)}) _h) _s"))
def q_t8(spark, sf_dir):
    return g.total_variation_2d(g.hist2d_real_edges(lineitem_points(spark, sf_dir)))


@register("t9_kl_divergence_2d", dbl=("statistic",), sql=lambda: (
    "SELECT statistic, CASE WHEN statistic > 0.1 THEN 'REJECT' ELSE 'ACCEPT' END AS result FROM "
    f"(SELECT sum(p_real * ln((p_real + 1e-10) / (p_synthetic + 1e-10))) AS statistic "
    f"FROM ({hist2d_sql(LI_POINTS_SQL)}) _h) _s"))
def q_t9(spark, sf_dir):
    return g.kl_divergence_2d(g.hist2d_real_edges(lineitem_points(spark, sf_dir)))


# ------------------------------------------------------------ correlation
def pairs_sql(rel: str = LINEITEM_SQL, cols=tuple(LI_NUMERIC)) -> str:
    parts = []
    for a, b in combinations(cols, 2):
        parts.append(
            f"SELECT '{a}' AS col_i, '{b}' AS col_j, "
            f"corr(CASE WHEN src = 'real' THEN {a} END, CASE WHEN src = 'real' THEN {b} END) AS real_r, "
            f"corr(CASE WHEN src = 'synthetic' THEN {a} END, CASE WHEN src = 'synthetic' THEN {b} END) AS synthetic_r "
            f"FROM ({rel}) _t")
    return " UNION ALL ".join(parts)


@register("t5_pearson_pairs", sql=pairs_sql, dbl=("real_r", "synthetic_r"))
def q_t5(spark, sf_dir):
    return co.pearson_pairs(lineitem_twin(spark, sf_dir))


@register("t6_correlation_compare", dbl=("percentage_significant",), sql=lambda: (
    "SELECT *, CASE WHEN total_comparisons > 0 THEN significant_differences / total_comparisons * 100.0E0 "
    "ELSE 0.0E0 END AS percentage_significant FROM (SELECT count(*) AS total_comparisons, "
    f"count_if(abs(real_r - synthetic_r) > 0.3) AS significant_differences FROM ({pairs_sql()}) _p) _s"))
def q_t6(spark, sf_dir):
    return co.compare_summary(co.pearson_pairs(lineitem_twin(spark, sf_dir)))


T6_DIMS = [f"e{i}" for i in range(8)]


@register("t6b_first_differences", dbl=("real_r", "synthetic_r", "difference"), sql=lambda: (
    "SELECT col_i, col_j, real_r, synthetic_r, abs(real_r - synthetic_r) AS difference FROM "
    f"({pairs_sql(embedding_sql(), tuple(T6_DIMS))}) _p WHERE abs(real_r - synthetic_r) > 0.02 "
    "AND NOT isnan(abs(real_r - synthetic_r)) ORDER BY col_i, col_j LIMIT 10"))
def q_t6b(spark, sf_dir):
    """T6's list; a lower threshold, as the test tables' sides are alike."""
    t = embedding_twin(spark, sf_dir)
    return co.first_differences(co.pearson_pairs(t, T6_DIMS), T6_DIMS, threshold=0.02)


@register("t7_jennrich", dbl=("statistic",), sql=lambda: (
    "SELECT statistic, CASE WHEN statistic > 0.1 THEN 'REJECT' ELSE 'ACCEPT' END AS result FROM "
    f"(SELECT sqrt(2.0E0 * sum(pow(real_r - synthetic_r, 2))) AS statistic FROM ({pairs_sql()}) _p) _s"))
def q_t7(spark, sf_dir):
    return co.jennrich(co.pearson_pairs(lineitem_twin(spark, sf_dir)))


@register("t22_bivariate_score", dbl=("bivariate_distance",), sql=lambda: (
    "SELECT count(*) AS pairs, avg(abs(real_r - synthetic_r)) AS bivariate_distance "
    f"FROM ({pairs_sql()}) _p WHERE real_r IS NOT NULL AND synthetic_r IS NOT NULL "
    "AND NOT isnan(real_r) AND NOT isnan(synthetic_r)"))
def q_t22(spark, sf_dir):
    return co.bivariate_score(co.pearson_pairs(lineitem_twin(spark, sf_dir)))


LI_NULLS = ("SELECT src, row_id, l_quantity, l_extendedprice, nullif(l_discount, 0.0E0) AS l_discount, "
            f"nullif(l_tax, 0.0E0) AS l_tax FROM ({LINEITEM_SQL}) _li")


def strict_pairs_sql() -> str:
    parts = []
    for a, b in combinations(LI_NUMERIC, 2):
        ok = lambda side: (f"count_if(src = '{side}' AND ({a} IS NULL OR isnan({a}))) + "  # noqa: E731
                           f"count_if(src = '{side}' AND ({b} IS NULL OR isnan({b}))) = 0")
        parts.append(
            f"SELECT '{a}' AS col_i, '{b}' AS col_j, CASE WHEN {ok('real')} THEN "
            f"corr(CASE WHEN src = 'real' THEN {a} END, CASE WHEN src = 'real' THEN {b} END) END AS real_r, "
            f"CASE WHEN {ok('synthetic')} THEN corr(CASE WHEN src = 'synthetic' THEN {a} END, "
            f"CASE WHEN src = 'synthetic' THEN {b} END) END AS synthetic_r FROM ({LI_NULLS}) _t")
    return " UNION ALL ".join(parts)


@register("t5_pearson_strict", sql=strict_pairs_sql, dbl=("real_r", "synthetic_r"))
def q_t5s(spark, sf_dir):
    """T5 strict: a column with any missing value poisons its coefficients
    (missing values injected in the query: zero discount / tax)."""
    from pyspark.sql import functions as F

    from ..sources.testdata import Twin
    t = lineitem_twin(spark, sf_dir)
    df = t.df.select("src", "row_id", "l_quantity", "l_extendedprice",
                     F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"),
                     F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"))
    return co.pearson_pairs(Twin(df, t.numeric, []), strict=True)
