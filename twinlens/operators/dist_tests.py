"""Two-sample distribution tests on long frames.

Statistics come from aggregated rows only: per-(column, value) side counts,
prefix sums over distinct values, per-column moments. p-values are SQL
expressions applied to the one-row-per-test result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import chi2_pvalue, ks_pvalue, norm_sf, t_pvalue
from ..session import ship_package
from .fdr import bh_adjust, fdr_result
from .reshape import running_totals, side_moments, side_value_counts


def _ecdf(long_num: DataFrame) -> DataFrame:
    vc = side_value_counts(long_num)
    return running_totals(vc, "column_name", "value", ["n_real", "n_synth"])


def ecdf(long_num: DataFrame) -> DataFrame:
    """The shared per-(column, value) relation: side counts and inclusive
    prefix sums / totals. KS, energy, Mann-Whitney and exact side quantiles
    all read it, so a report can materialise it once."""
    return _ecdf(long_num)


def ks_statistic(long_num: DataFrame, cdf: DataFrame | None = None) -> DataFrame:
    """(column_name, n_real, n_synthetic, statistic): sup |F_real - F_synth|."""
    cdf = cdf if cdf is not None else _ecdf(long_num)
    gap = F.abs(F.col("cum_n_real") / F.nullif(F.col("tot_n_real"), F.lit(0))
                - F.col("cum_n_synth") / F.nullif(F.col("tot_n_synth"), F.lit(0)))
    return cdf.groupBy("column_name").agg(
        F.max("tot_n_real").cast("long").alias("n_real"),
        F.max("tot_n_synth").cast("long").alias("n_synthetic"),
        F.max(gap).alias("statistic"))


def ks_test(long_num: DataFrame, min_n: int = 30, alpha: float = 0.05,
            fdr: bool = True, cdf: DataFrame | None = None) -> DataFrame:
    """KS per numeric column, INSUFFICIENT_DATA below ``min_n`` per side,
    then BH across the ks family."""
    st = ks_statistic(long_num, cdf)
    enough = (F.col("n_real") >= min_n) & (F.col("n_synthetic") >= min_n)
    out = st.select(
        "column_name", "n_real", "n_synthetic",
        F.when(enough, F.col("statistic")).alias("statistic"),
        F.when(enough, ks_pvalue("statistic", "n_real", "n_synthetic")).alias("p_value"))
    out = out.select("*", (F.col("p_value") < alpha).alias("significant"),
                     F.when(F.col("p_value").isNull(), F.lit("INSUFFICIENT_DATA"))
                      .when(F.col("p_value") < alpha, F.lit("REJECT"))
                      .otherwise(F.lit("ACCEPT")).alias("result"))
    if not fdr:
        return out
    adj = bh_adjust(out, "p_value", None, alpha, tiebreak=["column_name"])
    return adj.withColumn("final_result", fdr_result())


def chi_square_test(long_cat: DataFrame, alpha: float = 0.05, vc: DataFrame | None = None) -> DataFrame:
    """Chi-square on the 2 x K table of side counts per category.

    Yates' correction applies when dof = 1 (K = 2), as SciPy's default does;
    K = 1 gives statistic 0 and p 1. A side without any value is an ERROR.
    """
    vc = vc if vc is not None else side_value_counts(long_cat)
    tot = vc.groupBy("column_name").agg(
        F.sum("n_real").alias("R"), F.sum("n_synth").alias("S"), F.count("*").alias("K"))
    j = vc.join(tot, "column_name")  # one row per column on the right
    n = F.col("R") + F.col("S")
    both = (F.col("n_real") + F.col("n_synth")).cast("double")  # products of counts exceed a long
    e_r, e_s = F.col("R") * both / n, F.col("S") * both / n

    def cell(obs, exp):
        diff = exp - F.col(obs)
        corr = F.when(F.col("K") == 2, F.signum(diff) * F.least(F.lit(0.5), F.abs(diff))).otherwise(0.0)
        o = F.col(obs) + corr
        return F.pow(o - exp, 2) / F.nullif(exp, F.lit(0.0))

    st = j.groupBy("column_name").agg(
        F.first("K").alias("K"), F.first("R").alias("n_real"), F.first("S").alias("n_synthetic"), F.first("R").alias("R"), F.first("S").alias("S"),
        F.sum(cell("n_real", e_r) + cell("n_synth", e_s)).alias("statistic"))
    st = st.select(
        "column_name", F.col("n_real").cast("long").alias("n_real"),
        F.col("n_synthetic").cast("long").alias("n_synthetic"),
        (F.col("K") - 1).cast("long").alias("dof"),
        F.when((F.col("R") == 0) | (F.col("S") == 0), F.lit(None)).when(F.col("K") <= 1, F.lit(0.0))
        .otherwise(F.col("statistic")).alias("statistic"))
    out = st.select("*", F.when(F.col("statistic").isNull(), F.lit(None)).when(F.col("dof") <= 0, F.lit(1.0))
                    .otherwise(chi2_pvalue("statistic", "dof")).alias("p_value"))
    return out.select("*", (F.col("p_value") < alpha).alias("significant"),
                      F.when(F.col("statistic").isNull(), "ERROR")
                      .when(F.col("p_value") < alpha, "REJECT").otherwise("ACCEPT").alias("result"))


def welch_t_test(long_num: DataFrame, min_n: int = 20, alpha: float = 0.05,
                 moments: DataFrame | None = None) -> DataFrame:
    """Welch's t with sample variances and Welch-Satterthwaite dof."""
    m = (moments if moments is not None else side_moments(long_num)).select(
        "column_name", "n_real", "n_synthetic", "mean_real", "mean_synthetic",
        F.col("var_real").alias("_vr"), F.col("var_synthetic").alias("_vs"))
    se_r = F.col("_vr") / F.col("n_real")
    se_s = F.col("_vs") / F.col("n_synthetic")
    enough = (F.col("n_real") >= min_n) & (F.col("n_synthetic") >= min_n)
    t = m.select(
        "column_name", "n_real", "n_synthetic", "mean_real", "mean_synthetic",
        F.when(enough, (F.col("mean_real") - F.col("mean_synthetic"))
               / F.sqrt(F.nullif(se_r + se_s, F.lit(0.0)))).alias("statistic"),
        F.when(enough, F.pow(se_r + se_s, 2) / F.nullif(
            F.pow(se_r, 2) / (F.col("n_real") - 1) + F.pow(se_s, 2) / (F.col("n_synthetic") - 1),
            F.lit(0.0))).alias("dof"))
    out = t.select("*", t_pvalue("statistic", "dof").alias("p_value"))
    return out.select("*", (F.col("p_value") < alpha).alias("significant"),
                      F.when(~enough, "INSUFFICIENT_DATA")
                       .when(F.col("p_value") < alpha, "REJECT").otherwise("ACCEPT").alias("result"))


def mann_whitney_u(long_num: DataFrame) -> DataFrame:
    """Two-sided Mann-Whitney U with tie-averaged ranks, tie-corrected
    normal approximation and continuity correction; ranks come from prefix
    sums over distinct values (no global sort of rows)."""
    # same ECDF relation as KS / energy / quantiles, so plans can share it
    rt = _ecdf(long_num).select(
        "*", (F.col("n_real") + F.col("n_synth")).alias("n_all"),
        (F.col("cum_n_real") + F.col("cum_n_synth")).alias("cum_n_all"))
    avg_rank = F.col("cum_n_all") - F.col("n_all") + (F.col("n_all") + 1) / 2.0
    agg = rt.groupBy("column_name").agg(
        F.sum(F.col("n_real") * avg_rank).alias("rank_sum_real"),
        F.sum(F.col("n_real")).cast("long").alias("n_real"),
        F.sum(F.col("n_synth")).cast("long").alias("n_synthetic"),
        F.sum(F.pow(F.col("n_all").cast("double"), 3) - F.col("n_all")).alias("_ties"))
    n1, n2 = F.col("n_real").cast("double"), F.col("n_synthetic").cast("double")
    n = n1 + n2
    u1 = F.col("rank_sum_real") - n1 * (n1 + 1) / 2.0
    mu = n1 * n2 / 2.0
    sigma = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    u = agg.select("column_name", "n_real", "n_synthetic", u1.alias("u_statistic"),
                   mu.alias("_mu"), sigma.alias("_sigma"))
    big = F.greatest(F.col("u_statistic"), F.col("n_real").cast("double") * F.col("n_synthetic") - F.col("u_statistic"))
    z = u.select("*", ((big - F.col("_mu") - 0.5) / F.nullif(F.col("_sigma"), F.lit(0.0))).alias("z"))
    return z.select("column_name", "n_real", "n_synthetic", "u_statistic", "z",
                    F.least(F.lit(1.0), 2.0 * norm_sf("z")).alias("p_value"))


def energy_distance_1d(long_num: DataFrame,
                       cdf: DataFrame | None = None) -> DataFrame:
    """T10 per column: E = sqrt(2 * integral (F - G)^2 dx), exact.

    With d_j = F(v_j) - G(v_j) over the sorted distinct values and d = 0 at the
    last value, sum_j d_j^2 (v_{j+1} - v_j) = sum_j v_j (d_{j-1}^2 - d_j^2),
    and d_{j-1} is the exclusive prefix of the same row. So no ``lead`` is
    needed and the prefix sums stay two-level on a cluster."""
    cdf = cdf if cdf is not None else _ecdf(long_num)
    # a side without values has no distribution: the distance is null
    fr, gs = F.nullif(F.col("tot_n_real"), F.lit(0)), F.nullif(F.col("tot_n_synth"), F.lit(0))
    d = F.col("cum_n_real") / fr - F.col("cum_n_synth") / gs
    d_prev = (F.col("cum_n_real") - F.col("n_real")) / fr - (F.col("cum_n_synth") - F.col("n_synth")) / gs
    seg = cdf.select("column_name", (F.col("value") * (F.pow(d_prev, 2) - F.pow(d, 2))).alias("_a"))
    area = F.sum("_a")
    return seg.groupBy("column_name").agg(F.when(area.isNotNull(), F.sqrt(2.0 * F.greatest(area, F.lit(0.0))))
                                          .alias("energy_distance"))


def ks_test_auto(long_num: DataFrame, min_n: int = 30, alpha: float = 0.05) -> DataFrame:
    """T1 with SciPy's 'auto' p-value: the exact lattice-path probability when
    both sides have at most 10,000 values, else the asymptotic series; the
    ``method`` column says which. The exact part is an Arrow-batched pandas
    UDF over the one-row-per-column statistics (never over data rows)."""
    from pyspark.sql.functions import pandas_udf

    from ..functions.exact_ks import ks_pvalues

    @pandas_udf("p_value_auto double, method string")
    def auto(n_real, n_synth, stat, p_asymp):
        return ks_pvalues(n_real, n_synth, stat, p_asymp)

    ship_package(long_num.sparkSession)
    base = ks_test(long_num, min_n, alpha, fdr=False)
    a = base.select("column_name", "n_real", "n_synthetic", "statistic",
                    F.col("p_value").alias("p_value_asymptotic"),
                    auto("n_real", "n_synthetic", "statistic", "p_value").alias("_a"))
    out = a.select("*", F.col("_a.p_value_auto").alias("p_value"), F.col("_a.method").alias("method")).drop("_a")
    out = out.select("*", (F.col("p_value") < alpha).alias("significant"),
                     F.when(F.col("p_value").isNull(), F.lit("INSUFFICIENT_DATA"))
                      .when(F.col("p_value") < alpha, F.lit("REJECT")).otherwise(F.lit("ACCEPT")).alias("result"))
    adj = bh_adjust(out, "p_value", None, alpha, tiebreak=["column_name"])
    return adj.withColumn("final_result", fdr_result())
