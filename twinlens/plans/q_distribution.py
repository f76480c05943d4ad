"""Registered distribution tests on the lineitem binding."""

from __future__ import annotations

from ..functions import distributions as D
from ..operators import dist_tests as dt
from ..operators.reshape import categorical_long, numeric_long
from ..sources.testdata import LI_CATEGORICAL, LI_NUMERIC, LINEITEM_SQL, lineitem_twin
from .registry import register
from .sqltext import FDR_RESULT_SQL, bh_sql, ecdf_sql, long_sql, value_counts_sql

DK = "duckdb"
LI_LONG = long_sql(LINEITEM_SQL, LI_NUMERIC)
LI_CAT_LONG = long_sql(LINEITEM_SQL, LI_CATEGORICAL, cast="VARCHAR")


def ks_sql(long_rel: str = LI_LONG, min_n: int = 30, alpha: float = 0.05) -> str:
    cdf = ecdf_sql(value_counts_sql(long_rel))
    st = ("SELECT column_name, CAST(max(tot_n_real) AS BIGINT) AS n_real, "
          "CAST(max(tot_n_synth) AS BIGINT) AS n_synthetic, "
          "max(abs(cum_n_real / nullif(tot_n_real, 0) - cum_n_synth / nullif(tot_n_synth, 0))) AS statistic "
          f"FROM ({cdf}) _c GROUP BY column_name")
    enough = f"n_real >= {min_n} AND n_synthetic >= {min_n}"
    pv = ("SELECT column_name, n_real, n_synthetic, "
          f"CASE WHEN {enough} THEN statistic END AS statistic, "
          f"CASE WHEN {enough} THEN {D.ks_sf('statistic', 'n_real', 'n_synthetic', DK)} END AS p_value "
          f"FROM ({st}) _s")
    res = (f"SELECT *, p_value < {alpha} AS significant, CASE WHEN p_value IS NULL THEN 'INSUFFICIENT_DATA' "
           f"WHEN p_value < {alpha} THEN 'REJECT' ELSE 'ACCEPT' END AS result FROM ({pv}) _p")
    adj = bh_sql(res, "p_value", None, alpha, tiebreak=["column_name"])
    return f"SELECT *, {FDR_RESULT_SQL} AS final_result FROM ({adj}) _f"


@register("t1_ks_test", sql=ks_sql, dbl=("statistic", "p_value", "p_value_corrected"))
def q_ks(spark, sf_dir):
    """Flagship: which numeric columns of the synthetic side differ?"""
    return dt.ks_test(numeric_long(lineitem_twin(spark, sf_dir)))


def ks_stat_sql() -> str:
    cdf = ecdf_sql(value_counts_sql(LI_LONG))
    return ("SELECT column_name, CAST(max(tot_n_real) AS BIGINT) AS n_real, "
            "CAST(max(tot_n_synth) AS BIGINT) AS n_synthetic, "
            "max(abs(cum_n_real / nullif(tot_n_real, 0) - cum_n_synth / nullif(tot_n_synth, 0))) AS statistic "
            f"FROM ({cdf}) _c GROUP BY column_name")


@register("t1b_ks_statistic", sql=ks_stat_sql, dbl=("statistic",))
def q_ks_stat(spark, sf_dir):
    return dt.ks_statistic(numeric_long(lineitem_twin(spark, sf_dir)))


def chi2_sql(long_rel: str = LI_CAT_LONG, alpha: float = 0.05) -> str:
    vc = value_counts_sql(long_rel)
    tot = (f"SELECT column_name, sum(n_real) AS R, sum(n_synth) AS S, count(*) AS K "
           f"FROM ({vc}) _v GROUP BY column_name")
    j = (f"SELECT v.*, t.R, t.S, t.K, t.R * (v.n_real + v.n_synth) / (t.R + t.S) AS e_r, "
         f"t.S * (v.n_real + v.n_synth) / (t.R + t.S) AS e_s FROM ({vc}) v JOIN ({tot}) t USING (column_name)")

    def cell(obs, exp):
        corr = (f"CASE WHEN K = 2 THEN sign({exp} - {obs}) * least(0.5E0, abs({exp} - {obs})) ELSE 0.0E0 END")
        return f"pow({obs} + {corr} - {exp}, 2) / nullif({exp}, 0)"
    st = (f"SELECT column_name, any_value(K) AS K, CAST(any_value(R) AS BIGINT) AS n_real, "
          f"CAST(any_value(S) AS BIGINT) AS n_synthetic, "
          f"sum({cell('n_real', 'e_r')} + {cell('n_synth', 'e_s')}) AS statistic FROM ({j}) _j GROUP BY column_name")
    st2 = ("SELECT column_name, n_real, n_synthetic, CAST(K - 1 AS BIGINT) AS dof, "
           "CASE WHEN K <= 1 THEN 0.0E0 ELSE statistic END AS statistic FROM (" + st + ") _s")
    pv = (f"SELECT *, CASE WHEN dof <= 0 THEN 1.0E0 ELSE {D.chi2_sf('statistic', 'dof', DK)} END AS p_value "
          f"FROM ({st2}) _t")
    return (f"SELECT *, p_value < {alpha} AS significant, CASE WHEN p_value < {alpha} THEN 'REJECT' "
            f"ELSE 'ACCEPT' END AS result FROM ({pv}) _p")


ORDERS_CAT_NOTE = "lineitem l_linestatus (K = 2, Yates)"


@register("t2_chi_square", sql=chi2_sql, dbl=("statistic", "p_value"), note=ORDERS_CAT_NOTE)
def q_chi2(spark, sf_dir):
    return dt.chi_square_test(categorical_long(lineitem_twin(spark, sf_dir)))


def welch_sql(long_rel: str = LI_LONG, min_n: int = 20, alpha: float = 0.05) -> str:
    m = ("SELECT column_name, count_if(src = 'real') AS n_real, count_if(src = 'synthetic') AS n_synthetic, "
         "avg(CASE WHEN src = 'real' THEN value END) AS mean_real, "
         "avg(CASE WHEN src = 'synthetic' THEN value END) AS mean_synthetic, "
         "var_samp(CASE WHEN src = 'real' THEN value END) AS _vr, "
         "var_samp(CASE WHEN src = 'synthetic' THEN value END) AS _vs "
         f"FROM ({long_rel}) _l GROUP BY column_name")
    enough = f"n_real >= {min_n} AND n_synthetic >= {min_n}"
    t = ("SELECT column_name, n_real, n_synthetic, mean_real, mean_synthetic, "
         f"CASE WHEN {enough} THEN (mean_real - mean_synthetic) / sqrt(nullif(_vr / n_real + _vs / n_synthetic, 0)) END AS statistic, "
         f"CASE WHEN {enough} THEN pow(_vr / n_real + _vs / n_synthetic, 2) / nullif(pow(_vr / n_real, 2) / (n_real - 1) "
         f"+ pow(_vs / n_synthetic, 2) / (n_synthetic - 1), 0) END AS dof FROM ({m}) _m")
    pv = f"SELECT *, {D.t_two_sided('statistic', 'dof', DK)} AS p_value FROM ({t}) _t"
    return (f"SELECT *, p_value < {alpha} AS significant, CASE WHEN NOT ({enough}) THEN 'INSUFFICIENT_DATA' "
            f"WHEN p_value < {alpha} THEN 'REJECT' ELSE 'ACCEPT' END AS result FROM ({pv}) _p")


@register("t3_welch_t", sql=welch_sql,
          dbl=("mean_real", "mean_synthetic", "statistic", "dof", "p_value"))
def q_welch(spark, sf_dir):
    return dt.welch_t_test(numeric_long(lineitem_twin(spark, sf_dir)))


def mwu_sql(long_rel: str = LI_LONG) -> str:
    vc = f"SELECT *, n_real + n_synth AS n_all FROM ({value_counts_sql(long_rel)}) _v"
    rt = ecdf_sql(vc, sums=("n_all",))
    agg = ("SELECT column_name, sum(n_real * (cum_n_all - n_all + (n_all + 1) / 2.0E0)) AS rank_sum_real, "
           "CAST(sum(n_real) AS BIGINT) AS n_real, CAST(sum(n_synth) AS BIGINT) AS n_synthetic, "
           f"sum(pow(CAST(n_all AS DOUBLE), 3) - n_all) AS _ties FROM ({rt}) _r GROUP BY column_name")
    u = ("SELECT column_name, n_real, n_synthetic, rank_sum_real - n_real * (n_real + 1) / 2.0E0 AS u_statistic, "
         "n_real * n_synthetic / 2.0E0 AS _mu, "
         "sqrt(n_real * n_synthetic / 12.0E0 * ((n_real + n_synthetic + 1) - _ties / "
         "((n_real + n_synthetic) * (n_real + n_synthetic - 1.0E0)))) AS _sigma "
         f"FROM ({agg}) _a")
    z = ("SELECT column_name, n_real, n_synthetic, u_statistic, "
         "(greatest(u_statistic, n_real * n_synthetic - u_statistic) - _mu - 0.5E0) / nullif(_sigma, 0) AS z "
         f"FROM ({u}) _u")
    return f"SELECT *, least(1.0E0, 2.0E0 * {D.norm_sf('z', DK)}) AS p_value FROM ({z}) _z"


@register("t11_mann_whitney", sql=mwu_sql, dbl=("u_statistic", "z", "p_value"))
def q_mwu(spark, sf_dir):
    return dt.mann_whitney_u(numeric_long(lineitem_twin(spark, sf_dir)))


def energy_sql(long_rel: str = LI_LONG) -> str:
    cdf = ecdf_sql(value_counts_sql(long_rel))
    seg = ("SELECT column_name, value * (pow((cum_n_real - n_real) / tot_n_real - (cum_n_synth - n_synth) / tot_n_synth, 2) "
           "- pow(cum_n_real / tot_n_real - cum_n_synth / tot_n_synth, 2)) AS _a "
           f"FROM ({cdf}) _c")
    return (f"SELECT column_name, sqrt(2.0E0 * greatest(coalesce(sum(_a), 0.0E0), 0.0E0)) AS energy_distance "
            f"FROM ({seg}) _s GROUP BY column_name")


@register("t10_energy_distance_1d", sql=energy_sql, dbl=("energy_distance",))
def q_energy(spark, sf_dir):
    return dt.energy_distance_1d(numeric_long(lineitem_twin(spark, sf_dir)))


@register("t1_ks_test_auto", note="exact small-sample p-values via a pandas UDF: rows-only check")
def q_ks_auto(spark, sf_dir):
    """T1 with SciPy's 'auto' p-value choice (exact up to 10,000 per side) and a method column."""
    return dt.ks_test_auto(numeric_long(lineitem_twin(spark, sf_dir)))
