"""Registered association queries on the orders / part bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assoc as asc
from ..operators.reshape import categorical_long
from ..sources.testdata import OR_CATEGORICAL, ORDERS_SQL, orders_twin, table
from .registry import register
from .sqltext import long_sql

OR_CAT_LONG = long_sql(ORDERS_SQL, OR_CATEGORICAL, cast="VARCHAR")
PART_SQL = ("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'real' ELSE 'synthetic' END AS src, p_type, "
            "CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part")


def _part(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.when(F.col("p_partkey") % 2 == 0, "real").otherwise("synthetic").alias("src"),
                    "p_type", F.col("p_retailprice").cast("double").alias("p_retailprice"))


def v_sql(rel: str, a: str, b: str, by: str) -> str:
    ct = (f"SELECT {by}, {a}, {b}, count(*) AS o FROM ({rel}) _r WHERE {a} IS NOT NULL AND {b} IS NOT NULL "
          f"AND CAST({a} AS VARCHAR) <> '' AND CAST({b} AS VARCHAR) <> '' GROUP BY {by}, {a}, {b}")
    t = (f"SELECT {by}, o, sum(o) OVER (PARTITION BY {by}, {a}) AS _row, sum(o) OVER (PARTITION BY {by}, {b}) AS _col, "
         f"sum(o) OVER (PARTITION BY {by}) AS _n FROM ({ct}) _c")
    s = f"SELECT {by}, any_value(_n) AS _n, sum(o * o / (_row * _col)) AS _s FROM ({t}) _t GROUP BY {by}"
    ka = f"SELECT {by}, count(DISTINCT {a}) AS _ka, count(DISTINCT {b}) AS _kb FROM ({ct}) _c GROUP BY {by}"
    k = "(least(_ka, _kb) - 1)"
    return (f"SELECT {by}, CASE WHEN {k} <= 0 THEN 0.0E0 ELSE least(1.0E0, greatest(0.0E0, "
            f"sqrt(greatest(_n * _s - _n, 0.0E0) / (_n * {k})))) END AS cramers_v "
            f"FROM ({s}) _s JOIN ({ka}) _k USING ({by})")


@register("t13_cramers_v", sql=lambda: v_sql(ORDERS_SQL, "o_orderpriority", "o_orderstatus", "src"),
          dbl=("cramers_v",))
def q_t13(spark, sf_dir):
    return asc.cramers_v(orders_twin(spark, sf_dir).df, "o_orderpriority", "o_orderstatus", ["src"])


@register("t13b_cramers_v_labels", sql=lambda: v_sql(OR_CAT_LONG, "value", "src", "column_name"),
          dbl=("cramers_v",))
def q_t13b(spark, sf_dir):
    return asc.cramers_v_labels(categorical_long(orders_twin(spark, sf_dir)))


def eta_sql(rel: str, cat: str, num: str, by: str) -> str:
    d = (f"SELECT * FROM ({rel}) _r WHERE {cat} IS NOT NULL AND CAST({cat} AS VARCHAR) <> '' "
         f"AND {num} IS NOT NULL AND NOT isnan({num})")
    tot = f"SELECT {by}, avg({num}) AS _mu, var_pop({num}) * count(*) AS _sst FROM ({d}) _d GROUP BY {by}"
    grp = f"SELECT {by}, {cat}, count(*) AS _ng, avg({num}) AS _mg FROM ({d}) _d GROUP BY {by}, {cat}"
    ssb = (f"SELECT {by}, sum(_ng * pow(_mg - _mu, 2)) AS _ssb, any_value(_sst) AS _sst "
           f"FROM ({grp}) g JOIN ({tot}) t USING ({by}) GROUP BY {by}")
    return (f"SELECT {by}, CASE WHEN _sst <= 1e-12 THEN 0.0E0 ELSE sqrt(least(1.0E0, greatest(0.0E0, _ssb / _sst))) "
            f"END AS eta FROM ({ssb}) _s")


@register("t14_correlation_ratio", sql=lambda: eta_sql(PART_SQL, "p_type", "p_retailprice", "src"), dbl=("eta",))
def q_t14(spark, sf_dir):
    return asc.correlation_ratio(_part(spark, sf_dir), "p_type", "p_retailprice", ["src"])


def mixed_sql() -> str:
    cols = ["o_totalprice", "o_orderpriority", "o_orderstatus"]
    parts = [f"SELECT DISTINCT src, '{c}' AS col_i, '{c}' AS col_j, 'diagonal' AS kind, 1.0E0 AS value "
             f"FROM ({ORDERS_SQL}) _o" for c in cols]
    v = v_sql(ORDERS_SQL, "o_orderpriority", "o_orderstatus", "src")
    parts.append(f"SELECT src, 'o_orderpriority' AS col_i, 'o_orderstatus' AS col_j, 'cramers_v' AS kind, "
                 f"cramers_v AS value FROM ({v}) _v")
    for c in ("o_orderpriority", "o_orderstatus"):
        e = eta_sql(ORDERS_SQL, c, "o_totalprice", "src")
        parts.append(f"SELECT src, 'o_totalprice' AS col_i, '{c}' AS col_j, 'eta' AS kind, eta AS value FROM ({e}) _e")
    return " UNION ALL ".join(parts)


def _mixed(spark, sf_dir):
    return asc.mixed_matrix(orders_twin(spark, sf_dir).df, ["o_totalprice"], list(OR_CATEGORICAL), ["src"])


@register("t15_mixed_matrix", sql=mixed_sql, dbl=("value",))
def q_t15(spark, sf_dir):
    """Mixed association matrix per side: Pearson, Cramer's V or eta by column-type pair; diagonal 1."""
    return _mixed(spark, sf_dir)


@register("t15b_matrix_difference", dbl=("real_value", "synthetic_value", "abs_diff"), sql=lambda: (
    f"SELECT r.col_i, r.col_j, r.kind, r.value AS real_value, s.value AS synthetic_value, "
    f"CASE WHEN r.col_i = r.col_j THEN 0.0E0 ELSE abs(s.value - r.value) END AS abs_diff "
    f"FROM ({mixed_sql()}) r JOIN ({mixed_sql()}) s ON r.col_i = s.col_i AND r.col_j = s.col_j "
    f"WHERE r.src = 'real' AND s.src = 'synthetic'"))
def q_t15b(spark, sf_dir):
    return asc.matrix_difference(_mixed(spark, sf_dir))


def shares_dist_sql(long_rel: str = OR_CAT_LONG) -> str:
    vc = (f"SELECT column_name, value, count_if(src = 'real') AS n_real, count_if(src = 'synthetic') AS n_synth "
          f"FROM ({long_rel}) _l GROUP BY column_name, value")
    sh = (f"SELECT column_name, value, n_real / sum(n_real) OVER (PARTITION BY column_name) AS p, "
          f"n_synth / sum(n_synth) OVER (PARTITION BY column_name) AS q FROM ({vc}) _v")
    rt = (f"SELECT *, p - q AS _d, sum(p - q) OVER (PARTITION BY column_name ORDER BY value ROWS BETWEEN "
          f"UNBOUNDED PRECEDING AND CURRENT ROW) AS cum__d FROM ({sh}) _s")
    kl = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (0.5E0 * (p + q))) ELSE 0.0E0 END"
    a = (f"SELECT column_name, count(*) AS categories, 0.5E0 * sum(abs(_d)) AS _tvd, "
         f"0.5E0 * sum({kl('p')}) + 0.5E0 * sum({kl('q')}) AS _jsd, sum(abs(cum__d)) AS _w "
         f"FROM ({rt}) _r GROUP BY column_name")
    cl = lambda c: f"least(1.0E0, greatest(0.0E0, {c}))"
    return (f"SELECT column_name, categories, {cl('_tvd')} AS tvd, {cl('_jsd')} AS jsd, "
            f"CASE WHEN categories = 1 THEN 0.0E0 ELSE {cl('_w / greatest(categories - 1, 1)')} END AS wasserstein "
            f"FROM ({a}) _a")


@register("t16_t17_t18_share_distances", sql=shares_dist_sql, dbl=("tvd", "jsd", "wasserstein"))
def q_t16(spark, sf_dir):
    return asc.share_distances(categorical_long(orders_twin(spark, sf_dir)))


@register("t30_mutual_information", dbl=("mutual_information",), sql=lambda: (
    "SELECT src, sum((o / _n) * ln((o * _n) / (_ra * _cb))) AS mutual_information FROM ("
    "SELECT src, o, sum(o) OVER (PARTITION BY src, o_orderpriority) AS _ra, "
    "sum(o) OVER (PARTITION BY src, o_orderstatus) AS _cb, sum(o) OVER (PARTITION BY src) AS _n FROM ("
    f"SELECT src, o_orderpriority, o_orderstatus, count(*) AS o FROM ({ORDERS_SQL}) _o "
    "GROUP BY src, o_orderpriority, o_orderstatus) _c) _t GROUP BY src"))
def q_t30(spark, sf_dir):
    return asc.mutual_information(orders_twin(spark, sf_dir).df, "o_orderpriority", "o_orderstatus", ["src"])
