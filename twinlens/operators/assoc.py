"""Associations and share distances.

Contingency tables are ``groupBy`` results (levels_a x levels_b rows), so the
windows over them run on aggregated data. Chi-square uses the identity
chi2 = n * (sum o^2 / (row * col) - 1), which needs observed cells only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .reshape import running_totals, side_value_counts


def _present(c: str):
    return F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def _marginals(ct: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Contingency cells with their row, column and grand totals, from grouped
    marginals joined back (no window holds a whole side in one task)."""
    ra = ct.groupBy(*by, a).agg(F.sum("o").alias("_row"))
    cb = ct.groupBy(*by, b).agg(F.sum("o").alias("_col"))
    n = ct.groupBy(*by).agg(F.sum("o").alias("_n"), F.count("*").alias("_cells"))
    return ct.join(ra, [*by, a]).join(cb, [*by, b]).join(F.broadcast(n), by)  # n: one row per group


def cramers_v(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by..., cramers_v) without correction, clamped to [0, 1],
    0 when either variable has a single level; missing values skipped."""
    ct = df.where(_present(a) & _present(b)).groupBy(*by, a, b).agg(F.count("*").alias("o"))
    t = _marginals(ct, a, b, by)
    ka = ct.groupBy(*by, a).count().groupBy(*by).agg(F.count("*").alias("_ka"))
    kb = ct.groupBy(*by, b).count().groupBy(*by).agg(F.count("*").alias("_kb"))
    s = t.groupBy(*by).agg(F.first("_n").alias("_n"),
                           F.sum(F.col("o").cast("double") * F.col("o") / (F.col("_row").cast("double") * F.col("_col"))).alias("_s"))
    j = s.join(ka, by).join(kb, by)
    chi2 = F.col("_n") * F.col("_s") - F.col("_n")
    k = F.least(F.col("_ka"), F.col("_kb")) - 1
    v = F.when(k <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.sqrt(F.greatest(chi2, F.lit(0.0)) / (F.col("_n") * k)))))
    return j.select(*by, v.alias("cramers_v"))


def cramers_v_labels(long_cat: DataFrame) -> DataFrame:
    """V of each categorical column against the side label."""
    return cramers_v(long_cat, "value", "src", ["column_name"])


def correlation_ratio(df: DataFrame, cat: str, num: str, by: list[str]) -> DataFrame:
    """eta = sqrt(SSB / SST), 0 when SST <= 1e-12."""
    d = df.where(_present(cat) & F.col(num).isNotNull() & ~F.isnan(num))
    tot = d.groupBy(*by).agg(F.avg(num).alias("_mu"), (F.var_pop(num) * F.count("*")).alias("_sst"))
    grp = d.groupBy(*by, cat).agg(F.count("*").alias("_ng"), F.avg(num).alias("_mg"))
    ssb = grp.join(tot, by).groupBy(*by).agg(
        F.sum(F.col("_ng") * F.pow(F.col("_mg") - F.col("_mu"), 2)).alias("_ssb"),
        F.first("_sst").alias("_sst"))
    eta = F.when(F.col("_sst") <= 1e-12, F.lit(0.0)).otherwise(
        F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_ssb") / F.col("_sst")))))
    return ssb.select(*by, eta.alias("eta"))


def mixed_matrix(df: DataFrame, numeric: list[str], categorical: list[str], by: list[str]) -> DataFrame:
    """(by, col_i, col_j, kind, value) for every unordered pair and the
    diagonal: Pearson (num-num), Cramer's V (cat-cat), eta (cat-num)."""
    cols = numeric + categorical
    parts = []
    for c in cols:
        parts.append(df.select(*by).distinct().select(
            *by, F.lit(c).alias("col_i"), F.lit(c).alias("col_j"), F.lit("diagonal").alias("kind"),
            F.lit(1.0).alias("value")))
    num_pairs = list(combinations(numeric, 2))
    if num_pairs:
        row = df.groupBy(*by).agg(*[F.corr(a, b).alias(f"_p{k}") for k, (a, b) in enumerate(num_pairs)])
        for k, (a, b) in enumerate(num_pairs):
            parts.append(row.select(*by, F.lit(a).alias("col_i"), F.lit(b).alias("col_j"),
                                    F.lit("pearson").alias("kind"),
                                    F.coalesce(F.col(f"_p{k}"), F.lit(0.0)).alias("value")))
    for a, b in combinations(categorical, 2):
        parts.append(cramers_v(df, a, b, by).select(
            *by, F.lit(a).alias("col_i"), F.lit(b).alias("col_j"), F.lit("cramers_v").alias("kind"),
            F.col("cramers_v").alias("value")))
    for n in numeric:
        for c in categorical:
            i, j = (n, c) if cols.index(n) < cols.index(c) else (c, n)
            parts.append(correlation_ratio(df, c, n, by).select(
                *by, F.lit(i).alias("col_i"), F.lit(j).alias("col_j"), F.lit("eta").alias("kind"),
                F.col("eta").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def matrix_difference(m: DataFrame) -> DataFrame:
    """|synthetic - real| per pair; diagonal 0."""
    r = m.where(F.col("src") == "real").select("col_i", "col_j", "kind", F.col("value").alias("real_value"))
    s = m.where(F.col("src") == "synthetic").select("col_i", "col_j", F.col("value").alias("synthetic_value"))
    j = r.join(s, ["col_i", "col_j"])
    d = F.when(F.col("col_i") == F.col("col_j"), F.lit(0.0)).otherwise(
        F.abs(F.col("synthetic_value") - F.col("real_value")))
    return j.select("col_i", "col_j", "kind", "real_value", "synthetic_value", d.alias("abs_diff"))


def share_distances(long_cat: DataFrame) -> DataFrame:
    """T16 TVD, T17 JSD (base 2), T18 categorical Wasserstein per column.

    Shares are aligned over the category union (0-filled); the Wasserstein
    distance walks the categories in sorted order. A side without any value
    has no shares: the distances are null.
    """
    vc = side_value_counts(long_cat)
    tot = vc.groupBy("column_name").agg(F.sum("n_real").alias("_tr"), F.sum("n_synth").alias("_ts"))
    sh = vc.join(F.broadcast(tot), "column_name").select(  # one row per column
        "column_name", "value", (F.col("n_real") / F.nullif(F.col("_tr"), F.lit(0))).alias("p"),
        (F.col("n_synth") / F.nullif(F.col("_ts"), F.lit(0))).alias("q"))
    sh = sh.select("*", (F.col("p") - F.col("q")).alias("_d"))
    rt = running_totals(sh, "column_name", "value", ["_d"])
    m = 0.5 * (F.col("p") + F.col("q"))
    kl = lambda x: F.when(m.isNull(), F.lit(None)).when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0)
    a = rt.groupBy("column_name").agg(
        F.count("*").alias("categories"),
        (0.5 * F.sum(F.abs(F.col("_d")))).alias("_tvd"),
        (0.5 * F.sum(kl("p")) + 0.5 * F.sum(kl("q"))).alias("_jsd"),
        F.sum(F.abs(F.col("cum__d"))).alias("_w"))
    clamp = lambda c: F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))
    return a.select("column_name", "categories", clamp(F.col("_tvd")).alias("tvd"),
                    clamp(F.col("_jsd")).alias("jsd"),
                    F.when(F.col("categories") == 1, F.lit(0.0))
                     .otherwise(clamp(F.col("_w") / F.greatest(F.col("categories") - 1, F.lit(1))))
                     .alias("wasserstein"))


def mutual_information(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Sum p(a,b) ln(p(a,b) / (p(a) p(b))) from the contingency table."""
    ct = df.where(_present(a) & _present(b)).groupBy(*by, a, b).agg(F.count("*").alias("o"))
    t = _marginals(ct, a, b, by).select(*by, "o", F.col("_row").alias("_ra"), F.col("_col").alias("_cb"), "_n")
    term = (F.col("o") / F.col("_n")) * F.log((F.col("o").cast("double") * F.col("_n")) / (F.col("_ra").cast("double") * F.col("_cb")))
    return t.groupBy(*by).agg(F.sum(term).alias("mutual_information"))
