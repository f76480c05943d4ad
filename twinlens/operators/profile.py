"""Per-column profiles of both sides.

Every profile is one aggregation over the long frame, keyed by column (and
side), with conditional aggregates instead of per-side scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.testdata import REAL, SYNTH, Twin
from .reshape import exact_quantiles, is_real, is_synth, side_moments, side_quantiles, side_value_counts


def _on(side_col, col):
    return F.when(side_col, F.col(col))


def numeric_range(long_num: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """A1: min, max, mean, sample std per side; rangeDiff, meanDiff, stdDiff."""
    a = (moments if moments is not None else side_moments(long_num)).select(
        "column_name", "n_real", "n_synthetic",
        *[F.col(f"{n}_{lab}") for lab in ("real", "synthetic") for n in ("min", "max", "mean")],
        *[F.sqrt(F.col(f"var_{lab}")).alias(f"std_{lab}") for lab in ("real", "synthetic")])
    rr = F.col("max_real") - F.col("min_real")
    rs = F.col("max_synthetic") - F.col("min_synthetic")
    return (a.where((F.col("n_real") > 0) & (F.col("n_synthetic") > 0))
             .select("column_name", "min_real", "max_real", "mean_real", "std_real",
                     "min_synthetic", "max_synthetic", "mean_synthetic", "std_synthetic",
                     F.when(rr != 0, F.abs(rr - rs) / rr).otherwise(F.lit(0.0)).alias("range_diff"),
                     F.abs(F.col("mean_real") - F.col("mean_synthetic")).alias("mean_diff"),
                     F.abs(F.col("std_real") - F.col("std_synthetic")).alias("std_diff")))


def _group_totals(vc, cols, key="column_name"):
    """Per-group totals as a small frame (one row per group) for a broadcast
    join, instead of an unordered window that puts a whole group in one task."""
    return vc.groupBy(key).agg(*[F.sum(c).alias(f"_tot_{c}") for c in cols])


def categorical_range(long_cat: DataFrame, show: int = 10, vc: DataFrame | None = None) -> DataFrame:
    """A2 (+J4, U2): distinct counts, new / missing categories, overlap ratio,
    and the first ``show`` values of each side in sorted order."""
    vc = vc if vc is not None else side_value_counts(long_cat)
    r, s = F.col("n_real") > 0, F.col("n_synth") > 0
    a = vc.groupBy("column_name").agg(
        F.count_if(r).alias("real_unique"), F.count_if(s).alias("synthetic_unique"),
        F.count_if(s & ~r).alias("new_categories"), F.count_if(r & ~s).alias("missing_categories"),
        F.count_if(r & s).alias("_shared"))
    w = Window.partitionBy("column_name").orderBy("value")

    def first_values(side, name):
        # row_number <= k is planned as a per-partition group limit before the shuffle
        top = vc.where(side).select("column_name", "value", F.row_number().over(w).alias("_k")).where(
            F.col("_k") <= show)
        return top.groupBy("column_name").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias(name))
    a = (a.join(first_values(r, "real_values"), "column_name", "left")
          .join(first_values(s, "synthetic_values"), "column_name", "left"))
    return a.select("column_name", "real_unique", "synthetic_unique", "new_categories",
                    "missing_categories",
                    F.when(F.col("real_unique") > 0, F.col("_shared") / F.col("real_unique"))
                     .otherwise(F.lit(0.0)).alias("overlap_ratio"),
                    F.coalesce("real_values", F.lit("")).alias("real_values"),
                    F.coalesce("synthetic_values", F.lit("")).alias("synthetic_values"))


def descriptive(long_num: DataFrame, population_std: bool = False) -> DataFrame:
    """Count, mean, std, min, median, max per (side, column).
    ``population_std`` switches to the population std of the score code."""
    std = F.stddev_pop if population_std else F.stddev_samp
    m = long_num.groupBy("src", "column_name").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), std("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    med = side_quantiles(long_num, {"median": 0.5}).drop("n")
    return m.join(med, ["src", "column_name"]).select(
        "src", "column_name", "count", "mean", "std", "min", "median", "max")


def completeness(twin: Twin, threshold: float = 0.95) -> DataFrame:
    """A5: 1 - nulls / cells per side, ratio synthetic / real, verdict."""
    cols = twin.columns
    nulls = sum(F.when(F.col(c).isNull(), 1).otherwise(0) for c in cols)
    per = twin.df.groupBy().agg(
        F.sum(F.when(is_real(), nulls)).alias("_nr"), F.count_if(is_real()).alias("_rr"),
        F.sum(F.when(is_synth(), nulls)).alias("_ns"), F.count_if(is_synth()).alias("_rs"))
    k = float(len(cols))
    rc = 1 - F.col("_nr") / (F.col("_rr") * k)
    sc = 1 - F.col("_ns") / (F.col("_rs") * k)
    out = per.select(rc.alias("real_completeness"), sc.alias("synthetic_completeness"))
    ratio = F.when(F.col("real_completeness") > 0,
                   F.col("synthetic_completeness") / F.col("real_completeness")).otherwise(F.lit(0.0))
    return out.select("*", ratio.alias("ratio")).select(
        "*", F.when(F.col("ratio") >= threshold, "ACCEPT").otherwise("REJECT").alias("result"))


def iqr_outliers(long_num: DataFrame, k: float = 1.5, min_n: int = 4, cdf: DataFrame | None = None) -> DataFrame:
    """Own-side IQR fences (linear quartiles), outlier count and percent.

    The quartiles come from the shared per-value ECDF; the counts are one
    map-only pass over the values against the broadcast fences (one row per
    side and column), so no second shuffle of the data."""
    q = side_quantiles(long_num, {"q1": 0.25, "q3": 0.75}, cdf=cdf)
    fences = q.select("src", "column_name", "n", "q1", "q3",
                      (F.col("q3") - F.col("q1")).alias("iqr"))
    fences = fences.select("*", (F.col("q1") - k * F.col("iqr")).alias("lower_fence"),
                           (F.col("q3") + k * F.col("iqr")).alias("upper_fence"))
    # one row per (side, column): a bounded broadcast
    j = long_num.join(F.broadcast(fences), ["src", "column_name"])
    out = (F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence"))
    # the fences ride along as grouping keys, so they are computed once
    keys = ["src", "column_name", "n", "q1", "q3", "iqr", "lower_fence", "upper_fence"]
    res = j.groupBy(*keys).agg(F.count_if(out).alias("outlier_count")).where(F.col("n") >= min_n)
    return res.select(*keys, "outlier_count", (F.col("outlier_count") / F.col("n") * 100.0).alias("outlier_percentage"))


def first_outliers(long_num: DataFrame, k: float = 1.5, limit: int = 5) -> DataFrame:
    """The first ``limit`` outliers per (side, column) in row order."""
    q = side_quantiles(long_num, {"q1": 0.25, "q3": 0.75})
    f = q.select("src", "column_name", (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lo"),
                 (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("hi"))
    j = long_num.join(F.broadcast(f), ["src", "column_name"]).where(
        (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")))
    w = Window.partitionBy("src", "column_name").orderBy("row_id")
    # row_number <= k becomes a per-partition group limit before the shuffle
    return (j.select("src", "column_name", "row_id", "value", F.row_number().over(w).alias("ordinal"))
             .where(F.col("ordinal") <= limit)
             .select("src", "column_name", F.col("ordinal").cast("long").alias("ordinal"), "value"))


def category_shares(long_cat: DataFrame, digits: int = 2) -> DataFrame:
    """Aligned counts and percentages per category (0-filled)."""
    vc = side_value_counts(long_cat)
    j = vc.join(F.broadcast(_group_totals(vc, ["n_real", "n_synth"])), "column_name")  # one row per column
    return j.select(
        "column_name", F.col("value").alias("category"),
        F.col("n_real").alias("real_count"), F.col("n_synth").alias("synthetic_count"),
        F.round(F.col("n_real") * 100.0 / F.nullif(F.col("_tot_n_real"), F.lit(0)), digits).alias("real_pct"),
        F.round(F.col("n_synth") * 100.0 / F.nullif(F.col("_tot_n_synth"), F.lit(0)), digits).alias("synthetic_pct"))


def histogram(long_num: DataFrame, max_bins: int = 30, fixed_bins: int | None = None) -> DataFrame:
    """Shared equal-width bins over both sides.

    bins = min(30, ceil(sqrt(n))), start = min - 0.1 bin, as the plots do;
    ``fixed_bins`` gives the notebook's shared 30-bin density histogram.
    A constant column gets one bin [v - 0.5, v + 0.5].
    """
    b = long_num.groupBy("column_name").agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count("*").alias("_n"),
        F.count_if(is_real()).alias("_nr"), F.count_if(is_synth()).alias("_ns"))
    nb = (F.lit(fixed_bins) if fixed_bins else
          F.least(F.lit(max_bins), F.ceil(F.sqrt(F.col("_n"))).cast("int")))
    rng = F.col("_hi") - F.col("_lo")
    b = b.select("*", F.when(rng == 0, F.lit(1)).otherwise(nb).alias("bins"))
    size = F.when(rng == 0, F.lit(1.0)).otherwise(rng / F.col("bins"))
    b = b.select("*", size.alias("bin_size"))
    b = b.select("*", F.when(rng == 0, F.col("_lo") - 0.5)
                 .otherwise(F.col("_lo") - F.col("bin_size") * 0.1).alias("start"))
    j = long_num.join(F.broadcast(b), "column_name")  # one row per column
    idx = F.least(F.floor((F.col("value") - F.col("start")) / F.col("bin_size")),
                  F.col("bins") - 1 + F.when(rng == 0, 0).otherwise(1)).cast("int")
    h = j.groupBy("column_name", idx.alias("bin")).agg(
        F.count_if(is_real()).alias("real_count"), F.count_if(is_synth()).alias("synthetic_count"),
        F.first("start").alias("_start"), F.first("bin_size").alias("bin_size"),
        F.first("_nr").alias("_nr"), F.first("_ns").alias("_ns"))
    return h.select(
        "column_name", "bin", (F.col("_start") + F.col("bin") * F.col("bin_size")).alias("bin_start"),
        (F.col("_start") + (F.col("bin") + 1) * F.col("bin_size")).alias("bin_end"),
        "real_count", "synthetic_count",
        (F.col("real_count") / F.nullif(F.col("_nr") * F.col("bin_size"), F.lit(0.0))).alias("real_density"),
        (F.col("synthetic_count") / F.nullif(F.col("_ns") * F.col("bin_size"), F.lit(0.0))).alias("synthetic_density"))


def discrete_histogram(long_cat: DataFrame) -> DataFrame:
    """Counts and shares per value and side."""
    vc = side_value_counts(long_cat)
    j = vc.join(F.broadcast(_group_totals(vc, ["n_real", "n_synth"])), "column_name")  # one row per column
    return j.select("column_name", "value", F.col("n_real").alias("real_count"),
                    F.col("n_synth").alias("synthetic_count"),
                    (F.col("n_real") / F.nullif(F.col("_tot_n_real"), F.lit(0))).alias("real_share"),
                    (F.col("n_synth") / F.nullif(F.col("_tot_n_synth"), F.lit(0))).alias("synthetic_share"))


def five_number(long_num: DataFrame) -> DataFrame:
    """Box summary (min, q1, median, q3, max) per side and column."""
    return side_quantiles(long_num, {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0})


def side_totals(twin: Twin) -> DataFrame:
    """Rows per side."""
    return twin.df.groupBy("src").agg(F.count("*").alias("rows"))


def metric_domains(diff_long: DataFrame) -> DataFrame:
    """[min, max] of each difference metric across columns."""
    return diff_long.groupBy("metric").agg(F.min("value").alias("domain_min"),
                                           F.max("value").alias("domain_max"))


REAL_SIDE, SYNTH_SIDE = REAL, SYNTH
