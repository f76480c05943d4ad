"""Correlation structure.

All pairwise coefficients for both sides come from a single aggregation by
pair (``corr`` is a mergeable moment sketch, so it partially aggregates per
partition before the one small shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.testdata import Twin
from .reshape import is_real, is_synth


def pearson_pairs(twin: Twin, cols: list[str] | None = None, strict: bool = False) -> DataFrame:
    """(col_i, col_j, real_r, synthetic_r) for i < j in catalogue order.

    Pairwise-complete by default (rows with a null in either column are
    skipped); ``strict`` makes a column with any missing value yield null,
    like a NumPy matrix with NaN in it. A row is unfolded into its pairs and
    aggregated by pair, map-side combined: the plan is the same small one at any
    number of columns, and only one row a pair and task is shuffled.
    """
    cols = cols or twin.numeric
    values = F.array(*[F.col(c).cast("double") for c in cols])
    one = twin.df.select("src", values.alias("v")).select("src", "v", F.posexplode("v").alias("i", "x"))
    two = one.where(F.col("i") < len(cols) - 1).select(
        "src", "i", "x", F.posexplode(F.slice("v", F.col("i") + 2, len(cols))).alias("k", "y"))
    aggs = []
    for side, name in ((is_real(), "real_r"), (is_synth(), "synthetic_r")):
        r = F.corr(F.when(side, F.col("x")), F.when(side, F.col("y")))
        if strict:
            missing = lambda c: F.col(c).isNull() | F.isnan(c)
            r = F.when(F.count_if(side & (missing("x") | missing("y"))) == 0, r)
        aggs.append(r.alias(name))
    names = F.array(*[F.lit(c) for c in cols])
    return two.groupBy("i", (F.col("i") + F.col("k") + 1).alias("j")).agg(*aggs).select(
        F.get(names, F.col("i")).alias("col_i"), F.get(names, F.col("j")).alias("col_j"), "real_r", "synthetic_r")


def compare_pairs(pairs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """T6 per pair: absolute difference and the > threshold flag."""
    d = F.abs(F.col("real_r") - F.col("synthetic_r"))
    return pairs.select("*", d.alias("abs_diff"), (d > threshold).alias("significant"))


def first_differences(pairs: DataFrame, cols: list[str], threshold: float = 0.3, limit: int = 10) -> DataFrame:
    """T6 list: the first ``limit`` pairs, in catalogue order, whose coefficients
    differ by more than the threshold, with both values. A pair undefined on a side
    differs from nothing."""
    d = compare_pairs(pairs, threshold).where(F.col("significant") & ~F.isnan("abs_diff"))
    place = [F.array_position(F.lit(list(cols)), F.col(c)) for c in ("col_i", "col_j")]
    first = d.orderBy(*place).limit(limit)
    return first.select("col_i", "col_j", "real_r", "synthetic_r", F.col("abs_diff").alias("difference"))


def compare_summary(pairs: DataFrame, threshold: float = 0.3) -> DataFrame:
    """T6 summary: comparisons, significant differences and their percent."""
    c = compare_pairs(pairs, threshold)
    return c.agg(F.count("*").alias("total_comparisons"),
                 F.count_if(F.col("significant")).alias("significant_differences")).select(
        "*", F.when(F.col("total_comparisons") > 0,
                    F.col("significant_differences") / F.col("total_comparisons") * 100.0)
         .otherwise(F.lit(0.0)).alias("percentage_significant"))


def jennrich(pairs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Frobenius norm of R_real - R_synth over the full matrix (both
    triangles; the diagonal is 0)."""
    return pairs.agg(F.sqrt(2.0 * F.sum(F.pow(F.col("real_r") - F.col("synthetic_r"), 2))).alias("statistic")) \
        .select("statistic", F.when(F.col("statistic") > threshold, "REJECT").otherwise("ACCEPT").alias("result"))


def bivariate_score(pairs: DataFrame) -> DataFrame:
    """Mean |r_real - r_synth| over pairs defined on both sides."""
    ok = F.col("real_r").isNotNull() & F.col("synthetic_r").isNotNull() & \
        ~F.isnan("real_r") & ~F.isnan("synthetic_r")
    return pairs.where(ok).agg(F.count("*").alias("pairs"),
                               F.avg(F.abs(F.col("real_r") - F.col("synthetic_r"))).alias("bivariate_distance"))
