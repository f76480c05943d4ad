"""Benjamini-Hochberg step-up correction (T4, T4b, R3) as windows.

The test table is small (one row per test), so windows over a family are
cheap; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bh_adjust(tests: DataFrame, p_col: str = "p_value", family: list[str] | None = None,
              alpha: float = 0.05, min_tests: int = 2, tiebreak: list[str] | None = None,
              adjusted: str = "p_value_corrected", rejected: str = "fdr_rejected") -> DataFrame:
    """Add BH-adjusted p and the step-up rejection flag per family.

    Families with fewer than ``min_tests`` p-values are left uncorrected
    (null columns), as the reference does. The rejection compares
    p <= rank / m * alpha (not the adjusted p), then extends it down the
    ranks with a reverse running max, which is the step-up rule.
    """
    fam = family or []
    order = [F.col(p_col).asc_nulls_last()] + [F.col(c) for c in (tiebreak or [])]
    part = Window.partitionBy(*fam) if fam else Window.partitionBy(F.lit(1))
    ranked = tests.select(
        "*",
        F.count(p_col).over(part).alias("_m"),
        F.row_number().over(part.orderBy(*order)).alias("_rk"))
    rev = ((Window.partitionBy(*fam) if fam else Window.partitionBy(F.lit(1)))
           .orderBy(F.col("_rk").desc()).rowsBetween(Window.unboundedPreceding, 0))
    raw = F.col(p_col) * F.col("_m") / F.col("_rk")
    hit = F.when(F.col(p_col) <= F.col("_rk") / F.col("_m") * F.lit(alpha), 1).otherwise(0)
    out = ranked.select(
        "*",
        F.least(F.lit(1.0), F.min(F.when(F.col(p_col).isNotNull(), raw)).over(rev)).alias("_adj"),
        F.max(F.when(F.col(p_col).isNotNull(), hit)).over(rev).alias("_rej"))
    ok = (F.col("_m") >= min_tests) & F.col(p_col).isNotNull()
    return out.select(
        *tests.columns,
        F.when(ok, F.col("_adj")).alias(adjusted),
        F.when(ok, F.col("_rej") == 1).alias(rejected))


def fdr_result(result_col: str = "result", significant: str = "significant",
               rejected: str = "fdr_rejected"):
    """Verdict after correction: flips both ways, unchanged when uncorrected."""
    return (F.when(F.col(rejected).isNull(), F.col(result_col))
             .when(F.col(significant) & ~F.col(rejected), F.lit("ACCEPT"))
             .when(~F.col(significant) & F.col(rejected), F.lit("REJECT"))
             .otherwise(F.col(result_col)))
