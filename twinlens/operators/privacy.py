"""Privacy checks.

Exact match rate is a null-safe left-semi join against the *distinct* real
rows, so a hot duplicated real row is one build row, not a fan-out.  Nearest
neighbours are in ``neighbours``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import knn  # noqa: F401  (part of this module's interface)
from .reshape import exact_quantiles


def exact_matches(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """J1 + T28: synthetic rows equal (null-safe, all columns) to a real row."""
    r = real.select(*cols).distinct()
    cond = [synth[c].eqNullSafe(r[c]) for c in cols]
    hits = synth.join(r, cond, "left_semi")
    m = hits.agg(F.count("*").alias("matches"))
    t = synth.agg(F.count("*").alias("total"))
    out = m.crossJoin(t)
    return out.select("matches", "total",
                      (F.col("matches") / F.greatest(F.col("total"), F.lit(1))).alias("rate"),
                      F.when(F.col("matches") == 0, "SUCCESS").otherwise("WARNING").alias("result"))


def nndr(neigh: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Per synthetic row, d1 / (d2 + eps) clipped to [0, 1], and d1."""
    p = neigh.groupBy("row_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("distance"))).alias("d1"),
        F.max(F.when(F.col("rank") == 2, F.col("distance"))).alias("d2"))
    return p.select("row_id", "d1", F.least(F.lit(1.0), F.greatest(F.lit(0.0),
                                                                    F.col("d1") / (F.col("d2") + eps))).alias("ratio"))


def privacy_summary(per_row: DataFrame) -> DataFrame:
    """T27 summaries (median, mean, quartiles) of the ratio and of d1, with
    T29's level and verdict on the ratio median."""
    long = per_row.select(F.lit("x").alias("src"),
                          F.explode(F.array(
                              F.struct(F.lit("NNDR").alias("column_name"), F.col("ratio").alias("value")),
                              F.struct(F.lit("NN_Distance").alias("column_name"), F.col("d1").alias("value"))))
                          .alias("t")).select("src", "t.*")
    q = exact_quantiles(long, {"q25": 0.25, "median": 0.5, "q75": 0.75}, ["src", "column_name"])
    m = long.groupBy("column_name").agg(F.avg("value").alias("mean"))
    s = q.join(m, "column_name").select(F.col("column_name").alias("type"), "n", "median", "mean", "q25", "q75")
    level = (F.when(F.col("median") >= 0.8, "EXCELLENT").when(F.col("median") >= 0.6, "GOOD")
              .when(F.col("median") >= 0.4, "FAIR").otherwise("POOR"))
    return s.select("*", F.when(F.col("type") == "NNDR", level).alias("privacy_level"),
                    F.when(F.col("type") == "NNDR",
                           F.when(level.isin("EXCELLENT", "GOOD"), "PASS").otherwise("FAIL")).alias("verdict"))
