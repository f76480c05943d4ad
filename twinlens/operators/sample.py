"""Seeded, partition-independent sampling (M1-M7).

Order keys are md5(seed | row_id): the same rows are chosen however the data
is partitioned, unlike ``rand(seed)``. Per-side top-n is a ``row_number``
filter, which Spark turns into a partial per-partition limit before the
shuffle, so only n rows per side and partition move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_key(seed: int | str, row_id: str = "row_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(row_id).cast("string")))


def sample_per_side(df: DataFrame, n: int, seed: int = 42, by: str = "src") -> DataFrame:
    """M1 / M5: exactly min(n, side size) rows per side, seeded, no replacement."""
    w = Window.partitionBy(by).orderBy(sample_key(seed), "row_id")
    return df.select("*", F.row_number().over(w).alias("_k")).where(F.col("_k") <= n).drop("_k")


def head_per_side(df: DataFrame, n: int, by: str = "src") -> DataFrame:
    """M2 / M7: the first n rows per side in row order."""
    w = Window.partitionBy(by).orderBy("row_id")
    return df.select("*", F.row_number().over(w).alias("_k")).where(F.col("_k") <= n).drop("_k")


def plot_sample(df: DataFrame, cap: int = 10_000, seed: int = 42, coords: tuple[str, ...] = ()) -> DataFrame:
    """M3: points without finite coordinates go; then all points when they are
    ``cap`` at most, else half the cap per side, seeded; original order restored.
    One plan at every size: ``cap`` rows a side are enough for either case, so the
    rank keeps a literal bound (a partial top-k before the shuffle)."""
    for c in coords:
        v = F.col(c).cast("double")
        df = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    w = Window.partitionBy("src").orderBy(sample_key(seed), "row_id")
    ranked = df.select("*", F.row_number().over(w).alias("_k")).where(F.col("_k") <= cap)
    picked = ranked.crossJoin(F.broadcast(total)).where((F.col("_total") <= cap) | (F.col("_k") <= cap // 2))
    return picked.drop("_k", "_total").orderBy("src", "row_id")


def stratified_equal(df: DataFrame, label: str, max_total: int, seed: int = 42) -> DataFrame:
    """M4: floor(max_total / groups) rows per label, seeded."""
    groups = df.agg(F.count_distinct(label)).collect()[0][0] or 1
    return sample_per_side(df, max_total // groups, seed, by=label)


def hash_rank_threshold(df: DataFrame, n_col: str, seed: int = 42, by: str = "src") -> DataFrame:
    """Per group, the n-th smallest sample key (exact), from prefix sums over
    the keys: no group is sorted in one task, whatever n is. ``df`` must carry
    the wanted count per row in ``n_col``. Returns (by, _threshold)."""
    from .reshape import running_totals
    key = F.conv(F.substring(sample_key(seed), 1, 15), 16, 10).cast("long")
    vc = (df.select(by, key.alias("value"), n_col).groupBy(by, "value")
            .agg(F.count("*").alias("n"), F.first(n_col).alias(n_col)))
    rt = running_totals(vc, by, "value", ["n"])
    return rt.groupBy(by).agg(F.min(F.when(F.col("cum_n") >= F.col(n_col), F.col("value"))).alias("_threshold"))


def fraction_subset(df: DataFrame, fraction: float = 0.05, seed: int = 42) -> DataFrame:
    """M6: floor(fraction * N) rows per side marked by an ``injected`` flag.

    The rows with the smallest floor(fraction * N) sample keys are chosen; the
    cut-off key is found from distributed prefix sums, then every row is
    flagged by comparing its key with its side's cut-off (a two-row broadcast).
    """
    n = df.groupBy("src").agg(F.floor(F.count("*") * fraction).alias("_want"))
    with_n = df.join(F.broadcast(n), "src")
    th = hash_rank_threshold(with_n, "_want", seed)
    key = F.conv(F.substring(sample_key(seed), 1, 15), 16, 10).cast("long")
    flagged = df.join(F.broadcast(th), "src", "left")
    return flagged.select(*df.columns, F.coalesce(key <= F.col("_threshold"), F.lit(False)).alias("injected"))
