"""Long (unpivoted) views of a twin frame and running totals over them.

All per-column statistics run on one long frame ``(src, row_id, column_name,
value)`` so that every column shares a single shuffle instead of one job per
column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.testdata import REAL, SYNTH, Twin


def _unpivot(wide: DataFrame, cols: list[str]) -> DataFrame:
    """(src, row_id, column_name, value). A generator, not ``unpivot``: the latter
    passes attributes through under their old ids, which keeps Spark from seeing that
    two reads of a long frame in one plan are the same exchange."""
    pairs = [x for c in cols for x in (F.lit(c), F.col(f"`{c}`"))]
    return wide.select("src", "row_id", F.stack(F.lit(len(cols)), *pairs).alias("column_name", "value"))


def numeric_long(twin: Twin, columns: list[str] | None = None,
                 drop_missing: bool = True) -> DataFrame:
    cols = columns or twin.numeric
    wide = twin.df.select("src", "row_id", *[F.col(c).cast("double").alias(c) for c in cols])
    long = _unpivot(wide, cols)
    if drop_missing:
        long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long


def categorical_long(twin: Twin, columns: list[str] | None = None,
                     drop_missing: bool = True) -> DataFrame:
    cols = columns or twin.categorical
    wide = twin.df.select("src", "row_id", *[F.col(c).cast("string").alias(c) for c in cols])
    long = _unpivot(wide, cols)
    if drop_missing:
        long = long.where(F.col("value").isNotNull())
    return long


def is_real() -> Column:
    return F.col("src") == REAL


def is_synth() -> Column:
    return F.col("src") == SYNTH


def side_value_counts(long: DataFrame) -> DataFrame:
    """(column_name, value, n_real, n_synth): one map-side-combined shuffle."""
    return long.groupBy("column_name", "value").agg(
        F.count_if(is_real()).alias("n_real"),
        F.count_if(is_synth()).alias("n_synth"))


def _ranges(df: DataFrame) -> int:
    """Ranges of a prefix sum: the session's shuffle width (a range is one task's
    work), as a power of two."""
    return 1 << max(3, (int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def _with_range(df: DataFrame, key: Column, borders: Column, ranges: int) -> DataFrame:
    """``df`` with ``_range``: how many of the sorted ``borders`` are not above
    ``key``, by a binary search of one projection a step."""
    out = df.withColumns({"_k": key, "_b": borders, "_range": F.lit(0)})
    for step in (ranges >> i for i in range(1, ranges.bit_length())):
        beyond = F.get("_b", F.col("_range") + (step - 1)) <= F.col("_k")      # null past the end
        out = out.withColumn("_range", F.when(beyond, F.col("_range") + step).otherwise(F.col("_range")))
    return out.drop("_k", "_b")


def running_totals(df: DataFrame, part: str | list[str], order: str, sums: list[str]) -> DataFrame:
    """Add ``cum_<c>`` (inclusive prefix sum ordered by ``order``) and
    ``tot_<c>`` (group total) for each c in ``sums``, per ``part``.

    Two levels, in one lazy plan: the rows are cut into ranges of (part, order) - any
    orderable key: number, string or struct -, per-range totals give each range's
    offset, and a window per (part, range) adds the running sum inside it, so no task
    sorts a group. The borders are the keys of least hash (one less than ranges, a
    scalar subquery): a fair sample that depends on the set of keys alone, so every
    read of the plan, also a repeated one after a lost executor, cuts alike. ``df``
    should be aggregated to one row per key.
    """
    parts = [part] if isinstance(part, str) else list(part)
    ranges = _ranges(df)
    key = F.struct(*parts, order)
    # the sums break ties only to keep this read of df equal to the other two, so it is shared
    least = df.select(key.alias("k"), *sums).orderBy(F.xxhash64("k"), "k", *sums).limit(ranges - 1)
    borders = least.agg(F.array_sort(F.collect_list("k")).alias("b")).scalar()
    ranged = _with_range(df, key, borders, ranges)
    per_range = ranged.groupBy(*parts, "_range").agg(*[F.sum(c).alias(f"_b_{c}") for c in sums])
    before = Window.partitionBy(*parts).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parts)
    offsets = per_range.select(
        *[F.col(c).alias(f"_p_{c}") for c in parts], F.col("_range").alias("_r"),
        *[F.coalesce(F.sum(f"_b_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_b_{c}").over(whole).alias(f"tot_{c}") for c in sums])
    same = ranged["_range"] == offsets["_r"]
    for c in parts:
        same = same & ranged[c].eqNullSafe(offsets[f"_p_{c}"])
    w = Window.partitionBy(*parts, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(offsets, same).select(
        *df.columns, *[(F.sum(c).over(w) + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums],
        *[F.col(f"tot_{c}") for c in sums])


def exact_quantiles(long: DataFrame, probs: dict[str, float], group: list[str]) -> DataFrame:
    """Exact quantiles with linear interpolation (NumPy/pandas default).

    Works from value counts and prefix sums, so no group's values are ever
    held by one task: the value at 0-based rank r is the smallest value whose
    inclusive running count exceeds r.
    """
    vc = long.groupBy(*group, "value").agg(F.count("*").alias("n"))
    rt = running_totals(vc, group, "value", ["n"])
    aggs = [F.max("tot_n").alias("n")]
    for name, q in probs.items():
        pos = (F.col("tot_n") - 1) * F.lit(float(q))
        aggs.append(F.min(F.when(F.col("cum_n") > F.floor(pos), F.col("value"))).alias(f"_lo_{name}"))
        aggs.append(F.min(F.when(F.col("cum_n") > F.ceil(pos), F.col("value"))).alias(f"_hi_{name}"))
    a = rt.groupBy(*group).agg(*aggs)
    outs = []
    for name, q in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(q))
        frac = pos - F.floor(pos)
        outs.append((F.col(f"_lo_{name}") + frac * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    return a.select(*group, F.col("n").cast("long").alias("n"), *outs)


def side_quantiles(long: DataFrame | None, probs: dict[str, float],
                   cdf: DataFrame | None = None) -> DataFrame:
    """Exact per-side quantiles (linear interpolation) from the *same* side
    value counts and prefix sums the KS statistic uses (``cdf`` when it is
    already materialised). Returns (src, column_name, n, <prob names>)."""
    rt = cdf if cdf is not None else running_totals(side_value_counts(long), "column_name", "value",
                                                    ["n_real", "n_synth"])
    aggs = []
    for side, cum, tot in (("r", "cum_n_real", "tot_n_real"), ("s", "cum_n_synth", "tot_n_synth")):
        aggs.append(F.max(tot).alias(f"_n_{side}"))
        for name, q in probs.items():
            pos = (F.col(tot) - 1) * F.lit(float(q))
            aggs.append(F.min(F.when(F.col(cum) > F.floor(pos), F.col("value"))).alias(f"_lo_{side}_{name}"))
            aggs.append(F.min(F.when(F.col(cum) > F.ceil(pos), F.col("value"))).alias(f"_hi_{side}_{name}"))
    a = rt.groupBy("column_name").agg(*aggs)
    rows = []
    for side, src in (("r", REAL), ("s", SYNTH)):
        fields = [F.lit(src).alias("src"), F.col(f"_n_{side}").cast("long").alias("n")]
        for name, q in probs.items():
            pos = (F.col(f"_n_{side}") - 1) * F.lit(float(q))
            frac = pos - F.floor(pos)
            lo, hi = F.col(f"_lo_{side}_{name}"), F.col(f"_hi_{side}_{name}")
            fields.append((lo + frac * (hi - lo)).alias(name))
        rows.append(F.struct(*fields))
    out = a.select("column_name", F.explode(F.array(*rows)).alias("t"))
    return (out.select(F.col("t.src").alias("src"), "column_name", F.col("t.n").alias("n"),
                       *[F.col(f"t.{k}").alias(k) for k in probs])
               .where(F.col("n") > 0))


def side_moments(long_num: DataFrame) -> DataFrame:
    """Per column and side: n, min, max, mean, sample and population variance.
    Range profiles, Welch's t and the score terms all select from this one
    aggregate, so a plan that needs several of them shares one shuffle."""
    aggs = []
    for side, lab in ((is_real(), "real"), (is_synth(), "synthetic")):
        v = F.when(side, F.col("value"))
        aggs += [F.count_if(side).alias(f"n_{lab}"), F.min(v).alias(f"min_{lab}"), F.max(v).alias(f"max_{lab}"),
                 F.avg(v).alias(f"mean_{lab}"), F.var_samp(v).alias(f"var_{lab}"),
                 F.var_pop(v).alias(f"varpop_{lab}")]
    return long_num.groupBy("column_name").agg(*aggs)
