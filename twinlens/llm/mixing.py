"""Mixing sources to target weights.

Words are summed per source, each source gets a target, and the ratio of target
to size is its repetition rate: every document is emitted floor(rate) times plus
one hash-seeded Bernoulli copy whose probability is the fraction.  An id's hash
yields ``TRIALS`` draws; per source the trial whose total comes nearest to the
target is taken, so small sources don't drift.  Targets are
shares by weight, held to ``max_repeat`` times the source's size; what a capped
source can't take is shared again by weight among the others.  That is a water
level: sort sources by size per weight, and the level is set by the first source
that stays below its cap.

Aggregation per source combines map-side, so a hot source costs one row a task;
documents meet the table of sources by a broadcast when its row count is within
``BROADCAST_SOURCES`` and by a plain join otherwise.

Defined results: null text has size 0; a null source is a source of its own,
last in order; documents of size 0 are emitted like the others (they take no
words); when all sizes are 0 every target and rate is 0; a null id is seeded as
the text '~'; rows that repeat an id get the same draw; extra columns pass
through (a result column replaces one of its name); an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, beside, saved, text_or_empty

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_REPEAT = 2.0
SEED = "mix-1"
TRIALS = 20                           # draws read off one digest
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != F.lit(""))).cast("long")


def digest(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("~"))))


def draw(hex_digest: Column, trial) -> Column:
    """The trial's number in [0, 1): twelve hex digits of the id's digest."""
    return F.conv(F.substr(hex_digest, F.lit(trial) if isinstance(trial, int) else trial, F.lit(12)), 16, 10
                  ).cast("double") / F.lit(float(2 ** 48))


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE,
                   max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> weight, target, rate.  One row per source, so the
    ordering windows see the aggregated table only."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    d = (sizes.withColumn("weight", w)
         .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
         .withColumn("total", F.least(F.sum("source_size").over(everything) * F.lit(float(total_share)),
                                      F.sum("cap").over(everything))))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # the level if this source and all after it stay below their caps
    d = d.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("weight").over(after))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    d = d.withColumn("water", F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything))
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("water")["level"] * F.col("weight")))
    return (d.withColumn("target", target)
            .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                        .otherwise(F.lit(0.0)))
            .select("source", "source_size", "weight", "target", "rate"))


def _with_trials(targets: DataFrame, docs: DataFrame) -> DataFrame:
    """Per source, the trial whose copies come nearest to the target.  ``docs``
    has _key, _hex, size; one sum a trial, combined map-side."""
    fraction = F.col("rate") - F.floor("rate")
    taken = [F.sum(F.when(draw(F.col("_hex"), k) < fraction, F.col("size")).otherwise(0)).alias(f"_x{k}")
             for k in range(1, TRIALS + 1)]
    t = (_join_sources(docs, targets).groupBy("_source")
         .agg(*taken, F.first("target").alias("_target"), F.first("rate").alias("_rate"),
              F.first("source_size").alias("_size")))
    misses = F.array(*[F.struct(F.abs(F.floor("_rate") * F.col("_size") + F.col(f"_x{k}") - F.col("_target")),
                                F.lit(k).alias("trial")) for k in range(1, TRIALS + 1)])
    best = t.select(F.col("_source").alias("_s"), F.array_min(misses)["trial"].alias("trial"))
    return targets.join(best, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")


def _join_sources(d: DataFrame, targets: DataFrame) -> DataFrame:
    small = targets.count() <= BROADCAST_SOURCES
    return d.join(F.broadcast(targets) if small else targets, F.col("_key").eqNullSafe(F.col("_source")), "left")


def plan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
         seed: str = SEED, **kw) -> DataFrame:
    """Input columns plus size, source_size, target, rate, copies, taken."""
    docs = saved(df.select(F.col(f"`{source}`").cast("string").alias("_key"),
                           digest(F.col(f"`{doc_id}`"), seed).alias("_hex"),
                           n_words(text_or_empty(text)).alias("size")), "mix-sizes")
    sizes = docs.groupBy(F.col("_key").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = saved(source_targets(sizes, **kw).withColumnRenamed("source", "_source"), "mix-targets")
    targets = saved(_with_trials(targets, docs), "mix-trials")

    def step(d: DataFrame) -> DataFrame:
        row = F.col("row")
        d = _join_sources(d.withColumns({"_key": row.getField(source).cast("string"),
                                         "size": n_words(F.col("text"))}), targets)
        extra = draw(digest(row.getField(doc_id), seed), F.col("trial")) < F.col("rate") - F.floor("rate")
        d = d.withColumn("copies", F.floor("rate").cast("int") + extra.cast("int"))
        return d.withColumn("taken", F.col("size") * F.col("copies"))
    return beside(df, text, step, ["size", "source_size", "target", "rate", "copies", "taken"])


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **kw) -> DataFrame:
    """The mix itself: every document's row as many times as its copies."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("input"),
                       F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                       F.col(f"`{source}`").alias("source"))
    p = plan(packed, **kw).where("copies > 0")
    return p.select("input", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("input.*")
