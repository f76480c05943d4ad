"""Sharding by balanced label propagation.

Documents with equal texts are linked; every document of such a group starts
with the label (shard) its id hashes to.  The documents of one group that share
a start label (and one of ``PARTS`` parts) form an atom, and atoms move: in each round a join tells every
group its fullest shard that has room left (as many as it has quotas to fill),
the group's other atoms ask to move there, and requests are granted, most links first, as far as the shard's quota
reaches (a two-level prefix sum over (shard, lane), so no task sorts a shard).
Rounds go on until nothing moves, which ends: atoms move whole, out of cells that are
no target, into cells of as many rows or more, so a round with a move adds to the sum of
squared cell sizes, which the group's size bounds.  Unlinked documents have no preference and fill what is left, so
that shard sizes (law ``rows``) differ by one row at most.

Texts are read once, for their length, checksum and group key; rounds work on
atoms, which are counts per (group, start label).  Every round is written to
the checkpoint folder.

Defined results: a null text has size 16, checksum 0 and stands in the group of
null-or-empty texts; null and repeated ids are ordinary rows (repeated rows are
dealt apart by their lane and a row number); extra columns are ignored; fewer
rows than shards leave shards empty; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lanes, saved

SHARDS = 40
PARTS = 8                              # atoms a group has for each start label, at most
OVERHEAD = 16


def _offsets(df: DataFrame, keys: list[str], lane: str, amount: Column) -> DataFrame:
    """Sum of ``amount`` in earlier lanes of the same keys: one row per (keys, lane)."""
    sums = df.groupBy(*keys, lane).agg(F.sum(amount).alias("_sum"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(lane)
    before = F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.select(*keys, lane, before.cast("long").alias("_before"))


def _ranked(df: DataFrame, keys: list[str], order: list, n_lanes: int, out: str) -> DataFrame:
    """Gapless rank from 0 within ``keys``: rank in the lane plus the lanes before."""
    d = df.withColumn("_lane", F.pmod(F.col("h2"), F.lit(n_lanes)))
    off = _offsets(d, keys, "_lane", F.lit(1))
    w = Window.partitionBy(*keys, "_lane").orderBy(*order)
    d = d.withColumn("_rn", F.row_number().over(w) - 1)
    return (d.join(F.broadcast(off), [*keys, "_lane"])
            .withColumn(out, (F.col("_before") + F.col("_rn")).cast("long")).drop("_lane", "_before", "_rn"))


def base_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, checksum, group key and hashes: all later steps need."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    utf8 = F.encode(t, "UTF-8")
    return df.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), (F.octet_length(t) + OVERHEAD).cast("long").alias("size"),
        F.crc32(utf8).alias("text_crc32"), F.xxhash64(t, F.lit("g")).alias("g"), F.octet_length(t).alias("g_len"),
        F.xxhash64(F.col(f"`{doc_id}`").cast("long"), F.lit("s")).alias("h1"),
        F.xxhash64(F.col(f"`{doc_id}`").cast("long"), F.lit("r")).alias("h2"))


def _round(atoms: DataFrame, quota: int, n_lanes: int) -> DataFrame:
    """One round of propagation: atoms with their labels after the granted moves."""
    cells = atoms.groupBy("g", "g_len", "shard").agg(F.sum("n").alias("n_cell"))
    # shards without any linked row have no group to draw, so they need no room entry
    room = (atoms.groupBy("shard").agg(F.sum("n").alias("_used"))
            .select("shard", (F.lit(quota) - F.col("_used")).alias("room")))
    open_cells = cells.join(F.broadcast(room), "shard").where("room > 0")
    # a group of m quotas draws to its m fullest open shards (40 cells a group at most)
    fullest = Window.partitionBy("g", "g_len").orderBy(F.desc("n_cell"), "shard")
    m = cells.groupBy("g", "g_len").agg(F.ceil(F.sum("n_cell") / F.lit(max(1, quota))).cast("int").alias("m"))
    target = (open_cells.withColumn("k", F.row_number().over(fullest)).join(m, ["g", "g_len"]).where("k <= m")
              .select("g", "g_len", "k", F.col("shard").alias("to"), F.col("n_cell").alias("n_to"), "room"))
    own = (cells.join(F.broadcast(room), "shard")
           .select("g", "g_len", "shard", F.col("n_cell").alias("n_own"), (F.col("room") <= 0).alias("full")))
    drawn = target.groupBy("g", "g_len").agg(F.max("k").alias("targets"), F.collect_set("to").alias("all_to"))
    asks = (atoms.join(own, ["g", "g_len", "shard"]).join(drawn, ["g", "g_len"])
            .where(~F.array_contains("all_to", F.col("shard")) | (F.col("targets") == 1))
            .withColumn("k", (F.pmod(F.xxhash64("g", "start"), F.col("targets")) + 1).cast("int"))
            .join(target, ["g", "g_len", "k"]))
    # only towards a cell of more rows (equal ones: out of a full shard, or to the smaller number),
    # so rounds cannot swap for ever
    asks = asks.where((F.col("shard") != F.col("to")) & (
        (F.col("n_to") > F.col("n_own")) | ((F.col("n_to") == F.col("n_own")) & (F.col("full") | (F.col("to") < F.col("shard"))))))
    # lane 0 .. 31: by the links gained, largest target first; equal ones are dealt over further lanes
    size_class = F.lit(31) - F.least(F.lit(31), F.floor(F.log2(F.col("n_to"))).cast("int"))
    asks = asks.withColumn("_lane", size_class * n_lanes + F.pmod(F.xxhash64("g", "start"), F.lit(n_lanes)))
    off = _offsets(asks, ["to"], "_lane", F.col("n"))
    w = Window.partitionBy("to", "_lane").orderBy("g", "start").rowsBetween(Window.unboundedPreceding, 0)
    granted = (asks.withColumn("_run", F.sum("n").over(w)).join(F.broadcast(off), ["to", "_lane"])
               .where(F.col("_before") + F.col("_run") <= F.col("room"))
               .select("g", "g_len", "start", "to"))
    return (atoms.join(granted, ["g", "g_len", "start"], "left")
            .select("g", "g_len", "start", "n", F.coalesce("to", "shard").cast("int").alias("shard"),
                    F.col("to").isNotNull().alias("moved")))


def shard_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, linked."""
    spark = df.sparkSession
    n_lanes = lanes(spark)
    base = saved(base_rows(df, doc_id, text), "shard-base")
    total = base.count()
    start = F.pmod(F.col("h1"), F.lit(shards * PARTS)).cast("int")
    atoms0 = base.groupBy("g", "g_len", start.alias("start")).agg(F.count(F.lit(1)).alias("n"))
    linked = (atoms0.groupBy("g", "g_len").agg(F.sum("n").alias("n_group")).where("n_group > 1")
              .select("g", "g_len"))
    atoms = saved(atoms0.join(linked, ["g", "g_len"])
                  .select("g", "g_len", "start", "n", (F.col("start") % shards).alias("shard"), F.lit(True).alias("moved")),
                  "shard-atoms")
    quota = total // shards
    k, moving = 0, True
    while moving:
        atoms = saved(_round(atoms, quota, n_lanes), f"shard-round{k}")
        k, moving = k + 1, atoms.where("moved").limit(1).count() > 0
    # linked rows keep their label as far as the shard's exact row count reaches
    labels = atoms.select("g", "g_len", "start", F.col("shard").alias("label"))
    d = base.withColumn("start", start).join(labels, ["g", "g_len", "start"], "left")
    d = d.withColumn("label", F.coalesce("label", F.lit(-1)))
    ranked = saved(_ranked(d, ["label"], ["g", "g_len", "h2", "doc_id"], n_lanes, "rank"), "shard-ranked")
    # rows a shard must hold: at most one more than another (one number a shard)
    rows_of = [total // shards + (1 if s < total % shards else 0) for s in range(shards)]
    held = {r["label"]: r["n"] for r in ranked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    fixed = [min(held.get(s, 0), rows_of[s]) for s in range(shards)]
    cap = F.element_at(F.array(*[F.lit(x) for x in rows_of]), F.col("label") + 1)
    stays = (F.col("label") >= 0) & (F.col("rank") < cap)
    placed = ranked.where(stays).withColumns({"shard": F.col("label"), "slot": F.col("rank")})
    fill = _ranked(ranked.where(~stays), [], ["h2", "doc_id"], n_lanes, "k")
    gaps, at = [], 0
    for s in range(shards):
        gaps.append(at)
        at += rows_of[s] - fixed[s]
    # the last shard whose gap begins at or before k and is not empty
    shard = F.lit(0)
    for s in range(shards):
        if rows_of[s] > fixed[s]:
            shard = F.when(F.col("k") >= gaps[s], F.lit(s)).otherwise(shard)
    fill = fill.withColumn("shard", shard)
    fill = fill.withColumn("slot", F.col("k") - F.element_at(F.array(*[F.lit(x) for x in gaps]), F.col("shard") + 1)
                           + F.element_at(F.array(*[F.lit(x) for x in fixed]), F.col("shard") + 1))
    cols = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
            F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
            (F.col("label") >= 0).alias("linked")]
    return placed.select(*cols).unionByName(fill.select(*cols))
