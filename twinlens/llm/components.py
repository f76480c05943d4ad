"""Connected components of an edge list by contraction.

In every round each node points at the neighbour (or itself) of least random
rank, edges are rewritten to the nodes pointed at, and duplicates and loops
drop out.  Ranks are drawn anew each round from the round's seed, so long
chains shrink by a constant factor as well.  Each round is written to the
checkpoint folder; a hot node is one key of map-side combined aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved


def _ranked(node: str, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), F.col(node)), F.col(node).alias("id"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node id that links reach, for every node that
    has an edge to another node.  Null ends and loops are no edges."""
    e = saved(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
              .where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct(), "cc-edges")
    labels = saved(e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
                   .withColumn("label", F.col("node")), "cc-labels")
    seed = 0
    while e.limit(1).count():
        seed += 1
        both = e.union(e.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min(_ranked("b", seed)).alias("m"))
        to = saved(least.select(F.col("a").alias("node"), F.least(F.col("m"), _ranked("a", seed))["id"].alias("to")),
                   f"cc-point{seed}")
        labels = saved(labels.join(to.withColumnRenamed("node", "label"), "label", "left")
                       .select("node", F.coalesce("to", "label").alias("label")), f"cc-labels{seed}")
        e = saved(e.join(to.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
                  .join(to.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
                  .where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
                  .distinct(), f"cc-edges{seed}")
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
