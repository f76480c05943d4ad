"""Embedding near-duplicates: sign hashing, exact cosine, connected components.

Equal vectors are collapsed first.  Every distinct vector gets one code per
table: the signs of its products with the table's random hyperplanes.  Vectors
that share a code in some table are compared by their cosine in double
precision; a pair counts in the first table in which it meets, so it is linked
once.  The number of tables follows from the bits and ``MISS``: a pair at the
threshold is overlooked with that probability at most.

A bucket is never capped.  It is dealt into blocks of ``BLOCK`` vectors by hash
and block meets block, so a hot bucket becomes many block pairs, and no pairs
leave a task: only each vector's number of links and, per block pair, one edge
from a vector to the least vector it hangs together with there.  Block pairs
travel in lanes of a bounded number of rows.

Defined results: a null, empty or zero vector, one with a null or non-finite
component, and vectors of another length than their partner's link with
nothing; equal vectors link with one another; a null id takes part as a row
without an id (it counts as a neighbour, and its own component is null);
repeated ids are rows of one id; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import connected_components

THRESHOLD = 0.95
MISS = 1e-4
BLOCK = 256
LANE_ROWS = 20_000
SEED = 11


def n_tables(bits: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Tables needed so that a pair at the threshold meets with probability 1 - miss."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - agree))


def bits_for(n: int) -> int:
    """Bits that leave a few unrelated vectors a bucket, whatever the table's size."""
    return max(8, math.ceil(math.log2(max(n, 2))) - 2)


def _planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, bits * tables))


def _codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    signs = (vectors @ _planes(vectors.shape[1], bits, tables) > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def distinct_vectors(df: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, vector, good) and (distinct: rep, vector, copies)."""
    v = F.col(f"`{embedding}`").cast("array<double>")
    good = F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.when(good, v).alias("vector"))
    rows = saved(rows.withColumn("key", F.xxhash64("vector")), "vectors")
    distinct = (rows.where("vector IS NOT NULL").groupBy("key", "vector")
                .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
                .withColumn("d", F.monotonically_increasing_id()))
    return rows, saved(distinct, "vectors-distinct")


def _coded(distinct: DataFrame, bits: int, tables: int) -> DataFrame:
    """One row per distinct vector and table: d, table, code."""
    import pyarrow as pa

    def coded(batches):
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                for some in np.array_split(at, max(1, len(at) // 2000)):
                    codes = _codes(np.array([vectors[i] for i in some]), bits, tables)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids[some], tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(some))),
                         pa.array(codes.ravel()), pa.array(np.full(len(some) * tables, dim, dtype=np.int32))],
                        ["d", "table", "code", "dim"])
    return distinct.select("d", "vector").mapInArrow(coded, "d long, table int, code long, dim int")


def _block_pairs(coded: DataFrame) -> DataFrame:
    """d, bucket, side: every vector once per block pair of its bucket."""
    bucket = ["table", "dim", "code"]
    sizes = (coded.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .select(*bucket, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("d", F.lit(SEED)), F.col("blocks")).cast("int")
    d = coded.join(sizes, bucket).withColumn("own", own)
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return d.select("d", *bucket, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
                    F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"))


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                    threshold: float = THRESHOLD, bits: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    import pandas as pd
    rows, distinct = distinct_vectors(df, vec_id, embedding)
    n = distinct.count()
    bits = bits or bits_for(n)
    tables = n_tables(bits, threshold)
    pairs = saved(_block_pairs(saved(_coded(distinct, bits, tables), "sign-codes")), "block-pairs")
    n_lanes = max(1, math.ceil(pairs.count() / LANE_ROWS))
    pairs = pairs.withColumn("lane", F.pmod(F.xxhash64("table", "dim", "code", "x", "y"), F.lit(n_lanes)))
    work = pairs.join(distinct.select("d", "vector", "copies"), "d")

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dim", "table", "code", "x", "y", "side"], kind="stable")
        out_d, out_links, out_least = [], [], []
        for _, same in pdf.groupby("dim", sort=False):
            vectors = np.array(same["vector"].tolist(), dtype=np.float64)
            unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
            ids, copies, side = (same[c].to_numpy() for c in ("d", "copies", "side"))
            table = same["table"].to_numpy()
            uniq, back = np.unique(ids, return_index=True)
            codes = dict(zip(uniq.tolist(), _codes(vectors[back], bits, tables), strict=True)) if len(uniq) else {}
            key = same[["table", "code", "x", "y"]].to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(ids)])), strict=True):
                one_block = key[a][2] == key[a][3]
                left = np.arange(a, b) if one_block else np.arange(a, b)[side[a:b] == 0]
                right = left if one_block else np.arange(a, b)[side[a:b] == 1]
                if not len(left) or not len(right) or (one_block and len(left) < 2):
                    continue
                hit = unit[left] @ unit[right].T >= threshold
                if one_block:
                    np.fill_diagonal(hit, False)
                i, j = np.nonzero(hit)
                if not len(i):
                    continue
                ci = np.array([codes[x] for x in ids[left]])
                cj = ci if one_block else np.array([codes[x] for x in ids[right]])
                t = table[a]
                first = np.ones(len(i), dtype=bool)
                for u in range(t):                       # met in an earlier table: counted there
                    first &= ci[i, u] != cj[j, u]
                i, j = i[first], j[first]
                if not len(i):
                    continue
                li, rj = left[i], right[j]
                ends = [(ids[li], ids[rj], copies[rj])]
                if not one_block:
                    ends.append((ids[rj], ids[li], copies[li]))
                for me, other, weight in ends:
                    who, inv = np.unique(me, return_inverse=True)
                    least = np.full(len(who), np.iinfo(np.int64).max)
                    np.minimum.at(least, inv, other)
                    out_d.append(who)
                    out_links.append(np.bincount(inv, weight).astype(np.int64))
                    out_least.append(least)
                # links whose least partner does not chain them together need their own edge
                extra = _spanning(ids[li], ids[rj])
                out_d.append(extra[:, 0])
                out_links.append(np.zeros(len(extra), dtype=np.int64))
                out_least.append(extra[:, 1])
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
        return pd.DataFrame({"d": join(out_d), "links": join(out_links), "other": join(out_least)})

    cols = ["lane", "d", "table", "dim", "code", "x", "y", "side", "vector", "copies"]
    found = saved(work.select(*cols).groupBy("lane").applyInPandas(linked, "d long, links long, other long"), "links")
    links = found.groupBy("d").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("d").alias("a"), F.col("other").alias("b")))
    per_vector = (distinct.join(links, "d", "left").join(comp.withColumnRenamed("node", "d"), "d", "left")
                  .withColumn("component", F.coalesce("component", "d"))
                  .withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1))
    least = per_vector.groupBy("component").agg(F.min("rep").alias("component_id"))
    per_vector = per_vector.join(least, "component").select("key", F.col("vector").alias("v"), "links", "component_id")
    out = rows.join(per_vector, (rows["key"] == per_vector["key"]) & (rows["vector"] == per_vector["v"]), "left")
    n_links = F.coalesce("links", F.lit(0)).cast("long")
    component = F.when(F.col("links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"),
                      (F.col("vec_id").eqNullSafe(component)).alias("kept"))


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A forest's edges (node, root) of the links within one block pair."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
    return np.array([(x, root(x)) for x in parent if root(x) != x], dtype=np.int64).reshape(-1, 2)
