"""Exact ranked lexical search by norm buckets (the published LEMP scheme).

A document is a sparse vector of term impacts, an item (query) a vector of term
weights; the score is their inner product in 64-bit integers (impacts in ``_block``,
weights in ``weights``).  The best ``k`` documents of every item are found exactly:

1. Items are taken in blocks of at most ``BLOCK_BYTES`` of text.  One pass over all
   documents counts, per document, its terms and how often each of the block's terms
   stands in it; the rows are written.  Document frequencies, N and L follow from
   them, then impacts and each vector's length (Euclidean norm).
2. Vectors are ordered by length, longest first, over ranges of (length, id, row
   position), so equal vectors spread over tasks, and written.
3. The range of the longest vectors is searched first; its k-th best score of an item
   is the item's threshold everywhere else.  A task takes its vectors in buckets of
   ``BUCKET`` in order of length.  A bucket whose greatest length times the item's is
   under the threshold is pruned (Cauchy-Schwarz).
   Inside a bucket the item's heaviest coordinates are taken until the rest of the
   item times the bucket's greatest length is under the threshold: a document without
   any of them is out.  The others' partial sum plus (rest of the item) x (rest of the
   document's length) bounds their score from above.  Survivors are scored again in
   integers.  Bounds in floating point are widened by ``SLACK``, so none is lost.
4. Each task keeps its k best of every item (that many rows per task and item travel
   at most); a window ranks them.

What goes to the tasks as a whole is one block's item vectors (bounded by the block's
bytes) and three numbers; thresholds of a block come back to the driver (one number
per item).  Many items mean many blocks, each with its own pass over the documents.

Defined results: null and empty texts, and texts without a term, are in no result and
count neither in N nor in L; an item without terms has no row; every item row is a
query of its own, also with a repeated or null id; equal scores go by ascending
document id, null ids last; rows with equal ids are documents of their own; extra
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from .common import runs, saved

K = 20
BLOCK_BYTES = 4 << 20
BUCKET = 16_384
SLACK = 1e-9
NULL_ID = np.iinfo(np.int64).max

# bytes that are no part of a term become blanks, A-Z become a-z
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
               for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def weights(df: np.ndarray, total_docs: int) -> np.ndarray:
    """Per term: floor(1000 ln((2N + 2) / (2 df + 1)))."""
    return np.array([math.floor(1000 * math.log((2 * total_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


class Items:
    """A block's items as sparse vectors, coordinates in descending weight."""

    def __init__(self, keys: list[int], counts: list[dict[int, int]], weight: np.ndarray):
        self.keys = keys
        self.terms, self.weights, self.rest = [], [], []
        for c in counts:
            t = np.fromiter(c.keys(), dtype=np.int64, count=len(c))
            w = weight[t] * np.fromiter(c.values(), dtype=np.int64, count=len(c))
            t, w = t[w > 0], w[w > 0]
            order = np.lexsort((t, -w))
            self.terms.append(t[order])
            self.weights.append(w[order])
            squares = np.cumsum((w[order].astype(float) ** 2)[::-1])[::-1]
            self.rest.append(np.sqrt(np.concatenate((squares, [0.0]))))     # norm without the first j coordinates
        self.n_terms = len(weight)
        self.dense = np.zeros(self.n_terms, dtype=np.int64)


class Best:
    """The k best (score, doc_id) of every item so far, and what is needed to get in."""

    def __init__(self, n_items: int, k: int, threshold: np.ndarray):
        self.k, self.need = k, np.maximum(threshold, 1)
        self.rows = [(np.zeros(0, dtype=np.int64),) * 3 for _ in range(n_items)]

    def add(self, item: int, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.need[item]
        if not keep.any():
            return
        s, d, z = (np.concatenate((a, b[keep])) for a, b in zip(self.rows[item], (score, doc, null), strict=True))
        order = np.lexsort((d, z, -s))[:self.k]
        self.rows[item] = s[order], d[order], z[order]
        if len(order) == self.k:
            self.need[item] = max(self.need[item], int(s[order[-1]]))


def search_bucket(items: Items, best: Best, doc: np.ndarray, null: np.ndarray, norm: np.ndarray, first: np.ndarray,
                  term: np.ndarray, value: np.ndarray, tally: dict | None = None) -> None:
    """Search one bucket; vector i has the coordinates term[first[i]:first[i + 1]];
    ``tally`` counts what was done (for tests)."""
    size = len(doc)
    row = np.repeat(np.arange(size), np.diff(first))
    by_term = np.argsort(term, kind="stable")
    starts = np.searchsorted(term[by_term], np.arange(items.n_terms + 1))
    longest = float(norm.max())
    for i, (t, w, rest) in enumerate(zip(items.terms, items.weights, items.rest, strict=True)):
        need = int(best.need[i])
        if not len(t) or rest[0] * longest * (1 + SLACK) < need:
            continue
        # the fewest heavy coordinates without which no document of the bucket gets there
        focus = int(np.argmax(rest * longest * (1 + SLACK) < need))
        places = np.concatenate([by_term[starts[x]:starts[x + 1]] for x in t[:focus].tolist()])
        if not len(places):
            continue
        rows, values = row[places], value[places].astype(float)
        partial = np.bincount(rows, np.repeat(w[:focus].astype(float), starts[t[:focus] + 1] - starts[t[:focus]]) * values, size)
        seen = np.bincount(rows, values * values, size)
        bound = partial + rest[focus] * np.sqrt(np.maximum(norm * norm * (1 + SLACK) - seen, 0.0))
        survivors = np.flatnonzero((partial > 0) & (bound * (1 + SLACK) >= need))
        if tally is not None:
            tally["touched"] = tally.get("touched", 0) + int((partial > 0).sum())
            tally["scored"] = tally.get("scored", 0) + len(survivors)
        if not len(survivors):
            continue
        items.dense[t] = w
        length = first[survivors + 1] - first[survivors]
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) + np.repeat(first[survivors] - (ends - length), length)
        score = np.add.reduceat(items.dense[term[at]] * value[at], ends - length)
        items.dense[t] = 0
        best.add(i, score, doc[survivors], null[survivors])


def _blocks(items: DataFrame, item_id: str, text: str) -> list[DataFrame]:
    """Item rows (key, item_id, text), cut by bytes of text in row order."""
    rows = saved(items.select(F.col(f"`{item_id}`").alias("item_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
                 .withColumn("key", F.monotonically_increasing_id()), "search-items")
    sizes = rows.select("key", F.shiftright("key", 33).alias("part"), (F.octet_length("text") + 16).cast("long").alias("size"))
    within = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    before, at = {}, 0
    for r in sizes.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect():      # one row per partition
        before[r["part"]], at = at, at + r["size"]
    if at <= BLOCK_BYTES:
        return [rows]
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("part")]
    block = sizes.select("key", F.floor((offset + F.coalesce(F.sum("size").over(within), F.lit(0))) / BLOCK_BYTES).alias("block"))
    dealt = saved(rows.join(block, "key"), "search-blocks")
    numbers = sorted(r["block"] for r in dealt.select("block").distinct().collect())
    return [dealt.where(F.col("block") == b) for b in numbers]


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf): every document with a term; of its terms, those of the
    vocabulary with their counts."""
    import pyarrow as pa
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    width = len(vocabulary) + 1

    def counted(batches):
        number = shared.value
        for batch in batches:
            for run in runs(batch, 1):
                words = [terms(t.as_py() or b"") for t in run.column(1).cast(pa.binary())]
                n = np.array([len(w) for w in words], dtype=np.int64)
                at = np.fromiter((x for w in words for x in map(number.get, w, repeat(-1))), dtype=np.int64, count=int(n.sum()))
                doc = np.repeat(np.arange(len(words)), n)
                pair, tf = np.unique((doc * width + at)[at >= 0], return_counts=True)
                rows = np.flatnonzero(n)
                offsets = np.searchsorted(pair // width, np.append(rows, len(words))).astype(np.int32)
                # documents without terms have no pairs, so the offsets of the kept rows join up
                yield pa.RecordBatch.from_arrays(
                    [run.column(0).take(pa.array(rows)), pa.array(n[rows]),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array((pair % width).astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(tf.astype(np.int32)))], ["doc_id", "n", "term", "tf"])

    out = saved(docs.mapInArrow(counted, "doc_id long, n long, term array<int>, tf array<int>"), "search-vectors")
    shared.destroy()
    return out


def _frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the block's vocabulary."""
    import pyarrow as pa

    def counted(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    out = np.zeros(size, dtype=np.int64)
    per_term = vectors.select("term").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in per_term.collect():        # at most the terms of one block
        out[r["term"]] = r["df"]
    return out


def _search(ordered: DataFrame, items: Items, threshold: np.ndarray, k: int, label: str) -> DataFrame:
    """(key, doc_id, score): each task's k best of every item."""
    import pyarrow as pa
    shared = ordered.sparkSession.sparkContext.broadcast((items, threshold))

    def found(batches):
        block, need = shared.value
        best = Best(len(block.keys), k, need)
        for batch in batches:
            for a in range(0, batch.num_rows, BUCKET):
                part = batch.slice(a, BUCKET)
                ids = part.column(0)
                null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                first = part.column(2).offsets.to_numpy().astype(np.int64)
                search_bucket(block, best, doc, null, part.column(1).to_numpy(), first - first[0],
                              part.column(2).flatten().to_numpy().astype(np.int64), part.column(3).flatten().to_numpy())
        for key, (score, doc, null) in zip(block.keys, best.rows, strict=True):
            if len(score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(score), key)), pa.array(doc, mask=null.astype(bool)), pa.array(score)], ["key", "doc_id", "score"])

    rows = ordered.select("doc_id", "norm", "term", "impact")
    out = saved(rows.mapInArrow(found, "key long, doc_id long, score long"), label)
    shared.destroy()
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """(key, rank, doc_id, score) for one block of items."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    keys, counts = [], []
    for r in block.select("key", "text").orderBy("key").toLocalIterator():      # at most BLOCK_BYTES of text, or one item
        bag: dict[int, int] = {}
        for t in terms(r["text"].encode()):
            x = vocabulary.setdefault(t, len(vocabulary))
            bag[x] = bag.get(x, 0) + 1
        keys.append(r["key"])
        counts.append(bag)
    vectors = _vectors(docs, vocabulary)
    total_docs, total_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    items = Items(keys, counts, weights(_frequencies(vectors, len(vocabulary)), total_docs))
    m = f"(75 + (25 * n * {total_docs}L) div {max(total_terms, 1)}L)"
    impacts = vectors.where(F.size("term") > 0).selectExpr(
        "doc_id", "term", f"transform(tf, x -> (1000000000L * x) div (1000L * x + 12 * {m})) AS impact")
    lengths = impacts.selectExpr("*", "sqrt(aggregate(impact, 0D, (a, x) -> a + double(x) * double(x))) AS norm")
    width = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = (lengths.withColumn("place", F.monotonically_increasing_id())
               .repartitionByRange(width, F.desc("norm"), "doc_id", "place").sortWithinPartitions(F.desc("norm"), "doc_id", "place")
               .withColumn("range", F.spark_partition_id()))
    ordered = saved(ordered.drop("place"), "search-ordered")
    none = np.zeros(len(keys), dtype=np.int64)
    top = _search(ordered.where("range = 0"), items, none, k, "search-longest")
    place = {key: i for i, key in enumerate(keys)}
    for r in top.groupBy("key").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).collect():
        none[place[r["key"]]] = r["least"]
    others = _search(ordered.where("range > 0"), items, none, k, "search-rest")
    return _ranked(top.union(others), k)


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    out = None
    for block in _blocks(items, item_id, item_text):
        ranked = _block(rows, block, k).join(block.select("key", "item_id"), "key")
        ranked = ranked.select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.union(ranked)
    return out
