"""Exact nearest neighbours by an index of occupied cells.

Rows of either side that are equal in all features are one point, so a third of
all rows in one place is one point with its ``k`` least row ids.  The reference
points are dealt into the leaves of a k-d tree over all features (built from a
hash sample of at most ``SAMPLE`` points, the widest feature split at its median);
a leaf's cell is the bounding box of the points it really holds, so empty space
belongs to no cell.  The index - at most ``SAMPLE / 16`` boxes - is what tasks get
as a whole.

Cells are opened best first: a query point opens the nearest cell, then the next
eight, then all others, each time only those whose box is nearer than the k-th
neighbour found so far.  So a far outlier opens few cells, and the result is exact.
Opening is a join: (query, cell) rows meet the cell's points in blocks of at most
``PART_POINTS`` points and about ``LANE_QUERIES`` queries, however many rows a cell
gets; each block returns k points per query, and a window merges them.

Rows with a null, NaN or infinite feature have no neighbours and are none.
Neighbours at equal distance go by row id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .reshape import is_real, is_synth, running_totals

SAMPLE = 1 << 17
CELL_POINTS = 512
PART_POINTS = 1 << 14
LANE_QUERIES = 1 << 12
OPEN = (1, 9, None)         # how many of the nearest cells are open after each round; None: all


@dataclass
class Tree:
    axis: np.ndarray        # split feature of each node, -1 at a leaf
    cut: np.ndarray         # rows at or below go left
    left: np.ndarray
    right: np.ndarray

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(self.axis[node] >= 0)
            if not len(inner):
                return node
            at = node[inner]
            low = x[inner, self.axis[at]] <= self.cut[at]
            node[inner] = np.where(low, self.left[at], self.right[at])


def grow(x: np.ndarray, leaves: int) -> Tree:
    """Split the widest feature of the fullest part at its median until there are
    ``leaves`` parts (equal rows are never split)."""
    nodes: list[list] = [[-1, 0.0, 0, 0]]
    todo, n_leaves = [(0, np.arange(len(x)), max(1, leaves))], 1
    while todo:
        node, rows, share = todo.pop()
        part = x[rows]
        width = np.ptp(part, axis=0) if len(rows) else np.zeros(1)
        axis = int(np.argmax(width))
        if share < 2 or width[axis] <= 0:
            continue
        values = np.sort(part[:, axis])
        cut = values[(len(values) - 1) // 2]
        if cut == values[-1]:
            cut = values[np.searchsorted(values, cut) - 1]
        low = part[:, axis] <= cut
        nodes[node] = [axis, cut, len(nodes), len(nodes) + 1]
        nodes += [[-1, 0.0, 0, 0], [-1, 0.0, 0, 0]]
        n_leaves += 1
        todo += [(len(nodes) - 2, rows[low], share // 2), (len(nodes) - 1, rows[~low], share - share // 2)]
    axis, cut, left, right = zip(*nodes, strict=True)
    return Tree(np.array(axis), np.array(cut, dtype=float), np.array(left), np.array(right))


@dataclass
class Cells:
    ids: np.ndarray
    low: np.ndarray         # one row per cell, one column per feature
    high: np.ndarray

    def distance(self, x: np.ndarray) -> np.ndarray:
        """From each row to each box, a hair too small (never too large)."""
        total = np.zeros((len(x), len(self.ids)))
        for f in range(x.shape[1]):
            v = x[:, f, None]
            gap = np.maximum(np.maximum(self.low[None, :, f] - v, v - self.high[None, :, f]), 0.0)
            total += gap * gap
        return np.sqrt(total) * (1 - 1e-12)

    def opened(self, x: np.ndarray, bound: np.ndarray, first: int, last: int | None):
        """(row, cell id) for the cells of rank first..last-1 by distance that are
        not farther than the row's bound."""
        d = self.distance(x)
        order = np.argsort(d, axis=1, kind="stable")[:, first:last]
        near = np.take_along_axis(d, order, axis=1) <= bound[:, None]
        row, place = np.nonzero(near)
        return row, self.ids[order[row, place]]


def nearest_block(q: np.ndarray, p: np.ndarray, k: int):
    """(query row, point row, distance): the k nearest points of each query, equal
    distances in the order of the points."""
    out = []
    step = max(1, (1 << 22) // max(len(p), 1))
    for a in range(0, len(q), step):
        part = q[a:a + step]
        total = np.zeros((len(part), len(p)))
        for f in range(q.shape[1]):
            gap = part[:, f, None] - p[None, :, f]
            total += gap * gap
        d = np.sqrt(total)
        row, col = np.nonzero(d <= np.partition(d, min(k, len(p)) - 1, axis=1)[:, min(k, len(p)) - 1:min(k, len(p))])
        order = np.lexsort((col, d[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[place < k], col[place < k]
        out.append((row + a, col, d[row, col]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _matrix(batch, names: list[str]) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(c)) for c in names])


def _finite(df: DataFrame, xs: list[str]) -> DataFrame:
    ok = F.lit(True)
    for x in xs:
        ok = ok & F.col(x).isNotNull() & (F.abs(F.col(x)) < float("inf")) & ~F.isnan(x)
    return df.where(ok)


def _points(real: DataFrame, xs: list[str], k: int) -> DataFrame:
    """(pid, x..., ids, m): distinct points in the order of their least row id, with
    their k least row ids and how many these are."""
    first = Window.partitionBy(*xs).orderBy("row_id")
    some = real.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k)
    distinct = some.groupBy(*xs).agg(F.array_sort(F.collect_list("row_id")).alias("ids"))
    keyed = distinct.select(*xs, "ids", F.col("ids")[0].alias("_least"), F.lit(1).alias("_one"), F.lit(0).alias("_g"))
    return cut_lineage(running_totals(keyed, "_g", "_least", ["_one"]).select(
        F.col("cum__one").alias("pid"), *xs, "ids", F.size("ids").alias("m")))


def _index(points: DataFrame, xs: list[str], cell_points: int) -> tuple[DataFrame, Cells, dict[int, int]]:
    """The points with their cell, the cells' boxes, and the points of each cell."""
    import pyarrow as pa
    n = points.count()
    sample = points.select(*xs).orderBy(F.xxhash64("pid"), "pid").limit(SAMPLE).toPandas().to_numpy(dtype=float)
    tree = grow(sample, min(-(-n // cell_points), SAMPLE // 16))

    def assigned(batches):
        for b in batches:
            cell = tree.leaf(_matrix(b, xs))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ["pid", *xs]] + [pa.array(cell, pa.int64())], ["pid", *xs, "cell"])

    schema = ", ".join(["pid long", *[f"{x} double" for x in xs], "cell long"])
    placed = points.select("pid", *xs).mapInArrow(assigned, schema)
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *[F.min(x).alias(f"lo_{x}") for x in xs],
                                       *[F.max(x).alias(f"hi_{x}") for x in xs]).orderBy("cell").toPandas()
    cells = Cells(boxes["cell"].to_numpy(dtype=np.int64), boxes[[f"lo_{x}" for x in xs]].to_numpy(dtype=float),
                  boxes[[f"hi_{x}" for x in xs]].to_numpy(dtype=float))
    return placed, cells, dict(zip(boxes["cell"].tolist(), boxes["n"].tolist(), strict=True))


def _open(queries: DataFrame, placed: DataFrame, cells: Cells, sizes: dict[int, int], xs: list[str], k: int,
          first: int, last: int | None, tally: list | None) -> DataFrame:
    """(qid, pid, distance) of the cells that this round opens."""
    import pyarrow as pa
    spark = queries.sparkSession
    fields = ["qid", *xs, "cell"]

    def visits(batches):
        for b in batches:
            x, bound = _matrix(b, xs), np.asarray(b.column("bound"))
            step = max(1, (1 << 21) // max(len(cells.ids), 1))
            for a in range(0, len(x), step):
                row, cell = cells.opened(x[a:a + step], bound[a:a + step], first, last)
                take = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([b.column(c).take(take) for c in ["qid", *xs]] + [pa.array(cell, pa.int64())], fields)

    schema = ", ".join(["qid long", *[f"{x} double" for x in xs], "cell long"])
    pairs = queries.select("qid", *xs, "bound").mapInArrow(visits, schema)
    # one row per opened cell, at most as many as the index has
    wanted = {r["cell"]: r["n"] for r in pairs.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    if tally is not None:
        tally.append(sum(wanted.values()))
    plan = spark.createDataFrame([(c, -(-sizes[c] // PART_POINTS), -(-n // LANE_QUERIES)) for c, n in wanted.items()],
                                 "cell long, parts int, lanes int")
    deal = F.broadcast(plan)
    left = pairs.join(deal, "cell").select("qid", *xs, "cell", F.pmod(F.xxhash64("qid"), "lanes").cast("int").alias("lane"),
                                           F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = placed.join(deal, "cell").select("pid", *xs, "cell", F.pmod(F.xxhash64("pid"), "parts").cast("int").alias("part"),
                                             F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"))

    def block(queries_of, points_of):
        if not queries_of.num_rows or not points_of.num_rows:
            return pa.table({"qid": pa.array([], pa.int64()), "pid": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        points_of = points_of.sort_by("pid")
        row, col, d = nearest_block(_matrix(queries_of, xs), _matrix(points_of, xs), k)
        return pa.table({"qid": queries_of.column("qid").to_numpy()[row], "pid": points_of.column("pid").to_numpy()[col], "distance": d})

    keys = ("cell", "part", "lane")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, "qid long, pid long, distance double")


def knn(enc: DataFrame, feats: list[str], k: int = 2, target_per_cell: int = CELL_POINTS, with_ids: bool = False,
        tally: list | None = None) -> DataFrame:
    """For each synthetic row, its k nearest real rows: (row_id, rank, distance
    [, neighbor_id]), rank 1..k.  ``tally`` collects the (query point, cell) pairs
    that each round opened."""
    ship_package(enc.sparkSession)
    xs = [f"_x{i}" for i in range(len(feats))]
    rows = _finite(enc.select("src", "row_id", *[(F.col(f"`{c}`").cast("double") + 0.0).alias(x) for c, x in zip(feats, xs, strict=True)]), xs)
    rows = cut_lineage(rows)
    points = _points(rows.where(is_real()), xs, k)
    synth = rows.where(is_synth())
    queries = cut_lineage(synth.select(*xs).distinct().withColumn("qid", F.monotonically_increasing_id()))
    placed, cells, sizes = _index(points, xs, target_per_cell)
    best = Window.partitionBy("qid").orderBy("distance", "pid")
    before = best.rowsBetween(Window.unboundedPreceding, -1)
    found, first = None, 0
    bounded = queries.withColumn("bound", F.lit(float("inf")))
    for last in OPEN:
        new = _open(bounded, placed, cells, sizes, xs, k, first, last, tally).join(points.select("pid", "m"), "pid")
        found = new if found is None else found.unionByName(new)
        # points until their rows are k; a k-th row's distance bounds what is still to be opened
        found = cut_lineage(found.withColumn("_b", F.coalesce(F.sum("m").over(before), F.lit(0))).where(F.col("_b") < k).drop("_b"))
        if last is None or last >= len(cells.ids):
            break
        kth = found.groupBy("qid").agg(F.max("distance").alias("_d"), F.sum("m").alias("_m"))
        bounded = queries.join(kth, "qid", "left").withColumn(
            "bound", F.when(F.col("_m") >= k, F.col("_d")).otherwise(float("inf"))).drop("_d", "_m")
        first = last
    each = found.join(points.select("pid", "ids"), "pid").select("qid", "distance", F.explode("ids").alias("neighbor_id"))
    order = Window.partitionBy("qid").orderBy("distance", "neighbor_id")
    ranked = each.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    # k rows per query point meet the rows at that point
    out = synth.join(queries, xs).select("row_id", "qid").join(ranked, "qid")
    return out.select("row_id", *(["neighbor_id"] if with_ids else []), "rank", "distance")
