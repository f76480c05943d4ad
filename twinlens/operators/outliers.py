"""Outlier and anomaly operators (D4-D8, A23, J7 minimum distance).

Rule checks are one broadcast row of real bounds; centroid checks are two
small aggregates; LOF is three joins over an exact kNN relation; the
isolation forest is built per tree with ``applyInPandas`` on small seeded
subsamples and scored with ``mapInPandas`` against the broadcast forest
(100 trees x at most 511 nodes: a fixed size bound).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .neighbours import knn
from .reshape import is_real, is_synth


def rule_anomalies(num_long: DataFrame) -> DataFrame:
    """Synthetic values below real min, above real max, or negative where
    real min >= 0; count and percent of synthetic values; counts > 0 only."""
    b = num_long.where(is_real()).groupBy("column_name").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    j = num_long.where(is_synth()).join(F.broadcast(b), "column_name")  # one row per column
    a = j.groupBy("column_name").agg(
        F.count("*").alias("_n"),
        F.count_if(F.col("value") < F.col("_lo")).alias("below_min"),
        F.count_if(F.col("value") > F.col("_hi")).alias("above_max"),
        F.count_if((F.col("_lo") >= 0) & (F.col("value") < 0)).alias("negative"))
    rows = a.select("column_name", "_n", F.explode(F.array(*[
        F.struct(F.lit(k).alias("rule"), F.col(k).alias("count")) for k in ("below_min", "above_max", "negative")
    ])).alias("r")).select("column_name", "r.rule", "r.count", (F.col("r.count") / F.col("_n") * 100.0).alias("percentage"))
    return rows.where(F.col("count") > 0)


def range_expansion(num_long: DataFrame) -> DataFrame:
    """Real vs synthetic ranges per column and the expansion flags."""
    a = num_long.groupBy("column_name").agg(
        F.min(F.when(is_real(), F.col("value"))).alias("real_min"), F.max(F.when(is_real(), F.col("value"))).alias("real_max"),
        F.min(F.when(is_synth(), F.col("value"))).alias("synthetic_min"),
        F.max(F.when(is_synth(), F.col("value"))).alias("synthetic_max"))
    lo, hi = F.col("synthetic_min") < F.col("real_min"), F.col("synthetic_max") > F.col("real_max")
    return a.select("*", lo.alias("expands_min"), hi.alias("expands_max"), (lo | hi).alias("range_expanded"))


def centroid_outliers(points: DataFrame, threshold: float = 2.5) -> DataFrame:
    """|d - mean d| > threshold * population std of d, with d the
    distance to the centroid of all points."""
    c = points.agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    d = points.crossJoin(F.broadcast(c)).select(
        "src", "row_id", F.sqrt(F.pow(F.col("x") - F.col("_cx"), 2) + F.pow(F.col("y") - F.col("_cy"), 2)).alias("distance"))
    s = d.agg(F.avg("distance").alias("_m"), F.stddev_pop("distance").alias("_s"))
    return (d.crossJoin(F.broadcast(s)).where(F.abs(F.col("distance") - F.col("_m")) > threshold * F.col("_s"))
             .select("src", "row_id", "distance"))


def cluster_metrics(points: DataFrame, label: str) -> DataFrame:
    """Per label count, centroid, mean / max distance to it, x / y spread."""
    c = points.groupBy(label).agg(F.count("*").alias("count"), F.avg("x").alias("centroid_x"),
                                  F.avg("y").alias("centroid_y"))
    j = points.join(F.broadcast(c), label)  # one row per label
    dist = F.sqrt(F.pow(F.col("x") - F.col("centroid_x"), 2) + F.pow(F.col("y") - F.col("centroid_y"), 2))
    return j.groupBy(label).agg(
        F.first("count").alias("count"), F.first("centroid_x").alias("centroid_x"),
        F.first("centroid_y").alias("centroid_y"), F.avg(dist).alias("avg_distance"), F.max(dist).alias("max_distance"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def min_cross_distance(points: DataFrame) -> DataFrame:
    """J7 (minimum part): the smallest real-synthetic distance, exact, from a
    1-NN join instead of all pairs. The all-pairs mean is not computed."""
    nn = knn(points.select("src", "row_id", "x", "y"), ["x", "y"], k=1)
    return nn.agg(F.min("distance").alias("min_distance"))


def local_outlier_factor(points: DataFrame, k: int = 20, threshold: float = 1.5) -> DataFrame:
    """LOF of synthetic points among themselves (fitted on synthetic
    only, as the notebook does), flag LOF > threshold. The mean reach gains 1e-10,
    so that a point with k equal neighbours has a finite density."""
    syn = points.where(is_synth()).select("row_id", "x", "y")
    both = (syn.select(F.lit("real").alias("src"), "row_id", "x", "y")
               .unionByName(syn.select(F.lit("synthetic").alias("src"), "row_id", "x", "y")))
    nb = knn(both, ["x", "y"], k=k + 1, with_ids=True)
    nb = nb.where(F.col("row_id") != F.col("neighbor_id"))
    from pyspark.sql import Window
    w = Window.partitionBy("row_id").orderBy("distance", "neighbor_id")
    nb = nb.select("row_id", "neighbor_id", "distance", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
    kd = nb.where(F.col("rank") == k).select(F.col("row_id").alias("neighbor_id"), F.col("distance").alias("_kd"))
    reach = nb.join(kd, "neighbor_id").select("row_id", "neighbor_id", F.greatest("distance", "_kd").alias("_reach"))
    lrd = reach.groupBy("row_id").agg((1.0 / (F.avg("_reach") + 1e-10)).alias("lrd"))
    lo = nb.join(lrd.select(F.col("row_id").alias("neighbor_id"), F.col("lrd").alias("_lrd_o")), "neighbor_id") \
        .groupBy("row_id").agg(F.avg("_lrd_o").alias("_m"))
    out = lo.join(lrd, "row_id").select("row_id", (F.col("_m") / F.col("lrd")).alias("lof"))
    return out.select("*", (F.col("lof") > threshold).alias("is_outlier"))


# ---------------------------------------------------------- isolation forest
def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search (Liu et al.)."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int):
    """Array-encoded isolation tree: feature, split, left, right, size."""
    feat, split, left, right, size = [], [], [], [], []

    def node(idx, depth):
        i = len(feat)
        feat.append(-1), split.append(0.0), left.append(-1), right.append(-1), size.append(len(idx))
        if depth >= limit or len(idx) <= 1:
            return i
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            return i
        f = int(rng.choice(cand))
        s = float(rng.uniform(lo[f], hi[f]))
        feat[i], split[i] = f, s
        left[i] = node(idx[sub[:, f] < s], depth + 1)
        right[i] = node(idx[sub[:, f] >= s], depth + 1)
        return i
    node(np.arange(len(x)), 0)
    return feat, split, left, right, size


def isolation_forest(points: DataFrame, feats: list[str], trees: int = 100, sample: int = 256,
                     seed: int = 42, threshold: float = 0.5) -> DataFrame:
    """Fit on real, score synthetic: score = 2^(-E[h(x)] / c(sample))."""
    spark = points.sparkSession
    ship_package(spark)
    real = points.where(is_real()).select("row_id", *feats)
    n_real = real.count()
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("row_id").cast("string"))), 1, 12), 16, 10)
         .cast("double") / float(16 ** 12))
    # A row joins the pool with probability q and from there each tree with p / q, so every
    # tree draws each row with p: about four times its sample, of which the least keys stay.
    # One rule at every size: on few rows q is 1 and every tree draws from all of them.
    p = min(1.0, 4.0 * sample / max(1, n_real))
    q = min(1.0, p * trees)
    draw = F.pmod(F.xxhash64(F.lit(seed), "tree", "row_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    per_tree = (real.where(u < q).select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
                .where(draw < p / q))
    from pyspark.sql import Window
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.col("tree").cast("string"), F.lit("|"), F.col("row_id").cast("string")))
    w = Window.partitionBy("tree").orderBy(key)
    picked = per_tree.select("*", F.row_number().over(w).alias("_k")).where(F.col("_k") <= sample).drop("_k")
    limit = int(np.ceil(np.log2(max(sample, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        f, s, lft, rgt, sz = _grow(pdf[feats].to_numpy(float), np.random.default_rng(seed + t), limit)
        return pd.DataFrame({"tree": t, "node": np.arange(len(f)), "feature": f, "split": s,
                             "left": lft, "right": rgt, "size": sz})
    forest = picked.groupBy("tree").applyInPandas(
        build, "tree int, node long, feature long, split double, left long, right long, size long")
    nodes = forest.toPandas()  # trees x nodes <= 100 x 511 rows: bounded
    bc = spark.sparkContext.broadcast(nodes)
    c_n = _c(min(sample, n_real))

    def score(it):
        nd = bc.value
        tabs = [g.sort_values("node") for _, g in nd.groupby("tree")]
        for pdf in it:
            x = pdf[feats].to_numpy(float)
            depth = np.zeros(len(x))
            for tb in tabs:
                fe, sp, le, ri, si = (tb[c].to_numpy() for c in ("feature", "split", "left", "right", "size"))
                cur = np.zeros(len(x), dtype=int)
                h = np.zeros(len(x))
                active = fe[cur] >= 0
                while active.any():
                    go_left = x[np.arange(len(x)), np.where(active, fe[cur], 0)] < sp[cur]
                    nxt = np.where(go_left, le[cur], ri[cur])
                    cur = np.where(active, nxt, cur)
                    h = h + active
                    active = fe[cur] >= 0
                depth += h + np.array([_c(v) for v in si[cur]])
            e = depth / max(len(tabs), 1)
            s = np.power(2.0, -e / c_n) if c_n > 0 else np.zeros(len(x))
            yield pd.DataFrame({"row_id": pdf["row_id"].to_numpy(), "anomaly_score": s})
    syn = points.where(is_synth()).select("row_id", *feats)
    scored = syn.mapInPandas(score, f"row_id {syn.schema['row_id'].dataType.simpleString()}, anomaly_score double")
    return scored.select("*", (F.col("anomaly_score") > threshold).alias("is_anomaly"))
