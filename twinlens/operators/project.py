"""Fit-on-real, transform-both projection.

The reference's projection solvers (UMAP, t-SNE) are single-machine
libraries; the shared contract - fit on the real side only, transform both
sides to 2 components, keep the fitted preprocessing with the model - is
re-aimed as principal components of the real-fitted one-hot rows (first level
dropped), centred on the real mean.

The components come from block power iteration over the sparse rows; no d x d
matrix exists anywhere.  A round multiplies the rows by a block of a few vectors
(a table of one row per feature, joined by feature index, summed per row), and the
products back into the block (summed per feature).  The driver sees the vectors'
inner products alone: a matrix of the block's width.  The few numeric features,
which every row has, do not go through the join but as constants of the schema's
size, so no join key holds all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.testdata import Twin
from .encode import OneHot, encode_one_hot, fit_one_hot
from .reshape import is_real

SPARE = 8               # vectors beside the wanted components
MAX_ROUNDS = 100
TOLERANCE = 1e-11       # change of the wanted unit vectors between rounds that ends them
SETTLED = 1e-6          # below this, a change that no longer halves is rounding noise
SEED = 42


@dataclass
class Projection:
    """``components`` (index, weights): one row per feature; ``offset`` is the
    projected real mean; ``variances`` those of the components on the real side."""
    encoder: OneHot
    components: DataFrame
    offset: list[float]
    variances: list[float]

    @property
    def k(self) -> int:
        return len(self.variances)


def features(twin: Twin) -> tuple[DataFrame, OneHot]:
    enc = fit_one_hot(twin)
    return encode_one_hot(twin.df, enc), enc


def _numeric_weights(block: DataFrame, n_levels: int, n_numeric: int, width: int) -> np.ndarray:
    out = np.zeros((n_numeric, width))
    for r in block.where(F.col("index") >= n_levels).collect():        # one row per numeric column
        out[r["index"] - n_levels] = r["w"]
    return out


def _times(rows: DataFrame, block: DataFrame, width: int, n_levels: int, n_numeric: int, keys: list[str]) -> DataFrame:
    """rows x block: (keys, y) with y an array of ``width``; every row is kept."""
    numeric = _numeric_weights(block, n_levels, n_numeric, width)
    cells = rows.select(*keys, F.explode_outer(F.arrays_zip("indices", "values")).alias("e")).select(
        *keys, F.when(F.col("e.indices") < n_levels, F.col("e.indices")).alias("index"),
        F.when(F.col("e.indices") >= n_levels, F.col("e.indices") - n_levels).alias("_j"),
        F.coalesce(F.col("e.values").cast("double"), F.lit(0.0)).alias("v"))
    j = cells.join(block.where(F.col("index") < n_levels), "index", "left")
    here = [F.coalesce(F.get("w", c), *([F.get(F.lit([float(x) for x in numeric[:, c]]), F.col("_j"))] if n_numeric else []), F.lit(0.0))
            for c in range(width)]
    return j.groupBy(*keys).agg(F.array(*[F.sum(F.col("v") * h) for h in here]).alias("y"))


def _combined(column: Column, m: np.ndarray) -> Column:
    """An array column times a small matrix."""
    return F.array(*[sum((F.get(column, i) * float(m[i, c]) for i in range(m.shape[0])), F.lit(0.0)) for c in range(m.shape[1])])


def _gram(block: DataFrame, column: str, width: int) -> np.ndarray:
    sums = [F.sum(F.get(column, i) * F.get(column, j)) for i in range(width) for j in range(i, width)]
    row = block.agg(*[s.alias(f"s{n}") for n, s in enumerate(sums)]).first()
    out = np.zeros((width, width))
    out[np.triu_indices(width)] = [x or 0.0 for x in row]
    return out + np.triu(out, 1).T


def fit_projection(rows: DataFrame, enc: OneHot, k: int = 2) -> Projection:
    """The first k principal components of the real rows."""
    # an id of one type, whatever row_id is; repeated row ids stay apart
    real = cut_lineage(rows.where(is_real()).select(F.monotonically_increasing_id().alias("r"), "size", "indices", "values"))
    n, size = real.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    n_numeric = len(enc.numeric)
    n_levels = size - n_numeric
    cells = real.select("r", F.explode(F.arrays_zip("indices", "values")).alias("e")).select(
        "r", F.col("e.indices").alias("index"), F.col("e.values").cast("double").alias("v"))
    mean = cut_lineage(cells.groupBy("index").agg((F.sum("v") / n).alias("mean"), F.count("*").alias("_n")))
    width = min(size, k + SPARE)
    # features that the real rows never set have weight 0 throughout
    block = mean.select("index", F.array(*[F.xxhash64(F.lit(SEED), F.lit(c), "index") / float(2 ** 63) for c in range(width)]).alias("w"))
    if not n or not width:
        return Projection(enc, cut_lineage(block.limit(0)), [], [])
    before, last = None, np.inf
    for _ in range(MAX_ROUNDS):
        center = _offset(mean, block, width)
        y = cut_lineage(_times(real, block, width, n_levels, n_numeric, ["r"]).select(
            "r", F.array(*[F.get("y", c) - float(center[c]) for c in range(width)]).alias("y")))
        # rotate to the block's own principal axes, so that large variances do not hide small ones
        values, axes = principal_axes(_gram(y, "y", width))
        wanted = min(k, width)
        turned = block.select("index", _combined(F.col("w"), axes[:, :wanted]).alias("w"))
        change = _change(before, turned, wanted)
        if change <= TOLERANCE or (change <= SETTLED and change > last / 2):
            break
        before, last = turned, change
        y = y.select("r", _combined(F.col("y"), axes / np.sqrt(np.maximum(values, 1e-300))).alias("y"))
        z = cut_lineage(cells.join(y, "r").groupBy("index").agg(
            F.array(*[F.sum(F.col("v") * F.get("y", c)) for c in range(width)]).alias("z")))
        base = orthonormal(_gram(z, "z", width))
        width = base.shape[1]
        block = z.select("index", _combined(F.col("z"), base).alias("w"))
    components = cut_lineage(turned)
    return Projection(enc, components, [float(x) for x in _offset(mean, components, wanted)],
                      [float(x) for x in np.maximum(values[:wanted], 0.0) / max(n - 1, 1)])


def _change(before: DataFrame | None, now: DataFrame, width: int) -> float:
    """The largest distance of a unit vector from its predecessor, signs aside."""
    if before is None or not width:
        return 0.0 if not width else np.inf
    j = before.withColumnRenamed("w", "b").join(now, "index")
    sums = [F.sum(F.pow(op(F.get("w", c), F.get("b", c)), 2)) for c in range(width) for op in (lambda x, y: x - y, lambda x, y: x + y)]
    row = np.array([x or 0.0 for x in j.agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).first()]).reshape(-1, 2)
    return float(np.sqrt(row.min(axis=1)).max())


def principal_axes(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (descending) and vectors of a small symmetric matrix by Jacobi
    rotations, which keep small eigenvalues beside large ones to full precision."""
    a, v = gram.copy(), np.eye(len(gram))
    for _ in range(60):
        turned = False
        for i in range(len(a)):
            for j in range(i + 1, len(a)):
                if abs(a[i, j]) <= 1e-16 * np.sqrt(abs(a[i, i] * a[j, j])):
                    continue
                turned = True
                tau = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = (1.0 if tau >= 0 else -1.0) / (abs(tau) + np.sqrt(1 + tau * tau))
                c = 1 / np.sqrt(1 + t * t)
                turn = np.array([[c, t * c], [-t * c, c]])
                a[:, [i, j]] = a[:, [i, j]] @ turn
                a[[i, j], :] = turn.T @ a[[i, j], :]
                a[i, j] = a[j, i] = 0.0
                v[:, [i, j]] = v[:, [i, j]] @ turn
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


def orthonormal(gram: np.ndarray) -> np.ndarray:
    """Combinations of vectors with these inner products that are orthonormal, each
    of earlier vectors and its own; vectors that depend on earlier ones drop out."""
    found: list[np.ndarray] = []
    for j in range(len(gram)):
        t = np.eye(len(gram))[j]
        for _ in range(2):
            for s in found:
                t = t - s * (s @ gram @ t)
        square = t @ gram @ t
        if square > 1e-13 * gram[j, j]:
            found.append(t / np.sqrt(square))
    return np.array(found).reshape(-1, len(gram)).T


def _offset(mean: DataFrame, block: DataFrame, width: int) -> np.ndarray:
    """The mean row times the block."""
    if not width:
        return np.zeros(0)
    j = mean.join(block, "index").agg(*[F.coalesce(F.sum(F.col("mean") * F.get("w", c)), F.lit(0.0)) for c in range(width)])
    return np.array(j.first(), dtype=float)


def transform(model: Projection, rows: DataFrame) -> DataFrame:
    """Project both sides; (src, row_id, x, y)."""
    n_numeric = len(model.encoder.numeric)
    n_levels = rows.agg(F.coalesce(F.max("size"), F.lit(n_numeric))).first()[0] - n_numeric
    y = _times(rows, model.components, model.k, n_levels, n_numeric, ["src", "row_id"])
    at = [F.get("y", c) - model.offset[c] if c < model.k else F.lit(0.0) for c in range(2)]
    return y.select("src", "row_id", at[0].alias("x"), at[1].alias("y"))


def save(model: Projection, path: str) -> None:
    """Persist the fitted preprocessing with the projection."""
    model.encoder.levels.write.mode("overwrite").parquet(f"{path}/levels")
    model.components.write.mode("overwrite").parquet(f"{path}/components")
    spark = model.components.sparkSession
    spark.createDataFrame([(model.encoder.categorical, model.encoder.numeric, model.offset, model.variances)],
                          "categorical array<string>, numeric array<string>, offset array<double>, variances array<double>"
                          ).write.mode("overwrite").parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> Projection:
    m = spark.read.parquet(f"{path}/model").first()
    levels = spark.read.parquet(f"{path}/levels")
    enc = OneHot(list(m["categorical"]), list(m["numeric"]), levels, levels.agg(F.count("*")).scalar())
    return Projection(enc, spark.read.parquet(f"{path}/components"), list(m["offset"]), list(m["variances"]))


def label_sides(points: DataFrame) -> DataFrame:
    """E5: the combined point set with display labels."""
    return points.select("*", F.when(is_real(), "Real").otherwise("Synthetic").alias("label"))


def metadata(rows: DataFrame) -> DataFrame:
    """Input shape and sample counts (runtime is measured by the caller)."""
    return rows.agg(F.count_if(is_real()).alias("n_real"), F.count_if(~is_real()).alias("n_synthetic"),
                    F.max("size").alias("n_features"))
