"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SPACE = r"[\x20\x09-\x0D]+"          # runs between words
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Words of a text in order, JVM-side."""
    return F.filter(F.split(text, SPACE), lambda w: w != F.lit(""))


def beside(df: DataFrame, text: str, step, results: list[str]) -> DataFrame:
    """Run ``step`` on (row, text) and put its ``results`` beside the columns of
    ``df``.  The input columns travel packed in ``row``, so none can clash with a
    working column; one that bears a result's name is replaced by the result."""
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                       text_or_empty(text).alias("text"))
    kept = [c for c in df.columns if c not in results]
    return step(packed).select(*[F.col("row").getField(c).alias(c) for c in kept], *results)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    The folder is the one the session names in ``spark.checkpoint.dir``, so the
    rows outlive any executor, and the reread frame carries real size statistics.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lanes(spark: SparkSession) -> int:
    """Number of lanes a hot group is dealt over: the session's shuffle width."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """``df`` marked for broadcast when it is counted to hold few rows, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def runs(batch, column: int = 0, limit: int = 2 << 20):
    """Cut an Arrow batch into slices of about ``limit`` bytes of the text in
    ``column`` (one row at least), so that no whole batch becomes Python objects."""
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes.astype(np.int64) + 64), 0
    while at < len(ends):
        until = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
        until = max(until, at + 1)
        yield batch.slice(at, until - at)
        at = until


def text_runs(batch, column: int):
    """The texts of an Arrow batch as bytes, a list of about 2 MB at a time."""
    import pyarrow as pa
    for part in runs(batch, column):
        yield part.column(column).cast(pa.binary()).to_pylist()
