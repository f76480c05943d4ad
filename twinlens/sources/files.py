"""File sources and sinks.

Output paths are placed under the session's ``spark.checkpoint.dir`` (a
shared folder on a cluster) unless the caller gives one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

CODECS = {"parquet": ("none", "snappy", "gzip", "lz4", "zstd"), "json": ("none", "gzip", "bzip2", "deflate")}


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/twinlens-out/{name}-{uuid.uuid4().hex[:8]}"


# ------------------------------------------------------------------ sources
def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Header row, empty lines skipped, every value a string, first
    malformed row aborts."""
    return spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST", ignoreLeadingWhiteSpace=False)


def read_csv_typed(spark: SparkSession, path: str, index_col: str | None = None) -> DataFrame:
    """Typed CSV, optional index column dropped."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.drop(index_col) if index_col else df


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """S3 (array of objects): names come from the objects."""
    return spark.read.json(path, multiLine=True)


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """S3 (array of arrays): the first inner array is the header. Each file is
    one JSON document; rows are exploded with their position so the header is
    picked per file without collecting the data."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("_f"), "value")
    arr = raw.select("_f", F.from_json("value", "array<array<string>>").alias("a"))
    rows = arr.select("_f", F.posexplode("a").alias("pos", "cells"))
    head = rows.where(F.col("pos") == 0).select("_f", F.col("cells").alias("_h"))
    body = rows.where(F.col("pos") > 0).join(F.broadcast(head), "_f")  # one header per file
    return body.select("_f", "pos", F.map_from_arrays("_h", "cells").alias("record"))


def label_tagged(df: DataFrame, label_col: str) -> DataFrame:
    """Rows carrying Real / Synthetic labels -> ``src``."""
    return df.withColumn("src", F.lower(F.col(label_col))).drop(label_col)


def read_package(spark: SparkSession, path: str, side: str | None = None) -> DataFrame:
    """A side-tagged package; the side filter prunes partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col("_dataset_type") == side) if side else df


# ------------------------------------------------------------------ sinks
def write_package(real: DataFrame, synth: DataFrame, path: str, codec: str = "zstd",
                  level: int | None = None) -> str:
    """K1 + K2: both sides in one dataset partitioned by ``_dataset_type``."""
    both = (real.withColumn("_dataset_type", F.lit("real"))
            .unionByName(synth.withColumn("_dataset_type", F.lit("synthetic")), allowMissingColumns=True))
    w = both.write.mode("overwrite").partitionBy("_dataset_type").option("compression", codec)
    if level is not None and codec == "zstd":
        w = w.option("parquet.compression.codec.zstd.level", str(level))
    w.parquet(path)
    return path


def write_json(df: DataFrame, path: str, codec: str = "gzip") -> str:
    """K2 (json format) / K6: JSON lines with a codec."""
    df.write.mode("overwrite").option("compression", codec).json(path)
    return path


def size_report(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """K3: bytes written vs the uncompressed JSON text size of the rows."""
    written = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
               .where(~F.col("path").contains("/_") & ~F.col("path").endswith(".crc"))
               .agg(F.sum("length").alias("compressed_bytes")))
    raw = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("json_bytes"))
    return written.crossJoin(raw).select("*", (F.col("json_bytes") / F.col("compressed_bytes")).alias("ratio"))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """K5: first n rows per side (row order) with the side totals."""
    w = Window.partitionBy("src").orderBy("row_id")
    tot = df.groupBy("src").agg(F.count("*").alias("side_rows"))
    head = df.select("*", F.row_number().over(w).alias("ordinal")).where(F.col("ordinal") <= n)
    return head.withColumn("ordinal", F.col("ordinal").cast("long")).join(F.broadcast(tot), "src")  # two rows


def export_points_csv(points: DataFrame, path: str, dims: list[str], headers: list[str] | None = None) -> str:
    """K7: columns Dim_1..n (or headers) + Type."""
    names = headers or [f"Dim_{i + 1}" for i in range(len(dims))]
    out = points.select(*[F.col(d).alias(n) for d, n in zip(dims, names)],
                        F.when(F.col("src") == "real", "Real").otherwise("Synthetic").alias("Type"))
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def anomaly_report_lines(cells: DataFrame, flags: DataFrame, alpha: float = 0.05) -> DataFrame:
    """K8: the anomaly CSV as ordered text lines: comment header, the cell
    table (3 decimals, default colour #CCCCCC), a blank line, point counts."""
    def f3(c):
        return F.format_string("%.3f", F.col(c))
    head = cells.sparkSession.range(1).select(F.explode(F.array(
        F.lit("# Grid anomaly detection report"), F.lit(f"# FDR alpha: {alpha}"),
        F.lit("cell_x,cell_y,real_count,synthetic_count,cell_proportion,p_value,p_value_adjusted,"
              "is_significant,test_type,color"))).alias("line")).select(
        F.lit(0).alias("section"), F.monotonically_increasing_id().alias("ord"), "line")
    body = cells.select(F.lit(1).alias("section"), (F.col("cell_x") * 100000 + F.col("cell_y")).alias("ord"),
                        F.concat_ws(",", "cell_x", "cell_y", "real_count", "synthetic_count", f3("cell_proportion"),
                                    f3("p_value"), f3("p_value_adjusted"), F.col("is_significant").cast("string"),
                                    "test_type", F.coalesce("color", F.lit("#CCCCCC"))).alias("line"))
    blank = cells.sparkSession.range(1).select(F.lit(2).alias("section"), F.lit(0).alias("ord"), F.lit("").alias("line"))
    pts = flags.select(F.lit(3).alias("section"), F.when(F.col("src") == "real", 0).otherwise(1).alias("ord"),
                       F.concat_ws(",", "src", "n_points", "in_real_overpopulated", "in_synthetic_overpopulated")
                       .alias("line"))
    return head.unionByName(body).unionByName(blank).unionByName(pts)


def write_encoded_csv(rows: DataFrame, path: str) -> str:
    """K9 sink: sparse encoded rows as dense CSV lines of all features, written in
    parallel below ``path``/rows, with the header line in ``path``/header."""
    from ..operators.encode import dense_line
    rows.select(dense_line().alias("line")).write.mode("overwrite").text(f"{path}/rows")
    names = F.concat_ws(",", F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.concat(F.lit("f"), i)))
    rows.select("size").limit(1).select(names.alias("line")).coalesce(1).write.mode("overwrite").text(f"{path}/header")
    return path


def read_encoded_csv(spark: SparkSession, path: str) -> DataFrame:
    header = spark.read.text(f"{path}/header").first()
    names = header["value"].split(",") if header else []
    return spark.read.schema(", ".join(f"`{n}` string" for n in names)).csv(f"{path}/rows")


def write_lines(lines: DataFrame, path: str) -> str:
    """K8 sink: one ordered text file (the report is at most cells + a few
    lines, so a single output file is bounded)."""
    lines.orderBy("section", "ord").select("line").coalesce(1).write.mode("overwrite").text(path)
    return path
