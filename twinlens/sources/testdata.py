"""Fixture bindings over the driver tables.

Each binding has a Spark builder and the same relation as DuckDB SQL text,
so that a registered query and its oracle read identical rows. A "twin" frame
has ``src`` ('real' / 'synthetic'), an orderable unique ``row_id`` and the
feature columns. ``lineitem`` has no single-column key, so its ``row_id`` is
the struct (l_orderkey, l_linenumber, l_partkey, l_suppkey), which is unique
and orders the same way in both engines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

REAL, SYNTH = "real", "synthetic"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@dataclass
class Twin:
    """Both sides in one frame, plus the column catalogue."""
    df: DataFrame
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return self.numeric + self.categorical

    def side(self, src: str) -> DataFrame:
        return self.df.where(F.col("src") == src)


# ---------------------------------------------------------------- lineitem
LI_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_CATEGORICAL = ["l_linestatus"]


def lineitem_twin(spark: SparkSession, sf_dir: str) -> Twin:
    li = table(spark, sf_dir, "lineitem")
    df = li.select(
        F.when(F.col("l_returnflag") == "R", F.lit(REAL)).otherwise(F.lit(SYNTH)).alias("src"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        *[F.col(c).cast("double").alias(c) for c in LI_NUMERIC],
        *LI_CATEGORICAL)
    return Twin(df, list(LI_NUMERIC), list(LI_CATEGORICAL))


LINEITEM_SQL = (
    "SELECT CASE WHEN l_returnflag = 'R' THEN 'real' ELSE 'synthetic' END AS src, "
    "{'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, "
    "'l_partkey': l_partkey, 'l_suppkey': l_suppkey} AS row_id, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in LI_NUMERIC)
    + ", l_linestatus FROM lineitem")


# ---------------------------------------------------------------- orders
OR_CATEGORICAL = ["o_orderpriority", "o_orderstatus"]


def orders_twin(spark: SparkSession, sf_dir: str) -> Twin:
    o = table(spark, sf_dir, "orders")
    df = o.select(
        F.when(F.col("o_orderkey") % 2 == 0, F.lit(REAL)).otherwise(F.lit(SYNTH)).alias("src"),
        F.col("o_orderkey").alias("row_id"),
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
        *OR_CATEGORICAL)
    return Twin(df, ["o_totalprice"], list(OR_CATEGORICAL))


ORDERS_SQL = (
    "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'real' ELSE 'synthetic' END AS src, "
    "o_orderkey AS row_id, CAST(o_totalprice AS DOUBLE) AS o_totalprice, "
    "o_orderpriority, o_orderstatus FROM orders")


# ------------------------------------------------- customer vs supplier
def customer_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(*[F.col(x).alias(x[2:]) for x in c.columns])


def supplier_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(*[F.col(x).alias(x[2:]) for x in s.columns])


CUSTOMER_SQL = ("SELECT c_custkey AS custkey, c_name AS name, c_nationkey AS nationkey, "
                "c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer")
SUPPLIER_SQL = ("SELECT s_suppkey AS suppkey, s_name AS name, s_nationkey AS nationkey, "
                "s_acctbal AS acctbal FROM supplier")


# ---------------------------------------------------------------- 2-D points
def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lineitem_twin(spark, sf_dir).df
    return t.select("src", "row_id", F.col("l_quantity").alias("x"),
                    F.col("l_extendedprice").alias("y"))


LI_POINTS_SQL = (f"SELECT src, row_id, l_quantity AS x, l_extendedprice AS y "
                 f"FROM ({LINEITEM_SQL}) li")

EMB_DIMS = 8


def embedding_twin(spark: SparkSession, sf_dir: str, dims: int = EMB_DIMS) -> Twin:
    e = table(spark, sf_dir, "embeddings")
    cols = [F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)]
    df = e.select(
        F.when(F.col("vec_id") % 2 == 0, F.lit(REAL)).otherwise(F.lit(SYNTH)).alias("src"),
        F.col("vec_id").alias("row_id"), *cols, F.col("label").cast("string").alias("label"))
    return Twin(df, [f"e{i}" for i in range(dims)], ["label"])


def embedding_sql(dims: int = EMB_DIMS) -> str:
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(dims))
    return ("SELECT CASE WHEN vec_id % 2 = 0 THEN 'real' ELSE 'synthetic' END AS src, "
            f"vec_id AS row_id, {cols}, CAST(label AS VARCHAR) AS label FROM embeddings")


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = embedding_twin(spark, sf_dir, 2).df
    return t.select("src", "row_id", F.col("e0").alias("x"), F.col("e1").alias("y"))


EMB_POINTS_SQL = f"SELECT src, row_id, e0 AS x, e1 AS y FROM ({embedding_sql(2)}) e"


# ---------------------------------------------------------------- jobs
def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job table from orders: status O/F/P -> completed/failed/running."""
    o = table(spark, sf_dir, "orders")
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.when(F.col("o_orderstatus") == "O", "completed")
         .when(F.col("o_orderstatus") == "F", "failed").otherwise("running").alias("status"),
        F.when(digit % 3 == 1, "umap").when(digit % 3 == 2, "tsne").otherwise("pca").alias("method"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").cast("double").alias("runtime"),
        (F.col("o_custkey") % 7 == 0).alias("is_favorite"),
        F.col("o_custkey").alias("owner_id"),
        # some jobs name no real samples, some no synthetic ones
        F.concat(F.lit('{"method": 1'),
                 F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(
                     F.concat(F.lit(', "n_real": '), (F.col("o_custkey") % 1000 + 10).cast("string"))),
                 F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(
                     F.concat(F.lit(', "n_synthetic": '), (F.col("o_orderkey") % 1000 + 10).cast("string"))),
                 F.lit("}")).alias("parameters"),
        F.concat(F.lit("job "), F.col("o_orderkey").cast("string")).alias("name"),
        F.when(F.col("o_orderkey") % 13 != 0, (F.col("o_orderkey") % 11) / 10.0).alias("progress"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(None).cast("int"))
         .otherwise((F.col("o_orderkey") % 997).cast("int")).alias("processed_samples"),
        F.concat(F.lit("["), (F.col("o_orderkey") % 997).cast("string"), F.lit(", 2]")).alias("shape"))


JOBS_SQL = (
    "SELECT o_orderkey AS job_id, "
    "CASE WHEN o_orderstatus = 'O' THEN 'completed' WHEN o_orderstatus = 'F' THEN 'failed' "
    "ELSE 'running' END AS status, "
    "CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 3 = 1 THEN 'umap' "
    "WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) % 3 = 2 THEN 'tsne' ELSE 'pca' END AS method, "
    "o_orderdate AS created_at, CAST(o_totalprice AS DOUBLE) AS runtime, "
    "(o_custkey % 7 = 0) AS is_favorite, o_custkey AS owner_id, "
    "'{\"method\": 1' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ', \"n_real\": ' || CAST(o_custkey % 1000 + 10 AS VARCHAR) END "
    "|| CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE ', \"n_synthetic\": ' || CAST(o_orderkey % 1000 + 10 AS VARCHAR) END || '}' "
    "AS parameters, 'job ' || CAST(o_orderkey AS VARCHAR) AS name, "
    "CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 11) / 10.0E0 END AS progress, "
    "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 997 AS INTEGER) END AS processed_samples, "
    "'[' || CAST(o_orderkey % 997 AS VARCHAR) || ', 2]' AS shape "
    "FROM orders")


# ---------------------------------------------------------------- call log
def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an API call log: event_type = endpoint, value = response time."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "ts", F.col("event_type").alias("endpoint"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
        F.col("value").cast("double").alias("response_time"),
        F.when(F.col("user_id") % 2 == 0, "POST").otherwise("GET").alias("method"),
        "props", "user_id", "event_id")


CALL_LOG_SQL = (
    "SELECT ts, event_type AS endpoint, "
    "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, "
    "CAST(value AS DOUBLE) AS response_time, "
    "CASE WHEN user_id % 2 = 0 THEN 'POST' ELSE 'GET' END AS method, props, user_id, event_id "
    "FROM events")
