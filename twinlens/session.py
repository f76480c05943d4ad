"""Spark session and lineage helpers.

Cluster settings (checkpoint dir, shuffle partitions) come from the session
the caller hands in; local defaults are only applied when a setting is unset.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "twinlens") -> SparkSession:
    """Local session for tests and the bench; on a cluster use the given one."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (SparkSession.builder
               .master(master or f"local[{cpus}]")
               .appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g"))
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder; set a scratch one only when none is set.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is left
    untouched; the local fallback is for tests and single-machine runs.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
        current = current or sc.getCheckpointDir()
    except Exception:  # pragma: no cover - sessions without a context
        sc = None
    if not current:
        if sc is not None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="twinlens-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc is not None:
        try:
            if not sc.getCheckpointDir():
                sc.setCheckpointDir(current)
        except Exception:  # pragma: no cover
            pass
    return current


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers once a session, for plans with Python
    functions that import from it (a driver started elsewhere has it on its own
    path only)."""
    sc = spark.sparkContext
    if getattr(sc, "_twinlens_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="twinlens-"), "twinlens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("twinlens", os.path.relpath(full, here)))
    sc.addPyFile(path)
    sc._twinlens_shipped = True


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint dir (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
