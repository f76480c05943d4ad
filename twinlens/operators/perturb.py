"""Perturbations for stress tests.

Random draws come from hashes of (seed, row_id, column), so a value is the
same whatever the partitioning or retry; ``rand(seed)`` would depend on the
partition layout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sample import fraction_subset


def uniform(seed: int, salt: str, row_id: str = "row_id") -> Column:
    """Deterministic U(0, 1) from a 52-bit slice of md5(seed|salt|row_id)."""
    h = F.md5(F.concat(F.lit(f"{seed}|{salt}|"), F.col(row_id).cast("string")))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(16 ** 13)


def normal(seed: int, salt: str) -> Column:
    """Deterministic N(0, 1) by Box-Muller."""
    u1, u2 = uniform(seed, salt + "#1"), uniform(seed, salt + "#2")
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def add_noise(df: DataFrame, cols: list[str], noise_mean: float = 0.0, shift_factor: float = 0.5,
              seed: int = 42) -> DataFrame:
    """X + N(noise_mean, shift_factor * sample std); clipped at 0 when the
    column's minimum is >= 0; rounded when every value is whole. The column
    statistics are one aggregate row."""
    st = df.agg(*[F.stddev_samp(c).alias(f"_sd_{c}") for c in cols],
                *[F.min(c).alias(f"_mn_{c}") for c in cols],
                *[F.bool_and(F.col(c) == F.floor(c)).alias(f"_wh_{c}") for c in cols])
    j = df.crossJoin(F.broadcast(st))
    out = []
    for c in cols:
        v = F.col(c) + (F.lit(noise_mean) + normal(seed, c) * shift_factor * F.col(f"_sd_{c}"))
        v = F.when(F.col(f"_mn_{c}") >= 0, F.greatest(v, F.lit(0.0))).otherwise(v)
        v = F.when(F.col(f"_wh_{c}"), F.round(v)).otherwise(v)
        out.append(v.alias(c))
    keep = [c for c in df.columns if c not in cols]
    return j.select(*keep, *out).select(*df.columns)


def inject_anomalies(df: DataFrame, spec: dict, fraction: float = 0.05, seed: int = 42) -> DataFrame:
    """Overwrite ``spec`` columns in a seeded floor(fraction * N) subset.

    spec: column -> ("int", lo, hi) | ("uniform", lo, hi, digits) | ("const", value)
    Keeps the ``injected`` flag (the index list of the notebook).
    """
    flagged = fraction_subset(df, fraction, seed)
    out = []
    for c in df.columns:
        if c not in spec:
            out.append(F.col(c))
            continue
        kind, *args = spec[c]
        u = uniform(seed, f"inject:{c}")
        if kind == "int":
            lo, hi = args
            v = (F.floor(u * (hi - lo + 1)) + lo).cast(df.schema[c].dataType)
        elif kind == "uniform":
            lo, hi, digits = args
            v = F.round(u * (hi - lo) + lo, digits).cast(df.schema[c].dataType)
        else:
            v = F.lit(args[0]).cast(df.schema[c].dataType)
        out.append(F.when(F.col("injected"), v).otherwise(F.col(c)).alias(c))
    return flagged.select(*out, "injected")
