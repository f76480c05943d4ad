"""Column-level helpers (Spark side) built from the shared SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from . import distributions as dist
from .sqlexpr import SPARK, sig


def sig_col(name: str, digits: int = 9) -> Column:
    return F.expr(sig(f"`{name}`", digits)).alias(name)


def round_doubles(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column to ``digits`` significant digits."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.expr(sig(f"CAST(`{f.name}` AS DOUBLE)", digits)).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def expr(sql_builder, *args: str) -> Column:
    """Evaluate a distributions.* builder in the Spark dialect."""
    return F.expr(sql_builder(*args, SPARK))


def ks_pvalue(stat: str, n: str, m: str) -> Column:
    return expr(dist.ks_sf, stat, n, m)


def chi2_pvalue(x: str, dof: str) -> Column:
    return expr(dist.chi2_sf, x, dof)


def t_pvalue(t: str, dof: str) -> Column:
    return expr(dist.t_two_sided, t, dof)


def norm_sf(z: str) -> Column:
    return expr(dist.norm_sf, z)


def binom_greater(k: str, n: str, p: str) -> Column:
    return expr(dist.binom_sf_ge, k, n, p)


def binom_less(k: str, n: str, p: str) -> Column:
    return expr(dist.binom_cdf, k, n, p)
