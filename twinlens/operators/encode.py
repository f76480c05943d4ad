"""Encodings fitted on the real side and applied to both.

Every "fit" is an aggregate over the real rows that yields one small row (or
one row per category); applying it is a broadcast join or a crossJoin with a
single row, never a collect.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.testdata import Twin
from .reshape import exact_quantiles, is_real, running_totals


def coerce_numeric_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    """Try-cast to double, failures and nulls -> 0."""
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, *[F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)).alias(c)
                              for c in cols])


def _first_rows(twin: Twin, col: str) -> DataFrame:
    """(value, _first): each real category with its least row id."""
    return (twin.df.where(is_real() & F.col(col).isNotNull())
            .groupBy(F.col(col).cast("string").alias("value")).agg(F.min("row_id").alias("_first")))


def first_appearance_codes(twin: Twin, col: str) -> DataFrame:
    """(value, code) with codes in order of first appearance in the
    real side (by row_id); one row per real category."""
    # rank by first row id from distributed prefix sums (no single-task sort)
    one = _first_rows(twin, col).select("value", "_first", F.lit(1).alias("_one"), F.lit(0).alias("_g"))
    rt = running_totals(one, "_g", "_first", ["_one"])
    return rt.select("value", (F.col("cum__one") - 1).cast("long").alias("code"))


def encode_for_distance(twin: Twin) -> tuple[DataFrame, list[str]]:
    """P13 + P14 + P12: own-side median fill for numerics, first-appearance
    codes / max(1, max code) for categoricals (unseen -> -1), then min-max
    scaling by the real side's min and max. Returns (src, row_id, f_*)."""
    df = twin.df
    feats = []
    med = exact_quantiles(
        df.select("src", "row_id", *[F.col(c).cast("double").alias(c) for c in twin.numeric])
          .unpivot(["src", "row_id"], twin.numeric, "column_name", "value")
          .where(F.col("value").isNotNull() & ~F.isnan("value")),
        {"median": 0.5}, ["src", "column_name"]) if twin.numeric else None
    if med is not None:
        medw = med.groupBy("src").pivot("column_name", twin.numeric).agg(F.first("median"))
        df = df.join(F.broadcast(medw.select("src", *[F.col(c).alias(f"_med_{c}") for c in twin.numeric])),
                     "src", "left")  # two rows
        for c in twin.numeric:
            df = df.withColumn(f"f_{c}", F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")))
            feats.append(f"f_{c}")
    # the real side's limits follow from its raw columns: a filled value lies between
    # them, codes run from 0 (from -1 if a category is missing) to their number less one
    real = twin.df.where(is_real())
    limits = real.agg(*[F.min(F.col(c).cast("double")).alias(f"mn_{c}") for c in twin.numeric],
                      *[F.max(F.col(c).cast("double")).alias(f"mx_{c}") for c in twin.numeric],
                      *[F.count_if(F.col(c).isNull()).alias(f"na_{c}") for c in twin.categorical])
    st = limits.agg(F.first(F.struct(*limits.columns))).scalar()
    df = df.withColumn("_st", st)
    low, high = {}, {}
    for c in twin.numeric:
        low[c], high[c] = F.col("_st").getField(f"mn_{c}"), F.col("_st").getField(f"mx_{c}")
    for c in twin.categorical:
        n = _first_rows(twin, c).agg(F.count("*")).scalar()
        # one row per real category: grows with the column's cardinality, so
        # no broadcast hint - Spark broadcasts it only under its own size check
        codes = first_appearance_codes(twin, c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        df = df.join(codes, F.col(c).cast("string") == F.col(f"_v_{c}"), "left").withColumn(f"_n_{c}", n)
        den = F.greatest(F.lit(1), F.col(f"_n_{c}") - 1)
        df = df.withColumn(f"f_{c}", F.coalesce(F.col(f"_c_{c}"), F.lit(-1)) / den)
        low[c] = F.when(F.col("_st").getField(f"na_{c}") > 0, F.lit(-1)).otherwise(F.lit(0)) / den
        high[c] = (F.col(f"_n_{c}") - 1) / den
        feats.append(f"f_{c}")
    return df.select("src", "row_id", *[_scaled(F.col(f"f_{c}"), low[c], high[c]).alias(f"f_{c}") for c in twin.columns]), feats


def _scaled(v, low, high):
    return (v - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)


def min_max_by_real(df: DataFrame, feats: list[str]) -> DataFrame:
    """(v - min_real) / (max_real - min_real); a constant feature keeps
    v - min (scale 1), as scikit-learn's MinMaxScaler does."""
    st = df.where(is_real()).agg(*[F.min(c).alias(f"_mn_{c}") for c in feats],
                                 *[F.max(c).alias(f"_mx_{c}") for c in feats])
    j = df.crossJoin(F.broadcast(st))  # one row
    return j.select("src", "row_id", *[_scaled(F.col(c), F.col(f"_mn_{c}"), F.col(f"_mx_{c}")).alias(c) for c in feats])


FLOAT32_MAX = 3.4028234663852886e38  # fixed value: largest finite float32


def finite_float(v):
    """float32 cell with missing / NaN -> 0 and +/-inf -> +/- float32 max."""
    v = F.nanvl(v, F.lit(0.0))
    v = (F.when(v == float("inf"), F.lit(FLOAT32_MAX)).when(v == float("-inf"), F.lit(-FLOAT32_MAX))
          .otherwise(v))
    return F.coalesce(v, F.lit(0.0)).cast("float")


@dataclass
class OneHot:
    """A fitted encoder: ``levels`` (position, value, index) has a row per real level
    but the first of each categorical column (``position``); numeric column j has the
    index n_levels + j.  ``n_levels`` is a scalar column."""
    categorical: list[str]
    numeric: list[str]
    levels: DataFrame
    n_levels: Column

    @property
    def size(self) -> Column:
        return (self.n_levels + len(self.numeric)).cast("int")


def fit_one_hot(twin: Twin) -> OneHot:
    """P10: real levels sorted per column, the *first* of each dropped, numbered over
    all columns by distributed prefix sums; a dictionary of any size stays a table."""
    wide = twin.df.where(is_real()).select(*[F.col(c).cast("string").alias(c) for c in twin.categorical])
    pairs = [x for p, c in enumerate(twin.categorical) for x in (F.lit(p), F.col(f"`{c}`"))]
    if pairs:
        found = (wide.select(F.stack(F.lit(len(twin.categorical)), *pairs).alias("position", "value"))
                 .where("value IS NOT NULL").distinct())
    else:
        found = twin.df.sparkSession.createDataFrame([], "position int, value string")
    first = found.groupBy("position").agg(F.min("value").alias("_first"))      # one row per column
    kept = found.join(F.broadcast(first), "position").where("value <> _first").select(
        F.struct("position", "value").alias("_o"), F.lit(1).alias("_one"), F.lit(0).alias("_g"))
    levels = running_totals(kept, "_g", "_o", ["_one"]).select("_o.*", (F.col("cum__one") - 1).cast("int").alias("index"))
    return OneHot(twin.categorical, twin.numeric, levels, kept.agg(F.count("*")).scalar())


def encode_one_hot(df: DataFrame, enc: OneHot) -> DataFrame:
    """P10 + P11: (src, row_id, size, indices, values) - sparse rows, indices ascending,
    zeros left out.  Unknown and missing levels set nothing; numerics are coerced,
    failures -> 0, as float32.  Each categorical column is joined with its levels,
    without a broadcast hint: Spark broadcasts a dictionary under its own size check."""
    out = df.withColumn("_m", enc.n_levels)
    entries = []
    for p, c in enumerate(enc.categorical):
        of_column = enc.levels.where(F.col("position") == p).select(F.col("value").alias(f"_v{p}"), F.col("index").alias(f"_i{p}"))
        out = out.join(of_column, F.col(f"`{c}`").cast("string") == F.col(f"_v{p}"), "left")
        entries.append(F.struct(F.col(f"_i{p}").alias("i"), F.lit(1.0).cast("float").alias("v")))
    for j, c in enumerate(enc.numeric):
        value = finite_float(F.col(f"`{c}`").cast("string").try_cast("double"))
        entries.append(F.struct((F.col("_m") + j).cast("int").alias("i"), value.alias("v")))
    cells = F.filter(F.array(*entries), lambda e: e["i"].isNotNull() & (e["v"] != 0))
    rows = out.select("src", "row_id", (F.col("_m") + len(enc.numeric)).cast("int").alias("size"), cells.alias("_e"))
    return rows.select("src", "row_id", "size", F.col("_e.i").alias("indices"), F.col("_e.v").alias("values"))


def value_at(i: int) -> Column:
    """Feature i of a sparse row."""
    at = F.array_position("indices", i).cast("int")
    return F.when(at > 0, F.get("values", at - 1)).otherwise(F.lit(0.0).cast("float"))


def dense_line() -> Column:
    """A sparse row as one line of comma-separated values."""
    cells = F.map_from_arrays("indices", "values")
    return F.concat_ws(",", F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.coalesce(F.element_at(cells, i), F.lit(0.0).cast("float")).cast("string")))
