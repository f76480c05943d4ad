"""Schema alignment and type inference.

Alignment is planning-time work on ``df.columns`` (no data moves); type
inference is one aggregate over all columns of a side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.testdata import REAL, SYNTH


def _tag(df: DataFrame, src: str) -> DataFrame:
    return df.select(F.lit(src).alias("src"), *df.columns)


def align(real: DataFrame, synth: DataFrame, mode: str = "intersect") -> DataFrame:
    """P1 intersect / P2 union / P3 positional / P4 none, stacked with ``src``."""
    rc, sc = real.columns, synth.columns
    if mode == "intersect":
        shared = [c for c in rc if c in set(sc)]
        if shared:
            return _tag(real.select(*shared), REAL).unionByName(_tag(synth.select(*shared), SYNTH))
        mode = "positional"
    if mode == "positional":
        k = min(len(rc), len(sc))
        names = [f"col_{i}" for i in range(k)]
        r = real.select(*[F.col(c).alias(n) for c, n in zip(rc[:k], names)])
        s = synth.select(*[F.col(c).alias(n) for c, n in zip(sc[:k], names)])
        return _tag(r, REAL).unionByName(_tag(s, SYNTH))
    if mode == "union":
        order = rc + [c for c in sc if c not in set(rc)]
        out = _tag(real, REAL).unionByName(_tag(synth, SYNTH), allowMissingColumns=True)
        return out.select("src", *order)
    if mode == "none":
        return _tag(real, REAL).unionByName(_tag(synth, SYNTH), allowMissingColumns=True)
    raise ValueError(f"unknown alignment mode {mode!r}")


def header_diff(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Real-only, synthetic-only and common names (sorted, '|'-joined)
    and the number of excluded columns, from the two schemas."""
    spark = real.sparkSession
    names = spark.createDataFrame([(list(real.columns), list(synth.columns))], "r array<string>, s array<string>")
    ro, so = F.array_sort(F.array_except("r", "s")), F.array_sort(F.array_except("s", "r"))
    return names.select(F.array_join(ro, "|").alias("real_only"), F.array_join(so, "|").alias("synthetic_only"),
                        F.array_join(F.array_sort(F.array_intersect("r", "s")), "|").alias("common"),
                        (F.size(ro) + F.size(so)).alias("excluded"))


def _fails(c: str) -> Column:
    return F.col(c).cast("string").try_cast("double").isNull()


def infer_types(df: DataFrame, cols: list[str], threshold: float = 0.5,
                by_side: bool = False) -> DataFrame:
    """P6a (real side, nulls count as failures) / P6b (``by_side``: numeric only
    when the failure ratio is <= threshold on both sides) / P6h-style
    all-values check in ``all_parse``.

    Returns (column_name, fail_ratio[_real/_synthetic], all_parse, inferred_type).
    """
    keys = ["src"] if by_side else []
    aggs = []
    for c in cols:
        aggs += [F.avg(F.when(_fails(c), 1.0).otherwise(0.0)).alias(f"fr_{c}"),
                 F.bool_and(F.col(c).isNull() | ~_fails(c)).alias(f"ap_{c}")]
    a = df.groupBy(*keys).agg(*aggs)
    stacks = [F.struct(F.lit(c).alias("column_name"), F.col(f"fr_{c}").alias("fail_ratio"),
                       F.col(f"ap_{c}").alias("all_parse")) for c in cols]
    long = a.select(*keys, F.explode(F.array(*stacks)).alias("t")).select(*keys, "t.*")
    if not by_side:
        return long.select("column_name", "fail_ratio", "all_parse",
                           F.when(F.col("fail_ratio") > threshold, "categorical").otherwise("numeric")
                            .alias("inferred_type"))
    w = long.groupBy("column_name").agg(
        F.max(F.when(F.col("src") == REAL, F.col("fail_ratio"))).alias("fail_ratio_real"),
        F.max(F.when(F.col("src") == SYNTH, F.col("fail_ratio"))).alias("fail_ratio_synthetic"),
        F.bool_and("all_parse").alias("all_parse"))
    num = (F.col("fail_ratio_real") <= threshold) & (F.col("fail_ratio_synthetic") <= threshold)
    return w.select("*", F.when(num, "numeric").otherwise("categorical").alias("inferred_type"))


def discrete_columns(twin_df: DataFrame, cols: list[str], max_distinct: int = 20) -> DataFrame:
    """Per column, discrete iff on each side every value is whole and
    there are at most ``max_distinct`` distinct values."""
    out = []
    for c in cols:
        v = F.col(c).cast("double")
        out.append(twin_df.where(v.isNotNull()).groupBy("src").agg(
            F.lit(c).alias("column_name"), F.bool_and(v == F.floor(v)).alias("_whole"),
            F.count_distinct(v).alias("_k")))
    u = out[0]
    for o in out[1:]:
        u = u.unionByName(o)
    side_ok = F.col("_whole") & (F.col("_k") <= max_distinct)
    return u.groupBy("column_name").agg(F.bool_and(side_ok).alias("is_discrete"),
                                        F.max("_k").alias("max_distinct"))


def categorical_coercion(df: DataFrame, cols: list[str]) -> DataFrame:
    """P20: null or '' -> 'NA', everything else its string form."""
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, *[F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("NA")).alias(c)
                              for c in cols])


# Verdict labels of the variable type table.
TYPE_VERDICTS = ("No data", "Types match", "Missing column", "Numeric (int vs float)", "Type mismatch")
NUMERIC_PREFIX = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"


def parse_float_prefix(c: Column) -> Column:
    """``parseFloat``-style: the leading numeric prefix, else null."""
    m = F.regexp_extract(c, NUMERIC_PREFIX, 0)
    return F.when(m != "", m.try_cast("double"))


def sampled_types(long_str: DataFrame, limit: int = 400) -> DataFrame:
    """P6f per (src, column): over the first ``limit`` non-missing values in
    row order: categorical unless > 50 % parse; integer iff every parsed
    value is whole, else float."""
    from pyspark.sql import Window
    v = long_str.where(F.col("value").isNotNull() & (F.col("value") != ""))
    w = Window.partitionBy("src", "column_name").orderBy("row_id")
    top = v.select("*", F.row_number().over(w).alias("_k")).where(F.col("_k") <= limit)
    num = parse_float_prefix(F.col("value"))
    a = top.groupBy("src", "column_name").agg(
        F.count("*").alias("_n"), F.count(num).alias("_num"),
        F.count_if(num.isNotNull() & (num == F.floor(num))).alias("_int"))
    t = (F.when((F.col("_num") == 0) | (F.col("_num") / F.col("_n") <= 0.5), "categorical")
          .when(F.col("_int") == F.col("_num"), "integer").otherwise("float"))
    return a.select("src", "column_name", t.alias("type"))


def type_match_table(long_str: DataFrame, names: DataFrame, limit: int = 400) -> DataFrame:
    """(variable, real_type, synthetic_type, verdict) sorted by name;
    ``names`` is the union of both sides' column names."""
    t = sampled_types(long_str, limit)
    r = t.where(F.col("src") == REAL).select("column_name", F.col("type").alias("_rt"))
    s = t.where(F.col("src") == SYNTH).select("column_name", F.col("type").alias("_st"))
    j = names.join(r, "column_name", "left").join(s, "column_name", "left")
    rt, st = F.coalesce("_rt", F.lit("—")), F.coalesce("_st", F.lit("—"))
    numeric = lambda c: c.isin("integer", "float")
    verdict = (F.when((rt == "—") & (st == "—"), TYPE_VERDICTS[0]).when(rt == st, TYPE_VERDICTS[1])
                .when((rt == "—") | (st == "—"), TYPE_VERDICTS[2])
                .when(numeric(rt) & numeric(st), TYPE_VERDICTS[3]).otherwise(TYPE_VERDICTS[4]))
    cap = lambda c: F.when(c == "—", c).otherwise(F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 100)))
    return j.select(F.col("column_name").alias("variable"), cap(rt).alias("real_type"),
                    cap(st).alias("synthetic_type"), verdict.alias("verdict")).orderBy("variable")


def in_polygon(x: str, y: str, polygon: list[tuple[float, float]]) -> str:
    """Even-odd ray casting as SQL text (same in both dialects): a point is
    inside when an odd number of polygon edges cross the ray to its right."""
    terms = []
    n = len(polygon)
    for i in range(n):
        xi, yi = polygon[i]
        xj, yj = polygon[(i + n - 1) % n]
        if yi == yj:
            continue
        terms.append(f"(CASE WHEN (({yi!r}E0 > {y}) <> ({yj!r}E0 > {y})) AND "
                     f"({x} < ({xj!r}E0 - {xi!r}E0) * ({y} - {yi!r}E0) / ({yj!r}E0 - {yi!r}E0) + {xi!r}E0) "
                     f"THEN 1 ELSE 0 END)")
    return f"((({' + '.join(terms) or '0'})) % 2 = 1)"


def type_presets(long_str: DataFrame) -> DataFrame:
    """P6c / P6d / P6e / P6g / P6h side by side per (src, column).

    P6c: numeric iff > 50 % of non-empty values in the first 100 rows parse;
    P6d: >= 80 % among the first 200 non-empty; P6e: >= 90 % of all
    non-missing (null when none); P6g: numeric / categorical / empty over the
    first 500 non-missing (> 50 %); P6h: numeric iff every value parses.
    "First n" is row order; each window filter is a per-partition group limit.
    """
    from pyspark.sql import Window
    ok = F.col("value").isNotNull() & (F.trim(F.col("value")) != "")
    parses = F.col("value").try_cast("double").isNotNull()
    w = Window.partitionBy("src", "column_name").orderBy("row_id")

    def share(limit: int | None, name: str):
        v = long_str.where(ok)
        if limit:
            v = v.select("*", F.row_number().over(w).alias("_k")).where(F.col("_k") <= limit)
        return v.groupBy("src", "column_name").agg(
            F.count("*").alias(f"_n_{name}"), F.count_if(parses).alias(f"_p_{name}"))
    rows100 = (long_str.select("*", F.row_number().over(w).alias("_k")).where(F.col("_k") <= 100)
               .where(ok).groupBy("src", "column_name")
               .agg(F.count("*").alias("_n_c"), F.count_if(parses).alias("_p_c")))
    keys = long_str.select("src", "column_name").distinct()
    j = keys
    for part in (rows100, share(200, "d"), share(None, "e"), share(500, "g")):
        j = j.join(part, ["src", "column_name"], "left")
    allp = long_str.groupBy("src", "column_name").agg(
        F.bool_and(F.col("value").isNull() | parses).alias("p6h_all_parse"))
    j = j.join(allp, ["src", "column_name"], "left")
    num = lambda cond: F.when(cond, "numeric").otherwise("categorical")
    r = lambda n: F.coalesce(F.col(f"_p_{n}"), F.lit(0)) / F.col(f"_n_{n}")
    return j.select(
        "src", "column_name",
        num(F.coalesce(r("c"), F.lit(0.0)) > 0.5).alias("p6c"),
        num(F.coalesce(r("d"), F.lit(0.0)) >= 0.8).alias("p6d"),
        F.when(F.coalesce(F.col("_n_e"), F.lit(0)) == 0, F.lit(None).cast("string")).otherwise(num(r("e") >= 0.9))
         .alias("p6e"),
        F.when(F.coalesce(F.col("_n_g"), F.lit(0)) == 0, F.lit("empty")).otherwise(num(r("g") > 0.5)).alias("p6g"),
        "p6h_all_parse")


def normalize_headers(real_cols: list[str], synth_cols: list[str]) -> list[str]:
    """P5: trimmed names, empties dropped, first duplicate wins, real's order
    then synthetic-only names (planning-time work on the two schemas)."""
    out: list[str] = []
    for name in list(real_cols) + list(synth_cols):
        key = name.strip() if isinstance(name, str) else name
        if key and key not in out:
            out.append(key)
    return out


def apply_header_normalization(df: DataFrame) -> DataFrame:
    """P5 on one frame: trim names, drop empty and later duplicate names."""
    seen, cols = set(), []
    for i, name in enumerate(df.columns):
        key = name.strip()
        if key and key not in seen:
            seen.add(key)
            cols.append(F.col(f"`{name}`").alias(key))
    return df.select(*cols)


def numeric_rescue(real: DataFrame, synth: DataFrame, min_numeric: int = 2):
    """When real has fewer than ``min_numeric`` numeric columns, convert
    every real column with at least one parsable value (and the same column of
    synthetic) to double. The decision is one aggregate row over real."""
    from pyspark.sql.types import NumericType
    numeric = [f.name for f in real.schema.fields if isinstance(f.dataType, NumericType)]
    if len(numeric) >= min_numeric:
        return real, synth, []
    cand = [c for c in real.columns if c not in numeric]
    if not cand:
        return real, synth, []
    row = real.agg(*[F.max(F.col(c).cast("string").try_cast("double").isNotNull().cast("int")).alias(c)
                     for c in cand]).collect()[0]
    rescue = [c for c in cand if row[c] == 1]

    def conv(df):
        return df.select(*[F.col(c).cast("string").try_cast("double").alias(c) if c in rescue else F.col(c)
                           for c in df.columns])
    return conv(real), conv(synth), rescue


def _per_column(df: DataFrame, *fields) -> DataFrame:
    """One row per column from one aggregate: (column_name, fields...)."""
    row = df.agg(*[F.struct(*[make(F.col(c)).alias(name) for name, make in fields]).alias(c) for c in df.columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v"))
                                          for c in df.columns])).alias("t")).select("t.column_name", "t.v.*")


def rescued_columns(df: DataFrame) -> DataFrame:
    """(column_name, rescued): a text column holds at least one number."""
    return _per_column(df, ("rescued", lambda c: F.bool_or(c.try_cast("double").isNotNull())))


def inferred_kinds(df: DataFrame) -> DataFrame:
    """(column_name, kind): categorical when more than half of the values fail to parse."""
    fails = lambda c: F.avg(F.when(c.try_cast("double").isNull(), 1.0).otherwise(0.0))
    return _per_column(df, ("kind", lambda c: F.when(fails(c) > 0.5, "categorical").otherwise("numeric")))


def header_values(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Headers of both sides, which side has them, and their values and missing values."""
    def side(df, n):
        return _per_column(df, (n, F.count), (f"{n}_missing", lambda c: F.count(F.lit(1)) - F.count(c)))
    j = side(real, "real_values").join(side(synth, "synthetic_values"), "column_name", "full")
    status = (F.when(F.col("real_values").isNull(), "synthetic_only").when(F.col("synthetic_values").isNull(), "real_only")
              .otherwise("common"))
    return j.select(F.col("column_name").alias("header"), status.alias("status"), "real_values", "real_values_missing",
                    "synthetic_values", "synthetic_values_missing")
