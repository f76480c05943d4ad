"""Similarity scores (T19-T26): structural, univariate, bivariate, anomaly and
the weighted overall score, each an aggregate over long frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.testdata import REAL, SYNTH
from . import assoc, correlation, dist_tests
from .reshape import is_real, is_synth, side_moments, side_quantiles

# Weights of the reference score definition.
STRUCT_W = {"missing": 0.25, "extra": 0.20, "type": 0.25, "category": 0.15, "range": 0.15}
OVERALL_W = {"structural": 0.25, "univariate": 0.30, "bivariate": 0.30, "anomaly": 0.15}


def _clamp(c):
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def _present(c):
    return F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")


def infer_side_types(real: DataFrame, synth: DataFrame, cols: list[str], share: float = 0.9) -> dict:
    """P6e per side: numeric iff >= 90 % of non-missing values parse; None when
    a column has no values. One aggregate over both sides; two small rows come
    back (one entry per shared column and side)."""
    def tag(df, side):  # strings on both sides: the union never depends on the two dtypes
        return df.select(F.lit(side).alias("_side"), *[F.col(c).cast("string").alias(c) for c in cols])
    both = tag(real, REAL).unionByName(tag(synth, SYNTH))
    aggs = []
    for c in cols:
        ok = _present(c)
        aggs += [F.count_if(ok).alias(f"n_{c}"),
                 F.count_if(ok & F.col(c).cast("string").try_cast("double").isNotNull()).alias(f"p_{c}")]
    rows = {r["_side"]: r for r in both.groupBy("_side").agg(*aggs).collect()}

    def decide(side):
        r = rows.get(side)
        return {c: (None if r is None or r[f"n_{c}"] == 0 else
                    ("numeric" if r[f"p_{c}"] / r[f"n_{c}"] >= share else "categorical")) for c in cols}
    return {"real": decide(REAL), "synthetic": decide(SYNTH)}


def shared_long(real: DataFrame, synth: DataFrame, numeric: list[str], categorical: list[str]):
    def tag(df, src):
        return df.select(F.lit(src).alias("src"), *df.columns)
    both = tag(real.select(*numeric, *categorical), REAL).unionByName(
        tag(synth.select(*numeric, *categorical), SYNTH))
    num = (both.select("src", *[F.col(c).cast("string").try_cast("double").alias(c) for c in numeric])
               .unpivot(["src"], numeric, "column_name", "value")
               .where(F.col("value").isNotNull())) if numeric else None
    cat = (both.select("src", *[F.col(c).cast("string").alias(c) for c in categorical])
               .unpivot(["src"], categorical, "column_name", "value")
               .where(F.col("value").isNotNull() & (F.trim("value") != ""))) if categorical else None
    return num, cat


def structural(real: DataFrame, synth: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """Weighted structural errors; returns (one-row frame, numeric, categorical)."""
    rc, sc = real.columns, synth.columns
    missing = [c for c in rc if c not in sc]
    extra = [c for c in sc if c not in rc]
    shared = [c for c in rc if c in sc]
    types = infer_side_types(real, synth, shared)
    mism = [c for c in shared if types["real"][c] and types["synthetic"][c]
            and types["real"][c] != types["synthetic"][c]]
    same = [c for c in shared if types["real"][c] and types["real"][c] == types["synthetic"][c]]
    numeric = [c for c in same if types["real"][c] == "numeric"]
    categorical = [c for c in same if types["real"][c] == "categorical"]
    num, cat = shared_long(real, synth, numeric, categorical)
    spark = real.sparkSession
    zero = spark.range(1).select(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    if cat is not None:
        allowed = cat.where(is_real()).select("column_name", "value").distinct()
        s = cat.where(is_synth())
        bad = s.join(allowed, ["column_name", "value"], "left_anti").agg(F.count("*").alias("bad"))
        cat_row = s.agg(F.count("*").alias("n")).crossJoin(bad)
    else:
        cat_row = zero
    if num is not None:
        rng = num.where(is_real()).groupBy("column_name").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        j = num.where(is_synth()).join(F.broadcast(rng), "column_name")  # one row per column
        num_row = j.agg(F.count("*").alias("n"),
                        F.count_if((F.col("value") < F.col("_lo")) | (F.col("value") > F.col("_hi"))).alias("bad"))
    else:
        num_row = zero
    nr = float(len(rc))
    row = (cat_row.select(F.col("n").alias("checked_categorical_values"),
                          F.col("bad").alias("invalid_category_values"))
           .crossJoin(num_row.select(F.col("n").alias("checked_numeric_values"),
                                     F.col("bad").alias("out_of_range_values"))))
    missing_err = len(missing) / nr if nr else 0.0
    extra_err = len(extra) / nr if nr else 0.0
    type_err = len(mism) / len(shared) if shared else 0.0
    cat_err = F.when(F.col("checked_categorical_values") > 0,
                     F.col("invalid_category_values") / F.col("checked_categorical_values")).otherwise(0.0)
    rng_err = F.when(F.col("checked_numeric_values") > 0,
                     F.col("out_of_range_values") / F.col("checked_numeric_values")).otherwise(0.0)
    d = _clamp(F.lit(STRUCT_W["missing"] * missing_err + STRUCT_W["extra"] * extra_err
                     + STRUCT_W["type"] * type_err)
               + STRUCT_W["category"] * cat_err + STRUCT_W["range"] * rng_err)
    out = row.select(F.lit(len(missing)).alias("missing_columns"), F.lit(len(extra)).alias("extra_columns"),
                     F.lit(len(shared)).alias("shared_columns"), F.lit(len(mism)).alias("type_mismatches"),
                     "invalid_category_values", "checked_categorical_values", "out_of_range_values",
                     "checked_numeric_values", d.alias("structural_discrepancy"))
    return out.select("*", (100.0 * (1 - F.col("structural_discrepancy"))).alias("structural_score")), \
        numeric, categorical


def univariate_terms(num_long: DataFrame | None, cat_long: DataFrame | None) -> DataFrame:
    """T21 per column: numeric d = mean(KS, |dmean|/s, |dstd|/s, |dmedian|/s)
    with s = max(IQR_real, 1e-9), terms clamped, >= 3 values per side and
    population std; categorical d = TVD of shares."""
    parts = []
    if num_long is not None:
        long = num_long.withColumn("row_id", F.lit(0))
        ks = dist_tests.ks_statistic(long)
        m = side_moments(long).select(
            "column_name", F.col("mean_real").alias("_mr"), F.col("mean_synthetic").alias("_ms"),
            F.sqrt("varpop_real").alias("_sr"), F.sqrt("varpop_synthetic").alias("_ss"))
        q = side_quantiles(long, {"q1": 0.25, "median": 0.5, "q3": 0.75})
        qr = q.where(is_real()).select("column_name", F.col("q1").alias("_q1"), F.col("q3").alias("_q3"),
                                       F.col("median").alias("_medr"))
        qs = q.where(is_synth()).select("column_name", F.col("median").alias("_meds"))
        j = ks.join(m, "column_name").join(qr, "column_name").join(qs, "column_name")
        s = F.greatest(F.col("_q3") - F.col("_q1"), F.lit(1e-9))
        terms = [F.col("statistic"), _clamp(F.abs(F.col("_mr") - F.col("_ms")) / s),
                 _clamp(F.abs(F.col("_sr") - F.col("_ss")) / s), _clamp(F.abs(F.col("_medr") - F.col("_meds")) / s)]
        d = _clamp(sum(terms) / 4.0)
        parts.append(j.where((F.col("n_real") >= 3) & (F.col("n_synthetic") >= 3))
                      .select("column_name", F.lit("numeric").alias("kind"), d.alias("discrepancy")))
    if cat_long is not None:
        tv = assoc.share_distances(cat_long.withColumn("row_id", F.lit(0)))
        parts.append(tv.select("column_name", F.lit("categorical").alias("kind"), F.col("tvd").alias("discrepancy")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def univariate(terms: DataFrame) -> DataFrame:
    return terms.agg(F.count_if(F.col("kind") == "numeric").alias("numeric_variables"),
                     F.count_if(F.col("kind") == "categorical").alias("categorical_variables"),
                     _clamp(F.avg("discrepancy")).alias("univariate_discrepancy")).select(
        "*", (100.0 * (1 - F.col("univariate_discrepancy"))).alias("univariate_score"))


def bivariate_from(real: DataFrame, synth: DataFrame, numeric: list[str]) -> DataFrame:
    """T22 over the shared numeric columns (by name, not position)."""
    from ..sources.testdata import Twin

    def tag(df, src):
        return df.select(F.lit(src).alias("src"), *[F.col(c).cast("double").alias(c) for c in numeric])
    twin = Twin(tag(real, REAL).unionByName(tag(synth, SYNTH)), numeric, [])
    b = correlation.bivariate_score(correlation.pearson_pairs(twin))
    return b.select("pairs", "bivariate_distance", (100.0 * (1 - F.col("bivariate_distance"))).alias("bivariate_score"))


def overall(struct: DataFrame, uni: DataFrame, bi: DataFrame, anomaly: DataFrame) -> DataFrame:
    """Weighted overall (only when all four exist) and the
    multi-variable score."""
    j = (struct.select("structural_score").crossJoin(uni.select("univariate_score"))
         .crossJoin(bi.select("bivariate_score"))
         .crossJoin(anomaly.select((100.0 * (1 - F.col("anomaly_burden"))).alias("anomaly_score"))))
    w = OVERALL_W
    ov = (w["structural"] * F.col("structural_score") + w["univariate"] * F.col("univariate_score")
          + w["bivariate"] * F.col("bivariate_score") + w["anomaly"] * F.col("anomaly_score"))
    mv = (F.when(F.col("bivariate_score").isNotNull() & F.col("anomaly_score").isNotNull(),
                 (0.30 * F.col("bivariate_score") + 0.15 * F.col("anomaly_score")) / 0.45)
           .otherwise(F.coalesce("bivariate_score", "anomaly_score")))
    return j.select("*", ov.alias("overall_score"), mv.alias("multi_variable_score"))


def column_differences(num_long: DataFrame, cat_long: DataFrame) -> DataFrame:
    """Per column (column_name, metric, value): KS and absolute
    differences of mean, population std, median, min, max for numerics;
    Cramer's V against the label, TVD, JSD, Wasserstein for categoricals."""
    ks = dist_tests.ks_statistic(num_long).select("column_name", F.lit("ks").alias("metric"),
                                                  F.col("statistic").alias("value"))
    st = num_long.groupBy("column_name").agg(
        *[f(F.when(side, F.col("value"))).alias(f"{n}_{lab}")
          for side, lab in ((is_real(), "r"), (is_synth(), "s"))
          for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "min"), (F.max, "max"))])
    med = side_quantiles(num_long, {"median": 0.5})
    md = med.groupBy("column_name").agg(F.max(F.when(is_real(), F.col("median"))).alias("median_r"),
                                        F.max(F.when(is_synth(), F.col("median"))).alias("median_s"))
    j = st.join(md, "column_name")
    rows = [j.select("column_name", F.lit(m).alias("metric"), F.abs(F.col(f"{m}_r") - F.col(f"{m}_s")).alias("value"))
            for m in ("mean", "std", "median", "min", "max")]
    v = assoc.cramers_v_labels(cat_long).select("column_name", F.lit("cramers_v").alias("metric"),
                                                F.col("cramers_v").alias("value"))
    sd = assoc.share_distances(cat_long)
    cats = [sd.select("column_name", F.lit(m).alias("metric"), F.col(m).alias("value"))
            for m in ("tvd", "jsd", "wasserstein")]
    out = ks
    for p in rows + [v] + cats:
        out = out.unionByName(p)
    return out


def filtered_summary(diffs: DataFrame, metric: str) -> DataFrame:
    """T25 (+A20): the chosen metric divided by its maximum across columns,
    clamped, averaged."""
    d = diffs.where(F.col("metric") == metric)
    mx = d.agg(F.max("value").alias("_mx"))
    return d.crossJoin(mx).agg(
        F.count("*").alias("columns"),
        F.avg(_clamp(F.when(F.col("_mx") > 0, F.col("value") / F.col("_mx")).otherwise(F.lit(0.0))))
         .alias("normalised_mean"))


def pvalue_wording(p: str = "p_value"):
    """T26."""
    c = F.col(p)
    return (F.when(c.isNull() | F.isnan(c), "N/A").when(c < 0.001, "Highly significant")
             .when(c < 0.01, "Very significant").when(c < 0.05, "Significant").otherwise("Not significant"))
