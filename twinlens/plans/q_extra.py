"""Registered schema tables, selections, small profiles and helpers
(P6f/P18, P15, P19/A6, P23-P25, J5/R1, J9, A16-A18, A22, A24, A29, M5, M7, U4, S5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import sample as sm
from ..operators import schema as sc
from ..operators.reshape import exact_quantiles, running_totals
from ..sources import files as fl
from ..sources.testdata import (CUSTOMER_SQL, EMB_POINTS_SQL, JOBS_SQL, LINEITEM_SQL, ORDERS_SQL, SUPPLIER_SQL,
                                customer_real, embedding_points, embedding_sql, embedding_twin, jobs,
                                lineitem_twin, orders_twin, supplier_synth, table)
from .q_scores import _diffs, diffs_sql
from .registry import register

CUST = ["custkey", "name", "nationkey", "acctbal", "mktsegment"]
SUPP = ["suppkey", "name", "nationkey", "acctbal"]


def _str_long(spark, sf_dir):
    r = customer_real(spark, sf_dir)
    s = supplier_synth(spark, sf_dir)
    rl = r.select(F.lit("real").alias("src"), F.col("custkey").alias("row_id"),
                  *[F.col(c).cast("string").alias(c) for c in CUST]).unpivot(["src", "row_id"], CUST, "column_name", "value")
    sl = s.select(F.lit("synthetic").alias("src"), F.col("suppkey").alias("row_id"),
                  *[F.col(c).cast("string").alias(c) for c in SUPP]).unpivot(["src", "row_id"], SUPP, "column_name", "value")
    names = spark.createDataFrame([(c,) for c in dict.fromkeys(r.columns + s.columns)], "column_name string")
    return rl.unionByName(sl), names


def _str_long_sql() -> str:
    parts = [f"SELECT 'real' AS src, custkey AS row_id, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value "
             f"FROM ({CUSTOMER_SQL}) _c" for c in CUST]
    parts += [f"SELECT 'synthetic' AS src, suppkey AS row_id, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value "
              f"FROM ({SUPPLIER_SQL}) _s" for c in SUPP]
    return " UNION ALL ".join(parts)


def _p18_sql() -> str:
    v = f"SELECT * FROM ({_str_long_sql()}) _l WHERE value IS NOT NULL AND value <> ''"
    top = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, column_name ORDER BY row_id) AS _k FROM ({v}) _v) _t WHERE _k <= 400"
    num = f"TRY_CAST(nullif(regexp_extract(value, '{sc.NUMERIC_PREFIX}', 0), '') AS DOUBLE)"
    a = (f"SELECT src, column_name, count(*) AS _n, count({num}) AS _num, "
         f"count_if(coalesce({num} = floor({num}), false)) AS _int FROM ({top}) _t GROUP BY src, column_name")
    t = ("SELECT src, column_name, CASE WHEN _num = 0 OR _num / _n <= 0.5 THEN 'categorical' "
         f"WHEN _int = _num THEN 'integer' ELSE 'float' END AS type FROM ({a}) _a")
    names = ("SELECT column_name FROM (VALUES " + ", ".join(f"('{c}')" for c in dict.fromkeys(CUST + SUPP))
             + ") AS _n(column_name)")
    j = (f"SELECT n.column_name, coalesce(r.type, '—') AS rt, coalesce(s.type, '—') AS st FROM ({names}) n "
         f"LEFT JOIN (SELECT * FROM ({t}) _r WHERE src = 'real') r USING (column_name) "
         f"LEFT JOIN (SELECT * FROM ({t}) _s WHERE src = 'synthetic') s USING (column_name)")
    V = sc.TYPE_VERDICTS
    verdict = (f"CASE WHEN rt = '—' AND st = '—' THEN '{V[0]}' WHEN rt = st THEN '{V[1]}' "
               f"WHEN rt = '—' OR st = '—' THEN '{V[2]}' WHEN rt IN ('integer', 'float') AND st IN ('integer', 'float') "
               f"THEN '{V[3]}' ELSE '{V[4]}' END")
    cap = lambda c: f"CASE WHEN {c} = '—' THEN {c} ELSE upper(substr({c}, 1, 1)) || substr({c}, 2, 100) END"
    return (f"SELECT column_name AS variable, {cap('rt')} AS real_type, {cap('st')} AS synthetic_type, "
            f"{verdict} AS verdict FROM ({j}) _j")


@register("p18_type_match_table", sql=_p18_sql)
def q_p18(spark, sf_dir):
    long, names = _str_long(spark, sf_dir)
    return sc.type_match_table(long, names)


# Fixed parameter: the lasso polygon used by the selection query (in the
# scaled space of the first two embedding dimensions).
LASSO = [(-0.1, -0.1), (0.12, -0.08), (0.08, 0.14), (-0.06, 0.1)]


@register("j9_polygon_selection", dbl=("x", "y"), sql=(
    f"SELECT src, row_id, x, y FROM ({EMB_POINTS_SQL}) _p WHERE {sc.in_polygon('x', 'y', LASSO)}"))
def q_j9(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    return p.where(F.expr(sc.in_polygon("x", "y", LASSO))).select("src", "row_id", "x", "y")


@register("a16_contingency_table", sql=(
    f"SELECT src, o_orderpriority, o_orderstatus, count(*) AS count FROM ({ORDERS_SQL}) _o "
    "GROUP BY src, o_orderpriority, o_orderstatus"))
def q_a16(spark, sf_dir):
    """Contingency table of two categorical columns per side."""
    return orders_twin(spark, sf_dir).df.groupBy("src", "o_orderpriority", "o_orderstatus").agg(F.count("*").alias("count"))


PART_SIDES = ("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'real' ELSE 'synthetic' END AS src, p_type, "
              "CAST(p_retailprice AS DOUBLE) AS value FROM part")


@register("a17_grouped_box", dbl=("q1", "median", "q3", "min", "max"), sql=(
    "SELECT src, p_type, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, "
    f"quantile_cont(value, 0.75) AS q3, min(value) AS min, max(value) AS max FROM ({PART_SIDES}) _p GROUP BY src, p_type"))
def q_a17(spark, sf_dir):
    """Values grouped by category per side: count, exact quartiles, min, max."""
    p = table(spark, sf_dir, "part").select(
        F.when(F.col("p_partkey") % 2 == 0, "real").otherwise("synthetic").alias("src"), "p_type",
        F.col("p_retailprice").cast("double").alias("value"))
    q = exact_quantiles(p, {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["src", "p_type"])
    m = p.groupBy("src", "p_type").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    return q.join(m, ["src", "p_type"])


@register("a18_scatter_extents", dbl=("x_min", "x_max", "y_min", "y_max"), sql=(
    f"SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, count(*) AS points FROM ({EMB_POINTS_SQL}) _p"))
def q_a18(spark, sf_dir):
    """Shared x / y extents of the scatter points."""
    p = embedding_points(spark, sf_dir)
    return p.agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"),
                  F.max("y").alias("y_max"), F.count("*").alias("points"))


@register("a22_variable_counts", sql=(
    "SELECT src, count(*) AS total, count_if(kind = 'numeric') AS numeric, count_if(kind = 'categorical') AS categorical, "
    "count_if(n > 0) AS available FROM (SELECT src, column_name, CASE WHEN column_name IN ('l_quantity', 'l_extendedprice', "
    "'l_discount', 'l_tax') THEN 'numeric' ELSE 'categorical' END AS kind, count(value) AS n FROM ("
    + " UNION ALL ".join(f"SELECT src, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM ({LINEITEM_SQL}) _l"
                         for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"))
    + ") _u GROUP BY src, column_name) _c GROUP BY src"))
def q_a22(spark, sf_dir):
    """Variables per side: total, numeric, categorical, with any value."""
    t = lineitem_twin(spark, sf_dir)
    long = t.df.select("src", *[F.col(c).cast("string").alias(c) for c in t.columns]).unpivot(
        ["src"], t.columns, "column_name", "value")
    per = long.groupBy("src", "column_name").agg(F.count("value").alias("n"))
    kind = F.when(F.col("column_name").isin(*t.numeric), "numeric").otherwise("categorical")
    return per.groupBy("src").agg(F.count("*").alias("total"), F.count_if(kind == "numeric").alias("numeric"),
                                  F.count_if(kind == "categorical").alias("categorical"),
                                  F.count_if(F.col("n") > 0).alias("available"))


def _fp_sql(rel: str, cols: list[str], types: list[str], key: str) -> str:
    head = (f"SELECT string_agg(concat_ws(',', {', '.join(f'CAST({c} AS VARCHAR)' for c in cols)}), ';' ORDER BY {key}) "
            f"AS h FROM (SELECT * FROM ({rel}) _r ORDER BY {key} LIMIT 100) _t")
    return (f"SELECT upper(substr(md5(concat_ws('|', CAST((SELECT count(*) FROM ({rel}) _c) AS VARCHAR), "
            f"'{len(cols)}', '{','.join(cols)}', '{','.join(types)}', md5((SELECT h FROM ({head}) _h)))), 1, 8)) AS fingerprint")


CUST_TYPES = ["bigint", "string", "int", "double", "string"]


@register("a24_dataset_fingerprint", sql=lambda: _fp_sql(CUSTOMER_SQL, CUST, CUST_TYPES, "custkey"))
def q_a24(spark, sf_dir):
    """Dataset fingerprint: md5 over shape, names, types and the first 100 rows (8 hex, upper case)."""
    df = customer_real(spark, sf_dir)
    types = [f.dataType.simpleString() for f in df.schema.fields]
    # the first 100 rows by key: a bounded top-k, then one small row
    head = (df.orderBy("custkey").limit(100)
              .agg(F.sort_array(F.collect_list(F.struct("custkey", F.concat_ws(
                  ",", *[F.col(c).cast("string") for c in df.columns]).alias("line")))).alias("rows"))
              .select(F.array_join(F.transform("rows", lambda r: r["line"]), ";").alias("h")))
    n = df.agg(F.count("*").alias("n"))
    text = F.concat_ws("|", F.col("n").cast("string"), F.lit(str(len(df.columns))), F.lit(",".join(df.columns)),
                       F.lit(",".join(types)), F.md5("h"))
    return n.crossJoin(head).select(F.upper(F.substring(F.md5(text), 1, 8)).alias("fingerprint"))


@register("a29_runtime_model", dbl=("slope", "intercept", "predicted_100", "predicted_1000"), sql=(
    "SELECT regr_slope(ln(m), size) AS slope, regr_intercept(ln(m), size) AS intercept, count(*) AS sizes, "
    "exp(regr_intercept(ln(m), size) + regr_slope(ln(m), size) * 100) AS predicted_100, "
    "exp(regr_intercept(ln(m), size) + regr_slope(ln(m), size) * 1000) AS predicted_1000 FROM ("
    "SELECT CAST(json_extract_string(parameters, '$.n_real') AS BIGINT) AS size, avg(runtime) AS m "
    f"FROM ({JOBS_SQL}) _j WHERE status = 'completed' GROUP BY 1) _g"))
def q_a29(spark, sf_dir):
    """Runtime model: mean runtime per input size, log-linear fit, predictions."""
    j = jobs(spark, sf_dir).where(F.col("status") == "completed")
    g = j.groupBy(F.get_json_object("parameters", "$.n_real").cast("long").alias("size")).agg(F.avg("runtime").alias("m"))
    a = g.agg(F.regr_slope(F.ln("m"), "size").alias("slope"), F.regr_intercept(F.ln("m"), "size").alias("intercept"),
              F.count("*").alias("sizes"))
    return a.select("slope", "intercept", "sizes",
                    F.exp(F.col("intercept") + F.col("slope") * 100).alias("predicted_100"),
                    F.exp(F.col("intercept") + F.col("slope") * 1000).alias("predicted_1000"))


@register("p15_shape_checks", sql=(
    "SELECT 'non_empty_sides' AS check_name, count_if(src = 'real') > 0 AND count_if(src = 'synthetic') > 0 AS passed "
    f"FROM ({EMB_POINTS_SQL}) _p UNION ALL SELECT 'min_10_real_points', count_if(src = 'real') >= 10 FROM ({EMB_POINTS_SQL}) _p "
    "UNION ALL SELECT 'finite_first_5_rows', bool_and(NOT isnan(x) AND NOT isinf(x) AND NOT isnan(y) AND NOT isinf(y)) FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY src ORDER BY row_id) AS _k FROM ({EMB_POINTS_SQL}) _p) _f WHERE _k <= 5"))
def q_p15(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    a = p.agg((F.count_if(F.col("src") == "real") > 0) & (F.count_if(F.col("src") == "synthetic") > 0),
              F.count_if(F.col("src") == "real") >= 10).toDF("a", "b")
    head = sm.head_per_side(p, 5).agg(F.bool_and(finite("x") & finite("y")).alias("c"))
    j = a.crossJoin(head)
    return j.select(F.explode(F.array(
        F.struct(F.lit("non_empty_sides").alias("check_name"), F.col("a").alias("passed")),
        F.struct(F.lit("min_10_real_points").alias("check_name"), F.col("b").alias("passed")),
        F.struct(F.lit("finite_first_5_rows").alias("check_name"), F.col("c").alias("passed")))).alias("t")).select("t.*")


def _inferred_sql(rel: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS c, CASE WHEN avg(CASE WHEN TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NULL THEN 1.0E0 ELSE 0.0E0 END) "
        f"> 0.5 THEN 'categorical' ELSE 'numeric' END AS kind FROM ({rel}) _t" for c in cols)


@register("p19_a6_dtype_consistency", dbl=("ratio",), sql=lambda: (
    "SELECT consistent_columns, total_columns, consistent_columns / total_columns AS ratio, "
    "CASE WHEN consistent_columns / total_columns >= 0.95 THEN 'ACCEPT' ELSE 'REJECT' END AS result FROM ("
    "SELECT count_if(coalesce(r.kind = s.kind, false)) AS consistent_columns, count(*) AS total_columns "
    f"FROM ({_inferred_sql(CUSTOMER_SQL, CUST)}) r LEFT JOIN ({_inferred_sql(SUPPLIER_SQL, SUPP)}) s USING (c)) _a"))
def q_p19(spark, sf_dir):
    """Types inferred from each side's values, compared by header."""
    r, s = _strings_cs(spark, sf_dir)
    kinds = sc.inferred_kinds(r).join(sc.inferred_kinds(s).withColumnRenamed("kind", "other"), "column_name", "left")
    a = kinds.agg(F.count_if(F.coalesce(F.col("kind") == F.col("other"), F.lit(False))).alias("consistent_columns"),
                  F.count("*").alias("total_columns"))
    ratio = F.col("consistent_columns") / F.col("total_columns")
    return a.select("consistent_columns", "total_columns", ratio.alias("ratio"),
                    F.when(ratio >= 0.95, "ACCEPT").otherwise("REJECT").alias("result"))


@register("p23_metric_filter", dbl=("value",), sql=lambda: (
    f"SELECT d.column_name, d.value FROM ({diffs_sql()}) d CROSS JOIN (SELECT min(value) AS lo, max(value) AS hi "
    f"FROM ({diffs_sql()}) _k WHERE metric = 'ks') b WHERE d.metric = 'ks' AND (d.value IS NULL OR "
    "(d.value >= b.lo - 1e-6 AND d.value <= b.lo + (b.hi - b.lo) / 2 + 1e-6))"))
def q_p23(spark, sf_dir):
    """Columns whose chosen metric lies in a [lo - 1e-6, hi + 1e-6] range."""
    d = _diffs(spark, sf_dir).where(F.col("metric") == "ks")
    b = d.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    j = d.crossJoin(b)
    keep = F.col("value").isNull() | ((F.col("value") >= F.col("lo") - 1e-6)
                                      & (F.col("value") <= F.col("lo") + (F.col("hi") - F.col("lo")) / 2 + 1e-6))
    return j.where(keep).select("column_name", "value")


def _name_sql() -> str:
    base = "regexp_replace(regexp_extract(url, '[^/?#]*([?#].*)?$', 0), '[?#].*$', '')"
    stem = f"regexp_replace({base}, '\\.[^.]*$', '')"
    trunc = f"CASE WHEN length({stem}) > 17 THEN substr({stem}, 1, 17) || '...' ELSE {stem} END"
    return f"SELECT page_id, translate({trunc}, '_-', '  ') AS display_name FROM pages"


@register("p24_display_names", sql=_name_sql)
def q_p24(spark, sf_dir):
    """Display names: last path segment, extension stripped, 17 chars + '...', '_' / '-' as spaces."""
    p = table(spark, sf_dir, "pages")
    base = F.regexp_replace(F.regexp_extract("url", r"[^/?#]*([?#].*)?$", 0), r"[?#].*$", "")
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    trunc = F.when(F.length(stem) > 17, F.concat(F.substring(stem, 1, 17), F.lit("..."))).otherwise(stem)
    return p.select("page_id", F.translate(trunc, "_-", "  ").alias("display_name"))


@register("p25_seeds", sql=(
    "SELECT job_id, CAST(('0x' || right(sha256(parameters), 8))::UBIGINT AS BIGINT) AS seed FROM "
    f"({JOBS_SQL}) _j"))
def q_p25(spark, sf_dir):
    """P25: deterministic seed = sha256(text) mod 2^32."""
    j = jobs(spark, sf_dir)
    return j.select("job_id", F.conv(F.substring(F.sha2("parameters", 256), 57, 8), 16, 10).cast("long").alias("seed"))


@register("m5_equal_size_sample", sql=(
    f"SELECT src, row_id FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY md5('42|' || CAST(row_id AS VARCHAR)), "
    f"row_id) AS _k FROM ({ORDERS_SQL}) _o) _s WHERE _k <= (SELECT least(1000, min(n)) FROM (SELECT count(*) AS n "
    f"FROM ({ORDERS_SQL}) _c GROUP BY src) _m)"))
def q_m5(spark, sf_dir):
    df = orders_twin(spark, sf_dir).df
    n = min([1000] + [r["n"] for r in df.groupBy("src").agg(F.count("*").alias("n")).collect()])
    return sm.sample_per_side(df, n).select("src", "row_id")


@register("m7_head_2000", sql=(
    f"SELECT src, row_id FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY row_id) AS _k FROM ({ORDERS_SQL}) _o) _s "
    "WHERE _k <= 2000"))
def q_m7(spark, sf_dir):
    return sm.head_per_side(orders_twin(spark, sf_dir).df, 2000).select("src", "row_id")


@register("u4_category_union", sql=(
    f"SELECT DISTINCT o_orderpriority AS category FROM ({ORDERS_SQL}) _o"))
def q_u4(spark, sf_dir):
    """U4: distinct union of the categories of both sides."""
    t = orders_twin(spark, sf_dir)
    return (t.side("real").select(F.col("o_orderpriority").alias("category"))
             .union(t.side("synthetic").select(F.col("o_orderpriority").alias("category"))).distinct())


@register("s5_label_tagged_source", sql=(
    "SELECT CASE WHEN l_returnflag = 'R' THEN 'real' ELSE 'synthetic' END AS src, count(*) AS rows FROM lineitem GROUP BY 1"))
def q_s5(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "Real").otherwise("Synthetic").alias("label"))
    return fl.label_tagged(li, "label").groupBy("src").agg(F.count("*").alias("rows"))


@register("j5_r1_rank_join", dbl=("x", "y"), sql=(
    f"SELECT p.src, p.rank, p.x, p.y, o.label FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY row_id) AS rank "
    f"FROM ({EMB_POINTS_SQL}) _p) p JOIN (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY row_id) AS rank "
    f"FROM ({embedding_sql(2)}) _e) o USING (src, rank)"))
def q_j5(spark, sf_dir):
    """k-th point of a side <-> k-th original row of that side; ranks come from
    distributed prefix sums over row ids (no single-task sort of a side)."""
    def ranked(df):
        one = df.select("*", F.lit(1).alias("_one"))
        rt = running_totals(one, "src", "row_id", ["_one"])
        return rt.select(*df.columns, F.col("cum__one").cast("long").alias("rank"))
    pts = ranked(embedding_points(spark, sf_dir))
    orig = ranked(embedding_twin(spark, sf_dir, 2).df.select("src", "row_id", "label"))
    return pts.join(orig.select("src", "rank", "label"), ["src", "rank"]).select("src", "rank", "x", "y", "label")


def _presets_sql() -> str:
    L = f"SELECT * FROM ({_str_long_sql()}) _l"
    ok = "value IS NOT NULL AND trim(value) <> ''"
    parses = "TRY_CAST(value AS DOUBLE) IS NOT NULL"
    rn = "row_number() OVER (PARTITION BY src, column_name ORDER BY row_id)"

    def share(limit, name):
        v = f"SELECT * FROM ({L}) _a WHERE {ok}"
        if limit:
            v = f"SELECT * FROM (SELECT *, {rn} AS _k FROM ({v}) _b) _c WHERE _k <= {limit}"
        return (f"SELECT src, column_name, count(*) AS _n_{name}, count_if({parses}) AS _p_{name} "
                f"FROM ({v}) _d GROUP BY src, column_name")
    rows100 = (f"SELECT src, column_name, count(*) AS _n_c, count_if({parses}) AS _p_c FROM (SELECT *, {rn} AS _k "
               f"FROM ({L}) _a) _b WHERE _k <= 100 AND {ok} GROUP BY src, column_name")
    j = f"SELECT DISTINCT src, column_name FROM ({L}) _k"
    for i, part in enumerate((rows100, share(200, "d"), share(None, "e"), share(500, "g"))):
        j = f"SELECT * FROM ({j}) _j{i} LEFT JOIN ({part}) _p{i} USING (src, column_name)"
    allp = (f"SELECT src, column_name, bool_and(value IS NULL OR {parses}) AS p6h_all_parse FROM ({L}) _h "
            "GROUP BY src, column_name")
    j = f"SELECT * FROM ({j}) _jj LEFT JOIN ({allp}) _hh USING (src, column_name)"
    r = lambda n: f"(coalesce(_p_{n}, 0) / _n_{n})"
    num = lambda c: f"CASE WHEN {c} THEN 'numeric' ELSE 'categorical' END"
    return (f"SELECT src, column_name, {num(f'coalesce({r(chr(99))}, 0.0E0) > 0.5')} AS p6c, "
            f"{num(f'coalesce({r(chr(100))}, 0.0E0) >= 0.8')} AS p6d, "
            f"CASE WHEN coalesce(_n_e, 0) = 0 THEN NULL ELSE {num(r('e') + ' >= 0.9')} END AS p6e, "
            f"CASE WHEN coalesce(_n_g, 0) = 0 THEN 'empty' ELSE {num(r('g') + ' > 0.5')} END AS p6g, "
            f"p6h_all_parse FROM ({j}) _z")


@register("p6_type_presets", sql=_presets_sql)
def q_p6(spark, sf_dir):
    long, _ = _str_long(spark, sf_dir)
    return sc.type_presets(long)


COMPLETED_POINTS_SQL = (
    "SELECT CASE WHEN l_returnflag = 'R' THEN 'real' ELSE 'synthetic' END AS src, l_orderkey AS job_id, "
    "l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_orderkey IN "
    "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")


def _completed_points(spark, sf_dir):
    """Points of completed jobs only (left-semi join to the job table)."""
    li = table(spark, sf_dir, "lineitem")
    done = jobs(spark, sf_dir).where(F.col("status") == "completed").select("job_id")
    pts = li.select(F.when(F.col("l_returnflag") == "R", "real").otherwise("synthetic").alias("src"),
                    F.col("l_orderkey").alias("job_id"), F.col("l_quantity").alias("x"),
                    F.col("l_extendedprice").alias("y"))
    return pts.join(done, "job_id", "left_semi")


@register("s7_completed_job_points", sql=(
    f"SELECT job_id, count(*) AS n_points FROM ({COMPLETED_POINTS_SQL}) _p GROUP BY job_id"))
def q_s7(spark, sf_dir):
    """Stored points of completed jobs (left-semi join to the job table)."""
    return _completed_points(spark, sf_dir).groupBy("job_id").agg(F.count("*").alias("n_points"))


@register("d1b_detect_from_jobs", dbl=("cell_proportion", "global_proportion", "proportion_diff", "p_value",
                                       "p_value_adjusted"), sql=lambda: _d1b_sql())
def q_d1b(spark, sf_dir):
    """Grid anomaly detection on the stored points of completed jobs only."""
    from ..operators import grid as g
    p = _completed_points(spark, sf_dir).select("src", F.col("job_id").alias("row_id"), "x", "y")
    return g.detect_anomalies(p)


def _d1b_sql() -> str:
    from .q_grid import detect_sql
    return detect_sql(f"SELECT src, job_id AS row_id, x, y FROM ({COMPLETED_POINTS_SQL}) _c")


@register("p21_drop_missing_target", sql=(
    "SELECT src, count(*) AS rows FROM (SELECT src, nullif(o_orderstatus, 'P') AS target FROM "
    f"({ORDERS_SQL}) _o) _t WHERE target IS NOT NULL AND target <> '' GROUP BY src"))
def q_p21(spark, sf_dir):
    """Rows kept after dropping those with a missing target value."""
    t = orders_twin(spark, sf_dir).df.select("src", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("target"))
    return t.where(F.col("target").isNotNull() & (F.col("target") != "")).groupBy("src").agg(F.count("*").alias("rows"))


@register("k6_json_export_roundtrip", dbl=("x_sum",), sql=(
    f"SELECT src, count(*) AS rows, sum(x) AS x_sum FROM ({EMB_POINTS_SQL}) _p GROUP BY src"))
def q_k6(spark, sf_dir):
    path = fl.scratch_path(spark, "points-json")
    fl.write_json(embedding_points(spark, sf_dir), path, codec="gzip")
    back = spark.read.json(path)
    return back.groupBy("src").agg(F.count("*").alias("rows"), F.sum("x").alias("x_sum"))


def _strings_cs(spark, sf_dir):
    r = customer_real(spark, sf_dir)
    s = supplier_synth(spark, sf_dir)
    return (r.select(*[F.col(c).cast("string").alias(c) for c in r.columns]),
            s.select(*[F.col(c).cast("string").alias(c) for c in s.columns]))


@register("p8_numeric_rescue", sql=(
    "SELECT column_name, bool_or(TRY_CAST(value AS DOUBLE) IS NOT NULL) AS rescued FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM ({CUSTOMER_SQL}) _c"
                         for c in CUST) + ") _u GROUP BY column_name"))
def q_p8(spark, sf_dir):
    r, _ = _strings_cs(spark, sf_dir)
    return sc.rescued_columns(r)


def _summary_sql() -> str:
    parts = []
    for side, rel, cols in (("real", CUSTOMER_SQL, CUST), ("synthetic", SUPPLIER_SQL, SUPP)):
        checks = " + ".join(f"CASE WHEN bool_and({c} IS NULL OR TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NOT NULL) "
                            f"THEN 1 ELSE 0 END" for c in cols)
        parts.append(f"SELECT '{side}' AS src, count(*) AS rows, {len(cols)} AS columns, {checks} AS numeric_columns, "
                     f"{len(cols)} - ({checks}) AS categorical_columns, 3 AS common_columns FROM ({rel}) _t")
    return " UNION ALL ".join(parts)


@register("a25_dataset_summary", sql=_summary_sql)
def q_a25(spark, sf_dir):
    """P6h (numeric iff every value parses) + A3 + P17 per side."""
    out = None
    r, s = customer_real(spark, sf_dir), supplier_synth(spark, sf_dir)
    common = len([c for c in r.columns if c in s.columns])
    for side, df in (("real", r), ("synthetic", s)):
        a = df.agg(F.count("*").alias("rows"), *[
            F.bool_and(F.col(c).isNull() | F.col(c).cast("string").try_cast("double").isNotNull()).alias(c)
            for c in df.columns])
        nnum = sum(F.col(c).cast("int") for c in df.columns)
        part = a.select(F.lit(side).alias("src"), "rows", F.lit(len(df.columns)).alias("columns"),
                        nnum.alias("numeric_columns"), (F.lit(len(df.columns)) - nnum).alias("categorical_columns"),
                        F.lit(common).alias("common_columns"))
        out = part if out is None else out.unionByName(part)
    return out


@register("k9_encoded_csv_roundtrip", dbl=("o_totalprice",), sql=(
    f"SELECT count(*) AS rows, sum(CAST(CAST(CAST(o_totalprice AS FLOAT) AS VARCHAR) AS DOUBLE)) AS o_totalprice "
    f"FROM ({ORDERS_SQL}) _o"))
def q_k9(spark, sf_dir):
    """K9: encoded (one-hot, float32) frame written as CSV and read back."""
    from ..operators import encode as en
    t = orders_twin(spark, sf_dir)
    rows = en.encode_one_hot(t.df, en.fit_one_hot(t))
    path = fl.scratch_path(spark, "encoded-csv")
    fl.write_encoded_csv(rows, path)
    back = fl.read_encoded_csv(spark, path)
    price = back.columns[-1]            # numerics follow the indicators
    return back.agg(F.count("*").alias("rows"), F.sum(F.col(price).cast("double")).alias("o_totalprice"))


@register("s8_job_bundle", dbl=("stored_totalprice",), sql=(
    f"SELECT j.job_id, j.status, r.n_points, o.o_totalprice AS stored_totalprice FROM ({JOBS_SQL}) j "
    "LEFT JOIN (SELECT l_orderkey AS job_id, count(*) AS n_points FROM lineitem GROUP BY l_orderkey) r USING (job_id) "
    "LEFT JOIN orders o ON o.o_orderkey = j.job_id"))
def q_s8(spark, sf_dir):
    """Job metadata + stored result size + stored original row, by left joins."""
    j = jobs(spark, sf_dir).select("job_id", "status")
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.count("*").alias("n_points"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"),
                                              F.col("o_totalprice").alias("stored_totalprice"))
    return j.join(r, "job_id", "left").join(o, "job_id", "left")


LI_PAIR_SQL = ("SELECT CASE WHEN l_returnflag = 'R' THEN 'real' ELSE 'synthetic' END AS src, "
               "{'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey} "
               "AS row_id, '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM lineitem")
PAIR_COLS = ["l_quantity", "l_linenumber", "l_discount", "l_tax"]


def _pair_firsts(li, n: int):
    """(src, row_id, column_name, value): the first ``n`` rows with a value of each side and
    column. One ``orderBy.limit`` each keeps ``n`` rows a task; a window would sort, and
    spill, all rows once a column."""
    wide = li.select(F.when(F.col("l_returnflag") == "R", "real").otherwise("synthetic").alias("src"),
                     F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
                     *[F.col(c).cast("double").alias(c) for c in PAIR_COLS])
    parts = [wide.where((F.col("src") == src) & F.col(c).isNotNull())
                 .select("src", "row_id", F.lit(c).alias("column_name"), F.col(c).alias("value"))
                 .orderBy("row_id", "value").limit(n) for src in ("real", "synthetic") for c in PAIR_COLS]
    return reduce(lambda x, y: x.unionByName(y), parts)


def _p7b_sql(k: int = 7) -> str:
    u = " UNION ALL ".join(LI_PAIR_SQL.replace("{c}", c) for c in PAIR_COLS)
    top = (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, column_name ORDER BY row_id) AS _k "
           f"FROM ({u}) _u WHERE value IS NOT NULL) _t WHERE _k <= 400")
    a = (f"SELECT src, column_name, count(*) AS n, count(DISTINCT value) AS distinct_values, "
         f"avg(CASE WHEN abs(value - round(value)) < 1e-6 THEN 1.0E0 ELSE 0.0E0 END) AS integer_share "
         f"FROM ({top}) _t GROUP BY src, column_name")
    return (f"SELECT *, integer_share >= 0.9 AND distinct_values <= {k} AND distinct_values / n <= 0.35 AND n >= 3 "
            f"AS is_discrete, distinct_values <= 10 AND integer_share = 1.0 AS low_cardinality, "
            f"distinct_values = 2 AS is_binary FROM ({a}) _a")


@register("p7b_p7c_pair_plot_discreteness", dbl=("integer_share",), sql=_p7b_sql)
def q_p7b(spark, sf_dir):
    """>= 90 % integer-like (1e-6), <= 7 distinct, distinct / count <= 0.35,
    count >= 3 over the first 400 rows; P7c: <= 10 distinct whole values is
    categorical, 2 distinct is binary."""
    top = _pair_firsts(table(spark, sf_dir, "lineitem"), 400)
    a = top.groupBy("src", "column_name").agg(
        F.count("*").alias("n"), F.count_distinct("value").alias("distinct_values"),
        F.avg(F.when(F.abs(F.col("value") - F.round("value")) < 1e-6, 1.0).otherwise(0.0)).alias("integer_share"))
    return a.select("*", ((F.col("integer_share") >= 0.9) & (F.col("distinct_values") <= 7)
                          & (F.col("distinct_values") / F.col("n") <= 0.35) & (F.col("n") >= 3)).alias("is_discrete"),
                    ((F.col("distinct_values") <= 10) & (F.col("integer_share") == 1.0)).alias("low_cardinality"),
                    (F.col("distinct_values") == 2).alias("is_binary"))


SPECIAL_SQL = ("SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 7 = 0 THEN CAST('Infinity' AS DOUBLE) "
               "WHEN o_orderkey % 7 = 1 THEN CAST('-Infinity' AS DOUBLE) WHEN o_orderkey % 7 = 2 THEN CAST('NaN' AS DOUBLE) "
               "ELSE o_totalprice END AS v FROM orders")


@register("p22_special_value_text", sql=(
    "SELECT row_id, CASE WHEN isnan(v) THEN 'NaN' WHEN v = CAST('Infinity' AS DOUBLE) THEN 'Infinity' "
    "WHEN v = CAST('-Infinity' AS DOUBLE) THEN '-Infinity' ELSE CAST(v AS VARCHAR) END AS text "
    f"FROM ({SPECIAL_SQL}) _s"))
def q_p22(spark, sf_dir):
    """+/-inf and NaN spelled Infinity / -Infinity / NaN for serialisation
    (special values injected in the query: the tables have none)."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 7
    v = (F.when(k == 0, F.lit(float("inf"))).when(k == 1, F.lit(float("-inf")))
          .when(k == 2, F.lit(float("nan"))).otherwise(F.col("o_totalprice")))
    d = o.select(F.col("o_orderkey").alias("row_id"), v.alias("v"))
    text = (F.when(F.isnan("v"), "NaN").when(F.col("v") == float("inf"), "Infinity")
             .when(F.col("v") == float("-inf"), "-Infinity").otherwise(F.col("v").cast("string")))
    return d.select("row_id", text.alias("text"))


@register("j10_cell_drilldown", dbl=("x", "y"), sql=lambda: _j10_sql())
def q_j10(spark, sf_dir):
    """The original rows of one grid cell, by row id (a coordinate match
    would be ambiguous for duplicated points)."""
    from ..operators import grid as g
    p = embedding_points(spark, sf_dir)
    cells = g.assign_cells(p, g.grid_bounds(p))
    return cells.where((F.col("cell_x") == 10) & (F.col("cell_y") == 10)).select("src", "row_id", "x", "y")


def _j10_sql() -> str:
    from .q_grid import cells_sql
    return f"SELECT src, row_id, x, y FROM ({cells_sql(EMB_POINTS_SQL)}) _c WHERE cell_x = 10 AND cell_y = 10"


@register("t33b_correlation_only", dbl=("statistic", "p_value", "p_value_corrected"), sql=lambda: (
    f"SELECT * FROM ({_report_sql()}) _r WHERE category = 'Correlation Validation'"))
def q_t33b(spark, sf_dir):
    """The correlation validation of the report only."""
    from .report import validation_report
    return validation_report(lineitem_twin(spark, sf_dir)).where(F.col("category") == "Correlation Validation")


def _report_sql():
    from .q_report import report_sql
    return report_sql()


@register("p25b_string_hash_seed", sql=(
    "SELECT page_id, list_reduce(list_transform(string_split(url, ''), lambda ch: CAST(ascii(ch) AS BIGINT)), "
    "lambda acc, c: (acc * 31 + c) % 4294967296, CAST(0 AS BIGINT)) AS seed FROM pages"))
def q_p25b(spark, sf_dir):
    """P25 (plot seed): 31-multiplier string hash mod 2^32, as a fold over the
    characters of each value."""
    p = table(spark, sf_dir, "pages")
    seed = F.expr("aggregate(transform(split(url, ''), ch -> CAST(ascii(ch) AS BIGINT)), CAST(0 AS BIGINT), "
                  "(acc, c) -> (acc * 31 + c) % 4294967296)")
    return p.select("page_id", seed.alias("seed"))
