"""Registered outlier, perturbation, projection and sink/source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outliers as ol
from ..operators import perturb as pt
from ..operators import project as pj
from ..operators.reshape import numeric_long
from ..sources import files as fl
from ..sources.testdata import (EMB_POINTS_SQL, LINEITEM_SQL, ORDERS_SQL, Twin, customer_real, embedding_points,
                                embedding_sql, embedding_twin, lineitem_twin, orders_twin, supplier_synth, table)
from .q_scores import NUM, NUM_LONG
from .registry import register


def _cs_long(spark, sf_dir):
    r = customer_real(spark, sf_dir).select(F.lit("real").alias("src"), F.col("custkey").alias("row_id"), *NUM)
    s = supplier_synth(spark, sf_dir).select(F.lit("synthetic").alias("src"), F.col("suppkey").alias("row_id"), *NUM)
    return numeric_long(Twin(r.unionByName(s), NUM, []))


@register("d4_rule_anomalies", dbl=("percentage",), sql=lambda: (
    "SELECT column_name, rule, count, count / _n * 100.0E0 AS percentage FROM ("
    "SELECT column_name, _n, unnest(['below_min', 'above_max', 'negative']) AS rule, "
    "unnest([below_min, above_max, negative]) AS count FROM ("
    "SELECT s.column_name, count(*) AS _n, count_if(value < _lo) AS below_min, count_if(value > _hi) AS above_max, "
    "count_if(_lo >= 0 AND value < 0) AS negative "
    f"FROM ({NUM_LONG}) s JOIN (SELECT column_name, min(value) AS _lo, max(value) AS _hi FROM ({NUM_LONG}) _r "
    "WHERE src = 'real' GROUP BY column_name) b USING (column_name) WHERE s.src = 'synthetic' GROUP BY s.column_name) _a) _u "
    "WHERE count > 0"))
def q_d4(spark, sf_dir):
    return ol.rule_anomalies(_cs_long(spark, sf_dir))


@register("d5_range_expansion", dbl=("real_min", "real_max", "synthetic_min", "synthetic_max"), sql=lambda: (
    "SELECT *, synthetic_min < real_min AS expands_min, synthetic_max > real_max AS expands_max, "
    "(synthetic_min < real_min OR synthetic_max > real_max) AS range_expanded FROM ("
    "SELECT column_name, min(value) FILTER (WHERE src = 'real') AS real_min, max(value) FILTER (WHERE src = 'real') AS real_max, "
    "min(value) FILTER (WHERE src = 'synthetic') AS synthetic_min, max(value) FILTER (WHERE src = 'synthetic') AS synthetic_max "
    f"FROM ({NUM_LONG}) _l GROUP BY column_name) _a"))
def q_d5(spark, sf_dir):
    return ol.range_expansion(_cs_long(spark, sf_dir))


@register("d6_centroid_outliers", dbl=("distance",), sql=(
    "SELECT src, row_id, distance FROM (SELECT src, row_id, sqrt(pow(x - _cx, 2) + pow(y - _cy, 2)) AS distance "
    f"FROM ({EMB_POINTS_SQL}) p CROSS JOIN (SELECT avg(x) AS _cx, avg(y) AS _cy FROM ({EMB_POINTS_SQL}) _c) c) d "
    "CROSS JOIN (SELECT avg(distance) AS _m, stddev_pop(distance) AS _s FROM (SELECT sqrt(pow(x - _cx, 2) + pow(y - _cy, 2)) "
    f"AS distance FROM ({EMB_POINTS_SQL}) p CROSS JOIN (SELECT avg(x) AS _cx, avg(y) AS _cy FROM ({EMB_POINTS_SQL}) _c) c) _d) s "
    "WHERE abs(distance - _m) > 2.5 * _s"))
def q_d6(spark, sf_dir):
    return ol.centroid_outliers(embedding_points(spark, sf_dir))


EMB_LABELLED = f"SELECT e0 AS x, e1 AS y, label FROM ({embedding_sql(2)}) _e"


@register("a23_cluster_metrics", dbl=("centroid_x", "centroid_y", "avg_distance", "max_distance",
                                      "x_min", "x_max", "y_min", "y_max"), sql=(
    "SELECT label, any_value(count) AS count, any_value(centroid_x) AS centroid_x, any_value(centroid_y) AS centroid_y, "
    "avg(sqrt(pow(x - centroid_x, 2) + pow(y - centroid_y, 2))) AS avg_distance, "
    "max(sqrt(pow(x - centroid_x, 2) + pow(y - centroid_y, 2))) AS max_distance, min(x) AS x_min, max(x) AS x_max, "
    f"min(y) AS y_min, max(y) AS y_max FROM ({EMB_LABELLED}) p JOIN (SELECT label, count(*) AS count, avg(x) AS centroid_x, "
    f"avg(y) AS centroid_y FROM ({EMB_LABELLED}) _c GROUP BY label) c USING (label) GROUP BY label"))
def q_a23(spark, sf_dir):
    t = embedding_twin(spark, sf_dir, 2).df
    return ol.cluster_metrics(t.select(F.col("e0").alias("x"), F.col("e1").alias("y"), "label"), "label")


@register("j7_min_cross_distance", dbl=("min_distance",), note="oracle is brute force on the fixture", sql=(
    "SELECT min(sqrt(pow(s.x - r.x, 2) + pow(s.y - r.y, 2))) AS min_distance "
    f"FROM ({EMB_POINTS_SQL}) s CROSS JOIN ({EMB_POINTS_SQL}) r WHERE s.src = 'synthetic' AND r.src = 'real'"))
def q_j7(spark, sf_dir):
    return ol.min_cross_distance(embedding_points(spark, sf_dir))


def lof_sql(k: int = 20) -> str:
    syn = f"SELECT row_id, x, y FROM ({EMB_POINTS_SQL}) _p WHERE src = 'synthetic'"
    nb = (f"SELECT * FROM (SELECT p.row_id, o.row_id AS neighbor_id, sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2)) AS distance, "
          f"row_number() OVER (PARTITION BY p.row_id ORDER BY sqrt(pow(p.x - o.x, 2) + pow(p.y - o.y, 2)), o.row_id) AS rank "
          f"FROM ({syn}) p CROSS JOIN ({syn}) o WHERE p.row_id <> o.row_id) _n WHERE rank <= {k}")
    kd = f"SELECT row_id AS neighbor_id, distance AS _kd FROM ({nb}) _k WHERE rank = {k}"
    lrd = (f"SELECT row_id, 1.0E0 / (avg(greatest(distance, _kd)) + 1.0E-10) AS lrd FROM ({nb}) n JOIN ({kd}) k USING (neighbor_id) "
           "GROUP BY row_id")
    lo = (f"SELECT n.row_id, avg(l.lrd) AS _m FROM ({nb}) n JOIN ({lrd}) l ON n.neighbor_id = l.row_id GROUP BY n.row_id")
    return (f"SELECT row_id, _m / lrd AS lof, _m / lrd > 1.5 AS is_outlier FROM ({lo}) a JOIN ({lrd}) b USING (row_id)")


@register("d7_local_outlier_factor", sql=lof_sql, dbl=("lof",), note="oracle is brute force on the fixture")
def q_d7(spark, sf_dir):
    return ol.local_outlier_factor(embedding_points(spark, sf_dir))


@register("d8_isolation_forest", note="randomised trees: rows-only check")
def q_d8(spark, sf_dir):
    t = embedding_twin(spark, sf_dir)
    return ol.isolation_forest(t.df, t.numeric)


@register("d9_gaussian_noise", note="seeded hash-normal draws: rows-only check")
def q_d9(spark, sf_dir):
    t = lineitem_twin(spark, sf_dir).side("synthetic")
    return pt.add_noise(t, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).drop("row_id")


@register("d10_inject_anomalies", note="seeded hash draws: rows-only check")
def q_d10(spark, sf_dir):
    t = orders_twin(spark, sf_dir).df
    return pt.inject_anomalies(t, {"o_totalprice": ("uniform", 100000.0, 500000.0, 2),
                                   "o_orderstatus": ("const", "X"),
                                   "o_orderpriority": ("const", "1-URGENT")})


def _proj(spark, sf_dir, twin=None):
    t = twin or orders_twin(spark, sf_dir)
    rows, enc = pj.features(t)
    return rows, pj.fit_projection(rows, enc)


@register("e1_projection_fit_real", note="component signs are arbitrary: rows-only check")
def q_e1(spark, sf_dir):
    rows, model = _proj(spark, sf_dir)
    return pj.transform(model, rows)


def pca_sql() -> str:
    """Principal axes of the category indicators by squaring the covariance: its 2^30th
    power is the outer product of the first axis; the second likewise after deflation."""
    cols = {"o_orderpriority": ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), "o_orderstatus": ("O", "P")}
    x = [f"CAST({c} = '{v}' AS INT)::DOUBLE" for c, vs in cols.items() for v in vs]
    d = len(x)
    cov = "[" + ", ".join("[" + ", ".join(f"covar_samp(x[{i}], x[{j}])" for j in range(1, d + 1)) + "]" for i in range(1, d + 1)) + "]"
    # m x m / trace, with the list of columns equal to the list of rows (symmetric)
    square = ("list_transform(m, lambda r: list_transform(m, lambda c: list_dot_product(r, c) / "
              "list_sum(list_transform(m, lambda z: list_dot_product(z, z)))))")

    def axis(name: str, start: str) -> str:
        # the column of largest diagonal entry, normalised
        return (f"{name}p AS (SELECT 0 AS i, m FROM {start} UNION ALL SELECT i + 1, {square} FROM {name}p WHERE i < 30), "
                f"{name} AS (SELECT list_transform(v, lambda e: e / sqrt(list_dot_product(v, v))) AS v FROM (SELECT "
                f"m[list_position(list_transform(range(1, {d + 1}), lambda k: m[k][k]), list_max(list_transform(range(1, {d + 1}), lambda k: m[k][k])))] AS v "
                f"FROM {name}p WHERE i = 30) _{name})")
    deflated = (f"deflated AS (SELECT list_transform(range(1, {d + 1}), lambda i: list_transform(range(1, {d + 1}), lambda j: "
                f"m[i][j] - v[i] * v[j] * l)) AS m FROM (SELECT m, v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) AS l "
                f"FROM cov, first_axis) _f)")
    means = "[" + ", ".join(f"avg(x[{i}])" for i in range(1, d + 1)) + "]"
    return (f"WITH RECURSIVE rows AS (SELECT src, row_id, [{', '.join(x)}] AS x FROM ({ORDERS_SQL}) _o), "
            f"cov AS (SELECT {cov} AS m FROM rows WHERE src = 'real'), mu AS (SELECT {means} AS mu FROM rows WHERE src = 'real'), "
            f"{axis('first_axis', 'cov')}, {deflated}, {axis('second_axis', 'deflated')} "
            f"SELECT src, row_id, pow(list_dot_product(x, a.v) - list_dot_product(mu, a.v), 2) AS x2, "
            f"pow(list_dot_product(x, b.v) - list_dot_product(mu, b.v), 2) AS y2 FROM rows, mu, first_axis a, second_axis b")


@register("e1b_projection_of_categories", sql=pca_sql, dbl=("x2", "y2"), note="squared coordinates, which have no sign")
def q_e1b(spark, sf_dir):
    t = orders_twin(spark, sf_dir)
    rows, model = _proj(spark, sf_dir, Twin(t.df, [], t.categorical))
    return pj.transform(model, rows).select("src", "row_id", F.pow("x", 2).alias("x2"), F.pow("y", 2).alias("y2"))


@register("e3_reuse_saved_model", note="save, load, transform: rows-only check")
def q_e3(spark, sf_dir):
    rows, model = _proj(spark, sf_dir)
    path = fl.scratch_path(spark, "projection-model")
    pj.save(model, path)
    saved = pj.load(spark, path)
    from ..operators.encode import encode_one_hot
    return pj.transform(saved, encode_one_hot(orders_twin(spark, sf_dir).df, saved.encoder))


@register("e5_labelled_points", sql=(
    f"SELECT src, row_id, x, y, CASE WHEN src = 'real' THEN 'Real' ELSE 'Synthetic' END AS label FROM ({EMB_POINTS_SQL}) _p"),
    dbl=("x", "y"))
def q_e5(spark, sf_dir):
    return pj.label_sides(embedding_points(spark, sf_dir))


@register("e6_projection_metadata", sql=(
    "SELECT count_if(src = 'real') AS n_real, count_if(src <> 'real') AS n_synthetic, 7 AS n_features FROM orders_sides"
    .replace("orders_sides", "(SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'real' ELSE 'synthetic' END AS src FROM orders) _o")))
def q_e6(spark, sf_dir):
    return pj.metadata(pj.features(orders_twin(spark, sf_dir))[0])


# ---------------------------------------------------------- sinks, sources
@register("k1_s6_package_roundtrip", dbl=("l_quantity",), sql=(
    "SELECT 'synthetic' AS _dataset_type, count(*) AS rows, sum(l_quantity) AS l_quantity "
    f"FROM ({LINEITEM_SQL}) _l WHERE src = 'synthetic'"))
def q_k1(spark, sf_dir):
    t = lineitem_twin(spark, sf_dir)
    path = fl.scratch_path(spark, "package")
    fl.write_package(t.side("real").drop("src"), t.side("synthetic").drop("src"), path, codec="zstd", level=3)
    back = fl.read_package(spark, path, "synthetic")
    return back.groupBy("_dataset_type").agg(F.count("*").alias("rows"), F.sum("l_quantity").alias("l_quantity"))


@register("k2_k3_codec_sizes", note="byte counts depend on the codec build: rows-only check")
def q_k2(spark, sf_dir):
    t = lineitem_twin(spark, sf_dir)
    df = t.df.drop("row_id")
    out = None
    for codec in ("snappy", "gzip", "lz4", "zstd"):
        path = fl.scratch_path(spark, f"codec-{codec}")
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        r = fl.size_report(spark, df, path).select(F.lit(codec).alias("codec"), "*")
        out = r if out is None else out.unionByName(r)
    return out


@register("k5_preview", dbl=("l_quantity", "l_extendedprice", "l_discount", "l_tax"), sql=(
    "SELECT src, row_id.l_orderkey AS l_orderkey, row_id.l_linenumber AS l_linenumber, l_quantity, l_extendedprice, "
    "l_discount, l_tax, l_linestatus, ordinal, side_rows FROM ("
    "SELECT *, row_number() OVER (PARTITION BY src ORDER BY row_id) AS ordinal, count(*) OVER (PARTITION BY src) AS side_rows "
    f"FROM ({LINEITEM_SQL}) _l) _p WHERE ordinal <= 5"))
def q_k5(spark, sf_dir):
    return fl.preview(lineitem_twin(spark, sf_dir).df).select(
        "src", F.col("row_id.l_orderkey").alias("l_orderkey"), F.col("row_id.l_linenumber").alias("l_linenumber"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "ordinal", "side_rows")


@register("k7_csv_export_roundtrip", dbl=("Dim_1", "Dim_2"), sql=(
    "SELECT x AS Dim_1, y AS Dim_2, CASE WHEN src = 'real' THEN 'Real' ELSE 'Synthetic' END AS Type "
    f"FROM ({EMB_POINTS_SQL}) _p"))
def q_k7(spark, sf_dir):
    path = fl.scratch_path(spark, "points-csv")
    fl.export_points_csv(embedding_points(spark, sf_dir), path, ["x", "y"])
    back = fl.read_csv_strings(spark, path)
    return back.select(F.col("Dim_1").cast("double").alias("Dim_1"), F.col("Dim_2").cast("double").alias("Dim_2"), "Type")


@register("s2_typed_csv_source", dbl=("o_totalprice",), sql=(
    "SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders"))
def q_s2(spark, sf_dir):
    """Orders through a CSV with an index column, read back typed."""
    path = fl.scratch_path(spark, "typed-csv")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), "o_orderkey", "o_orderstatus", "o_totalprice")
    o.write.csv(path, header=True)
    back = fl.read_csv_typed(spark, path, index_col="idx")
    return back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus",
                       F.col("o_totalprice").cast("double").alias("o_totalprice"))


@register("k8_anomaly_report_lines", note="formatted text: rows-only check")
def q_k8(spark, sf_dir):
    from ..operators import grid as g
    p = embedding_points(spark, sf_dir)
    cells = g.detect_anomalies(p)
    lines = fl.anomaly_report_lines(cells, g.point_flags(p, cells))
    fl.write_lines(lines, fl.scratch_path(spark, "anomaly-report"))
    return lines
