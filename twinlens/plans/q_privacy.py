"""Registered privacy and encoding queries."""

from __future__ import annotations

from ..operators import encode as en
from ..operators import neighbours as nb
from ..operators import privacy as pv
from ..sources.testdata import (LI_CATEGORICAL, LI_NUMERIC, LINEITEM_SQL, embedding_sql,
                                embedding_twin, lineitem_twin)
from .registry import register

EMB = embedding_sql()
DIMS = [f"e{i}" for i in range(8)]
FEATS = [f"f_{c}" for c in DIMS] + ["f_label"]


def codes_sql(rel: str = EMB, col: str = "label") -> str:
    return (f"SELECT value, row_number() OVER (ORDER BY _first) - 1 AS code FROM (SELECT CAST({col} AS VARCHAR) AS value, "
            f"min(row_id) AS _first FROM ({rel}) _r WHERE src = 'real' AND {col} IS NOT NULL GROUP BY 1) _f")


@register("p13_first_appearance_codes", sql=codes_sql)
def q_p13(spark, sf_dir):
    return en.first_appearance_codes(embedding_twin(spark, sf_dir), "label")


def enc_sql() -> str:
    med = ", ".join(f"quantile_cont({c}, 0.5) AS _med_{c}" for c in DIMS)
    meds = f"SELECT src, {med} FROM ({EMB}) _e GROUP BY src"
    f = ", ".join(f"coalesce({c}, _med_{c}) AS f_{c}" for c in DIMS)
    mx = f"SELECT greatest(1, max(code)) AS _den FROM ({codes_sql()}) _c"
    raw = (f"SELECT e.src, e.row_id, {f}, coalesce(c.code, -1) / _den AS f_label FROM ({EMB}) e "
           f"JOIN ({meds}) m USING (src) LEFT JOIN ({codes_sql()}) c ON CAST(e.label AS VARCHAR) = c.value "
           f"CROSS JOIN ({mx}) x")
    st = ", ".join(f"min({c}) FILTER (WHERE src = 'real') AS _mn_{c}, max({c}) FILTER (WHERE src = 'real') AS _mx_{c}"
                   for c in FEATS)
    sc = ", ".join(f"({c} - _mn_{c}) / CASE WHEN _mx_{c} - _mn_{c} = 0 THEN 1.0E0 ELSE _mx_{c} - _mn_{c} END AS {c}"
                   for c in FEATS)
    return f"SELECT src, row_id, {sc} FROM ({raw}) r CROSS JOIN (SELECT {st} FROM ({raw}) _r2) s"


@register("p12_min_max_encoded", sql=enc_sql, dbl=tuple(FEATS))
def q_p12(spark, sf_dir):
    enc, _ = en.encode_for_distance(embedding_twin(spark, sf_dir))
    return enc


def knn_sql() -> str:
    e = enc_sql()
    dist = " + ".join(f"pow(s.{c} - r.{c}, 2)" for c in FEATS)
    pairs = (f"SELECT s.row_id AS row_id, sqrt({dist}) AS distance, row_number() OVER (PARTITION BY s.row_id "
             f"ORDER BY sqrt({dist}), r.row_id) AS rank FROM ({e}) s CROSS JOIN ({e}) r "
             f"WHERE s.src = 'synthetic' AND r.src = 'real'")
    return f"SELECT row_id, rank, distance FROM ({pairs}) _p WHERE rank <= 2"


def _neigh(spark, sf_dir):
    enc, feats = en.encode_for_distance(embedding_twin(spark, sf_dir))
    return nb.knn(enc, feats, k=2)


@register("j6_knn2", sql=knn_sql, dbl=("distance",), note="oracle is brute force on the fixture")
def q_j6(spark, sf_dir):
    return _neigh(spark, sf_dir)


def nndr_rows_sql() -> str:
    return ("SELECT row_id, max(CASE WHEN rank = 1 THEN distance END) AS d1, "
            "least(1.0E0, greatest(0.0E0, max(CASE WHEN rank = 1 THEN distance END) / "
            "(max(CASE WHEN rank = 2 THEN distance END) + 1e-12))) AS ratio "
            f"FROM ({knn_sql()}) _k GROUP BY row_id")


def privacy_sql() -> str:
    r = nndr_rows_sql()
    parts = []
    for t, c in (("NNDR", "ratio"), ("NN_Distance", "d1")):
        parts.append(f"SELECT '{t}' AS type, count(*) AS n, quantile_cont({c}, 0.5) AS median, avg({c}) AS mean, "
                     f"quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.75) AS q75 FROM ({r}) _r")
    u = " UNION ALL ".join(parts)
    lvl = ("CASE WHEN median >= 0.8 THEN 'EXCELLENT' WHEN median >= 0.6 THEN 'GOOD' "
           "WHEN median >= 0.4 THEN 'FAIR' ELSE 'POOR' END")
    return (f"SELECT *, CASE WHEN type = 'NNDR' THEN {lvl} END AS privacy_level, "
            f"CASE WHEN type = 'NNDR' THEN CASE WHEN {lvl} IN ('EXCELLENT', 'GOOD') THEN 'PASS' ELSE 'FAIL' END END "
            f"AS verdict FROM ({u}) _u")


@register("t27_nndr", sql=privacy_sql, dbl=("median", "mean", "q25", "q75"))
def q_t27(spark, sf_dir):
    return pv.privacy_summary(pv.nndr(_neigh(spark, sf_dir)))


MATCH_COLS = LI_NUMERIC + LI_CATEGORICAL


def match_sql() -> str:
    cols = ", ".join(MATCH_COLS)
    cond = " AND ".join(f"s.{c} IS NOT DISTINCT FROM r.{c}" for c in MATCH_COLS)
    m = (f"SELECT count(*) AS matches FROM ({LINEITEM_SQL}) s WHERE s.src = 'synthetic' AND EXISTS "
         f"(SELECT 1 FROM (SELECT DISTINCT {cols} FROM ({LINEITEM_SQL}) _r WHERE src = 'real') r WHERE {cond})")
    t = f"SELECT count(*) AS total FROM ({LINEITEM_SQL}) _s WHERE src = 'synthetic'"
    return (f"SELECT matches, total, matches / greatest(total, 1) AS rate, CASE WHEN matches = 0 THEN 'SUCCESS' "
            f"ELSE 'WARNING' END AS result FROM ({m}) _m CROSS JOIN ({t}) _t")


@register("t28_exact_match_rate", sql=match_sql, dbl=("rate",))
def q_t28(spark, sf_dir):
    t = lineitem_twin(spark, sf_dir)
    return pv.exact_matches(t.side("real"), t.side("synthetic"), MATCH_COLS)
