"""DuckDB SQL text for the oracle side of registered queries.

These mirror the Spark operators relation by relation; they are the
independent check, written against the pre-registered table views.
"""

from __future__ import annotations

from ..functions.sqlexpr import sig


def long_sql(rel: str, cols: list[str], cast: str = "DOUBLE", drop_missing: bool = True) -> str:
    parts = [f"SELECT src, row_id, '{c}' AS column_name, CAST({c} AS {cast}) AS value FROM ({rel}) _r"
             for c in cols]
    body = " UNION ALL ".join(parts)
    if not drop_missing:
        return body
    cond = "value IS NOT NULL" + (" AND NOT isnan(value)" if cast == "DOUBLE" else "")
    return f"SELECT * FROM ({body}) _l WHERE {cond}"


def value_counts_sql(long_rel: str) -> str:
    return (f"SELECT column_name, value, count_if(src = 'real') AS n_real, "
            f"count_if(src = 'synthetic') AS n_synth FROM ({long_rel}) _v GROUP BY column_name, value")


def ecdf_sql(vc_rel: str, sums=("n_real", "n_synth")) -> str:
    cums = ", ".join(
        f"CAST(sum({c}) OVER (PARTITION BY column_name ORDER BY value ROWS BETWEEN "
        f"UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_{c}, "
        f"CAST(sum({c}) OVER (PARTITION BY column_name) AS BIGINT) AS tot_{c}" for c in sums)
    return f"SELECT *, {cums} FROM ({vc_rel}) _e"


def bh_sql(rel: str, p: str = "p_value", family: list[str] | None = None, alpha: float = 0.05,
           min_tests: int = 2, tiebreak: list[str] | None = None,
           adjusted: str = "p_value_corrected", rejected: str = "fdr_rejected",
           keep: list[str] | None = None) -> str:
    part = f"PARTITION BY {', '.join(family)}" if family else ""
    order = ", ".join([f"{p} ASC NULLS LAST"] + (tiebreak or []))
    ranked = (f"SELECT *, count({p}) OVER ({part}) AS _m, "
              f"row_number() OVER ({part} ORDER BY {order}) AS _rk FROM ({rel}) _b")
    rev = f"({part} ORDER BY _rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    adj = (f"SELECT *, least(1.0E0, min(CASE WHEN {p} IS NOT NULL THEN {p} * _m / _rk END) OVER {rev}) AS _adj, "
           f"max(CASE WHEN {p} IS NOT NULL THEN CASE WHEN {p} <= _rk / _m * {alpha!r} THEN 1 ELSE 0 END END) "
           f"OVER {rev} AS _rej FROM ({ranked}) _c")
    cols = ", ".join(keep) if keep else "* EXCLUDE (_m, _rk, _adj, _rej)"
    ok = f"_m >= {min_tests} AND {p} IS NOT NULL"
    return (f"SELECT {cols}, CASE WHEN {ok} THEN _adj END AS {adjusted}, "
            f"CASE WHEN {ok} THEN _rej = 1 END AS {rejected} FROM ({adj}) _d")


FDR_RESULT_SQL = ("CASE WHEN fdr_rejected IS NULL THEN result "
                  "WHEN significant AND NOT fdr_rejected THEN 'ACCEPT' "
                  "WHEN NOT significant AND fdr_rejected THEN 'REJECT' ELSE result END")


def round_select(rel: str, cols: list[tuple[str, str]], digits: int = 9) -> str:
    """SELECT with the listed (name, kind) columns, rounding kind 'd'."""
    out = []
    for name, kind in cols:
        if kind == "d":
            out.append(f"{sig(f'CAST({name} AS DOUBLE)', digits)} AS {name}")
        else:
            out.append(name)
    return f"SELECT {', '.join(out)} FROM ({rel}) _o"
