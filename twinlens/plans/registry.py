"""Registry of named queries: Spark builder + DuckDB oracle text.

Doubles are rounded to nine significant digits on both sides with the same
SQL expression, so that summation-order noise between two engines does not
change result hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import round_doubles
from ..functions.sqlexpr import sig


@dataclass
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | Callable[[], str] | None
    dbl: tuple[str, ...]
    note: str = ""


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql=None, dbl=(), note: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, tuple(dbl), note)
        return fn
    return deco


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    e = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(e.build(spark, sf_dir))
    run.__name__ = f"q_{name}"
    return run


def _bigint_counts(sql: str) -> str:
    """Wrap every count_if(...) in CAST(... AS BIGINT): DuckDB returns HUGEINT
    for it, Spark bigint."""
    out, i, key = [], 0, "count_if("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        depth, k = 0, j + len(key) - 1
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = _bigint_counts(sql[j + len(key):k])
        out.append(sql[i:j] + f"CAST(count_if({inner}) AS BIGINT)")
        i = k + 1


def oracle_text(name: str) -> str | None:
    e = REGISTRY[name]
    if e.sql is None:
        return None
    text = _bigint_counts(e.sql() if callable(e.sql) else e.sql)
    if not e.dbl:
        return text
    repl = ", ".join(f"{sig(f'CAST({c} AS DOUBLE)')} AS {c}" for c in e.dbl)
    return f"SELECT * REPLACE ({repl}) FROM ({text}) _q"
