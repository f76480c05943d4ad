"""SQL expression text shared by Spark (``F.expr``) and the DuckDB oracle.

Only loops differ between the two dialects; everything else used here
(``ln exp sqrt pow greatest least CASE CAST``) is spelled the same.
A loop is a fold over an integer range, evaluated per row inside the JVM
(Spark ``aggregate(sequence(...))``), so these stay inside codegen-free but
vectorised Catalyst expressions and never leave the executor.
"""

from __future__ import annotations

SPARK = "spark"
DUCKDB = "duckdb"


def fold(dialect: str, lo: str, hi: str, step: int, var: str, acc: str,
         body: str, init: str = "0") -> str:
    """Fold ``body`` (using ``acc`` and ``var``) over lo..hi inclusive."""
    if dialect == SPARK:
        return (f"aggregate(sequence(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT), "
                f"CAST({step} AS BIGINT)), CAST({init} AS DOUBLE), "
                f"({acc}, {var}) -> {body})")
    return (f"list_reduce(generate_series(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT), "
            f"CAST({step} AS BIGINT)), lambda {acc}, {var}: {body}, CAST({init} AS DOUBLE))")


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def rnd(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits})"


def sig(x: str, digits: int = 9) -> str:
    """Round a double to ``digits`` significant digits (same text in both
    dialects), so engine-level summation-order noise does not leak into
    result hashes."""
    e = f"({digits - 1} - floor(log10(abs({x}))))"
    return (f"(CASE WHEN ({x}) IS NULL OR isnan({x}) OR ({x}) = 0 "
            f"OR abs({x}) > 1.0E300 THEN CAST({x} AS DOUBLE) "
            f"ELSE round(({x}) * pow(1.0E1, {e}), 0) / pow(1.0E1, {e}) END)")
