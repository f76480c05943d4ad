"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from . import (q_assoc, q_distribution, q_extra, q_grid, q_more, q_ops, q_privacy, q_profile,  # noqa: F401
               q_report, q_schema, q_scores)
from .registry import REGISTRY, oracle_text, spark_query


def queries():
    return {name: spark_query(name) for name in REGISTRY}


def oracle_sql():
    out = {}
    for name in REGISTRY:
        text = oracle_text(name)
        if text is not None:
            out[name] = text
    return out
