"""Registered queries of the genotyping operators and their SQL."""

from __future__ import annotations

from .operators.common import ship
from .plans import build_queries, call_queries, sequence_queries, source_queries

_MODULES = (sequence_queries, call_queries, build_queries, source_queries)


def _shipped(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries():
    return {name: _shipped(q) for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
