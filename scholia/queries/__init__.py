"""Registered queries: name -> (Spark function, DuckDB SQL or None)."""

from __future__ import annotations

from . import aggregates, extraction, graphs, merging, retrieval, rules, scalars, sources, streams, vectors

ALL = {}
for _module in (retrieval, scalars, sources, aggregates, graphs, vectors, rules, extraction, merging, streams):
    ALL |= _module.QUERIES
QUERIES = {name: f for name, (f, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items() if sql}
