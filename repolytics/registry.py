"""Names of the queries over the given tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from repolytics.plans import code_queries, doc_queries, graph_queries, history_queries, impact_queries, record_queries, ref_queries, text_queries

FLAGSHIP = "hotspots"
_MODULES = (history_queries, text_queries, graph_queries, record_queries, impact_queries, code_queries, ref_queries, doc_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: f for m in _MODULES for n, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {n: s for m in _MODULES for n, s in m.SQL.items()}
