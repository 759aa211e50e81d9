"""All registered queries of the document-table operators, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridmill.plans import edit_queries, flow_queries, layout_queries, match_queries, report_queries, session_queries, store_queries, text_queries
from gridmill.plans.registry import Query

MODULES = (store_queries, text_queries, layout_queries, match_queries, edit_queries, flow_queries, report_queries, session_queries)

QUERIES: dict[str, Query] = {name: f for m in MODULES for name, f in m.query.queries.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in MODULES for name, sql in m.query.sql.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: one page of search results with excerpts."""
    return store_queries.search_excerpts(spark, sf_dir)
