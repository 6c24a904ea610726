"""Every registered query of the library, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its own name, with SQL for the same rows."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    from . import admission_queries, assembly_queries, bundle_queries, claim_queries, depth_queries, event_queries, field_queries, gate_queries, graph_queries, journey_queries, layout_queries, ledger_queries, naming_queries, office_queries, placement_queries, report_queries, retrieval_queries, site_queries, text_queries, validation_queries  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
