"""The registered reconciliation queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallymark.plans import boundary_queries, cascade_queries, close_queries, evidence_queries, flow_queries, hypothesis_queries, ingest_queries, lineage_queries, panel_queries, recon_queries, report_queries, scope_queries

_MODULES = (recon_queries, close_queries, ingest_queries, report_queries, evidence_queries, boundary_queries, panel_queries, scope_queries, cascade_queries, hypothesis_queries, flow_queries, lineage_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over all payouts: counts and amounts."""
    return recon_queries.QUERIES["verdict_summary"](spark, sf_dir)
