"""All queries of the library, for the driver's entry module."""

from __future__ import annotations

from tidemark.plans import asof_queries, ledger_queries, portfolio_queries, record_queries, research_queries, source_queries

PARTS = (asof_queries, research_queries, ledger_queries, portfolio_queries, record_queries, source_queries)


def queries() -> dict:
    return {name: f for part in PARTS for name, f in part.BOOK.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.BOOK.sql.items()}
