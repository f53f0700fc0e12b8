"""The library's queries and the SQL that they are held against."""

from __future__ import annotations

from tessera.plans import corpus, ingest, monitoring, operations, provisions, relational, search, texts  # noqa: F401
from tessera.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
