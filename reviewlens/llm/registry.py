"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import (conversation_queries, dedup_queries, join_queries, license_queries, mix_queries, negative_queries, neighbour_queries, pack_queries, quality_queries,
               secret_queries, warc_queries)

GROUPS = [quality_queries, pack_queries, license_queries, neighbour_queries, dedup_queries, secret_queries, join_queries, mix_queries,
          conversation_queries, negative_queries, warc_queries]


def queries() -> dict:
    return {k: f for g in GROUPS for k, f in g.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for g in GROUPS for k, s in g.ORACLE.items()}
