"""All registered queries and their DuckDB oracle SQL."""

from __future__ import annotations

from . import crawl_queries, io_queries, model_queries, text_queries, topic_queries

GROUPS = [text_queries, model_queries, topic_queries, crawl_queries, io_queries]


def queries() -> dict:
    out: dict = {}
    for g in GROUPS:
        out.update(g.QUERIES)
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for g in GROUPS:
        out.update(g.ORACLE)
    return out
