"""All queries of the page-audit engine."""

from __future__ import annotations

from . import access_queries, audit, content_queries, corpus_queries, evidence_queries, page_queries, robots_queries, rule_queries, signals, source_queries, structured_queries, url_queries  # noqa: F401  each registers its queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
