"""Named queries over the star-schema tables, each with the same result as SQL."""

from __future__ import annotations

import importlib

from gavelwork.registry.base import QUERIES, SQL

_MODULES = (
    "series_queries", "metric_queries", "quality_queries", "market_queries", "catalog_queries",
    "text_queries", "ingest_queries", "page_queries", "stored_queries", "whole_queries",
)
for _name in _MODULES:
    importlib.import_module(f"gavelwork.registry.{_name}")

__all__ = ["QUERIES", "SQL"]
