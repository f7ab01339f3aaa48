"""Queries and reference SQL of the corpus operators."""

from __future__ import annotations

import importlib

MODULES = ("warc", "pii", "quality", "urls", "exact_dedup", "line_dedup", "mixing", "packing", "jaccard", "ppm", "toxicity", "centroids", "search")
QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"rillmark.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
