"""All queries that need no optional sub-package."""

from __future__ import annotations

from tessella.plans import files, further, graphs, knowledge, pipelines, reading, relational, retrieval, streams, texts

MODULES = [knowledge, relational, texts, retrieval, graphs, reading, streams, files, further, pipelines]


def catalogue() -> dict:
    """name -> (query, SQL twin or None)."""
    return {name: pair for module in MODULES for name, pair in module.QUERIES.items()}
