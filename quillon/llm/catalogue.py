"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from quillon.llm import exact_dedup, maxent, merkle, mixing, ngram_join, packing, prefix_trie, token_counts, token_files, toxicity, vector_codes, voronoi_knn, warc

_MODULES = (mixing, warc, exact_dedup, ngram_join, merkle, token_counts, token_files, maxent, packing, toxicity, voronoi_knn, prefix_trie, vector_codes)


def queries():
    """Name -> (spark, sf_dir) -> DataFrame."""
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    """Name -> DuckDB SQL."""
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
