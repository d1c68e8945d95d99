"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from . import code_queries, extract_queries, index_queries, retrieval_queries, search_queries, text_queries

FLAGSHIP = "bm25_topk"
_PARTS = (text_queries, search_queries, retrieval_queries, code_queries, extract_queries, index_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
