"""Hybrid search: dense and lexical candidates, fused, pinned, deduplicated and enriched, for a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.functions.text import snippet
from corvine.operators import dense, fusion, lexical


def hybrid_search(passages: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, complexity: int = 32, threshold: float = 0.95, snippet_chars: int = 600, index: str | None = None) -> DataFrame:
    """(query_id, rank, id, score, snippet) for queries (query_id, query, vector); ``index`` is a stored lexical index's folder."""
    depth = fusion.fetch_depth(k, complexity, threshold)
    if index:
        scores = lexical.scored_by_index(passages.sparkSession, index, queries)
        found, pinned = lexical.ranked(scores, depth), lexical.pins(scores)
    else:
        search = lexical.Search(passages, queries)
        found, pinned = search.top(depth), search.pins()
    fused = fusion.held(fusion.pin_and_fuse(fusion.held(dense.nearest(vectors, queries, depth)), fusion.held(found), fusion.held(pinned), depth))
    kept = fusion.suppress_near_duplicates(fused, vectors, k, threshold)
    found = fusion.enrich(kept, passages, ["text"])
    return found.select("query_id", "rank", "id", "score", snippet(F.col("text"), snippet_chars).alias("snippet"))
