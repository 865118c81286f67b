"""Exact dense top-K by cosine.

One query (or a few) is broadcast to a JVM-side projection. A larger batch goes through one matrix product for
each Arrow batch of vectors; every batch keeps its own k best for a query, so what is shuffled is k rows a batch
and query, not the similarity matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.functions.vectors import dot, l2_normalize
from corvine.operators.lexical import ranked

MAX_BATCH_QUERIES = 10_000
FEW_QUERIES = 16


def scores(vectors: DataFrame, queries: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, doc, score) for a handful of queries (query_id, vector)."""
    unit = F.broadcast(queries.select("query_id", l2_normalize(F.col("vector")).alias("q")))
    return vectors.crossJoin(unit).select("query_id", F.col(id_).alias("doc"), dot(F.col(vector), F.col("q")).alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of each query, by projection for up to ``FEW_QUERIES`` of them and by matrix products for more."""
    return (topk if queries.limit(FEW_QUERIES + 1).count() <= FEW_QUERIES else topk_batch)(vectors, queries, k, id_, vector)


def topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) of the k nearest of each query."""
    return ranked(scores(vectors, queries, id_, vector), k)


def topk_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The same for any number of queries, in blocks of ``MAX_BATCH_QUERIES``; each block passes over the vectors."""
    rows = queries.select("query_id", "vector").collect()
    kind = queries.schema["query_id"].dataType.simpleString()
    blocks = [rows[at : at + MAX_BATCH_QUERIES] for at in range(0, len(rows), MAX_BATCH_QUERIES)] or [[]]
    return ranked(reduce(DataFrame.unionAll, [block_candidates(vectors, block, kind, k, id_, vector) for block in blocks]), k)


def block_candidates(vectors: DataFrame, rows: list, kind: str, k: int, id_: str, vector: str) -> DataFrame:
    """(query_id, doc, score) of the best of every Arrow batch for one block of queries."""
    ids = [row.query_id for row in rows]
    matrix = np.array([row.vector for row in rows], np.float64).reshape(len(rows), -1 if rows else 0)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = np.where(lengths < 1e-12, matrix, matrix / np.maximum(lengths, 1e-300))
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, unit = shared.value
        for batch in batches:
            if not len(batch) or not len(names):
                continue
            own = batch["id"].to_numpy()
            found = np.round(unit @ np.stack([np.asarray(v, np.float64) for v in batch["v"]]).T, 9)
            for q, row in enumerate(found):
                edge = np.partition(row, -min(k, len(row)))[-min(k, len(row))]
                at = np.flatnonzero(row >= edge - 1e-6)  # ties stay, the rank decides
                yield pd.DataFrame({"query_id": names[q], "doc": own[at], "score": row[at]})

    return vectors.select(F.col(id_).cast("string").alias("id"), F.col(vector).alias("v")).mapInPandas(best, f"query_id {kind}, doc string, score double")
