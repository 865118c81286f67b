"""Rank fusion, pins, near-duplicate suppression and enrichment of ranked lists (query_id, rank, id, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvine.functions.vectors import dot
from corvine.operators.lexical import ranked

# fixed values
RRF_K = 60
PIN_MARGIN = 0.001
MAX_DEPTH = 1000
MAX_BROADCAST_HITS = 1 << 17


def fetch_depth(k: int, complexity: int = 32, threshold: float = 0.95, factor: int = 3) -> int:
    """How many candidates to fetch so that k are left after suppression; k may exceed the usual bound."""
    if k <= 0:
        return 0
    depth = min(max(complexity, k), max(MAX_DEPTH, k))
    return depth if threshold <= 0 or threshold >= 1 else max(depth, k * max(1, factor))


def rrf(dense: DataFrame, lexical: DataFrame, k: int, lexical_weight: float = 1.0, constant: int = RRF_K) -> DataFrame:
    """Weighted reciprocal ranks summed over both lists, the k best."""
    share = lambda df, w: df.select("query_id", F.col("id").alias("doc"), (F.lit(float(w)) / (constant + F.col("rank"))).alias("score"))
    both = share(dense, 1.0).unionByName(share(lexical, lexical_weight))
    return ranked(both.groupBy("query_id", "doc").agg(F.sum("score").alias("score")), k)


def without(hits: DataFrame, pins: DataFrame) -> DataFrame:
    """A list without the pinned ids, ranked anew."""
    left = hits.join(pins, ["query_id", "id"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def pin_and_fuse(dense: DataFrame, lexical: DataFrame, pins: DataFrame, k: int, lexical_weight: float = 2.0) -> DataFrame:
    """Fused lists, with a query's pin before all others, a little above the best score."""
    fused = rrf(without(dense, pins), without(lexical, pins), k, lexical_weight)
    pinned = F.col("pin").isNotNull()
    marked = fused.join(pins.withColumnRenamed("id", "pin"), "query_id", "left").where(~pinned | (F.col("rank") < k))
    marked = marked.withColumn("rank", F.col("rank") + pinned.cast("int")).select("query_id", "rank", "id", "score")
    top = fused.groupBy("query_id").agg(F.max("score").alias("top"))
    first = pins.join(top, "query_id", "left").select("query_id", F.lit(1).alias("rank"), "id", F.round(F.coalesce(F.col("top") + PIN_MARGIN, F.lit(1.0)), 6).alias("score"))
    return marked.unionByName(first)


def head(hits: DataFrame, k: int) -> DataFrame:
    return hits.where(F.col("rank") <= max(0, k))


def few(hits: DataFrame) -> DataFrame:
    """A hint to broadcast hits that are counted to be few enough."""
    return F.broadcast(hits) if hits.limit(MAX_BROADCAST_HITS + 1).count() <= MAX_BROADCAST_HITS else hits


def held(hits: DataFrame) -> DataFrame:
    """The same hits, worked out once and kept on the driver if they are few, so that what uses them twice doesn't search twice."""
    rows = hits.limit(MAX_BROADCAST_HITS + 1).collect()
    return hits.sparkSession.createDataFrame(rows, hits.schema) if len(rows) <= MAX_BROADCAST_HITS else hits


def suppress_near_duplicates(hits: DataFrame, vectors: DataFrame, k: int, threshold: float = 0.95, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Hits in order, without those as near as ``threshold`` to one kept before; hits without a vector stay.

    A query's candidates are at most a fetch depth (about a thousand), so its list is one row's array.
    """
    if k <= 0 or threshold <= 0 or threshold >= 1:
        return head(hits, k)
    own = vectors.select(F.col(id_).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    # the hits' ids go to the vectors, so only vectors of hits are moved
    own = own.join(few(hits.select("id").distinct()), "id", "left_semi")
    listed = hits.join(own, "id", "left").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", "v"))).alias("found"))
    none = F.array().cast(listed.schema["found"].dataType)

    def step(kept, hit):
        near = F.exists(kept, lambda other: F.coalesce(dot(other["v"], hit["v"]) >= threshold, F.lit(False)))
        return F.when((F.size(kept) >= k) | near, kept).otherwise(F.concat(kept, F.array(hit)))

    kept = listed.select("query_id", F.posexplode(F.aggregate("found", none, step)).alias("at", "hit"))
    return kept.select("query_id", (F.col("at") + 1).alias("rank"), "hit.id", "hit.score")


def enrich(hits: DataFrame, passages: DataFrame, columns: list[str], id_: str = "doc_id") -> DataFrame:
    """Hits with columns of their passages; hits without a passage are dropped, ranks stay."""
    own = passages.select(F.col(id_).cast("string").alias("id"), *columns)
    # hits are k a query: if they are few they go to the passages, so no passage text is shuffled
    return own.join(few(hits), "id").select("query_id", "rank", "id", "score", *[c.split(".")[-1] for c in columns])
