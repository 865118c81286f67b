"""Connected components of a table of links, with native operations only.

Alternating large-star and small-star rounds turn the links into stars around each component's least id in
O(log^2 n) rounds. A round groups by node for the least neighbour (combined before the shuffle) and joins that
back, so a node with very many links never has them gathered in one row. Each round is written to the shared
folder and read back, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.common import saved as kept


def _digest(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, saved: Callable[[DataFrame, str], DataFrame] = kept) -> DataFrame:
    """(node, component): for every node with a link to another, the least id that links reach; rounds go through ``saved``."""
    links = saved(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    before = _digest(links)
    for _ in range(max_rounds if before[0] else 0):
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = saved(large, "large")
        nearest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(nearest, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(nearest.select("hi", F.col("m").alias("lo")))
        links = saved(small.distinct(), "small")
        now = _digest(links)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
