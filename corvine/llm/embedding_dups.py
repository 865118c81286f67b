"""Embedding near-duplicates: exact all-pairs cosine by int8 tiles with rigorous error bounds.

Equal vectors are one row with a count first, so a vector that a third of all rows hold costs one comparison.
The distinct ones are dealt by hash into blocks, and every pair of blocks is a tile, a task's unit of work:

* each unit vector is quantised to int8 with its own scale, and its quantisation error's norm is kept;
* a tile's int8 products are exact (they fit float32's integers), and by Cauchy-Schwarz the true cosine lies
  within ``e_a (n_b + e_b) + n_a e_b`` of the scaled product, n being the quantised vector's norm;
* only pairs whose interval holds the threshold are recomputed in double precision; those surely over it are
  links, those surely under it are not. Where nearly all of a sub-tile is undecided it is recomputed as a whole.

A tile returns, for each of its rows, how many vectors it links to, and at most one edge a row (a spanning forest
of the tile's links), so a group of n near copies yields O(n) rows, never n^2 pairs, and no link is lost.
Memory is two blocks of at most ``MAX_TILE`` vectors and one sub-tile of products.

Defined results: vectors that are null, empty, zero or have null or non-finite components link with nothing (their
component is themselves, kept is true); vectors of different lengths don't link; each of several equal vectors
links with all others; repeated rows are separate vectors; other columns are left behind.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.common import saved
from corvine.llm.components import components

MIN_TILE, MAX_TILE, SUB = 2048, 16384, 1024
SLACK = 1e-6


class Forest:
    """Union-find over a tile's rows, fed with arrays of linked pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, norms of what they stand for, and norms of the errors."""
    scale = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / scale[:, None])
    stands = whole * scale[:, None]
    return whole.astype(np.int8), scale, np.linalg.norm(stands, axis=1), np.linalg.norm(unit - stands, axis=1)


def link_tile(vectors: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, Forest, int]:
    """Counts of linked vectors for each row, the forest of links, and how many pairs were recomputed.

    ``left`` and ``right`` are row numbers of the two blocks; equal arrays for a block with itself.
    """
    norms = np.linalg.norm(vectors, axis=1)
    unit = vectors / norms[:, None]
    ints, scale, length, error = quantised(unit)
    counts, forest, recomputed = np.zeros(len(vectors), np.int64), Forest(len(vectors)), 0
    same = left is right
    for i in range(0, len(left), SUB):
        a = left[i : i + SUB]
        floats = ints[a].astype(np.float32)
        for j in range(i if same else 0, len(right), SUB):
            b = right[j : j + SUB]
            # integers below 2**24 are exact in float32
            product = (floats @ ints[b].astype(np.float32).T).astype(np.float64) * scale[a][:, None] * scale[b]
            bound = np.outer(error[a], length[b] + error[b]) + np.outer(length[a], error[b]) + SLACK
            linked = product - bound >= threshold
            maybe = (product + bound >= threshold) & ~linked
            if same and i == j:
                upper = np.triu(np.ones(linked.shape, bool), 1)
                linked &= upper
                maybe &= upper
            undecided = int(maybe.sum())
            recomputed += undecided
            if undecided > linked.size // 50:
                exact = vectors[a] @ vectors[b].T / np.outer(norms[a], norms[b])
                linked |= maybe & (exact >= threshold)
            elif undecided:
                x, y = np.nonzero(maybe)
                exact = np.einsum("nd,nd->n", vectors[a[x]], vectors[b[y]]) / (norms[a[x]] * norms[b[y]])
                over = exact >= threshold
                linked[x[over], y[over]] = True
            if linked.any():
                counts[a] += linked @ sizes[b]
                counts[b] += sizes[a] @ linked
                x, y = np.nonzero(linked)
                forest.link(a[x], b[y])
    return counts, forest, recomputed


def link_vectors(df: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding", tile: int | None = None) -> DataFrame:
    """Per vector: key, n_links, component_id (the least key that links reach), kept (key = component_id)."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = F.coalesce(F.forall("v", number) & F.exists("v", lambda x: x != 0), F.lit(False))
    # equal vectors meet by a digest of their components; -0.0 is 0.0
    digest = F.when(usable, F.sha2(F.array_join(F.transform("v", lambda x: (x + F.lit(0.0).cast(x_type(df, vector))).cast("string")), ","), 256))
    rows = rows.withColumn("digest", digest)
    reps = rows.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("v").alias("v"))
    reps = saved(reps.withColumn("dim", F.size("v")), "vectors")
    n = reps.count()
    tile = tile or min(MAX_TILE, max(MIN_TILE, -(-n // 16)))
    grid = max(1, -(-n // tile))
    block = F.pmod(F.xxhash64("digest"), F.lit(grid)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))
    dealt = reps.select("rep", "size", "v", "dim", block.alias("block")).select("*", other.alias("other"))
    dealt = dealt.withColumn("tile", F.least("block", "other").cast("long") * grid + F.greatest("block", "other"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby("dim"):
            part = part.reset_index(drop=True)
            vectors = np.stack([np.asarray(x, np.float64) for x in part["v"]])
            vectors /= np.abs(vectors).max(axis=1)[:, None]  # neither overflow nor underflow in norms
            blocks = part["block"].to_numpy()
            low, high = divmod(int(part["tile"].iloc[0]), grid)
            left = np.flatnonzero(blocks == low)
            right = left if low == high else np.flatnonzero(blocks == high)
            counts, forest, _ = link_tile(vectors, part["size"].to_numpy(np.int64), left, right, threshold)
            ids = part["rep"].to_numpy(np.int64)
            use = np.flatnonzero(counts)
            out.append(pd.DataFrame({"rep": ids[use], "links": counts[use], "peer": ids[forest.root[use]]}))
        return pd.concat(out)

    found = saved(dealt.groupBy("tile").applyInPandas(compare, "rep long, links long, peer long"), "tiles")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    known = reps.select("digest", "rep", "size").join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("digest", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("id", "digest").join(known, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def x_type(df: DataFrame, vector: str) -> str:
    """The component type of an array column."""
    return df.schema[vector].dataType.elementType.simpleString()
