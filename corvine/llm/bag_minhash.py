"""Near-duplicate documents by weighted MinHash (BagMinHash), banding and verified multiset overlap.

A document is the multiset of its shingles of five words (lower-cased ``\\w`` runs). Its signature comes from
Poisson processes: a shingle of count c owns the weights 0..c, cut into dyadic intervals [0,1), [1,2), [2,4),
..., each with a process of its own whose rate is its length; every point has a time, a weight within its
interval (points at or beyond c don't count) and a component, and a component's value is its earliest point.
Two signatures agree in a component with exactly the probability of the weighted Jaccard similarity. Points are
drawn in time order and only up to a time by which all components are surely met (else further), so a
document costs about its length plus a constant.

Signatures are cut into ``BANDS`` bands of ``ROWS`` components; documents that agree in a band share a bucket.
At similarity 0.8 two documents share none with probability 7e-5. Equal multisets are one representative first.
Then, without ever listing the pairs of a bucket:

1. every member is compared with its bucket's least one: first the signatures (pairs whose estimate is under the
   threshold by four standard errors are dropped), then the texts' multisets exactly. Components follow.
2. Buckets whose members are still in several components are cut into tiles: members outside the bucket's largest
   component against a block of all members, bounded in documents and in characters. A tile compares signatures in
   memory and names the documents of candidate pairs (each pair in its first common band alone). Their texts are
   sent to the tile, which works out the multiset overlap of every candidate pair, many at once by products of
   incidence matrices, and returns a spanning forest of the links, at most one row a document. So every candidate
   pair is verified or lies within one component, nothing is capped, and no list of a group's pairs exists.

In step 1 texts to verify travel once per pair, beside one copy of the shared text for every ``SALT`` partners,
sorted and streamed, so a text with very many partners is neither copied to each nor gathered with them.

Defined results: null, '' and texts without words link with nothing and stay; texts of fewer than five words have
one shingle; rows with one key are one document; a null key stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.common import saved
from corvine.llm.components import components
from corvine.llm.embedding_dups import Forest
from corvine.llm.encoding import PieceEncoder, alone
from corvine.llm.toxicity import WORD

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
M = BANDS * ROWS
SALT, BLOCK, BLOCK_CHARS = 256, 1024, 16 << 20
SLAB = 4096
MAX_BROADCAST_ROWS = 1 << 18
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(PieceEncoder):
    """64-bit hashes of a text's words, in order; cached by white-space piece."""

    def __init__(self) -> None:
        self.spaceless, self.dtype = True, np.uint64
        self.clear()

    def piece(self, text: str) -> list[int]:
        return [xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) for word in WORD.findall(text.lower())]

    library = piece


_hashes: list[WordHashes] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles (hashes, ascending) and their counts."""
    if not _hashes:
        _hashes.append(WordHashes())
    words = alone(_hashes[0]).encode(text)
    if not len(words):
        return words, np.empty(0, np.int64)
    n = max(1, len(words) - size + 1)
    total = np.full(n, len(words) if len(words) < size else size, np.uint64)
    for k in range(min(size, len(words))):
        total = mixed(total * GOLDEN + words[k : k + n])
    return np.unique(total, return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; 0 if one is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    common = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The earliest time of each of M components for every (non-empty) bag."""
    sizes = np.array([len(keys) for keys, _ in bags])
    key = np.concatenate([keys for keys, _ in bags])
    count = np.concatenate([counts for _, counts in bags])
    owner = np.repeat(np.arange(len(bags)), sizes)
    weight = np.array([counts.sum() for _, counts in bags], float)
    # one process for each dyadic interval that begins below the count
    keys, owners, lows, lengths, counts = [key], [owner], [np.zeros(len(key), np.int64)], [np.ones(len(key), np.int64)], [count]
    low, level = 1, 1
    more = count > low
    while more.any():
        keys.append(mixed(key[more] + np.uint64(level * int(MIX2) & 0xFFFFFFFFFFFFFFFF)))
        owners.append(owner[more])
        lows.append(np.full(int(more.sum()), low))
        lengths.append(np.full(int(more.sum()), low))
        counts.append(count[more])
        low, level = 2 * low, level + 1
        more = count > low
    key, owner, start, length, count = map(np.concatenate, (keys, owners, lows, lengths, counts))
    out = np.full(len(bags) * M, np.inf)
    todo = np.arange(len(bags))
    margin = 4.0
    while len(todo):
        limit = np.full(len(bags), -1.0)
        limit[todo] = M / weight[todo] * (np.log(M) + margin)
        # a retry draws the same points again, further
        live = limit[owner] >= 0
        k, o, s, n, c = key[live], owner[live], start[live], length[live], count[live]
        time, step = np.zeros(len(k)), 0
        while len(k):
            step += 1
            draw = mixed(k + np.uint64(step * int(GOLDEN) & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / n
            near = time <= limit[o]
            k, o, s, n, c, time, draw = k[near], o[near], s[near], n[near], c[near], time[near], draw[near]
            second = mixed(draw ^ MIX1)
            place = s + ((second >> np.uint64(40)).astype(np.int64) % n)
            inside = place < c
            component = (second & np.uint64(0xFFFFFFFF)).astype(np.int64) % M
            np.minimum.at(out, o[inside] * M + component[inside], time[inside])
        todo = todo[np.isinf(out.reshape(len(bags), M)[todo]).any(axis=1)]
        margin += 8.0
    return out.reshape(len(bags), M)


def sign_documents(df: DataFrame, text: str, key: str) -> DataFrame:
    """doc, characters, digest of the multiset (null without words), signature (16 bits a component), band keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = [shingles(x if isinstance(x, str) else None) for x in batch["__text"]]
            n = len(bags)
            digest: list[bytes | None] = [xxhash.xxh3_128_digest(k.tobytes() + c.astype("<i8").tobytes()) if len(k) else None for k, c in bags]
            marks: list[bytes | None] = [None] * n
            bands: list[np.ndarray | None] = [None] * n
            order = sorted((i for i in range(n) if len(bags[i][0])), key=lambda i: len(bags[i][0]))
            group: list[int] = []
            held = 0
            for at, i in enumerate(order):
                group.append(i)
                held += len(bags[i][0])
                if held >= 150_000 or at == len(order) - 1:
                    bits = mixed(signatures([bags[j] for j in group]).view(np.uint64))
                    lanes = np.zeros((len(group), BANDS), np.uint64)
                    for row in range(ROWS):
                        lanes = mixed(lanes * GOLDEN + bits.reshape(len(group), BANDS, ROWS)[:, :, row])
                    lanes = mixed(lanes + np.arange(BANDS, dtype=np.uint64) * GOLDEN).view(np.int64)
                    short = (bits & np.uint64(0xFFFF)).astype("<u2")
                    for row, j in enumerate(group):
                        marks[j], bands[j] = short[row].tobytes(), lanes[row]
                    group, held = [], 0
            yield pd.DataFrame({"doc": batch["doc"], "chars": batch["__text"].str.len().fillna(0), "digest": digest, "marks": marks, "bands": bands})

    rows = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("__text")).where("doc is not null")
    return rows.mapInPandas(run, "doc long, chars long, digest binary, marks binary, bands array<bigint>")


def compared(a: np.ndarray, b: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """For two sets of signatures, all against all: shares of equal components; which agree in a band before ``band``."""
    if len(a) * len(b) <= 2048:
        equal = a[:, None, :] == b
        return equal.mean(axis=2), equal.reshape(len(a), len(b), BANDS, ROWS)[:, :, :band].all(axis=3).any(axis=2)
    count, earlier = np.zeros((len(a), len(b)), np.uint8), np.zeros((len(a), len(b)), bool)
    for group in range(BANDS):
        whole = None
        for column in range(group * ROWS, group * ROWS + ROWS):
            equal = a[:, column][:, None] == b[:, column]
            count += equal
            if group < band:
                whole = equal if whole is None else whole & equal
        if whole is not None:
            earlier |= whole
    return count / M, earlier


def candidates_of(tile: pd.DataFrame, least: float) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    """A tile's strays, its members, and which pairs of them are to be verified here."""
    stray = tile["stray"].to_numpy(bool)
    a, b = tile[stray], tile[~stray]
    if not len(a) or not len(b):
        return a, b, np.zeros((len(a), len(b)), bool)
    shares, earlier = compared(*(np.frombuffer(b"".join(x["marks"]), "<u2").reshape(-1, M) for x in (a, b)), int(tile["band"].iloc[0]))
    hub, main = int(tile["hub"].iloc[0]), int(tile["main"].iloc[0])
    (ra, ca), (rb, cb) = ((x["rep"].to_numpy(np.int64), x["component"].to_numpy(np.int64)) for x in (a, b))
    # pairs with the hub are verified before; two strays meet twice, and count once
    wanted = (shares >= least) & ~earlier & (ca[:, None] != cb) & (ra != hub)[:, None] & (rb != hub)
    return a, b, wanted & ((cb == main) | (ra[:, None] < rb))


def expanded(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A multiset as a set: each occurrence of a shingle has a key of its own."""
    keys, counts = bag
    nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return mixed(np.repeat(keys, counts) + nth.astype(np.uint64) * GOLDEN)


def similar_pairs(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the wanted pairs of bags overlap enough, by pairs or by products of incidence matrices."""
    x, y = np.nonzero(wanted)
    if len(x) <= 4 * (len(a) + len(b)):
        good = [overlap(a[i], b[j]) >= threshold for i, j in zip(x, y)]
        out = np.zeros_like(wanted)
        out[x[good], y[good]] = True
        return out
    left, right = [expanded(bag) for bag in a], [expanded(bag) for bag in b]
    sizes_a, sizes_b = np.array([len(k) for k in left]), np.array([len(k) for k in right])
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    places = []
    for side, sizes in ((left, sizes_a), (right, sizes_b)):
        keys, owner = np.concatenate(side), np.repeat(np.arange(len(side)), sizes)
        at = np.minimum(np.searchsorted(both, keys), max(0, len(both) - 1))
        known = both[at] == keys if len(both) else np.zeros(len(keys), bool)
        order = np.argsort(at[known], kind="stable")
        places.append((at[known][order], owner[known][order]))
    common = np.zeros(wanted.shape)
    for start in range(0, len(both), SLAB):
        parts = []
        for (at, owner), n in zip(places, wanted.shape):
            low, high = np.searchsorted(at, [start, start + SLAB])
            part = np.zeros((n, SLAB), np.float32)
            part[owner[low:high], at[low:high] - start] = 1
            parts.append(part)
        common += parts[0] @ parts[1].T
    return wanted & (common / (sizes_a[:, None] + sizes_b - common) >= threshold)


TILE = ["bucket", "i", "j"]


def tiles_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tiles of a stream sorted by them, each whole."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[TILE].to_numpy()
        if held and (held[-1][TILE].iloc[-1].to_numpy() != keys[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        for low, high in zip(cuts[:-2], cuts[1:-1]):
            yield pd.concat([*held, batch.iloc[low:high]], ignore_index=True) if held else batch.iloc[low:high]
            held = []
        held.append(batch.iloc[cuts[-2] :])
    if held:
        yield pd.concat(held, ignore_index=True)


def tile_links(members: DataFrame, joined: DataFrame, reps: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that join the components of buckets with several of them."""
    least = least_estimate(threshold)
    label = joined.select(F.col("node").alias("rep"), "component")
    placed = members.where("n > 2").join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("k"), F.sum("chars").alias("w"))
    split = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("k", "component", "w")).alias("top"), F.sum("w").alias("all_w")).where("parts > 1")
    placed = placed.join(split.select("bucket", F.col("top.component").alias("main"), F.col("top.k").alias("k"), F.col("top.w").alias("w"), "all_w"), "bucket")
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_CHARS), F.lit(1)).cast("int")
    placed = placed.withColumn("rows", blocks(F.col("n") - F.col("k"), F.col("all_w") - F.col("w"))).withColumn("columns", blocks(F.col("n"), F.col("all_w")))
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # strays meet every block of members; members meet every block of strays
    left = placed.where("component <> main").withColumn("i", block("rows")).withColumn("j", every("columns")).withColumn("stray", F.lit(True))
    right = placed.withColumn("j", block("columns")).withColumn("i", every("rows")).withColumn("stray", F.lit(False))
    columns = ["bucket", "i", "j", "band", "hub", "main", "rep", "component", "stray"]
    kinds = "bucket long, i int, j int, band int, hub long, main long, rep long, component long, stray boolean"
    marks = reps.select("rep", "marks")
    dealt = left.select(columns).unionAll(right.select(columns)).join(marks, "rep").select(*columns, "marks").repartition(*TILE).sortWithinPartitions(*TILE)

    def involved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, held = [], 0
        for tile in tiles_in(batches):
            a, b, wanted = candidates_of(tile, least)
            if wanted.any():
                found += [a[columns][wanted.any(axis=1)], b[columns][wanted.any(axis=0)]]
                held += len(found[-1]) + len(found[-2])
                if held > 20_000:
                    yield pd.concat(found)
                    found, held = [], 0
        if found:
            yield pd.concat(found)

    wanted_rows = saved(dealt.mapInPandas(involved, kinds), "tiles")
    ids = wanted_rows.select("rep").distinct()
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_ROWS else ids
    own = texts.join(ids.withColumnRenamed("rep", "doc"), "doc").withColumnRenamed("doc", "rep")
    met = wanted_rows.join(marks, "rep").join(own, "rep").select(*columns, "marks", "text").repartition(*TILE).sortWithinPartitions(*TILE)

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tile in tiles_in(batches):
            a, b, wanted = candidates_of(tile, least)
            if wanted.any():
                good = similar_pairs(*([shingles(t) for t in x["text"]] for x in (a, b)), wanted, threshold)
                x, y = np.nonzero(good)
                if len(x):
                    forest = Forest(len(a) + len(b))
                    forest.link(x, y + len(a))
                    names = np.concatenate([a["rep"].to_numpy(np.int64), b["rep"].to_numpy(np.int64)])
                    use = np.unique(np.concatenate([x, y + len(a)]))
                    yield pd.DataFrame({"a": names[use], "b": names[forest.root[use]]})

    return met.mapInPandas(linked, "a long, b long").where("a <> b")


def least_estimate(threshold: float) -> float:
    """Four standard errors below the threshold."""
    return threshold - 4 * float(np.sqrt(threshold * (1 - threshold) / M))


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b), distinct, whose texts (doc, text) overlap enough; b's text meets a's in a stream."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(1 << 20)))
    counted = pairs.groupBy("a").agg(F.count("*").alias("n"))
    # partners of one text are cut into parts of about SALT, with a copy of the text for each part
    parts = pairs.join(counted, "a").withColumn("salt", (F.col("salt") % F.ceil(F.col("n") / SALT)).cast("long"))
    parts = saved(parts.select("a", "b", "salt"), "pairs")
    roles = parts.select(F.col("b").alias("doc"), "a", "salt", F.lit(1).alias("role")).unionAll(parts.select(F.col("a").alias("doc"), "a", "salt", F.lit(0).alias("role")).distinct())
    # a checked size decides whether the ids go to the texts or the texts to the ids
    roles = F.broadcast(roles) if parts.count() <= MAX_BROADCAST_ROWS // 2 else roles
    met = texts.join(roles, "doc").repartition("a", "salt").sortWithinPartitions("a", "salt", "role", "doc")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, bag = None, None
        for batch in batches:
            rows = []
            for doc, a, salt, role, text in zip(batch["doc"], batch["a"], batch["salt"], batch["role"], batch["text"]):
                if role == 0:
                    if head != (a, salt):
                        head, bag = (a, salt), shingles(text)
                elif head == (a, salt) and overlap(bag, shingles(text)) >= threshold:
                    rows.append((a, doc))
            yield pd.DataFrame(rows, columns=["a", "b"])

    return met.select("doc", "a", "salt", "role", "text").mapInPandas(run, "a long, b long")


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, class_id, kept): the least key that links reach, and whether it is the document itself."""
    texts = df.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("doc is not null")
    signed = saved(sign_documents(df, text, key), "signed")
    least = least_estimate(threshold)
    reps = signed.where("digest is not null").groupBy("digest").agg(F.min("doc").alias("rep"), F.first("chars").alias("chars"), F.first("marks").alias("marks"), F.first("bands").alias("bands"))
    reps = saved(reps, "reps")
    buckets = reps.select("rep", "chars", F.posexplode("bands").alias("band", "bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = saved(buckets.join(hubs, "bucket"), "members")
    marks = reps.select("rep", "marks")
    stars = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    close = stars.join(marks.select(F.col("rep").alias("b"), F.col("marks").alias("mb")), "b").join(marks.select(F.col("rep").alias("a"), F.col("marks").alias("ma")), "a")

    def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c]), "<u2").reshape(-1, M) for c in ("ma", "mb"))
                yield batch[["a", "b"]][(a == b).mean(axis=1) >= least]

    close = close.select("a", "b", "ma", "mb").mapInPandas(estimate, "a long, b long")
    links = saved(verified(close, texts, threshold), "links")
    joined = components(links)

    more = saved(tile_links(members, joined, reps, texts, threshold), "links")
    if more.head(1):
        joined = components(links.unionAll(more))

    known = signed.join(reps.select("digest", "rep"), "digest", "left").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    classes = known.groupBy("doc").agg(F.min(F.coalesce("component", "rep", "doc")).alias("class_id"))
    nowhere = df.where(F.col(key).isNull()).select(F.col(key).cast("long").alias("doc"), F.lit(None).cast("long").alias("class_id"))
    return classes.unionAll(nowhere).select(F.col("doc").alias(key), "class_id", F.coalesce(F.col("doc") == F.col("class_id"), F.lit(True)).alias("kept"))


def keep_one(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, without those that near-duplicate one with a lesser id; of repeated rows one stays.

    Rows of one id with different texts are documents of their own, in the order of their texts' hashes.
    """
    repeated = df.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    if not repeated.head(1):
        dropped = near_duplicates(df, threshold).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
        return df.join(dropped, F.col("doc_id") == F.col("__gone"), "left_anti")
    marked = df.withColumn("__mark", F.xxhash64("text"))
    places = marked.where("doc_id is not null").select("doc_id", "__mark").distinct().orderBy("doc_id", "__mark")
    # ids that rise with doc_id; saved, so that they are the same at every use
    places = saved(places.withColumn("__n", F.monotonically_increasing_id()), "places")
    numbered = marked.join(places, ["doc_id", "__mark"], "left")
    dropped = near_duplicates(numbered, threshold, key="__n").where(~F.col("kept")).select(F.col("__n").alias("__gone"))
    left = numbered.join(dropped, F.col("__n") == F.col("__gone"), "left_anti")
    twice = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["__n"])
    return left.join(repeated, "doc_id", "left_anti").unionByName(twice).select(*df.columns)


def one_of_equal_texts(df: DataFrame) -> DataFrame:
    """The rows without those whose whole text another row with a lesser id has; a null key stays.

    Texts without words link with nothing in ``near_duplicates``; this leaves one of each of them, too.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = df.where("doc_id is not null").select(F.col("doc_id").alias("__doc"), digest.alias("__digest"))
    least = saved(rows.groupBy("__digest").agg(F.min("__doc").alias("__least"), F.count("*").alias("n")).where("n > 1").select("__digest", "__least"), "equal")
    least = F.broadcast(least) if least.count() <= MAX_BROADCAST_ROWS else least
    gone = rows.join(least, "__digest").where("__doc > __least").select("__doc", F.col("__digest").alias("__of")).distinct()
    return df.join(gone, (F.col("doc_id") == F.col("__doc")) & (digest == F.col("__of")), "left_anti")
