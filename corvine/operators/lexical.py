"""BM25 over identifier-aware tokens.

The index is long-form tables: postings (doc, term, tf), terms (term, df, idf), lengths (doc, dl) and one row of
corpus statistics. ``write_index`` stores postings with their document's length and terms by shards of the term's
hash; ``scored_by_index`` reads the shards of the query's terms alone.

A search without an index (``Search``) passes once over the texts and shuffles neither tokens nor scores: it keeps each
document's length and counts of the queries' terms, from which the statistics come; then Arrow batches of these rows are
scored against all queries, and the best of each batch are handed on. Counting inside a batch needs ids that are there
once; where an id repeats or is null, documents are grouped by a shuffle as before (``scored``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from corvine.functions.tokens import identifier_tokens, terms as terms_of

# fixed values
K1, B = 1.5, 0.75
BOOST = 3.0
PIN_DF = 5
MAX_QUERY_TERMS = 1 << 18
SHARDS = 256
#: Bytes of tokens that a Python worker counts at a time, and scores (queries by documents) that it holds.
SLICE_BYTES, SLICE_SCORES = 1 << 22, 1 << 22
MAX_BATCH_QUERIES = 10_000


def tokenized(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, tokens): the terms of every document, in no order."""
    return docs.select(F.col(id_).alias("doc"), terms_of(F.col(text)).alias("tokens"))


def keyed(docs: DataFrame, id_: str = "doc_id") -> bool:
    """Whether every document has an id of its own; only the ids are read."""
    return docs.groupBy(id_).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(id_).isNull()).isEmpty()


def joined(tokens: DataFrame) -> DataFrame:
    """(doc, tokens) with the tokens as one string, which is far cheaper to send to Python than an array; null without any."""
    return tokens.select("doc", F.nullif(F.array_join("tokens", "\n"), F.lit("")).alias("tokens"))


def token_slices(batch: pa.RecordBatch, most_rows: int = 1 << 31) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(ids, flat tokens, each document's number of tokens) of runs of a batch of ``joined`` with about ``SLICE_BYTES`` each."""
    ids, texts, start = batch.column(0), batch.column(1), 0
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    while start < len(ends):
        most = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES, "right")) - start
        n = max(1, min(most, most_rows))
        lists = pc.split_pattern(texts.slice(start, n), "\n")
        yield ids.slice(start, n), lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start += n


def counted_in_slice(codes: np.ndarray, sizes: np.ndarray, kinds: int, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document's place, code, count) of flat codes under ``kinds``; ``kept`` are the places of the tokens that have one."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    pairs, tf = np.unique((rows if kept is None else rows[kept]) * max(1, kinds) + codes, return_counts=True)
    return pairs // max(1, kinds), pairs % max(1, kinds), tf


def postings(tokens: DataFrame) -> DataFrame:
    """(doc, term, tf): counted where the document is, without a shuffle, if ids are there once."""
    if not keyed(tokens, "doc"):
        return tokens.select("doc", F.explode("tokens").alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, flat, sizes in token_slices(batch):
                known = flat.dictionary_encode()
                rows, codes, tf = counted_in_slice(known.indices.to_numpy(), sizes, len(known.dictionary))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), known.dictionary.take(pa.array(codes)), pa.array(tf, pa.int64())], ["doc", "term", "tf"])

    return joined(tokens).mapInArrow(count, f"doc {tokens.schema['doc'].dataType.simpleString()}, term string, tf bigint")


def document_frequencies(tokens: DataFrame) -> DataFrame:
    """(term, df): each term once a document, combined on the map side."""
    if not keyed(tokens, "doc"):
        return postings(tokens).groupBy("term").agg(F.count("*").alias("df"))
    return tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def terms(df: DataFrame, n: DataFrame) -> DataFrame:
    """(term, df, idf) for documents' numbers (term, df) and a one-row frame with the number of documents ``n``."""
    return df.crossJoin(F.broadcast(n)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def lengths(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc", F.size("tokens").cast("long").alias("dl"))


def corpus(tokens: DataFrame) -> DataFrame:
    """One row: documents (empty ones too) and their mean length."""
    return lengths(tokens).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(queries: DataFrame, id_: str = "query_id", text: str = "query") -> DataFrame:
    """(query_id, term, flag): each term once, flagged as a whole identifier by its first occurrence."""
    found = queries.select(F.col(id_).alias("query_id"), F.posexplode(identifier_tokens(F.col(text))).alias("pos", "t"))
    return found.groupBy("query_id", F.col("t.term").alias("term")).agg(F.min_by("t.is_whole_identifier", "pos").alias("flag"))


def scored(docs: DataFrame, queries: DataFrame, id_: str = "doc_id", text: str = "text", query_id: str = "query_id", query: str = "query") -> DataFrame:
    """(query_id, doc, score, pinnable): every document with a term of a query, and whether a rare identifier matched."""
    tokens = tokenized(docs, id_, text)
    wanted = query_terms(queries, query_id, query)
    distinct = wanted.select("term").distinct()
    if distinct.count() <= MAX_QUERY_TERMS:
        distinct = F.broadcast(distinct)
    hits = tokens.select("doc", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term")).join(distinct, "term", "left_semi")
    counted = hits.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    stats = corpus(tokens)
    weights = counted.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).select("term", "df", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    per_query = wanted.join(weights, "term")
    return weighted(counted, per_query)


def weighted(counted: DataFrame, per_query: DataFrame) -> DataFrame:
    """Scores of documents' terms (doc, term, tf, dl) for queries' terms (query_id, term, flag, df, idf, avgdl)."""
    part = F.col("idf") * F.when(F.col("flag"), BOOST).otherwise(1.0) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    rare = F.col("flag") & (F.col("df") <= PIN_DF)
    return counted.join(per_query, "term").groupBy("query_id", "doc").agg(F.sum(part).alias("score"), F.max(rare).alias("pinnable"))


def shard(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SHARDS)).cast("int")


def write_index(docs: DataFrame, folder: str, id_: str = "doc_id", text: str = "text") -> None:
    """Postings, terms and statistics of a corpus, tokenised once; a common term's postings are several files of its shard."""
    spark = docs.sparkSession
    rows = tokenized(docs, id_, text)
    found = rows.select("doc", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    counted = found.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    counted.withColumn("shard", shard(F.col("term"))).repartition("shard", F.pmod(F.xxhash64("doc"), F.lit(8))).sortWithinPartitions("shard", "term").write.mode("overwrite").partitionBy("shard").parquet(f"{folder}/postings")
    stored = spark.read.parquet(f"{folder}/postings")
    stored.groupBy("shard", "term").agg(F.count("*").alias("df")).repartition("shard").sortWithinPartitions("term").write.mode("overwrite").partitionBy("shard").parquet(f"{folder}/terms")
    corpus(rows).write.mode("overwrite").parquet(f"{folder}/corpus")


def scored_by_index(spark: SparkSession, folder: str, queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """The same as ``scored`` from a stored index: only the shards of the queries' terms are read, no text is."""
    wanted = query_terms(queries, query_id, query)
    distinct = wanted.select("term").distinct().withColumn("shard", shard(F.col("term")))
    shards = [row.shard for row in distinct.select("shard").distinct().collect()]
    of = lambda name: spark.read.parquet(f"{folder}/{name}").where(F.col("shard").isin(shards))
    distinct = F.broadcast(distinct) if distinct.count() <= MAX_QUERY_TERMS else distinct
    weights = of("terms").join(distinct, ["shard", "term"], "left_semi").crossJoin(F.broadcast(spark.read.parquet(f"{folder}/corpus"))).select("term", "df", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    return weighted(of("postings").join(distinct, ["shard", "term"], "left_semi").select("doc", "term", "tf", "dl"), wanted.join(weights, "term"))


def best_first() -> list[Column]:
    """Scores rounded to six places, ties by the id as a string."""
    return [F.round("score", 6).desc(), F.col("id").asc()]


def ranked(scores: DataFrame, k: int, id_: str = "doc") -> DataFrame:
    """(query_id, rank, id, score): the k best of each query."""
    rows = scores.select("query_id", F.col(id_).cast("string").alias("id"), "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*best_first()))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


class Search:
    """BM25 with identifier boost of queries (query_id, query) over documents; made with one pass over the texts."""

    def __init__(self, docs: DataFrame, queries: DataFrame, id_: str = "doc_id", text: str = "text"):
        self.spark, self.docs, self.id_, self.text = docs.sparkSession, docs, id_, text
        self.query_kind, self.doc_kind = queries.schema["query_id"].dataType.simpleString(), docs.schema[id_].dataType.simpleString()
        self.query_arrow = to_arrow_type(queries.schema["query_id"].dataType)
        if not keyed(docs, id_):
            self.scores = scored(docs, queries, id_, text)
            return
        self.scores = None
        wanted = query_terms(queries).collect()
        self.terms = sorted({row.term for row in wanted})
        place = {term: i for i, term in enumerate(self.terms)}
        self.wanted = [(row.query_id, place[row.term], row.flag) for row in wanted]
        self.measure()

    def measure(self) -> None:
        """The texts as (doc, dl, codes, tfs) of the queries' terms; from these the corpus' size and mean length, and each term's number of documents."""
        terms = self.spark.sparkContext.broadcast(self.terms)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = pa.array(terms.value, pa.string())
            for batch in batches:
                for ids, flat, sizes in token_slices(batch):
                    rows, codes, tf = matched(flat, sizes, known)
                    ends = pa.array(np.searchsorted(rows, np.arange(len(sizes) + 1)).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (codes, tf)]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), *lists], ["doc", "dl", "codes", "tfs"])

        self.rows = kept(joined(tokenized(self.docs, self.id_, self.text)).mapInArrow(count, f"doc {self.doc_kind}, dl bigint, codes array<int>, tfs array<int>"))
        size = self.rows.agg(F.count("*").alias("n"), F.sum("dl").alias("length")).first()
        self.n, self.avgdl = size.n, (size.length / size.n if size.n else 0.0)
        self.df = np.zeros(len(self.terms), np.int64)
        for row in self.rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df")).collect():
            self.df[row.code] = row.df

    def scored(self, docs: DataFrame, wanted: list[tuple], k: int) -> DataFrame:
        """(query_id, doc, score) of the best of every slice of documents (doc, dl, codes, tfs) for one block of queries; ties of the last one stay."""
        names = list(dict.fromkeys(query for query, _, _ in wanted))
        place = {query: i for i, query in enumerate(names)}
        weight = np.log((self.n - self.df + 0.5) / (self.df + 0.5) + 1.0)
        rows = np.array([(term, place[query], weight[term] * (BOOST if flag else 1.0)) for query, term, flag in wanted], np.float64).reshape(-1, 3)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        used, starts = np.unique(rows[:, 0].astype(np.int64), return_index=True)
        known = self.spark.sparkContext.broadcast((names, used, np.split(rows[:, 1].astype(np.int64), starts[1:]), np.split(rows[:, 2], starts[1:])))
        avgdl, query_kind, kinds = self.avgdl, self.query_arrow, f"query_id {self.query_kind}, doc {self.doc_kind}, score double"

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, used, asking, weights = known.value
            place = {term: i for i, term in enumerate(used.tolist())}
            least, step = np.zeros(len(names)), max(1, SLICE_SCORES // max(1, len(names)))
            for batch in batches:
                for part in (batch.slice(at, step) for at in range(0, len(batch), step)):
                    ids, sizes = part.column(0), part.column(1).to_numpy()
                    codes, tf = (part.column(i).flatten().to_numpy() for i in (2, 3))
                    at = np.repeat(np.arange(len(ids)), pc.list_value_length(part.column(2)).to_numpy())
                    order = np.argsort(codes, kind="stable")
                    at, codes, tf = at[order], codes[order], tf[order]
                    share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[at] / avgdl)) if len(at) else np.zeros(0)
                    scores = np.zeros((len(names), len(ids)))
                    present, begins = np.unique(codes, return_index=True)
                    for term, begin, end in zip(present.tolist(), begins.tolist(), [*begins[1:].tolist(), len(codes)]):
                        if (i := place.get(term)) is not None:
                            scores[np.ix_(asking[i], at[begin:end])] += np.outer(weights[i], share[begin:end])
                    if k < len(ids):
                        # the k-th best of a slice is no better than that of all documents
                        np.maximum(least, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k], out=least)
                    queries, docs = np.nonzero((scores > 0) & (scores >= least[:, None] - 2e-6))
                    asked = pa.array(names, query_kind).take(pa.array(queries))
                    yield pa.RecordBatch.from_arrays([asked, ids.take(pa.array(docs)), pa.array(scores[queries, docs])], ["query_id", "doc", "score"])

        return docs.mapInArrow(best, kinds)

    def top(self, k: int) -> DataFrame:
        """(query_id, rank, id, score): the k best documents of each query; only those with a term of it."""
        if self.scores is not None:
            return ranked(self.scores, k)
        names = list(dict.fromkeys(query for query, _, _ in self.wanted))
        blocks = [set(names[at : at + MAX_BATCH_QUERIES]) for at in range(0, len(names), MAX_BATCH_QUERIES)] or [set()]
        return ranked(reduce(DataFrame.unionAll, [self.scored(self.rows, [row for row in self.wanted if row[0] in block], max(1, k)) for block in blocks]), k)

    def pins(self) -> DataFrame:
        """(query_id, id): of the documents with a rare flagged identifier the best by the whole query; only such documents are scored."""
        if self.scores is not None:
            return pins(self.scores)
        rare = {t for _, t, flag in self.wanted if flag and 0 < self.df[t] <= PIN_DF}
        docs = self.rows.where(F.arrays_overlap("codes", F.lit(sorted(rare)).cast("array<int>"))) if rare else self.rows.limit(0)
        found = [(row.doc, set(row.codes)) for row in docs.select("doc", "codes").collect()]
        holders = {t: [doc for doc, codes in found if t in codes] for t in rare}
        pairs = list(dict.fromkeys((query, doc) for query, term, flag in self.wanted if flag and term in rare for doc in holders[term]))
        asking = {query for query, _ in pairs}
        frame = self.spark.createDataFrame(pairs, f"query_id {self.query_kind}, doc {self.doc_kind}")
        everything = self.scored(docs, [row for row in self.wanted if row[0] in asking], 1 << 31)
        return ranked(everything.join(F.broadcast(frame), ["query_id", "doc"], "left_semi"), 1).select("query_id", "id")


def kept(df: DataFrame) -> DataFrame:
    """The rows, worked out once: in the folder that ``spark.checkpoint.dir`` names, or else on the executors' disks."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist(StorageLevel.DISK_ONLY)
    path = f"{folder.rstrip('/')}/matched-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def matched(flat: pa.Array, sizes: np.ndarray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document's place, place of the term in ``known``, count) of the tokens that are known terms."""
    codes = pc.index_in(flat, value_set=known)
    kept = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
    return counted_in_slice(codes.drop_null().to_numpy().astype(np.int64), sizes, len(known), kept)


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """BM25 with identifier boost: the k best documents of each query; only those with a term of it."""
    return Search(docs, queries).top(k)


def pins(scores: DataFrame) -> DataFrame:
    """(query_id, id): of the documents with a rare flagged identifier the best by the whole query."""
    return ranked(scores.where("pinnable"), 1).select("query_id", "id")
