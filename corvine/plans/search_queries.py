"""Registered search queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.tokens import terms, whole_identifiers
from corvine.functions.vectors import dot, l2_normalize, norm
from corvine.operators import dense, fusion, hybrid, lexical
from corvine.plans.registry import query

PHRASE = " hybrid search."


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 0: the beginning of document 0 and a fixed phrase; vector 0."""
    text = table(spark, sf_dir, "documents").where("doc_id = 0").select(F.lit(0).cast("long").alias("query_id"), F.concat(F.substring("text", 1, 60), F.lit(PHRASE)).alias("query"))
    vector = table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    return text.join(vector, "query_id")


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def token_sql(name: str, source: str, key: str, text: str) -> str:
    """CTEs ending in ``name``(key, term, flag, pos) for the tokens of a source."""
    return rf"""
{name}_w AS (
  SELECT {key}, w, i FROM (SELECT {key}, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (
    SELECT {key}, list_filter(string_split_regex(coalesce({text}, ''), '[^\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}.\-]+'), lambda x: length(x) >= 2) AS ws FROM {source}))
), {name}_c AS (
  SELECT {key}, i, lower(w) AS whole, list_distinct(list_transform(list_filter(flatten(list_transform(
      list_filter(string_split_regex(w, '[_.\-]+'), lambda p: length(p) >= 2),
      lambda p: string_split(regexp_replace(regexp_replace(p, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' '))),
    lambda p: length(p) >= 2), lambda p: lower(p))) AS comps
  FROM {name}_w
), {name} AS (
  SELECT {key}, whole AS term, len(comps) > 0 AND NOT (len(comps) = 1 AND comps[1] = whole) AS flag, 2 * i AS pos FROM {name}_c
  UNION ALL
  SELECT {key}, term, false AS flag, 2 * i + 1 AS pos FROM (SELECT {key}, i, whole, unnest(comps) AS term FROM {name}_c) WHERE term <> whole
)"""


DOC_TOKENS = token_sql("tok", "documents", "doc_id", "text")
INDEX = (
    DOC_TOKENS
    + """, posting AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
dl AS (SELECT d.doc_id, coalesce(t.dl, 0) AS dl FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS dl FROM tok GROUP BY doc_id) t ON t.doc_id = d.doc_id),
stat AS (SELECT count(*)::DOUBLE AS n, avg(dl)::DOUBLE AS avgdl FROM dl),
term AS (SELECT term, count(*) AS df, ln((any_value(n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1::DOUBLE) AS idf FROM posting, stat GROUP BY term)"""
)


def scored_sql(queries: str) -> str:
    """CTEs ending in ``scored``(query_id, id, score, pinnable) for queries (query_id, query)."""
    return (
        INDEX
        + f", qs AS ({queries}), "
        + token_sql("qtok", "qs", "query_id", "query")
        + """, qterm AS (SELECT query_id, term, arg_min(flag, pos) AS flag FROM qtok GROUP BY query_id, term),
scored AS (
  SELECT q.query_id, p.doc_id::VARCHAR AS id, bool_or(q.flag AND t.df <= 5) AS pinnable,
    round(sum(t.idf * (CASE WHEN q.flag THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END) * p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / stat.avgdl))), 6) AS score
  FROM qterm q JOIN posting p ON p.term = q.term JOIN term t ON t.term = q.term JOIN dl ON dl.doc_id = p.doc_id, stat
  GROUP BY q.query_id, p.doc_id
), pin AS (
  SELECT query_id, id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM scored WHERE pinnable) WHERE r = 1
)"""
    )


ONE = f"SELECT 0::BIGINT AS query_id, substr(text, 1, 60) || '{PHRASE}' AS query FROM documents WHERE doc_id = 0"
MANY = "SELECT item_id AS query_id, text AS query FROM benchmark"


def dense_sql(k: int) -> str:
    return f""", unit AS (
  SELECT list_transform(e, lambda x: x / n) AS q FROM (SELECT e, sqrt(list_inner_product(e, e)) AS n FROM (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0))
), near AS (
  SELECT 0::BIGINT AS query_id, vec_id::VARCHAR AS id, round(list_inner_product(embedding::DOUBLE[], q), 6) AS score FROM embeddings, unit
), dense AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM near) WHERE rank <= {k})"""


def lexical_sql(k: int) -> str:
    return f", lexical AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= {k})"


def fuse_sql(k: int, dense_name: str = "dense", lexical_name: str = "lexical", name: str = "fused") -> str:
    return f""", {name} AS (SELECT * FROM (
  SELECT query_id, id, round(sum(s), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(s), 6) DESC, id) AS rank FROM (
    SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS s FROM {dense_name} UNION ALL SELECT query_id, id, 2.0::DOUBLE / (60 + rank) FROM {lexical_name}
  ) GROUP BY query_id, id) WHERE rank <= {k})"""


def pinned_sql(k: int) -> str:
    strip = lambda name: f", {name}_p AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM {name} x WHERE NOT EXISTS (SELECT 1 FROM pin p WHERE p.query_id = x.query_id AND p.id = x.id))"
    return (
        strip("dense")
        + strip("lexical")
        + fuse_sql(k, "dense_p", "lexical_p")
        + f""", hits AS (
  SELECT f.query_id, f.id, f.score, f.rank + (CASE WHEN p.id IS NULL THEN 0 ELSE 1 END) AS rank FROM fused f LEFT JOIN pin p ON p.query_id = f.query_id WHERE p.id IS NULL OR f.rank < {k}
  UNION ALL
  SELECT p.query_id, p.id, round(coalesce(max(f.score) + 0.001::DOUBLE, 1.0::DOUBLE), 6), 1 FROM pin p LEFT JOIN fused f ON f.query_id = p.query_id GROUP BY p.query_id, p.id
)"""
    )


def greedy_sql(source: str, k: int, threshold: float) -> str:
    """Recursive CTE ``kept`` over ``source``(id, score, rank), one query."""
    return f""", cand AS (SELECT h.id, h.score, h.rank, e.embedding::DOUBLE[] AS v FROM {source} h LEFT JOIN embeddings e ON e.vec_id::VARCHAR = h.id),
walk(rank, taken, vs) AS (
  SELECT 0::BIGINT, []::BIGINT[], []::DOUBLE[][]
  UNION ALL
  SELECT c.rank::BIGINT,
    CASE WHEN len(w.taken) >= {k} OR (c.v IS NOT NULL AND len(list_filter(w.vs, lambda o: list_inner_product(o, c.v) >= {threshold}::DOUBLE)) > 0) THEN w.taken ELSE list_append(w.taken, c.rank::BIGINT) END,
    CASE WHEN c.v IS NULL OR len(w.taken) >= {k} OR len(list_filter(w.vs, lambda o: list_inner_product(o, c.v) >= {threshold}::DOUBLE)) > 0 THEN w.vs ELSE list_append(w.vs, c.v) END
  FROM walk w JOIN cand c ON c.rank = w.rank + 1
), kept AS (
  SELECT c.id, c.score, row_number() OVER (ORDER BY c.rank) AS rank FROM cand c, (SELECT taken FROM walk ORDER BY rank DESC LIMIT 1) WHERE list_contains(taken, c.rank::BIGINT)
)"""


WITH = "WITH RECURSIVE " 


@query("tokenize_identifiers", f"WITH {DOC_TOKENS} SELECT doc_id, term, flag AS is_whole_identifier, count(*) AS tf FROM tok GROUP BY ALL")
def tokenize_identifiers(spark, sf_dir):
    # no term has a space
    found = lexical.postings(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), terms(F.col("text"), " ").alias("tokens")))
    return found.select(F.col("doc").alias("doc_id"), F.ltrim("term").alias("term"), F.startswith("term", F.lit(" ")).alias("is_whole_identifier"), "tf")


@query("identifier_flag", f"WITH {DOC_TOKENS} SELECT doc_id, count(*) AS flagged FROM tok WHERE flag GROUP BY doc_id")
def identifier_flag(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # a filter on the number would work it out twice
    flagged = F.filter(F.array(whole_identifiers(F.col("text")).cast("long")), lambda n: n > 0)
    return docs.select("doc_id", F.explode(flagged).alias("flagged"))


@query("bm25_postings", f"WITH {INDEX} SELECT doc_id, term, tf FROM posting")
def bm25_postings(spark, sf_dir):
    return lexical.postings(lexical.tokenized(table(spark, sf_dir, "documents"))).select(F.col("doc").alias("doc_id"), "term", "tf")


@query("bm25_terms", f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM term")
def bm25_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = lexical.terms(lexical.document_frequencies(lexical.tokenized(docs)), docs.agg(F.count("*").alias("n")))
    return found.select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_doc_len", f"WITH {INDEX} SELECT doc_id, dl FROM dl")
def bm25_doc_len(spark, sf_dir):
    return lexical.lengths(lexical.tokenized(table(spark, sf_dir, "documents"))).select(F.col("doc").alias("doc_id"), "dl")


@query("bm25_search", f"WITH {scored_sql(ONE)}{lexical_sql(10)} SELECT rank, id, score FROM lexical")
def bm25_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), one_query(spark, sf_dir), 10).drop("query_id")


@query("bm25_search_batch", f"WITH {scored_sql(MANY)}{lexical_sql(10)} SELECT query_id, rank, id, score FROM lexical")
def bm25_search_batch(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), batch(spark, sf_dir), 10)


@query("identifier_boost", f"WITH qs AS ({MANY}), {token_sql('qtok', 'qs', 'query_id', 'query')} SELECT query_id, term, CASE WHEN arg_min(flag, pos) THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS boost FROM qtok GROUP BY query_id, term")
def identifier_boost(spark, sf_dir):
    return lexical.query_terms(batch(spark, sf_dir)).select("query_id", "term", F.when(F.col("flag"), lexical.BOOST).otherwise(1.0).alias("boost"))


@query("identifier_pin", f"WITH {scored_sql(MANY)} SELECT query_id, id FROM pin")
def identifier_pin(spark, sf_dir):
    return lexical.Search(table(spark, sf_dir, "documents"), batch(spark, sf_dir)).pins()


@query(
    "l2_normalize",
    "SELECT vec_id, round(n, 6) AS norm_before, round(sqrt(list_inner_product(u, u)), 6) AS norm_after FROM (SELECT vec_id, n, list_transform(e, lambda x: x / n) AS u FROM (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: 3 * x) AS e FROM embeddings)))",
)
def l2_normalize_(spark, sf_dir):
    scaled = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: 3 * x).alias("e"))
    return scaled.select("vec_id", F.round(norm(F.col("e")), 6).alias("norm_before"), F.round(norm(l2_normalize(F.col("e"))), 6).alias("norm_after"))


@query("dot_product", "SELECT a.vec_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot FROM embeddings a, embeddings b WHERE b.vec_id = 1")
def dot_product(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    other = F.broadcast(vectors.where("vec_id = 1").select(F.col("embedding").alias("other")))
    return vectors.crossJoin(other).select("vec_id", F.round(dot(F.col("embedding"), F.col("other")), 6).alias("dot"))


@query("dense_topk", f"WITH one AS (SELECT 1){dense_sql(10)} SELECT rank, id, score FROM dense")
def dense_topk(spark, sf_dir):
    return dense.topk(table(spark, sf_dir, "embeddings"), one_query(spark, sf_dir), 10).drop("query_id")


@query(
    "dense_topk_batch",
    "SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id::VARCHAR AS id, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 10",
)
def dense_topk_batch(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return dense.topk_batch(vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 10)


@query("rrf_fuse", f"WITH {scored_sql(ONE)}{dense_sql(30)}{lexical_sql(30)}{fuse_sql(10)} SELECT rank, id, score FROM fused")
def rrf_fuse(spark, sf_dir):
    asked = one_query(spark, sf_dir)
    found = dense.topk(table(spark, sf_dir, "embeddings"), asked, 30), lexical.search(table(spark, sf_dir, "documents"), asked, 30)
    return fusion.rrf(*found, 10, 2.0).drop("query_id")


@query("pin_and_fuse", f"WITH {scored_sql(ONE)}{dense_sql(30)}{lexical_sql(30)}{pinned_sql(10)} SELECT rank, id, score FROM hits")
def pin_and_fuse(spark, sf_dir):
    asked = one_query(spark, sf_dir)
    search = lexical.Search(table(spark, sf_dir, "documents"), asked)
    found = dense.topk(table(spark, sf_dir, "embeddings"), asked, 30), search.top(30)
    return fusion.pin_and_fuse(*[fusion.held(hits) for hits in (*found, search.pins())], 10, 2.0).drop("query_id")


@query("near_dup_filter", f"{WITH} one AS (SELECT 1){dense_sql(32)}{greedy_sql('dense', 5, 0.2)} SELECT rank, id, score FROM kept")
def near_dup_filter(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return fusion.suppress_near_duplicates(dense.topk(vectors, one_query(spark, sf_dir), 32), vectors, 5, 0.2).drop("query_id")


@query("near_dup_disabled", f"WITH one AS (SELECT 1){dense_sql(32)} SELECT t AS threshold, rank, id, score FROM dense, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) v(t) WHERE rank <= 5")
def near_dup_disabled(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    hits = dense.topk(vectors, one_query(spark, sf_dir), 32)
    runs = [fusion.suppress_near_duplicates(hits, vectors, 5, t).select(F.lit(t).alias("threshold"), "rank", "id", "score") for t in (0.0, 1.0)]
    return runs[0].unionByName(runs[1])


@query("enrich", f"WITH one AS (SELECT 1){dense_sql(20)} SELECT rank, id, score, lang, source FROM dense JOIN documents ON doc_id::VARCHAR = id")
def enrich(spark, sf_dir):
    hits = dense.topk(table(spark, sf_dir, "embeddings"), one_query(spark, sf_dir), 20)
    return fusion.enrich(hits, table(spark, sf_dir, "documents"), ["lang", "source"]).drop("query_id")


SNIPPET = r"""CASE WHEN coalesce(length({t}), 0) = 0 THEN '' WHEN length({t}) <= 600 THEN {t}
  WHEN length(regexp_extract(substr({t}, 1, 600), '(?s)^(.*[.!?] )', 1)) - 2 >= 300 THEN regexp_replace(substr({t}, 1, length(regexp_extract(substr({t}, 1, 600), '(?s)^(.*[.!?] )', 1)) - 1), '[\s\p{{Z}}]+$', '') || '…'
  WHEN length(regexp_extract(substr({t}, 1, 600), '(?s)^(.*\n)', 1)) - 1 >= 300 THEN regexp_replace(substr({t}, 1, length(regexp_extract(substr({t}, 1, 600), '(?s)^(.*\n)', 1)) - 1), '[\s\p{{Z}}]+$', '') || '…'
  WHEN length(regexp_extract(substr({t}, 1, 600), '(?s)^(.* )', 1)) - 1 >= 300 THEN regexp_replace(substr({t}, 1, length(regexp_extract(substr({t}, 1, 600), '(?s)^(.* )', 1)) - 1), '[\s\p{{Z}}]+$', '') || '…'
  ELSE substr({t}, 1, 600) || '…' END"""


@query(
    "hybrid_search",
    f"{WITH} {scored_sql(ONE)}{dense_sql(32)}{lexical_sql(32)}{pinned_sql(32)}{greedy_sql('hits', 5, 0.95)} SELECT rank, id, score, {SNIPPET.format(t='d.text')} AS snippet FROM kept JOIN documents d ON d.doc_id::VARCHAR = id",
)
def hybrid_search(spark, sf_dir):
    return hybrid.hybrid_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), one_query(spark, sf_dir)).drop("query_id")
