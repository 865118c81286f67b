"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvine.llm import bag_minhash, embedding_dups, fuzzy_lines, html_text, packing, token_file, toxicity, trie_bpe, url_filter, winnowing
from corvine.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: (verdict, host, path) of the url rules; a rule's key is its host and path together.
URL_RULES = [
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
]


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op2_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_replace(substr(url, instr(url, '://') + 3), '[?#](.|\n)*$', '') ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
    translate(CASE WHEN instr(rest, '/') > 0 THEN substr(rest, 1, instr(rest, '/') - 1) ELSE rest END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM cut)
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), ranked AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rule_host || r.rule_path) DESC) AS nth
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM ranked WHERE nth = 1
"""


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, packed into sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to plane-shuffled files and read back."""
    return token_file.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@query
def op7_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by trie traversal and decoded again."""
    return trie_bpe.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, with the classifier trained on the labelled rows that are not held out."""
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at cosine 0.9 and its component."""
    return embedding_dups.link_vectors(table(spark, sf_dir, "embeddings"), 0.9)


ORACLES["op8_embedding_dups"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL
), n AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b
    ON a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS k FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.k, 0) AS n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""


@query
def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document."""
    return winnowing.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class at weighted Jaccard 0.8 of five-word shingles."""
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents"), 0.8)


@query
def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat or nearly repeat an earlier one."""
    return fuzzy_lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), 0.8)
