"""Registered queries over documents, pages, lines and paths, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.text import BINARY, LANGUAGES, PROSE, acceptable, extension, hidden, indexable, language, punctuation_ratio, snippet
from corvine.functions.vectors import mean_pool
from corvine.operators import chunking, pages, passages
from corvine.plans.registry import query
from corvine.plans.search_queries import SNIPPET, table
from corvine.sources.ignore import compile_rules, ignored

TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
RATIO = 0.20
IGNORE = ["# rules over url paths", "*.html", "!1*.html", "en/", "/fr/2*", "**/9?", "de/**"]


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page_no"), "text")


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[^:]*://[^/?#]*/([^?#]*)", 1).alias("path"))


PATHS = r"p AS (SELECT page_id, regexp_extract(url, '^[^:]*://[^/?#]*/([^?#]*)', 1) AS path FROM pages)"
EXT = r"lower(regexp_extract(path, '\.([^./]*)$', 1))"


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in sorted(values))


@query("snippet_truncate", f"SELECT doc_id, {SNIPPET.format(t='text')} AS snippet FROM documents")
def snippet_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", snippet(F.col("text")).alias("snippet"))


LINES = r"l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)"


@query(
    "quality_filter",
    rf"""WITH {LINES}, s AS (SELECT *, regexp_replace(line, '[\s\p{{Z}}]', '', 'g') AS solid FROM l)
    SELECT doc_id, line_no, round(ratio, 6) AS punct_ratio,
      length({TRIM.format('line')}) >= 20 AND ratio <= 0.70::DOUBLE AND NOT regexp_matches(line, '[A-Za-z0-9+/]{{200,}}') AND NOT regexp_matches(line, '_{{11,}}') AS keep
    FROM (SELECT *, CASE WHEN length(solid) = 0 THEN 0.0::DOUBLE ELSE (length(solid) - length(regexp_replace(solid, '[{{}}();,\[\]<>:.|&!?+\-*/=^%~@#$"''`\\]', '', 'g')))::DOUBLE / length(solid) END AS ratio FROM s)""",
)
def quality_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long"), F.round(punctuation_ratio(F.col("line")), 6).alias("punct_ratio"), acceptable(F.col("line")).alias("keep"))


@query("code_line_numbering", f"WITH {LINES} SELECT doc_id, line_no + 1 AS line_no, lpad((line_no + 1)::VARCHAR, length(n::VARCHAR)::INT, ' ') || '|' || line AS numbered FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM l)")
def code_line_numbering(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(passages.numbered_lines(F.col("text"))).alias("x"))
    return found.select("doc_id", F.col("x.line_no").cast("long").alias("line_no"), "x.numbered")


PAGES = "pg AS (SELECT source AS doc, doc_id AS page_no, text FROM documents)"
BOILER = (
    PAGES
    + f""", pl AS (SELECT DISTINCT doc, page_no, line FROM (SELECT doc, page_no, {TRIM.format('unnest(string_split(text, chr(10)))')} AS line FROM pg) WHERE line <> '' AND length(line) < 120),
np AS (SELECT doc, count(*) AS n FROM pg GROUP BY doc),
bp AS (SELECT pl.doc, line, count(*) AS pages FROM pl JOIN np ON np.doc = pl.doc GROUP BY pl.doc, line HAVING count(*) >= greatest(2, ceil(any_value(n) * {RATIO}::DOUBLE - 1e-9::DOUBLE)))"""
)


@query("boilerplate_lines", f"WITH {BOILER} SELECT doc, line, pages FROM bp")
def boilerplate_lines(spark, sf_dir):
    return pages.boilerplate_lines(by_source(spark, sf_dir), RATIO)


@query(
    "strip_boilerplate",
    f"""WITH {BOILER}, e AS (SELECT doc, page_no, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM pg),
    k AS (SELECT e.doc, e.page_no, string_agg(e.line, chr(10) ORDER BY i) AS body FROM e LEFT JOIN bp ON bp.doc = e.doc AND bp.line = {TRIM.format('e.line')} WHERE bp.line IS NULL GROUP BY e.doc, e.page_no)
    SELECT pg.doc, pg.page_no, CASE WHEN EXISTS (SELECT 1 FROM bp WHERE bp.doc = pg.doc) THEN {TRIM.format("coalesce(k.body, '')")} ELSE pg.text END AS text FROM pg LEFT JOIN k ON k.doc = pg.doc AND k.page_no = pg.page_no""",
)
def strip_boilerplate(spark, sf_dir):
    return pages.strip_boilerplate(by_source(spark, sf_dir), RATIO)


FOUND = (
    PAGES
    + f""", f AS (SELECT doc, page_no, text, row_number() OVER (PARTITION BY doc ORDER BY page_no) - 1 AS i, count(*) OVER (PARTITION BY doc) AS total,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: {TRIM.format('x')}), lambda x: x <> '') AS ls FROM pg),
m AS (SELECT *, len(ls)::INT AS n_lines, CASE WHEN len(ls) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(ls, lambda x: length(x) <= 80 AND NOT regexp_matches(x, '[.!?]$')))::DOUBLE / len(ls) END AS heading_ratio,
  CASE WHEN len(ls) = 0 THEN 0.0::DOUBLE ELSE list_sum(list_transform(ls, lambda x: length(x)))::DOUBLE / len(ls) END AS avg_len FROM f)"""
)


@query("toc_pages", f"WITH {FOUND} SELECT doc, page_no, n_lines, round(heading_ratio, 6) AS heading_ratio, i < greatest(1, ceil(total * 0.15::DOUBLE - 1e-9::DOUBLE)) AND n_lines >= 8 AND heading_ratio >= 0.8::DOUBLE AS is_toc FROM m")
def toc_pages(spark, sf_dir):
    return pages.toc_pages(by_source(spark, sf_dir)).select("doc", "page_no", "n_lines", F.round("heading_ratio", 6).alias("heading_ratio"), "is_toc")


@query(
    "title_pages",
    f"WITH {FOUND} SELECT doc, page_no, n_lines, round(avg_len, 6) AS avg_len, i = 0 AND (contains(lower(text), 'downloaded by ') OR (n_lines BETWEEN 1 AND 9 AND avg_len < 50 AND len(list_filter(ls, lambda x: regexp_matches(x, '[.!?]$'))) = 0)) AS is_title FROM m",
)
def title_pages(spark, sf_dir):
    return pages.title_pages(by_source(spark, sf_dir)).select("doc", "page_no", "n_lines", F.round("avg_len", 6).alias("avg_len"), "is_title")


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of their brand, ten a page."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.floor(F.col("p_partkey") / 10).cast("int").alias("page_no"), F.col("p_partkey").alias("line_no"), F.col("p_name").alias("text"), F.col("p_size").cast("double").alias("font_size"))


HEADS = "h AS (SELECT p.*, m.median, p_size >= m.median * 1.3::DOUBLE AND trim(p_name) <> '' AS is_heading FROM part p JOIN (SELECT p_brand, quantile_cont(p_size::DOUBLE, 0.5) AS median FROM part WHERE p_size > 0 AND trim(p_name) <> '' GROUP BY p_brand) m ON m.p_brand = p.p_brand)"


@query("detect_headings", f"WITH {HEADS} SELECT p_partkey, round(median, 6) AS median, is_heading FROM h")
def detect_headings(spark, sf_dir):
    return pages.detect_headings(part_lines(spark, sf_dir)).select(F.col("line_no").alias("p_partkey"), F.round("median", 6).alias("median"), "is_heading")


@query("page_heading", f"WITH {HEADS} SELECT p_brand AS doc, (p_partkey // 10)::INT AS page_no, arg_min(trim(p_name), p_partkey) AS heading FROM h WHERE is_heading GROUP BY ALL")
def page_heading(spark, sf_dir):
    return pages.page_heading(part_lines(spark, sf_dir))


@query("page_marker_join", "SELECT conv_id, string_agg('--- Page ' || turn || ' ---' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id")
def page_marker_join(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page_no"), "text")
    return pages.page_marker_join(turns).withColumnRenamed("doc", "conv_id")


GLYPHS = """(1, 0.0, 5.0, 700.4, 10.0, 'H'), (1, 5.2, 9.0, 699.8, 10.0, 'i'), (1, 14.0, 19.0, 700.0, 12.0, 'y'), (1, 19.0, 24.0, 700.2, 12.0, 'o'), (1, 0.0, 4.0, 650.5, 0.0, 'z'),
(1, 4.0, 8.0, 650.4, 9.0, ' '), (1, 20.0, 24.0, 650.1, 9.0, 'w'), (2, 3.0, 6.0, 10.0, 8.0, 'b'), (2, 0.0, 2.9, 10.0, 8.0, 'a'), (2, 0.0, 3.0, 5.0, 8.0, ' ')"""


@query(
    "pdf_line_reconstruct",
    f"""WITH g(page_no, x0, x1, y, font, v) AS (SELECT col0, col1::DOUBLE, col2::DOUBLE, col3::DOUBLE, col4::DOUBLE, col5 FROM (VALUES {GLYPHS})),
    r AS (SELECT *, round_even(y, 0)::INT AS row FROM g),
    s AS (SELECT *, CASE WHEN x0 - lag(x1) OVER w > 0.25::DOUBLE * font AND NOT ends_with(lag(v) OVER w, ' ') THEN ' ' || v ELSE v END AS piece FROM r WINDOW w AS (PARTITION BY page_no, row ORDER BY x0, x1)),
    t AS (SELECT page_no, row, {TRIM.format("string_agg(piece, '' ORDER BY x0, x1)")} AS text, coalesce(quantile_cont(font, 0.5) FILTER (font > 0), 0.0::DOUBLE) AS font_size FROM s GROUP BY page_no, row)
    SELECT page_no::INT AS page_no, (row_number() OVER (PARTITION BY page_no ORDER BY row DESC))::INT AS line_no, text, font_size FROM t WHERE text <> ''""",
)
def pdf_line_reconstruct(spark, sf_dir):
    glyphs = spark.sql(f"SELECT 0 AS doc, page_no, CAST(x0 AS DOUBLE) AS x_start, CAST(x1 AS DOUBLE) AS x_end, CAST(y AS DOUBLE) AS y, CAST(font AS DOUBLE) AS font_size, v AS value FROM VALUES {GLYPHS} AS g(page_no, x0, x1, y, font, v)")
    return pages.reconstruct_lines(glyphs).drop("doc")


@query("ext_filter", f"WITH {PATHS} SELECT page_id, path, {EXT} NOT IN ({listed(BINARY)}) AND {EXT} IN ({listed({*LANGUAGES, *PROSE})}) AS keep FROM p")
def ext_filter(spark, sf_dir):
    return url_paths(spark, sf_dir).select("page_id", "path", indexable(F.col("path")).alias("keep"))


@query("hidden_filter", f"WITH {PATHS} SELECT page_id, path, regexp_matches(path, '(^|/)\\.') AS hidden FROM p")
def hidden_filter(spark, sf_dir):
    return url_paths(spark, sf_dir).select("page_id", "path", hidden(F.col("path")).alias("hidden"))


@query("language_of", f"WITH {PATHS}, m(ext, language) AS (VALUES {', '.join(f'({k!r}, {v!r})' for k, v in sorted(LANGUAGES.items()))}) SELECT page_id, e AS ext, m.language, m.language IS NOT NULL AS is_code FROM (SELECT page_id, regexp_extract(path, '([a-z]+)', 1) AS e FROM p) LEFT JOIN m ON m.ext = e")
def language_of(spark, sf_dir):
    ext = url_paths(spark, sf_dir).select("page_id", F.regexp_extract("path", "([a-z]+)", 1).alias("ext"))
    found = language(F.concat(F.lit("x."), F.col("ext")))
    return ext.select("page_id", "ext", found.alias("language"), found.isNotNull().alias("is_code"))


def ignore_sql() -> str:
    def decide(part: str, directory: bool) -> str:
        answer = "false"
        for rule in compile_rules(IGNORE):
            if directory or not rule.directory_only:
                answer = f"CASE WHEN regexp_matches({part}, '{rule.regex}') THEN {str(not rule.keep).lower()} ELSE {answer} END"
        return answer

    above = "list_transform(range(1, len(string_split(path, '/'))), lambda n: array_to_string(list_slice(string_split(path, '/'), 1, n), '/'))"
    return f"WITH {PATHS} SELECT page_id, path, len(list_filter({above}, lambda d: {decide('d', True)})) > 0 OR {decide('path', False)} AS ignored FROM p"


@query("gitignore_filter", ignore_sql())
def gitignore_filter(spark, sf_dir):
    return url_paths(spark, sf_dir).select("page_id", "path", ignored(F.col("path"), compile_rules(IGNORE)).alias("ignored"))


@query("assign_passage_ids", f"WITH {LINES} SELECT (row_number() OVER (ORDER BY doc_id, line_no) - 1)::VARCHAR AS id, doc_id, line_no FROM l WHERE trim(line) <> ''")
def assign_passage_ids(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where("trim(line) <> ''")
    return passages.assign_ids(lines.drop("line"), "doc_id", "line_no").select("id", "doc_id", F.col("line_no").cast("long"))


@query("metadata_build", "SELECT o_orderkey, 'o/' || o_orderkey AS file_path, o_orderkey::VARCHAR AS file_name, 'o/' || o_orderkey AS source, 'text' AS source_type, strftime(o_orderdate, '%Y-%m-%d') AS creation_date, NULL::VARCHAR AS last_modified_date FROM orders")
def metadata_build(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    made = passages.metadata(F.concat(F.lit("o/"), key), key, F.lit("text"), F.col("o_orderdate"), F.lit(None).cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("m")).select("o_orderkey", "m.*")


@query("length_sorted_batches", "SELECT doc_id, (row_number() OVER (ORDER BY length(text), doc_id) - 1) // 32 AS batch_no FROM documents")
def length_sorted_batches(spark, sf_dir):
    return passages.length_batches(table(spark, sf_dir, "documents")).select("doc_id", "batch_no")


@query("integrity_counts", "SELECT (SELECT count(*) FROM documents) AS passages, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64) AS wrong_dimensions")
def integrity_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("passages"))
    vectors = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors"), F.count(F.when(F.size("embedding") != 64, 1)).alias("wrong_dimensions"))
    return docs.crossJoin(vectors)


@query("duplicate_ids", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return passages.duplicate_ids(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("missing_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_ids(spark, sf_dir):
    return passages.missing_ids(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), "doc_id", "vec_id")


@query("detect_change", "SELECT doc_id, CASE WHEN source = (SELECT min(source) FROM documents) THEN 'removed' WHEN lang = 'de' THEN 'changed' END AS status FROM documents WHERE source = (SELECT min(source) FROM documents) OR lang = 'de'")
def detect_change(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = docs.agg(F.min("source").alias("gone"))
    after = docs.join(F.broadcast(first), F.col("source") == F.col("gone"), "left_anti").withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return passages.changes(docs, after)


@query("mean_pool", "SELECT vec_id, round((embedding[1]::DOUBLE + 2 * embedding[2]::DOUBLE) / 2, 6) AS pooled FROM embeddings")
def mean_pool_(spark, sf_dir):
    v = F.col("embedding")
    states = F.array(F.slice(v, 1, 1), F.slice(v, 3, 1), F.transform(F.slice(v, 2, 1), lambda x: x * 2))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.element_at(mean_pool(states, F.array(F.lit(1), F.lit(0), F.lit(1))), 1), 6).alias("pooled"))


@query("chunk_sentences")
def chunk_sentences(spark, sf_dir):
    return chunking.chunk_table(table(spark, sf_dir, "documents"), chunking.chunk_sentences)


@query("merge_overlap")
def merge_overlap(spark, sf_dir):
    return chunking.chunk_table(table(spark, sf_dir, "documents"), lambda t: chunking.merge_overlap(t.split("\n"), 512, 64))


@query("chunk_code_lines")
def chunk_code_lines(spark, sf_dir):
    return chunking.chunk_table(table(spark, sf_dir, "documents"), chunking.chunk_code_lines)


@query("chunk_braces")
def chunk_braces(spark, sf_dir):
    return chunking.chunk_table(table(spark, sf_dir, "pages"), chunking.chunk_braces, ("page_id",), "html")


@query("chunk_members")
def chunk_members(spark, sf_dir):
    named = table(spark, sf_dir, "part").select("p_partkey", F.format_string("namespace Shop;\nclass Part%d {\n  int size = %d;\n  string Name() { return \"%s\"; }\n}", "p_partkey", "p_size", "p_name").alias("text"))
    return chunking.chunk_table(named, chunking.chunk_members, ("p_partkey",))


@query("chunk_route")
def chunk_route(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_ord"), F.col("text").alias("content"), F.when(F.col("lang") == "en", "java").when(F.col("lang") == "de", "python").alias("language"), F.col("lang").isin("en", "de").alias("is_code"))
    return chunking.chunk_documents(docs)


@query("chunk_pdf_pages")
def chunk_pdf_pages(spark, sf_dir):
    return pages.chunk_pages(by_source(spark, sf_dir), ratio=RATIO)


@query("embed_hashing")
def embed_hashing(spark, sf_dir):
    return passages.embed_texts(table(spark, sf_dir, "documents"), passages.hashing_embedder(), "doc_id")
