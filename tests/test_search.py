import os

import pytest

import __spark_entry__ as entry
from corvine.functions.text import acceptable, snippet
from corvine.functions.tokens import identifier_tokens
from corvine.operators import dense, fusion, lexical, passages
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def tokens(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(identifier_tokens(F.col("t")).alias("x")).first()
    return [(t.term, t.is_whole_identifier) for t in row.x]


def test_tokens(spark):
    assert tokens(spark, "parseHTTPResponse plain") == [("parsehttpresponse", True), ("parse", False), ("http", False), ("response", False), ("plain", False)]
    assert tokens(spark, "snake_case a.b-cc getX") == [("snake_case", True), ("snake", False), ("case", False), ("a.b-cc", True), ("cc", False), ("getx", True), ("get", False)]
    assert tokens(spark, "cache. --force x") == [("cache.", True), ("cache", False), ("--force", True), ("force", False)]
    assert tokens(spark, None) == tokens(spark, "  ") == []


def search(spark, docs, query, k=10):
    d = spark.createDataFrame(list(docs.items()), "doc_id string, text string")
    q = spark.createDataFrame([(0, query)], "query_id long, query string")
    return [r.id for r in lexical.search(d, q, k).orderBy("rank").collect()], [r.id for r in lexical.pins(lexical.scored(d, q)).collect()]


def test_bm25_and_pins(spark):
    assert search(spark, {"a": "fox " * 5, "b": "fox and hound", "c": "nothing"}, "fox")[0] == ["a", "b"]
    docs = {"target": "call StartEngineNow here", **{f"n{i}": "start the engine now" for i in range(4)}}
    assert search(spark, docs, "StartEngineNow") == (["target", "n0", "n1", "n2", "n3"], ["target"])
    assert search(spark, {f"d{i}": "StartEngineNow" for i in range(6)}, "StartEngineNow")[1] == []
    assert search(spark, docs, "   ") == ([], [])


def test_fusion(spark):
    ranked = lambda ids: spark.createDataFrame([(0, i + 1, x, 1.0) for i, x in enumerate(ids)], "query_id long, rank int, id string, score double")
    fused = fusion.rrf(ranked("ab"), ranked("bc"), 5).orderBy("rank").collect()
    assert [r.id for r in fused] == ["b", "a", "c"] and fused[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-6)
    pins = spark.createDataFrame([(0, "z")], "query_id long, id string")
    assert [r.id for r in fusion.pin_and_fuse(ranked("ab"), ranked("bz"), pins, 3).orderBy("rank").collect()] == ["z", "b", "a"]
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.01]), ("c", [0.0, 1.0])], "vec_id string, embedding array<double>")
    kept = lambda k, t: [r.id for r in fusion.suppress_near_duplicates(ranked("abxc"), vectors, k, t).orderBy("rank").collect()]
    assert kept(5, 0.95) == ["a", "x", "c"] and kept(2, 0.95) == ["a", "x"] and kept(5, 0.0) == kept(5, 1.0) == list("abxc") and kept(0, 0.95) == []
    assert fusion.fetch_depth(5) == 32 and fusion.fetch_depth(20) == 60 and fusion.fetch_depth(0) == 0 and fusion.fetch_depth(5, 9, 0) == 9


def test_snippet_and_quality(spark):
    cut = lambda t, n: spark.range(1).select(snippet(F.lit(t), n)).first()[0]
    assert cut("short", 10) == "short" and cut("aaaa bbb. cccc dddd", 12) == "aaaa bbb.…" and cut("a. bcdefghij", 8) == "a. bcdef…" and cut("abcdefghij", 4) == "abcd…"
    rows = spark.createDataFrame([(t,) for t in ["}\n  }\n}", "A" * 500, "=" * 400, "a sentence of 21 chars", None, "_" * 11 + " and some more text"]], "t string")
    assert [r[0] for r in rows.select(acceptable(F.col("t"))).collect()] == [False, False, False, True, False, False]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_every_search_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from corvine.plans import registry

    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    flat = lambda columns, rows: sorted(repr([x for _, x in sorted(zip(columns, row))]) for row in rows)
    for name in ("hybrid_search", "pin_and_fuse", "dense_topk_batch", "strip_boilerplate", "gitignore_filter", "assign_passage_ids", "code_line_numbering", "pdf_line_reconstruct"):
        got, want = registry.QUERIES[name](spark, SMALL), con.execute(registry.ORACLES[name])
        columns = [d[0] for d in want.description]
        assert flat(got.columns, map(tuple, got.collect())) == flat(columns, want.fetchall()), name
    assert entry.entry(spark).columns


def test_dense_batch_takes_any_number_of_queries(spark, monkeypatch):
    monkeypatch.setattr(dense, "MAX_BATCH_QUERIES", 3)
    rows = [(i, [float(i % 5 + 1), float(i % 7), float(i % 3)]) for i in range(20)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame(rows[:8], "query_id long, vector array<double>")
    one, many = (sorted((r.query_id, r["rank"], str(r.id)) for r in found.collect()) for found in (dense.topk(vectors, queries, 4), dense.topk_batch(vectors, queries, 4)))
    assert one == many and len(many) == 32
    assert dense.topk_batch(vectors, queries.limit(0), 4).count() == 0


def test_stored_index_scores_like_a_scan(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"StartEngineNow word{i % 3} " * (i % 4) + "common tail") for i in range(20)] + [("none", None), ("blank", "")], "doc_id string, text string")
    asked = spark.createDataFrame([(0, "StartEngineNow tail"), (1, "word2"), (2, "absent"), (3, "")], "query_id long, query string")
    lexical.write_index(docs, str(tmp_path / "index"))
    rows = lambda found: sorted((r.query_id, r.doc, round(r.score, 9), r.pinnable) for r in found.collect())
    want = rows(lexical.scored(docs, asked))
    assert want and rows(lexical.scored_by_index(spark, str(tmp_path / "index"), asked)) == want


def test_numbers_stay_even_beside_outliers(spark):
    df = spark.range(3000).select((F.col("id") % 700).alias("n")).unionAll(spark.range(1).select(F.lit(10**15).alias("n")))
    found = passages.numbered(df.withColumn("tie", F.monotonically_increasing_id()), "n", "tie").orderBy("id").collect()
    assert [r.id for r in found] == list(range(3001)) and [r.n for r in found] == sorted(r.n for r in found)
    assert passages.numbered(df.limit(0), "n").count() == 0


def test_terms_are_the_identifier_tokens(spark):
    from corvine.functions.tokens import terms, whole_identifiers

    for text in ("parseHTTPResponse plain a.b-cc parse", "snake_case ΟΔΟΣ'Α x -- cache. Plain", "", None):
        want = tokens(spark, text)
        row = spark.createDataFrame([(text,)], "t string").select(terms(F.col("t")).alias("bare"), terms(F.col("t"), " ").alias("marked"), whole_identifiers(F.col("t")).alias("n")).first()
        assert sorted(row.bare) == sorted(t for t, _ in want) and sorted(row.marked) == sorted(" " * flag + t for t, flag in want) and row.n == sum(flag for _, flag in want)


def test_search_scores_in_slices_without_a_shuffle_of_tokens(spark, monkeypatch):
    rows = [(f"d{i}", f"StartEngineNow{i // 3} word{i % 3} " * (i % 4) + "common tail") for i in range(40)] + [("blank", ""), ("none", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").coalesce(2)
    asked = spark.createDataFrame([(7, "StartEngineNow1 tail"), (8, "word2 common"), (9, "absent"), (10, ""), (11, "StartEngineNow2 StartEngineNow3")], "query_id long, query string")
    scores = lexical.scored(docs, asked)
    flat = lambda found: sorted(map(tuple, found.collect()))
    monkeypatch.setattr(lexical, "MAX_BATCH_QUERIES", 2)
    made = lexical.Search(docs, asked)
    assert flat(made.top(3)) == flat(lexical.ranked(scores, 3)) and flat(made.pins()) == flat(lexical.pins(scores))
    assert len(flat(made.pins())) == 2
    plan = made.top(3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning(doc" not in plan and "hashpartitioning(term" not in plan


def test_repeated_and_null_ids_are_counted_as_one_document(spark):
    docs = spark.createDataFrame([(1, "fox fox hen"), (1, "fox"), (None, "fox hen"), (2, "hen")], "doc_id long, text string")
    found = sorted(map(str, lexical.postings(lexical.tokenized(docs)).collect()))
    assert found == sorted(map(str, docs.select(F.col("doc_id").alias("doc"), F.explode(F.split("text", " ")).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf")).collect()))
    asked = spark.createDataFrame([(0, "fox")], "query_id long, query string")
    assert sorted(map(str, lexical.search(docs, asked).collect())) == sorted(map(str, lexical.ranked(lexical.scored(docs, asked), 10).collect()))
