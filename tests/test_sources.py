import json

import pytest

from corvine import cli
from corvine.operators import passages as ops
from corvine.sources import files, index_store as store
from corvine.sources.ignore import compile_rules, is_ignored
from corvine.streaming import watch


def tree(root, **found):
    for path, text in found.items():
        at = root / path.replace("__s__", "/").replace("__d__", ".")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def test_ignore_rules():
    rules = compile_rules(["*.log", "!keep.log", "build/", "/only.txt", "a/**/b", "**/T/**"]) + compile_rules(["gen", "x/y.cs"], "src")
    ignored = lambda path, d=False: is_ignored(path, d, rules)
    assert ignored("a.log") and ignored("d/a.log") and not ignored("d/keep.log")
    assert ignored("build", True) and not ignored("build") and ignored("d/build", True)
    assert ignored("only.txt") and not ignored("d/only.txt")
    assert ignored("a/b") and ignored("a/c/d/b") and not ignored("T", True) and ignored("q/T/z")
    assert ignored("src/gen", True) and ignored("src/q/gen") and not ignored("gen") and ignored("src/x/y.cs") and not ignored("x/y.cs")
    assert not ignored("a/[b]") and compile_rules(["", "# no"]) == []


def test_walk_prunes_and_reads(spark, tmp_path):
    tree(tmp_path, a__d__py="print(1)", __init____d__py="", b__d__png="no", __d__hid__d__py="h", src__s____d__gitignore="gen/\n", src__s__gen__s__x__d__py="x", src__s__k__d__cs="class K { void M() { } }", gen__s__y__d__py="y", odd__d__xyz="?")
    got = list(files.walk(str(tmp_path)))
    assert got == ["__init__.py", "a.py", "gen/y.py", "src/k.cs"]
    assert ".hid.py" in list(files.walk(str(tmp_path), hidden=True)) and list(files.walk(str(tmp_path), {".CS"})) == ["src/k.cs"]
    assert list(files.walk(str(tmp_path), excludes=("gen/",))) == ["__init__.py", "a.py", "src/k.cs"]
    with pytest.raises(FileNotFoundError):
        list(files.walk(str(tmp_path / "none")))
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    rows = {r.file_path: r for r in files.read_text(files.scan_files(spark, [str(tmp_path)])).collect()}
    assert "bad.txt" not in rows and rows["src/k.cs"].language == "csharp" and rows["a.py"].is_code


def test_build_search_and_flat_files(spark, tmp_path):
    docs, root = tmp_path / "docs", str(tmp_path / "indexes")
    tree(docs, one__d__md="The harbour is quiet in the morning and the boats are all asleep. " * 3, two__d__cs="namespace N; class Engine { int StartTurbineNow() { return 41 + 1; } int Stop() { return 0 - 1; } }", three__d__md="Mountains are covered with snow during the long winter months. " * 3)
    assert cli.main(["--root", root, "rebuild", "--docs", str(docs), "--index-name", "first"], spark) == "built"
    assert store.list_indexes(spark, root) == ["first"] and cli.main(["--root", root, "build-passages", "--docs", str(docs), "--index-name", "first"], spark) == "exists"
    report = cli.search(spark, root, "first", "where is StartTurbineNow", show_metadata=True)
    assert "1. Score:" in report and report.split("\n2. ")[0].count("StartTurbineNow") >= 2 and "Source: two.cs" in report
    assert cli.search(spark, root, "none", "x").startswith("Error:") and "first" in cli.warmup(spark, root)
    manifest, passages, vectors = store.load_index(spark, root, "first")
    store.export_flat(passages, vectors, str(tmp_path / "flat"))
    again, matrix = store.import_flat(spark, str(tmp_path / "flat"), 64)
    assert sorted((r.id, r.text) for r in again.select("id", "text").collect()) == sorted((r.id, r.text) for r in passages.select("id", "text").collect())
    assert sorted((r.id, r.embedding) for r in matrix.collect()) == sorted((r.id, r.embedding) for r in vectors.collect())
    with pytest.raises(ValueError):
        store.scan_matrix(spark, str(tmp_path / "flat" / "matrix.bin"), 1, 63)
    assert ops.check_integrity(passages, vectors, 64) == [] and len(ops.check_integrity(passages.limit(1), vectors.unionAll(vectors), 63)) >= 3
    with pytest.raises(ValueError):
        store.write_passages(spark, root, "x", passages, "no-such-model", [])


def test_jsonl_last_wins(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("﻿" + '{"id":"a","text":"1"}\n\n{"id":"b","text":"2"}\n{"id":"a","text":"3"}\n{"text":"no id"}\n', encoding="utf-8")
    assert [(r.id, r.text) for r in store.scan_jsonl(spark, str(tmp_path / "p.jsonl")).orderBy("position").collect()] == [("a", "3"), ("b", "2")]


def test_config_roots_and_arguments(tmp_path):
    (tmp_path / "c.json").write_text('{ // c\n "intervalSeconds": 5, "Repos": [{"folder": "http://x", "IndexName": "i",},], }')
    assert store.load_repo_config(str(tmp_path / "c.json"))["repos"][0] == {"folder": "http://x", "indexname": "i"}
    (tmp_path / "d.json").write_text('{"repos": []}')
    with pytest.raises(ValueError):
        store.load_repo_config(str(tmp_path / "d.json"))
    (tmp_path / "b" / ".corvine").mkdir(parents=True)
    assert cli.data_root(None, [str(tmp_path), str(tmp_path / "b")], "/w") == str(tmp_path / "b") and cli.data_root(None, [], "/w") == "/w" and cli.data_root("/e", ["/x"], "/w") == "/e"
    assert cli.with_force(["a"]) == ["a", "--force"] and cli.with_force(["--force"]) == ["--force"]
    assert cli.file_uri_to_path("file:///a%20b") == "/a b" and cli.file_uri_to_path("https://x/y") is None
    assert cli.model_path("org/m", home="/h") == "/h/.corvine/models/org-m"


def test_watching(spark, tmp_path):
    source = tmp_path / "in"
    seen = []
    schema = "doc_id long, text string"
    run = lambda: watch.watch_folder(spark, str(source), str(tmp_path / "state"), str(tmp_path / "check"), schema, lambda s, c: seen.append((sorted(map(tuple, s.collect())), sorted(map(tuple, c.collect()))))).awaitTermination()
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.mode("append").parquet(str(source))
    run()
    spark.createDataFrame([(2, "B"), (3, "c"), (1, None)], schema).coalesce(1).write.mode("append").parquet(str(source))
    run()
    assert seen[-1] == ([(2, "B"), (3, "c")], [(1, "removed"), (2, "changed"), (3, "added")])
    assert watch.needs_rebuild("a", "a", "a", True) and not watch.needs_rebuild("a", "a", "a", False) and watch.needs_rebuild("a", "b", "a", False)
    assert watch.sweep([{"indexname": "i", "folder": str(tmp_path / "nowhere")}, {"indexname": "j", "folder": "x", "enabled": False}], {}, lambda r: None).keys() == {"i"}


def test_numbering_and_embedding(spark):
    df = spark.createDataFrame([(i * 1_000_003 % 977, i) for i in range(500)], "doc_ord long, chunk_ord int")
    got = [(r.doc_ord, r.chunk_ord) for r in ops.assign_ids(df).orderBy(ops.F.col("id").cast("long")).collect()]
    assert got == sorted(got) and ops.assign_ids(df.limit(0)).count() == 0
    rows = spark.createDataFrame([("a", "some words"), ("b", ""), ("c", None)], "id string, text string")
    found = {r.id: r.embedding for r in ops.embed_texts(rows, ops.hashing_embedder(8)).collect()}
    assert abs(sum(x * x for x in found["a"]) - 1) < 1e-6 and set(found["b"]) == set(found["c"]) == {0.0}


def test_paged_files_and_repo_options(spark, tmp_path, monkeypatch):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "note.md").write_text("A first sentence that is long enough to pass. A second one follows it here.")
    (tmp_path / "docs" / "book.pdf").write_bytes(b"\xff\xfeThe first page tells of one thing at some length.|The second page tells of another thing at some length.")
    monkeypatch.setitem(files.PAGE_READERS, "pdf", lambda raw: raw[2:].decode().split("|"))
    assert cli.build_passages(spark, str(tmp_path / "root"), "mixed", [str(tmp_path / "docs")], "hashing-64")
    rows = spark.read.parquet(str(tmp_path / "root" / "mixed" / "passages")).collect()
    assert {(r.metadata.source_type, r.metadata.page_start) for r in rows} == {("text", None), ("pdf", 1), ("pdf", 2)} and len({r.id for r in rows}) == len(rows)
    options = watch.repo_options({"folder": "x", "codechunksize": 90, "codechunkoverlap": 0, "useast": False})["options"]
    assert (options.code_size, options.code_overlap, options.use_structure) == (90, 0, False) and watch.repo_options({"folder": "x"})["options"] == cli.Options()
