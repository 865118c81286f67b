import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvine.operators import chunking as c


def naive_merge(segments, size, overlap):
    out, cur = [], ""
    for s in segments:
        if len(cur) + len(s) > size and cur:
            out.append(cur.rstrip())
            cur = (cur[len(cur) - overlap :] if overlap and len(cur) > overlap else "") + s
        else:
            cur = cur + s
    if cur:
        out.append(cur.rstrip())
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab .\n", max_size=12), max_size=20), st.integers(1, 30), st.integers(0, 29))
def test_merge_matches_a_naive_loop(segments, size, overlap):
    assert c.merge_overlap(segments, size, overlap) == naive_merge(segments, size, min(overlap, size - 1))


@settings(max_examples=60, deadline=None)
@given(st.text("ab .!?\n", max_size=80))
def test_sentences_lose_nothing(text):
    assert "".join(c.sentences(text)) == text


def test_sentences_cut_and_words_pack():
    assert list(c.sentences("One. Two!\nThree\nfour")) == ["One. ", "Two!\n", "", "Three\n", "four"]
    assert c.packed_words("aa bb cccccccc d", 5) == ["aa bb", "cccccccc", "d"]
    assert c.chunk_sentences("short", 10, 0) == ["short"]
    assert all(len(x) <= 45 for x in c.chunk_sentences("word " * 100, 30, 10))


def test_code_lines_are_numbered_and_partial_lines_dropped():
    chunks = c.chunk_code_lines("\n".join(f"line {i} = {i}" for i in range(12)), 60, 10)
    assert chunks[0].startswith("1|line 0") and all(x[0].isdigit() for x in chunks)


def test_braces_in_strings_comments_and_templates():
    assert len(c.chunk_braces("function a() { return 1; }\nfunction b() { return 2; }")) == 2
    assert len(c.chunk_braces("function a() { return '}'; }\nfunction b() { return \"{\"; }")) == 2
    assert len(c.chunk_braces("const a = () => { return `${x ? '}' : `{${y}`} end}`; }\nfunction b() {} // }")) == 3
    assert c.chunk_braces("  \n ") == []
    assert c.chunk_braces("function a() { never closed") == ["function a() { never closed"]


def test_members_of_a_class():
    code = 'namespace A.B;\nusing System;\npublic class T {\n  private int x = 3, y;\n  public T() { }\n  public string N { get; set; } = "}";\n  int F(int a) => a + 1;\n  void G() { if (true) { } }\n  class Inner { void H() { } }\n}\nenum E { A, B }'
    heads = [x.split("\n")[0] for x in c.chunk_members(code)]
    assert heads == ["// A.B.T.Inner.H", "// A.B.T.x", "// A.B.T.T", "// A.B.T.N", "// A.B.T.F", "// A.B.T.G", "// A.B.E"]
    assert c.chunk_members("class Empty { }") == ["// Empty\nclass Empty { }"]
    assert c.chunk_members("not code at all") == ["not code at all"] and c.chunk_members("class Broken { void M() {")


def test_route_and_table(spark):
    rows = [(0, "class A { void M() { } void N() { } }", "csharp", True), (1, "x = 1", "python", True), (2, "Prose. More.", None, False), (3, None, None, False), (4, "", None, False)]
    df = spark.createDataFrame(rows, "doc_ord long, content string, language string, is_code boolean")
    got = sorted((r.doc_ord, r.chunk_ord, r.text) for r in c.chunk_documents(df).collect())
    assert [g[:2] for g in got] == [(0, 0), (0, 1), (1, 0), (2, 0), (4, 0)] and got[2][2] == "1|x = 1"


def test_null_keys_stand_beside_large_ones(spark):
    rows = [(None, "Some words to cut. More words."), (9007199254740993, "Some words to cut."), (1, None)]
    found = c.chunk_table(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), lambda t: t.split(". "))
    assert sorted((str(r.doc_id), r.chunk_ord, r.text) for r in found.collect()) == [("9007199254740993", 0, "Some words to cut."), ("None", 0, "Some words to cut"), ("None", 1, "More words.")]


def test_a_batch_of_long_texts_is_cut_before_python_holds_it(spark, monkeypatch):
    batch = c.pa.RecordBatch.from_arrays([c.pa.array(range(6)), c.pa.array(["x" * 50, "y" * 60, None, "", "z" * 500, "w"])], ["doc_id", "text"])
    monkeypatch.setattr(c, "SLICE_BYTES", 100)
    parts = list(c.cut_batch(batch, 1))
    assert c.pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and [len(p) for p in parts] == [1, 3, 1, 1]
