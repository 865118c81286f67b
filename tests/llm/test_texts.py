"""Extraction, urls, token files, packing and encoding against brute force."""

import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corvine.llm import html_text, packing, token_file, trie_bpe, url_filter
from corvine.llm.encoding import encoder

TEXTS = [None, "", "Hello  world\n\n two\t tabs ", "naïve Ünïcode ΣΑΣ İstanbul e\u0301", "<|endoftext|> inside <|startoftext|>", "😀 emoji 1234567 don't you'll", "x" * 3000, "word " * 5000, "Hello  world\n\n two\t tabs ", " lead", "trail \n", "\u00a0nbsp\u2003em", "3.14, e.g. foo_bar"]


def frame(spark, texts=TEXTS):
    rows = [(i, t, "a", "b") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string, start string")


def library(name, text):
    tool = Tokenizer.from_file(public_tokenizers.path(name))
    tool.no_padding()
    tool.no_truncation()
    ids = tool.encode(text or "", add_special_tokens=False).ids
    return ids, tool.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_piece_encoder_equals_the_library(name):
    tool = encoder(public_tokenizers.path(name))
    for text in TEXTS:
        assert tool.encode(text).tolist() == library(name, text)[0], text


def test_trie_encoder_equals_the_library(spark):
    got = {r.doc_id: r for r in trie_bpe.encode_texts(frame(spark), public_tokenizers.path("word_bpe_49k.json"), full=True).collect()}
    for i, text in enumerate(TEXTS):
        ids, decoded = library("word_bpe_49k.json", text)
        assert got[i].ids == ids and got[i].decoded == decoded and got[i].n_tokens == len(ids)
    assert trie_bpe.encode_texts(frame(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files_round_trip(spark, planes):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_file.round_trip(frame(spark), public_tokenizers.path("byte_bpe_50k.json"), planes=planes).collect())
    start, want = 0, []
    for i, text in enumerate(TEXTS):
        ids = [*library("byte_bpe_50k.json", text)[0], 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert token_file.round_trip(frame(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_fullest_is_the_best_subset():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths, room = rng.integers(1, 30, 9).tolist(), int(rng.integers(1, 80))
        counts = {x: lengths.count(x) for x in lengths}
        best = max(sum(c) for n in range(10) for c in combinations(lengths, n) if sum(c) <= room)
        found = packing.fullest(counts, room)
        assert sum(found) == best and all(found.count(x) <= counts[x] for x in found)


def test_packing_is_gapless_and_tight(spark):
    rows = packing.pack(frame(spark, TEXTS + ["many " * n for n in range(1, 400)]), public_tokenizers.path("word_bpe_49k.json"), capacity=256).toPandas()
    assert (rows.groupby("doc_id")["length"].sum() == rows.groupby("doc_id")["start"].max() + rows.sort_values("piece").groupby("doc_id")["length"].last()).all()
    for _, one in rows.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert one["offset"].tolist() == [0, *one["length"].cumsum().tolist()[:-1]] and one["length"].sum() <= 256
    total = rows["length"].sum()
    assert rows["sequence_id"].nunique() <= -(-total // 256) + 2
    assert rows[rows["piece"] > 0].doc_id.nunique() > 0 and len(rows[rows.doc_id == 0]) == 1
    assert packing.pack(frame(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


RULES = [url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]


def judged(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    for c in "?#":
        rest = rest.split(c)[0]
    host, slash, path = rest.partition("/")
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def test_urls_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://A.NET/x", "http://net/", "http://net", "https://sub.example.net/en/1", "https://example.net/english", "http://x.example.com/de/?q#f", "http://notexample.com/de/", "x://y.org/fr/a://b", "http://org/fr/", "http://e.org?x=/fr/", "http://net./", "http://.net/", "http://ÄÖ.net/é", "http://a.net\n/x", "http://q.org/fr/" + "z" * 5000] * 2
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, RULES).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(df.limit(0), RULES).count() == 0


def test_cascade_is_exact_with_few_bits(spark):
    listed = spark.createDataFrame([(f"k{i}",) for i in range(300)], "key string")
    universe = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "key string")
    levels = url_filter.build_cascade(listed, universe, bits_per_key=3)
    assert len(levels) > 2
    found = universe.where(url_filter.is_listed(url_filter.F.col("key"), levels)).collect()
    assert {r.key for r in found} == {f"k{i}" for i in range(300)}


def test_main_text():
    page = """<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href=x>menu</a></nav><div class="ad">Buy, now, please, this, thing</div>
    <article><header><h1>Head &amp; line</h1></header><p>First   paragraph,\n with <b>bold</b> words, long enough to count.<br>After<p>Second &lt;one&gt;, unclosed, also long enough here</p><div class="comments"><p>A reader, says, things, at, length</p></div></article><aside>Side</aside><footer>Foot</footer></body></html>"""
    assert html_text.main_text(page) == "Head & line\n\nFirst paragraph, with bold words, long enough to count. After\n\nSecond <one>, unclosed, also long enough here"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>only</nav>") == ""
    assert "needle" in html_text.main_text("<div>" * 20000 + "<p>" + "some words, here, " * 20 + "needle</p>")


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>one, two, three words in a paragraph</p>", "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract_text(df).orderBy("page_id").collect()] == [(1, "u", "one, two, three words in a paragraph", 36), (2, None, "", 0)]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_null_keys_stand_beside_large_ones(spark):
    """One batch with a null key: the other keys keep every digit; repeated rows repeat."""
    big, path = 9007199254740993, public_tokenizers.path("word_bpe_49k.json")
    rows = [(None, "u", "some text, with words"), (big, "u", "some text, with words"), (big, "u", "some text, with words"), (2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, url string, text string").coalesce(1)
    want = sorted(map(str, [None, big, big, 2]))
    for found in (packing.pack(docs, path), trie_bpe.encode_texts(docs, path), token_file.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")), html_text.extract_text(docs, "text", ("doc_id", "url")), url_filter.judge_urls(docs, RULES, keep=("doc_id",))):
        assert sorted(str(r.doc_id) for r in found.collect()) == want, found.columns


def test_long_words_are_walked_in_order():
    model = trie_bpe.trie_bpe(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("etaoin"[: 2 + n % 5]), size)) for n, size in enumerate([1, 2, 7, 63, 64, 65, 300, 4000] * 12)]
    text = " ".join(words)
    (ids, decoded), = model.encode_batch([text])
    assert model.ordered and (np.frombuffer(ids, "<u4").tolist(), decoded) == library("word_bpe_49k.json", text)
    pairs = [("th", "e"), ("t", "he"), ("in", "g"), ("i", "ng</w>"), ("a", "a")]
    model.ordered = False
    slow = [model.may_follow(*p) for p in pairs]
    model.ordered = True
    assert [model.may_follow(*p) for p in pairs] == slow


def test_an_articles_own_paragraphs_stay_whatever_their_class():
    page = '<div class="notice">Closed, today, for all, of us</div><article><h1>T</h1><p class="notice-period social">The notice period, of three months, runs from here on.</p><p>With <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and more, plain words, in it.</p><script src=/js/>var leak=1;</script><p class="ad">Buy, now</p></article>'
    assert html_text.main_text(page) == "T\n\nThe notice period, of three months, runs from here on.\n\nWith x=2 and more, plain words, in it."
