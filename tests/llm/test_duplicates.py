"""Near-duplicate documents, lines and vectors, and toxicity, against brute force or held-out labels."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from corvine.llm import bag_minhash, embedding_dups, fuzzy_lines, toxicity


def classes(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in nodes:
        for j in nodes:
            if i < j and linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def bag(text):
    words = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    texts = {}
    for base in range(6):
        words = [f"w{rng.randrange(400)}" for _ in range(120)]
        for _ in range(14):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
                copy[rng.randrange(120)] = f"e{rng.randrange(9999)}"
            texts[len(texts)] = " ".join(copy)
    texts |= {200: None, 201: "", 202: "!!!", 203: "few words", 204: "Few, words", 205: "again and again " * 400, 206: "again and again " * 390}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()] + [(3, texts[3], 1), (None, "no key", 1)], "doc_id long, text string, rep int")
    bags = {k: bag(t) for k, t in texts.items()}
    want = classes(sorted(texts), lambda i, j: bool(bags[i]) and jaccard(bags[i], bags[j]) >= 0.8)
    got = {r.doc_id: (r.class_id, r.kept) for r in bag_minhash.near_duplicates(df).collect()}
    assert got.pop(None) == (None, True) and got == {k: (c, k == c) for k, c in want.items()}
    kept = bag_minhash.keep_one(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted([*(str(k) for k, c in want.items() if k == c), "None"])
    assert bag_minhash.near_duplicates(df.limit(0)).count() == 0


def test_texts_of_one_id_are_documents_of_their_own(spark):
    near, far = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, near), (2, near), (2, far), (3, far + " more"), (4, "alone"), (4, "apart"), (4, "apart"), (None, near)]
    kept = bag_minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", near), ("2", far), ("4", "alone"), ("4", "apart"), ("None", near)])


def test_pipeline_keeps_one_of_equal_wordless_texts(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "***"), (2, ""), (3, "some words here"), (4, None), (5, "***"), (6, ""), (6, "Other text"), (7, "some words here"), (8, "---"), (None, "")]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("1", "***"), ("2", ""), ("3", "some words here"), ("6", "Other text"), ("8", "---"), ("None", "")])


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        keys = np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64))
        a, b = rng.integers(1, 9, len(keys)), rng.integers(1, 9, len(keys))
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        x, y = bag_minhash.signatures([(keys, a), (keys, b)])
        errors.append((x == y).mean() - true)
    assert abs(np.mean(errors)) < 4 * 0.045 / np.sqrt(40)


def test_products_equal_pairs():
    rng = np.random.default_rng(2)
    bags = [np.unique(rng.integers(0, 60, 40).astype(np.uint64), return_counts=True) for _ in range(40)]
    wanted = np.ones((40, 40), bool)
    got = bag_minhash.similar_pairs(bags, bags, wanted, 0.3)
    assert (got == np.array([[bag_minhash.overlap(a, b) >= 0.3 for b in bags] for a in bags])).all()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_keep_the_first_of_each_group(spark):
    rng = random.Random(4)
    words = [f"term{i}" for i in range(300)]
    unique = [" ".join(rng.sample(words, 12)) for _ in range(30)]
    shared = "The quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(i, f"{unique[i]}\n{shared}{'.' * i}\n***") for i in range(30)]
    rows += [(40, shared.replace("quick", "quicl")), (41, None), (42, ""), (43, f"{unique[0].upper()}!\nnew closing line"), (44, "long " * 3000), (45, "long " * 2999)]
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, node int")
    got = {r.doc_id: (r.text, r.lines_dropped) for r in fuzzy_lines.dedup_lines(df).collect()}
    assert got[0] == (f"{unique[0]}\n{shared}\n***", 0)
    assert all(got[i] == (f"{unique[i]}\n***", 1) for i in range(1, 30))
    assert got[40] == ("", 1) and got[41] == (None, 0) and got[42] == ("", 0) and got[43] == ("new closing line", 1)
    assert got[44][1] == 0 and got[45] == ("", 1)
    assert fuzzy_lines.dedup_lines(df.limit(0)).count() == 0


def edited_lines(rng):
    """Lines of 1 to 70 words, each with copies that differ in words or letters, as far as similarity 0.8 allows."""
    parts = ["ka", "lo", "men", "tir", "su", "pra", "vo", "nel", "gi", "ost"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    lines = []
    for words in (1, 1, 2, 3, 4, 6, 8, 10, 12, 15, 20, 30, 50, 70):
        base = [word() for _ in range(words)]
        lines.append(" ".join(base))
        for changed in (1, 1, 2, 3):
            copy = list(base)
            for _ in range(min(changed, words // 5)):
                copy[rng.randrange(words)] = word()
            lines.append(" ".join(copy))
        for share in (0, 0, 0.05, 0.1):
            copy = list(lines[-5])
            for _ in range(max(1, int(share * len(copy)))):
                copy[rng.randrange(len(copy))] = rng.choice("xyzq")
            lines.append("".join(copy))
    return lines


def test_lines_equal_brute_force(spark):
    lines = edited_lines(random.Random(7))
    near = lambda i, j: edits(lines[i], lines[j]) <= 0.2 * max(len(lines[i]), len(lines[j])) + 1e-9
    alike = lambda i, j: min(len(lines[i]), len(lines[j])) >= 0.8 * max(len(lines[i]), len(lines[j])) - 1e-9 and near(i, j)
    want = classes(range(len(lines)), alike)
    assert sum(k != c for k, c in want.items()) > 80
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id for r in fuzzy_lines.dedup_lines(df).collect() if not r.lines_dropped}
    assert got == {k for k, c in want.items() if k == c}


def test_every_one_letter_edit_is_compared(spark):
    line = "the quick brown fox jumps over the lazy dog near the river bank today"
    pairs = [(line, line[:i] + c + line[i + 1 :]) for i in range(len(line)) for c in "abcdefghijklmnopqrstuvwxyz" if line[i] != " " and line[i] != c]
    keys = lambda name: fuzzy_lines.line_keys(fuzzy_lines.F.col(name))
    assert len(pairs) == 1400 and spark.createDataFrame(pairs, "a string, b string").where(~fuzzy_lines.F.arrays_overlap(keys("a"), keys("b"))).count() == 0


def test_pipeline_stage_drops_edited_lines(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    lines = edited_lines(random.Random(21))
    alike = lambda i, j: edits(lines[i], lines[j]) <= 0.2 * max(len(lines[i]), len(lines[j])) + 1e-9
    want = classes(range(len(lines)), alike)
    docs = [(d, "\n".join(lines[d : d + 6]), 0) for d in range(0, len(lines), 6)]
    got = corpus_pipeline.drop_lines(spark, spark.createDataFrame(docs, "doc_id long, text string, n_chars int"), "").collect()
    kept = {d: "\n".join(lines[i] for i in range(d, min(d + 6, len(lines))) if want[i] == i) for d, _, _ in docs}
    assert {r.doc_id: (r.text, r.n_chars) for r in got} == {d: (t, len(t)) for d, t in kept.items()}


def test_common_phrases_of_unrelated_lines(spark):
    """Many unrelated lines hold the same phrases; copies among them are found by two of their keys, none is dropped wrongly."""
    rng = random.Random(12)
    phrase, other = "queens kept vexing jackdaws beyond the quiz", "wizards just boxed quickly with our gray viking"
    word = lambda: "".join(rng.choice("aeioulnrstdmpc") for _ in range(7))
    lines = [" ".join([*(word() for _ in range(9)), phrase, *(word() for _ in range(9)), other, *(word() for _ in range(4))]) for _ in range(40)]
    lines += [line.replace(line.split()[2], word()) for line in lines[:12]]
    near = lambda i, j: edits(lines[i], lines[j]) <= 0.2 * max(len(lines[i]), len(lines[j])) + 1e-9
    want = classes(range(len(lines)), near)
    got = {r.doc_id for r in fuzzy_lines.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect() if not r.lines_dropped}
    assert got == {k for k, c in want.items() if k == c} == set(range(40))


@pytest.mark.parametrize("strays_a_task", [2048, 7])
def test_pairs_with_one_common_key_are_compared(spark, monkeypatch, strays_a_task):
    """Copies with a letter edited in every other word share only the phrase that all lines hold."""
    monkeypatch.setattr(fuzzy_lines, "STRAYS_A_TASK", strays_a_task)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulnrstdmpc") for _ in range(6))
    lines = [" ".join(["xylophones", *(word() for _ in range(6))]) for _ in range(40)]
    copies = [" ".join(w[0] + "z" + w[2:] if i in (2, 4, 6) else w for i, w in enumerate(line.split())) for line in lines[:25]]
    keys = lambda name: fuzzy_lines.line_keys(fuzzy_lines.F.col(name))
    shared = spark.createDataFrame(list(zip(lines, copies)), "a string, b string").select(fuzzy_lines.F.size(fuzzy_lines.F.array_intersect(keys("a"), keys("b"))).alias("n"))
    assert {r.n for r in shared.collect()} == {1}
    got = {r.doc_id for r in fuzzy_lines.dedup_lines(spark.createDataFrame(list(enumerate(lines + copies)), "doc_id long, text string")).collect() if not r.lines_dropped}
    assert got == set(range(40))


def test_pipeline_stage_compares_lines_with_one_common_key(spark):
    """As above for the stage; each line's copy differs by edited words, and the phrase is all that they share."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioulnrstdmpc") for _ in range(6))
    lines = [" ".join(["xylophones", *(word() for _ in range(6))]) for _ in range(30)]
    copies = [" ".join(w[0] + "z" + w[2:] if i in (2, 4, 6) else w for i, w in enumerate(line.split())) for line in lines]
    docs = [(1, "\n".join(lines)), (2, "\n".join([*copies, "last line of this text"])), (3, None)]
    got = corpus_pipeline.drop_lines(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    assert {r.doc_id: r.text for r in got} == {1: docs[0][1], 2: "last line of this text", 3: None}


def test_pipeline_stage_compares_lines_that_share_few_words(spark):
    """A letter edited in every word but those of a phrase that all lines hold."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("aeioulnrstdm") for _ in range(7))
    halves = [([word() for _ in range(14)], [word() for _ in range(14)]) for _ in range(12)]
    edited = [[[w[:i] + "f" + w[i + 1 :] for w in half for i in [rng.randrange(7)]] for half in both] for both in halves]
    lines = [" ".join([*a, "kept vexing jackdaws beyond the quiz", *b]) for a, b in [*halves, *edited]]
    near = lambda i, j: edits(lines[i], lines[j]) <= 0.2 * max(len(lines[i]), len(lines[j])) + 1e-9
    want = classes(range(len(lines)), near)
    assert {k for k, c in want.items() if k == c} == set(range(12))
    got = corpus_pipeline.drop_lines(spark, spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string"), "").collect()
    assert {r.doc_id for r in got if r.text} == set(range(12))


def test_lines_of_null_keys_and_repeated_rows(spark):
    rows = [(None, "a line of some words to keep\nother line of this text"), (9007199254740993, "a line of some words to keep"), (9007199254740993, "a line of some words to keep"), (9007199254740992, "A line, of some words to keep!\n第一行没有空格的文字在这里写得很长很长很长很长很长很长很长很长很长很长"), (None, None)]
    got = sorted(((r.doc_id, r.text, r.lines_dropped) for r in fuzzy_lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    first = (9007199254740992, rows[3][1], 0)
    assert got == sorted([(None, "other line of this text", 1), (9007199254740993, "", 1), (9007199254740993, "", 1), first, (None, None, 0)], key=repr)


def test_similar_is_the_edit_similarity(spark):
    rng = random.Random(9)
    pairs = [("", ""), ("abc", "abc"), ("a" * 300, "a" * 250)]
    for _ in range(60):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 40)))
        b = list(a)
        for _ in range(rng.randrange(0, 10)):
            b[rng.randrange(len(b))] = rng.choice(["x", "", "yz"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", fuzzy_lines.similar(fuzzy_lines.F.col("a"), fuzzy_lines.F.col("b"), 0.8).alias("s")).collect():
        assert r.s == (1 - edits(r.a, r.b) / max(1, len(r.a), len(r.b)) >= 0.8 - 1e-9), (r.a, r.b)


def test_similar_of_long_texts(spark):
    """Edits at the ends, moved pieces and shifts near the limit; texts of few letters are similar by chance."""
    rng = random.Random(31)
    pairs = []
    for n in range(90):
        a = "".join(rng.choice("ab " if n % 3 else "abcdefgh ") for _ in range(rng.randrange(90, 260)))
        k, at = rng.randrange(int(0.15 * len(a)), int(0.25 * len(a))), rng.randrange(len(a) // 2)
        scattered = list(a)
        for i in rng.sample(range(len(a)), k):
            scattered[i] = rng.choice(["x", "", "yz"])
        pairs.append((a, [a[:at] + "x" * k + a[at + k :], a[k:] + "y" * (k // 2), "z" * k + a, a[:at] + a[at + k :], a[k // 2 :] + a[: k // 2], "".join(scattered)][n % 6]))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [(r.s, 1 - edits(r.a, r.b) / max(len(r.a), len(r.b)) >= 0.8 - 1e-9) for r in df.select("a", "b", fuzzy_lines.similar(fuzzy_lines.F.col("a"), fuzzy_lines.F.col("b"), 0.8).alias("s")).collect()]
    assert all(s == near for s, near in got) and 20 < sum(near for _, near in got) < 80


def test_beats_are_never_further_apart_than_the_texts(spark):
    """An edit of any character, vowels and spaces too, changes one beat at most; unrelated lines differ in more beats than edits are allowed."""
    rng = random.Random(23)
    letters, syllables = "aeé bcdst1第", ["the", "tion", "ou", "qui", "er", "ing", "ma", "ré", "st"]
    line = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(30))
    pairs = []
    for n in range(120):
        a = line() if n % 2 else "".join(rng.choice(letters) for _ in range(150))
        b = list(a)
        for i in rng.sample(range(len(b)), rng.randrange(1, 40)):
            b[i] = rng.choice([rng.choice(letters), "", rng.choice(letters) + b[i]])
        pairs.append((a, "".join(b)))
    pairs += [(line(), line()) for _ in range(60)]
    col, of = fuzzy_lines.F.col, fuzzy_lines.beats
    df = spark.createDataFrame([pair for pair in pairs if min(map(len, pair)) >= 100], "a string, b string")
    given = fuzzy_lines.similar(col("a"), col("b"), 0.8, of(col("a")), of(col("b")))
    apart, pieces = fuzzy_lines.F.levenshtein(of(col("a")), of(col("b"))), fuzzy_lines.by_pieces(col("a"), col("b"))
    rows = [(r.s, r.d, r.p, edits(r.a, r.b), max(len(r.a), len(r.b))) for r in df.select("a", "b", given.alias("s"), apart.alias("d"), pieces.alias("p")).collect()]
    assert len(rows) > 150 and all(d <= true <= p for _, d, p, true, _ in rows)
    assert all(s == (true <= 0.2 * size + 1e-9) for s, _, _, true, size in rows) and 40 < sum(s for s, *_ in rows) < 140
    assert sum(d > 0.2 * size for _, d, _, _, size in rows[-60:]) > 30
    assert spark.createDataFrame([("a" * 99,), (None,)], "a string").where(of(col("a")).isNotNull()).count() == 0


def test_pairs_of_several_buckets_are_compared_once(spark):
    line = "one line that two documents hold"
    rows = [(bucket, node, len(line), 9, node, node, 1, 2, [b for b in (5, 6) if b < bucket], line + "." * node, None, None) for bucket in (5, 6) for node in (1, 2)]
    df = spark.createDataFrame(rows, "bucket long, node long, size int, hub long, component long, now long, main long, strays long, earlier array<long>, norm string, spelt string, words array<short>")
    links = lambda rows: [(r.a, r.b) for r in fuzzy_lines.stray_links(rows.where("component <> main"), rows, 0.8, True).collect()]
    assert links(df.where("bucket = 5")) == [(1, 2)] and links(df.where("bucket = 6")) == [] and links(df) == [(1, 2)]


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 16))
    vectors = {i: (centres[i % 6] + rng.normal(size=16) * (0.12 if i % 3 else 0.3)).tolist() for i in range(90)}
    vectors |= {200: vectors[0], 201: vectors[0], 300: None, 301: [0.0] * 16, 302: [float("nan")] + [1.0] * 15, 303: [float("inf")] + [1.0] * 15, 304: [None] + [1.0] * 15, 305: [1e-30 * x for x in vectors[1]], 306: [], 307: [1.0, 2.0]}
    df = spark.createDataFrame([(k, v, 1) for k, v in vectors.items()], "vec_id long, embedding array<double>, size int")
    good = {k: np.array(v) for k, v in vectors.items() if v and None not in v and np.isfinite(v).all() and any(v)}
    cosine = lambda a, b: len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.9
    want = classes(sorted(good), lambda i, j: cosine(good[i], good[j]))
    links = {k: sum(cosine(v, w) for j, w in good.items() if j != k) for k, v in good.items()}
    for tile in (None, 16):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dups.link_vectors(df, 0.9, tile=tile).collect()}
        assert got == {k: (links.get(k, 0), want.get(k, k), want.get(k, k) == k) for k in vectors}
    assert embedding_dups.link_vectors(df.limit(0)).count() == 0


def test_int8_bounds_hold():
    rng = np.random.default_rng(3)
    unit = rng.normal(size=(200, 32))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    ints, scale, length, error = embedding_dups.quantised(unit)
    product = (ints.astype(float) @ ints.astype(float).T) * scale[:, None] * scale
    bound = np.outer(error, length + error) + np.outer(length, error) + embedding_dups.SLACK
    assert (np.abs(product - unit @ unit.T) <= bound).all()


def test_toxicity_learns_and_handles_gaps(spark):
    rng = random.Random(6)
    plain, rude = [f"calm{i}" for i in range(80)], [f"rude{i}" for i in range(8)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = rng.choices(plain, k=40)
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(rude)
        rows.append((i, " ".join(words), rng.choice(["en", "de"]), "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, None, "s"), (1001, "", "en", "s"), (None, "calm1", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, marks).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert 100 < len(held) < 200 and np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == got[1001].score and not got[None].held_out
    left = {r.doc_id for r in toxicity.keep_civil(docs, marks).collect()}
    assert {1000, 1001} <= left and toxicity.keep_civil(docs, marks).columns == docs.columns
    assert toxicity.classify(docs.limit(0), marks.limit(0)).count() == 0
    assert toxicity.classify(docs, marks.limit(0)).select("score").distinct().count() == 1
    big = spark.createDataFrame([(None, "calm1"), (9007199254740993, "rude1 calm2"), (9007199254740993, "rude1 calm2"), (2, "calm3 " * 60000)], "doc_id long, text string").coalesce(1)
    found = toxicity.classify(big, marks).collect()
    assert sorted(str(r.doc_id) for r in found) == ["2", "9007199254740993", "9007199254740993", "None"] and len({r.score for r in found if r.doc_id and r.doc_id > 2}) == 1
    assert {r.doc_id for r in toxicity.keep_civil(big.withColumn("__body", toxicity.F.lit(1)), marks).collect()} <= {None, 2, 9007199254740993}


def test_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(4)
    texts = [toxicity.padded(rng.integers(1, 50, n * toxicity.PARTS)) for n in (0, 1, 2, 5, 0, 30)]
    labels = np.array([0, 1, 0, 1, 0, 1])
    model = toxicity.train(texts * 20, np.tile(labels, 20), epochs=2)
    together = model.raw(texts)
    assert np.allclose(together, [model.raw([t])[0] for t in texts], atol=1e-5) and np.allclose(model.raw(texts[::-1])[::-1], together, atol=1e-5)
