import hashlib
import re

import xxhash

from corvine.llm import winnowing


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def brute(text, k=winnowing.K, w=winnowing.W):
    words = [x for x in re.split(r"[^\w]+|_+", text.lower()) if x] or ([text] if text else [])
    if not words:
        return "", set()
    grams = []
    for i in range(max(1, len(words) - k + 1)):
        h = 42
        for word in words[i : i + k]:
            h = xxhash.xxh64_intdigest(word.encode(), seed=h)
        grams.append(h)
    places = []
    for i in range(max(1, len(grams) - w + 1)):
        window = grams[i : i + w]
        least = min(x >> 31 for x in window)
        at = i + max(j for j, x in enumerate(window) if x >> 31 == least)
        if at not in places:
            places.append(at)
    return " ".join(f"{grams[i]:x}:{i}" for i in places), {grams[i] for i in places}


def like(a, b):
    return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))


def expected(rows):
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 62)), r[1]))
    out = []
    for i, (key, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        (own, a), (other, b), (_, c) = brute(text), brute(edited), brute(after)
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, round(like(a, b), 12), round(like(a, c), 12)))
    return sorted(out, key=repr)


def got(spark, rows):
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, bucket string, own string")
    found = winnowing.compare_with_next(df).collect()
    return sorted([(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in found], key=repr)


def test_matches_brute_force(spark):
    base = " ".join(f"wort{i * 7 % 31}, Über{i}" for i in range(200))
    rows = [(i, base[i * 5 : i * 40 + 30]) for i in range(30)] + [(100, None), (None, "ohne Schlüssel"), (7, "twice the key"), (7, "twice the key"), (101, ""), (102, "!!! ..."), (103, "ab " * 3000), (104, "😀 " * 9), (5000000, base)]
    assert got(spark, rows) == expected(rows)


def test_one_document_and_none(spark):
    assert got(spark, [(3, "one two three four five six")]) == expected([(3, "one two three four five six")])
    assert got(spark, []) == []


def test_shared_passage_is_caught(spark):
    shared = " ".join(f"s{i}" for i in range(winnowing.W + winnowing.K - 1))
    a, b = brute("alpha beta " + shared + " gamma"), brute("x y z " + shared + " q r s t u v")
    assert a[1] & b[1]


def test_ranges_stay_even_beside_outlying_keys(spark):
    for first, n in ((0, 0), (10**15, 1), (-(10**15), 1), (-(1 << 62), 1), (10**15, 5000)):
        keys = spark.range(20000).unionAll(spark.range(first, first + n)).select(winnowing.F.col("id").alias("order"))
        bucket, greatest = winnowing.ranges(keys, "order", 32)
        counts = [r["count"] for r in keys.groupBy(bucket.alias("b")).count().collect()]
        assert max(counts) <= 2 * sum(counts) / 32 and len(counts) == len(greatest)


def test_one_null_and_one_outlying_key(spark):
    rows = [(i, f"alpha beta gamma delta word{i} epsilon zeta eta") for i in range(60)] + [(None, "no key at all here"), (10**15, "far away from all others")]
    assert got(spark, rows) == expected(rows)
