"""Document fingerprints by winnowing, with native expressions only.

A text's words (lower-cased runs of letters and digits) give hashes of every ``K`` consecutive ones. In each
window of ``W`` consecutive hashes the least is chosen, the rightmost of equals, and each chosen hash is kept
once with its place. So any ``W + K - 1`` words that two texts share give a common fingerprint, and no match
shorter than ``K`` words does. Window minima come from doubling spans: a shifted array is merged with itself
``log2(W)`` times.

``compare_with_next`` puts each document beside the next one in descending key order in one shuffle of the
texts: keys are cut into ranges of like counts (by quantiles, a bounded number on the driver), a range's first
document is also sent to the range before it, and ``lead`` runs within a range.

Defined results: null is the empty text, with an empty fingerprint; a text without letters and digits is one
word; fewer than ``K`` words give one hash of all, fewer than ``W`` hashes give their least. The likeness is
twice the common hashes over both counts; 1 for two empty fingerprints, 0 for one. Documents with equal keys
follow one another by their texts; a null key comes last; one document alone is its own next; other columns are
left behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvine.llm.common import code_units

K, W = 5, 8
PLACE_BITS = 30
PLACES = (1 << PLACE_BITS) - 1
MAX_CUTS = 1 << 13


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; the text itself if it has none."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda word: word != "")
    return let(found, lambda words: F.when((F.size(words) == 0) & (text != ""), F.array(text)).otherwise(words))


def gram_hashes(words: Column, k: int = K) -> Column:
    """The hash of every k consecutive words; of all of them if they are fewer."""
    last = F.greatest(F.size(words) - k, F.lit(0))
    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, F.lit(k))))
    return F.when(F.size(words) > 0, grams).otherwise(F.array().cast("array<bigint>"))


def chosen(grams: Column, w: int = W) -> Column:
    """Places (from 0) of the hashes that some window of w chooses, in order."""
    if w & (w - 1):
        raise ValueError("the window must be a power of two")
    # the hash's upper 33 bits, then the place counted downwards: the least is the rightmost of equals
    value = F.transform(grams, lambda h, i: F.call_function("shiftleft", F.call_function("shiftrightunsigned", h, F.lit(64 - 33)), F.lit(PLACE_BITS)).bitwiseOR((F.lit(PLACES) - i).cast("long")))

    def widen(least: Column, span: int) -> Column:
        if span == w:
            windows = F.slice(least, F.lit(1), F.greatest(F.size(least) - w + 1, F.lit(1)))
            return F.transform(F.array_distinct(windows), lambda v: (F.lit(PLACES) - v.bitwiseAND(F.lit(PLACES))).cast("int"))
        # past its end the shifted array gives null, which least() passes over
        return let(F.zip_with(least, F.slice(least, F.lit(span + 1), F.size(least)), lambda a, b: F.least(a, b)), lambda wider: widen(wider, 2 * span))

    return let(value, lambda least: widen(least, 1))


def fingerprint(text: Column, k: int = K, w: int = W) -> Column:
    """struct(fingerprint string of ``hash:place`` pairs, hashes: the distinct chosen hashes)."""

    def of(grams: Column) -> Column:
        return let(
            chosen(grams, w),
            lambda places: F.struct(
                F.array_join(F.transform(places, lambda i: F.concat(F.lower(F.hex(F.element_at(grams, i + 1))), F.lit(":"), i.cast("string"))), " ").alias("fingerprint"),
                F.array_distinct(F.transform(places, lambda i: F.element_at(grams, i + 1))).alias("hashes"),
            ),
        )

    none = F.struct(F.lit("").alias("fingerprint"), F.array().cast("array<bigint>").alias("hashes"))
    return F.when(F.length(text) > 0, let(words_of(text), lambda words: let(gram_hashes(words, k), of))).otherwise(none)


def likeness(a: Column, b: Column) -> Column:
    """Twice the common hashes over both counts (0 to 1)."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def ranges(df: DataFrame, order: str, n: int) -> tuple[Column, dict[int, int]]:
    """A column that cuts ``order`` (a long) into about n ranges of like counts, and each range's greatest value.

    The cuts are approximate quantiles, so outlying keys and gaps leave the ranges even; the driver holds n of them.
    """
    n = min(n, MAX_CUTS)
    found = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)] or [0.5], 32 * n)).first()[0]
    cuts = sorted(set(found or []))
    if not cuts:
        return F.lit(0), {}
    listed = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    # how many cuts lie below, by bisection
    bucket = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.try_element_at(listed, at + step) < F.col(order)), at + step).otherwise(at))
    return bucket, {row.bucket: row.top for row in df.groupBy(bucket.alias("bucket")).agg(F.max(order).alias("top")).collect()}


def compare_with_next(df: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness to each other and to the next."""
    lowest = -(1 << 62)
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(lowest)).alias("order"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bucket, greatest = ranges(rows.select("order"), "order", 4 * code_units(df.sparkSession))
    # the first document of a range is also the guest of the range above it; of the highest range, of the lowest
    known = sorted(greatest)
    listed = lambda values, kind: F.split(F.lit(",".join(map(str, values)) or "0"), ",").cast(f"array<{kind}>")
    first = F.try_element_at(listed([greatest[i] for i in known], "bigint"), F.col("bucket") + 1) == F.col("order")
    host = F.try_element_at(listed(known[1:] + known[:1], "int"), F.col("bucket") + 1)
    home = lambda where, guest: F.struct(where.alias("bucket"), F.lit(guest).alias("guest"))
    homes = F.when(first, F.array(home(F.col("bucket"), False), home(host, True))).otherwise(F.array(home(F.col("bucket"), False)))
    dealt = rows.withColumn("bucket", bucket).select("key", "order", "text", F.explode(homes).alias("home"))
    dealt = dealt.select("key", "order", "text", "home.bucket", "home.guest").repartition("bucket")
    printed = dealt.withColumn("own", fingerprint(F.col("text"), k, w))
    ahead = Window.partitionBy("bucket").orderBy("guest", F.col("order").desc(), "text")
    paired = printed.withColumn("next_text", F.lead("text").over(ahead)).withColumn("next_hashes", F.lead("own.hashes").over(ahead)).where(~F.col("guest"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    done = paired.select("key", "text", "own", "next_hashes", edited.alias("edited")).withColumn("other", fingerprint(F.col("edited"), k, w))
    return done.select(
        F.col("key").alias(key),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("own.fingerprint").alias("fingerprint"),
        F.col("other.fingerprint").alias("edited_fingerprint"),
        likeness(F.col("own.hashes"), F.col("other.hashes")).alias("near_edited"),
        likeness(F.col("own.hashes"), F.col("next_hashes")).alias("near_next"),
    )
