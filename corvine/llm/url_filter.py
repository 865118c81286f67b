"""URL filter: allow and block rules held in Bloom filter cascades, judged with native expressions only.

A rule is a host and a path prefix written as one key, such as ``example.net/en/``. Each url yields the few
keys that could be rules (its host's suffixes with as many labels as a rule has, each with the path prefixes
as long as a rule's), and a cascade answers exactly whether a key is listed:

* level 0 encodes the listed keys; level 1 the keys of the corpus that level 0 wrongly accepts; level 2 the
  listed keys that level 1 accepts; and so on until a level has no false positive over the key universe.
* a key's answer is the parity of the first level that rejects it. Over the universe it was built for it is
  exact, so applying it needs no join: the bit arrays are literals in a projection.

Sizes: a level has ``bits_per_key`` bits for each of its keys, in whole longs, at most ``max_bits`` together
(8 MB by default, checked when it is built, larger lists raise ``ValueError``). Building scans the keys of
the corpus once a level; only false positives, a fraction of ``0.6185 ** bits_per_key`` of the distinct
unlisted keys, leave the scan, deduplicated before they are shuffled.

Defined results: a null url, or one without ``://``, has host and path '' and no rule; without a rule the
verdict is the method's for a key that is not listed, ``allow``. Repeated rows are judged each on its own,
an empty table gives an empty result, other columns are left behind.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HASHES = 4


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, below a path prefix (which begins with ``/``, or is '')."""

    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as 64-bit words, and the seed that sets its hashes apart."""

    words: tuple[int, ...]
    seed: int

    @property
    def bits(self) -> int:
        return 64 * len(self.words)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both '' for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.regexp_replace(rest, r"(?s)[?#].*$", "")
    slash = F.instr(rest, "/")
    host = F.when(slash > 0, F.substring(rest, F.lit(1), slash - 1)).otherwise(rest)
    path = F.when(slash > 0, F.substring(rest, slash, F.length(rest))).otherwise(F.lit(""))
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The keys of a url that have the form of some rule, longest first (ties: the longer host first).

    Their number is bounded by the rules' shapes: host label counts times path prefix lengths.
    """
    labels = F.split(host, r"\.")
    shapes = sorted({(rule.host.count(".") + 1, len(rule.path)) for rule in rules}, reverse=True)
    keys = [
        F.when(
            (host != "") & (F.size(labels) >= n) & (F.length(path) >= length),
            F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring(path, 1, length)),
        )
        for n, length in shapes
    ]
    by_length = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0)
    return F.array_sort(F.array_compact(F.array(*keys)), by_length) if keys else F.array().cast("array<string>")


def positions(key: Column, bits: int, seed: int) -> list[Column]:
    """The bits of a key in a level, by double hashing."""
    first = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits).cast("long"))
    step = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(bits - 1).cast("long")) + 1
    return [F.pmod(first + i * step, F.lit(bits).cast("long")) for i in range(HASHES)]


def in_level(key: Column, level: Level) -> Column:
    """Whether every bit of the key is set."""
    words = F.array(*[F.lit(word) for word in level.words]) if len(level.words) <= 64 else F.lit(list(level.words)).cast("array<bigint>")
    hit = lambda at: F.call_function("shiftright", F.element_at(words, (F.floor(at / 64) + 1).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return reduce(lambda a, b: a & b, [hit(at) for at in positions(key, level.bits, level.seed)])


def encode(keys: DataFrame, n: int, seed: int, bits_per_key: int, max_bits: int) -> Level:
    """A Bloom filter of the column ``key``: bits are joined into words on the executors."""
    bits = max(64, -(-n * bits_per_key // 64) * 64)
    if bits > max_bits:
        raise ValueError(f"a filter level needs {bits} bits for {n} keys; the bound is {max_bits}")
    at = F.explode(F.array(*positions(F.col("key"), bits, seed)))
    words = [0] * (bits // 64)
    set_bits = keys.select(at.alias("at")).select(F.floor(F.col("at") / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("bit"))
    for row in set_bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        words[row.word] = row.bits
    return Level(tuple(words), seed)


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = 16, max_bits: int = 1 << 26, max_levels: int = 64) -> list[Level]:
    """The levels that tell ``listed`` keys from all others of ``universe`` (both with a column ``key``)."""
    listed = listed.select("key").where(F.col("key").isNotNull()).distinct()
    others = universe.select("key").where(F.col("key").isNotNull())
    levels: list[Level] = []
    inside, outside = listed, None
    while len(levels) < max_levels:
        n = inside.count()
        if n == 0 and levels:
            return levels
        level = encode(inside, n, len(levels), bits_per_key, max_bits)
        levels.append(level)
        if outside is None:
            # the universe is filtered by the level before anything is shuffled
            wrong = others.where(in_level(F.col("key"), level)).distinct().join(listed, "key", "left_anti")
        else:
            wrong = outside.where(in_level(F.col("key"), level))
        inside, outside = wrong, inside
    raise ValueError(f"the cascade did not end within {max_levels} levels")


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Exact membership for keys of the universe: the parity of the first level that rejects the key."""
    answer = F.lit(len(levels) % 2 == 1)
    for depth in reversed(range(len(levels))):
        answer = F.when(~in_level(key, levels[depth]), F.lit(depth % 2 == 1)).otherwise(answer)
    return answer


def judge_urls(df: DataFrame, rules: list[Rule], url: str = "url", keep: tuple[str, ...] = ("page_id",), bits_per_key: int = 16, default: str = "allow") -> DataFrame:
    """``keep`` with host, path, rule and verdict: the longest listed key of each url decides."""
    if len({rule.key for rule in rules}) != len(rules):
        raise ValueError("two rules have the same key")
    spark = df.sparkSession
    host, path = split_url(F.col(url))
    parts = df.select(*keep, host.alias("host"), path.alias("path"))
    keyed = parts.select(*keep, "host", "path", candidate_keys(F.col("host"), F.col("path"), rules).alias("keys"))
    universe = keyed.select(F.explode("keys").alias("key"))
    cascades = {}
    for name, chosen in (("any", rules), ("block", [rule for rule in rules if rule.verdict == "block"])):
        listed = spark.createDataFrame([(rule.key,) for rule in chosen], "key string")
        cascades[name] = build_cascade(listed, universe, bits_per_key) if chosen else []
    rule = F.try_element_at(F.filter("keys", lambda key: is_listed(key, cascades["any"])), F.lit(1)) if rules else F.lit(None).cast("string")
    found = keyed.select(*keep, "host", "path", rule.alias("rule"))
    blocked = is_listed(F.col("rule"), cascades["block"]) if cascades["block"] else F.lit(False)
    return found.withColumn("verdict", F.when(F.col("rule").isNull(), default).when(blocked, "block").otherwise("allow"))
