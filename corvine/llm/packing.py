"""Best-fit packing of token sequences by minimum bin slack.

Lengths are integers up to the capacity, so the corpus is a histogram of at most ``capacity`` counts, however
many documents there are. Each bin starts with the longest piece left; a bitset subset-sum dynamic program over
the lengths left finds the combination that fills it best, which is removed. The same combination is then taken
as often as its counts allow, so there are at most about ``capacity`` distinct patterns and the driver's work and
memory are bounded, whatever the corpus.

The executors number the pieces of equal length: a running number within each task, and the count of equal
pieces in the tasks before it, by a join with the (task, length) counts. A piece's sequence and offset follow
from its number by arithmetic over the broadcast patterns. No group is gathered anywhere: a length that a third
of all pieces have is a number in the histogram.

Only documents longer than the capacity are cut, into pieces of exactly the capacity and a last shorter one.

Defined results: null and '' have the end id alone (length 1); repeated rows are packed each; an empty table
gives an empty result; a null key is kept as it is; other columns are left behind.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvine.llm.common import saved
from corvine.llm.encoding import encoder

CAPACITY = 4096


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths (descending, within their counts) whose sum is as near to ``room`` as any can be.

    Bit i of a state is set if some of the lengths so far sum to i. Copies of a length go in doubling
    bundles; the scan ends as soon as the room can be filled exactly.
    """
    if room <= 0:
        return []
    mask = (1 << (room + 1)) - 1
    states, bundles = [1], []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, size = min(counts[length], room // length), 1
        while left > 0:
            size = min(size, left)
            bundles.append((length, size))
            states.append(states[-1] | (states[-1] << (length * size)) & mask)
            left, size = left - size, size * 2
        if states[-1] >> room:
            break
    total = states[-1].bit_length() - 1
    chosen: list[int] = []
    for (length, size), state in zip(reversed(bundles), reversed(states[:-1])):
        if not state >> total & 1:
            chosen += [length] * size
            total -= length * size
    return sorted(chosen, reverse=True)


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, copies)], bins) that hold every length of the histogram once."""
    counts = Counter({length: n for length, n in histogram.items() if n > 0})
    if counts and max(counts) > capacity:
        raise ValueError("a length exceeds the capacity")
    patterns = []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        items = Counter([longest, *fullest({x: n for x, n in rest.items() if n}, capacity - longest)])
        bins = min(counts[length] // copies for length, copies in items.items())
        patterns.append((sorted(items.items(), reverse=True), bins))
        for length, copies in items.items():
            counts[length] -= copies * bins
            if not counts[length]:
                del counts[length]
    return patterns


def placements(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """By length, rows (first number, copies a bin, first bin, offset in a bin), ordered by first number."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    first_bin = 0
    for items, bins in patterns:
        offset = 0
        for length, copies in items:
            rows[length].append((used[length], copies, first_bin, offset))
            used[length] += copies * bins
            offset += length * copies
        first_bin += bins
    return {length: np.array(found, np.int64) for length, found in rows.items()}


def pieces_of(df: DataFrame, path: str, text: str, key: str, end_id: int, capacity: int) -> DataFrame:
    """Each document's pieces with their checksum, the task that made them and their number among its equal lengths."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, task, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], tool.dtype)
        for batch in batches:
            rows = []
            for at, words in enumerate(batch.column(1)):
                ids = np.append(tool.encode(words.as_py()), end).astype("<u4")
                for number, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((at, number, start, len(part), zlib.crc32(part.tobytes()), task, seen[len(part)]))
                    seen[len(part)] += 1
            at, number, start, length, crc, tasks, nth = np.array(rows, np.int64).reshape(-1, 7).T
            # the key stays in Arrow, so nulls and large integers stay what they are
            found = [batch.column(0).take(pa.array(at)), number.astype(np.int32), start, length, crc, tasks.astype(np.int32), nth]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in found], [key, "piece", "start", "length", "ids_crc32", "task", "nth"])

    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return rows.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = saved(pieces_of(df, path, text, key, end_id, capacity), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {row.length: row.n for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = placements(minimum_bin_slack(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))
    numbered = pieces.join(bases, ["task", "length"]).withColumn("nth", F.col("nth") + F.col("base")).drop("task", "base")
    spots = df.sparkSession.sparkContext.broadcast(table)

    columns = [key, "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, nth = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for group in np.split(order, cuts) if len(order) else []:
                length = int(lengths[group[0]])
                rows = spots.value[length]
                row = rows[np.searchsorted(rows[:, 0], nth[group], "right") - 1]
                inside = nth[group] - row[:, 0]
                sequence[group] = row[:, 2] + inside // row[:, 1]
                offset[group] = row[:, 3] + inside % row[:, 1] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    kind = df.schema[key].dataType.simpleString()
    numbered = numbered.select(*columns, "nth")
    return numbered.mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
