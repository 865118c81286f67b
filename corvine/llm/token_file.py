"""Token ids in binary files of shuffled planes.

A file holds the ids of a run of documents as blocks of ``BLOCK`` ids (the last may be shorter). A block's ids
are transposed into byte planes (all low bytes, then all next bytes; or single bits with ``planes="bit"``), each
plane is compressed by zstandard on its own, and a chunk index at the end gives every plane's place, so a reader
seeks to any block and a document's ids need only the blocks that it touches::

    magic | planes of block 0 | planes of block 1 | ... | document index | chunk index | trailer

The document index (compressed as well) has each document's key, whether the key is null, and its id count.

``write_token_files`` sorts documents by key over range partitions; every task writes one file to the shared
folder under a name of its own and returns a manifest row, committed as a Parquet table. A task that runs again
writes another file; only those in the committed manifest are read, so lost executors leave at most an orphan.
Files are reached with pyarrow's file systems, so the folder may be on any store that pyarrow knows.
Memory is one Arrow batch of texts and one block; the ids of a task are never held together.

Defined results: null and '' texts hold the end id alone; a null key comes first and is read back as null;
documents with equal keys stand in the order of their texts; an empty table gives no documents; other columns
are left behind.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvine.llm.common import scratch
from corvine.llm.encoding import encoder

MAGIC = b"CORVTOK1"
BLOCK = 1 << 16
LEVEL = 1
TRAILER = struct.Struct("<QQQIBBQ")


def split_planes(ids: np.ndarray, width: int, planes: str) -> list[bytes]:
    """The planes of a block: ``width`` byte planes, or eight times as many bit planes."""
    lanes = np.ascontiguousarray(ids.astype(f"<u{width}").view(np.uint8).reshape(len(ids), width).T)
    if planes == "byte":
        return [lane.tobytes() for lane in lanes]
    return [np.packbits(lane >> bit & 1).tobytes() for lane in lanes for bit in range(8)]


def join_planes(found: list[bytes], n: int, width: int, planes: str) -> np.ndarray:
    """The ids that ``split_planes`` took apart."""
    if planes == "byte":
        lanes = np.stack([np.frombuffer(plane, np.uint8) for plane in found])
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(plane, np.uint8), count=n) for plane in found])
        lanes = np.stack([sum((bits[8 * b + i] << np.uint8(i) for i in range(8)), np.zeros(n, np.uint8)).astype(np.uint8) for b in range(width)])
    return np.ascontiguousarray(lanes.T).view(f"<u{width}").reshape(n)


class TokenWriter:
    """Writes documents' ids to an open binary stream."""

    def __init__(self, stream, width: int, planes: str = "byte"):
        if planes not in ("byte", "bit"):
            raise ValueError(planes)
        self.stream, self.width, self.planes = stream, width, planes
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0
        self.keys: list[int | None] = []
        self.counts: list[int] = []
        self.chunks: list[tuple[int, ...]] = []
        self.at = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        while len(ids) >= BLOCK or last and len(ids):
            block, ids = ids[:BLOCK], ids[BLOCK:]
            packed = [self.packer.compress(plane) for plane in split_planes(block, self.width, self.planes)]
            self.chunks.append((self.at, len(block), *map(len, packed)))
            self._put(b"".join(packed))
        self.waiting, self.held = [ids], len(ids)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= 4 * BLOCK:
            self._blocks(False)

    def close(self) -> None:
        self._blocks(True)
        documents = self.packer.compress(
            np.array([0 if k is None else k for k in self.keys], "<i8").tobytes() + np.array([k is None for k in self.keys], np.uint8).tobytes() + np.array(self.counts, "<i8").tobytes()
        )
        chunks = self.packer.compress(np.array(self.chunks, "<i8").tobytes())
        at = self.at
        self._put(documents)
        self._put(chunks)
        self._put(TRAILER.pack(at, at + len(documents), len(self.keys), len(self.chunks), self.width, self.planes == "bit", self.total))


class TokenReader:
    """Reads a file of ``TokenWriter`` from a seekable stream."""

    def __init__(self, stream, size: int):
        self.stream = stream
        self.unpacker = zstandard.ZstdDecompressor()
        stream.seek(0)
        if stream.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        stream.seek(size - TRAILER.size)
        documents, chunks, n, n_chunks, self.width, bit, self.total = TRAILER.unpack(stream.read(TRAILER.size))
        self.planes = "bit" if bit else "byte"
        stream.seek(documents)
        raw = self.unpacker.decompress(stream.read(chunks - documents))
        self.keys = [None if null else key for key, null in zip(np.frombuffer(raw, "<i8", n).tolist(), raw[8 * n : 9 * n])]
        self.counts = np.frombuffer(raw[9 * n :], "<i8", n)
        raw = self.unpacker.decompress(stream.read(size - TRAILER.size - chunks))
        self.chunks = np.frombuffer(raw, "<i8").reshape(n_chunks, -1)

    def block(self, number: int) -> np.ndarray:
        at, n, *sizes = self.chunks[number].tolist()
        self.stream.seek(at)
        raw, planes = self.stream.read(sum(sizes)), []
        for size in sizes:
            planes.append(self.unpacker.decompress(raw[:size]))
            raw = raw[size:]
        return join_planes(planes, n, self.width, self.planes)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Key, start within the file and ids of each document, block by block."""
        held, number, start = np.empty(0, f"<u{self.width}"), 0, 0
        for key, count in zip(self.keys, self.counts.tolist()):
            parts = [held]
            have = len(held)
            while have < count:
                parts.append(self.block(number))
                have += len(parts[-1])
                number += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield key, start, held[:count]
            held, start = held[count:], start + count

    def ids(self, first: int, n: int) -> np.ndarray:
        """Any run of ids, from the blocks that hold it."""
        blocks = [self.block(i) for i in range(first // BLOCK, -(-(first + n) // BLOCK))]
        return np.concatenate(blocks)[first % BLOCK : first % BLOCK + n] if blocks else np.empty(0, f"<u{self.width}")


def write_token_files(df: DataFrame, path: str, folder: str, text: str = "text", key: str = "doc_id", end_id: int = 0, planes: str = "byte") -> DataFrame:
    """Encode and write all documents; the manifest (file, part, n_docs, n_ids, n_bytes), as committed."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first(), "text")
    out = f"{folder}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(path), TaskContext.get().partitionId()
        system, root = pafs.FileSystem.from_uri(out)
        system.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        end = np.array([end_id], tool.dtype)
        writer = None
        with system.open_output_stream(f"{root}/{name}") as stream:
            writer = TokenWriter(stream, np.dtype(tool.dtype).itemsize, planes)
            for batch in batches:
                for k, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                    writer.add(k, np.append(tool.encode(words.as_py()), end))
            writer.close()
        yield pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "n_docs": [len(writer.keys)], "n_ids": [writer.total], "n_bytes": [writer.at]})

    manifest = rows.mapInArrow(run, "file string, part int, n_docs long, n_ids long, n_bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """From the files: key, start (ids before the document in all files), n_tokens, ids_crc32.

    The driver holds one manifest row a file, as many as the writing job had tasks.
    """
    files = sorted(spark.read.parquet(f"{folder}/manifest").where("n_docs > 0").collect(), key=lambda row: row.part)
    todo, base = [], 0
    for row in files:
        todo.append((f"{folder}/files/{row.file}", row.n_bytes, base))
        base += row.n_ids
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("base", T.LongType())])
    listed = spark.createDataFrame(spark.sparkContext.parallelize(todo, max(1, len(todo))), schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                system, place = pafs.FileSystem.from_uri(row.file)
                with system.open_input_file(place) as stream:
                    found = [(k, row.base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for k, start, ids in TokenReader(stream, row.n_bytes).documents()]
                yield pd.DataFrame({key: pd.array([f[0] for f in found], dtype="Int64"), "start": [f[1] for f in found], "n_tokens": [f[2] for f in found], "ids_crc32": [f[3] for f in found]})

    return listed.mapInPandas(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", end_id: int = 0, planes: str = "byte") -> DataFrame:
    """Write the documents' ids to fresh files in the shared folder and read them back."""
    spark = df.sparkSession
    folder = scratch(spark, "tokens")
    write_token_files(df, path, folder, text, key, end_id, planes)
    return read_token_files(spark, folder, key)
