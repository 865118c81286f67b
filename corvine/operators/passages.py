"""Passages: ids, metadata, batches, integrity checks, change detection, embeddings."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvine.functions.text import trimmed

MAX_CUTS = 1024


def numbered_lines(text: Column) -> Column:
    """array<struct<line_no, numbered>>: each line behind its number, padded to the width of the last."""
    found = F.split(text, "\n")
    return F.transform(found, lambda line, i: F.struct((i + 1).alias("line_no"), F.concat(F.lpad((i + 1).cast("string"), F.length(F.size(found).cast("string")), F.lit(" ")), F.lit("|"), line).alias("numbered")))


def numbered(df: DataFrame, order: str, *then: str, name: str = "id") -> DataFrame:
    """Rows numbered from 0 in the order of a non-null integer column (then others), without one task for all.

    The order is cut at approximate quantiles (``MAX_CUTS`` at most), so outlying values leave the ranges even; a
    window numbers each range's rows, and the count of the rows before it comes from the ranges' counts.
    """
    found = df.agg(F.percentile_approx(order, [i / MAX_CUTS for i in range(1, MAX_CUTS)], 16 * MAX_CUTS)).first()[0]
    cuts = sorted(set(found or []))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(cuts).bit_length())))])
    listed = F.split(F.lit(",".join(map(str, cuts)) or "0"), ",").cast("array<bigint>")
    # how many cuts lie below, by bisection
    cell = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.try_element_at(listed, at + step) < F.col(order)), at + step).otherwise(at))
    celled = df.withColumn("__cell", cell)
    counts = celled.groupBy("__cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("__cell", F.coalesce(before, F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__cell").orderBy(order, *then)) - 1
    return celled.withColumn("__n", inside).join(F.broadcast(bases), "__cell").withColumn(name, F.col("__base") + F.col("__n")).drop("__cell", "__n", "__base")


def assign_ids(chunks: DataFrame, order: str = "doc_ord", *then: str) -> DataFrame:
    """Chunks with the passage id, a decimal string that counts from 0 in document, then chunk order."""
    return numbered(chunks, order, *(then or ("chunk_ord",))).withColumn("id", F.col("id").cast("string"))


def metadata(path: Column, name: Column, kind: Column, created: Column, modified: Column, page: Column | None = None, heading: Column | None = None) -> Column:
    """The metadata struct of a passage; dates are days, missing ones null."""
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    fields = [path.alias("file_path"), name.alias("file_name"), path.alias("source"), kind.alias("source_type"), day(created).alias("creation_date"), day(modified).alias("last_modified_date")]
    if page is not None:
        fields += [page.alias("page_start"), page.alias("page_end"), (heading if heading is not None else F.lit(None).cast("string")).alias("heading")]
    return F.struct(*fields)


def length_batches(df: DataFrame, size: int = 32, text: str = "text", tie: str = "doc_id") -> DataFrame:
    """Rows with the number of their batch in order of text length; ties by ``tie``."""
    sized = df.withColumn("__len", F.length(text).cast("long"))
    return numbered(sized, "__len", tie, name="__at").withColumn("batch_no", F.floor(F.col("__at") / size)).drop("__len", "__at")


def duplicate_ids(df: DataFrame, id_: str) -> DataFrame:
    return df.groupBy(id_).agg(F.count("*").alias("n")).where("n > 1")


def missing_ids(ids: DataFrame, passages: DataFrame, id_: str, of: str) -> DataFrame:
    """Ids that no passage has."""
    return ids.join(passages.select(F.col(of).alias(id_)), id_, "left_anti").select(id_)


def check_integrity(passages: DataFrame, vectors: DataFrame, dimensions: int) -> list[str]:
    """What is wrong with an index's passages (id) and vectors (id, embedding); empty if nothing is."""
    wrong = []
    n, m = passages.count(), vectors.count()
    if n != m:
        wrong.append(f"{m} vectors for {n} passages")
    if vectors.where(F.size("embedding") != dimensions).head(1):
        wrong.append(f"a vector hasn't {dimensions} dimensions")
    if twice := [r.id for r in duplicate_ids(vectors, "id").orderBy("id").limit(5).collect()]:
        wrong.append(f"ids twice: {', '.join(twice)}")
    if gone := [r.id for r in missing_ids(vectors, passages, "id", "id").orderBy("id").limit(5).collect()]:
        wrong.append(f"ids without a passage: {', '.join(gone)}")
    return wrong


def changes(before: DataFrame, after: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, status): added, changed or removed between two snapshots, by the texts' digests."""
    digest = lambda df, name: df.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias(name))
    both = digest(before, "old").join(digest(after, "new"), key, "full")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select(key, status.alias("status")).where("status is not null")


def strip_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(trimmed(F.col(text)) != "")


Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dimensions: int = 64) -> Embedder:
    """Signed hashes of words as vectors: deterministic, for tests and plumbing, without a model's meaning."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions), np.float64)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                out[row, h % dimensions] += 1.0 if h >> 31 else -1.0
        return out

    return embed


def onnx_embedder(model_path: str, tokenizer_path: str, max_tokens: int = 512) -> Embedder:
    """A transformer's mean-pooled states; the session is made on first use, once a worker."""
    state: dict = {}

    def embed(texts: list[str]) -> np.ndarray:
        if not state:
            import onnxruntime
            from tokenizers import Tokenizer

            state["session"] = onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])
            state["tokenizer"] = Tokenizer.from_file(tokenizer_path)
            state["tokenizer"].enable_truncation(max_tokens)
            state["tokenizer"].enable_padding()
        found = state["tokenizer"].encode_batch(texts)
        mask = np.array([x.attention_mask for x in found], np.int64)
        feed = {"input_ids": np.array([x.ids for x in found], np.int64), "attention_mask": mask, "token_type_ids": np.zeros_like(mask)}
        names = {x.name for x in state["session"].get_inputs()}
        states = state["session"].run(None, {k: v for k, v in feed.items() if k in names})[0]
        return (states * mask[:, :, None]).sum(axis=1) / np.maximum(1, mask.sum(axis=1))[:, None]

    return embed


def embed_texts(df: DataFrame, embedder: Embedder, key: str = "id", text: str = "text", batch: int = 32) -> DataFrame:
    """(key, embedding): unit vectors of every text; each Arrow batch is embedded in order of length."""
    rows = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            frame = frame.iloc[frame["__text"].str.len().argsort(kind="stable")] if len(frame) else frame
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                found = np.asarray(embedder(part["__text"].tolist()), np.float64)
                length = np.linalg.norm(found, axis=1, keepdims=True)
                found = np.where(length < 1e-12, found, found / np.maximum(length, 1e-300)).astype(np.float32)
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list(found)})

    return rows.mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, embedding array<float>")
