"""An index on disk: a folder with Parquet tables and a manifest, and import and export of flat files.

``<root>/<name>/`` holds ``passages`` (id, text, metadata), ``embeddings`` (id, embedding) and ``manifest.json``.
The manifest is written last, so a folder without it is no index. Flat files are JSON lines of passages, a list
of ids and a matrix of little-endian float32 rows.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvine.operators import lexical
from corvine.operators import passages as ops

MANIFEST = "manifest.json"
METADATA = "file_path string, file_name string, source string, source_type string, creation_date string, last_modified_date string, page_start int, page_end int, heading string"


@dataclass(frozen=True)
class ModelInfo:
    """An embedding model that indexes may name."""

    id: str
    dimensions: int
    max_tokens: int = 512


#: Models by lower-cased id; embedders are registered beside them.
MODELS: dict[str, ModelInfo] = {"hashing-64": ModelInfo("hashing-64", 64)}
EMBEDDERS = {"hashing-64": lambda: ops.hashing_embedder(64)}


def model(name: str) -> ModelInfo:
    if name.lower() not in MODELS:
        raise ValueError(f"unknown model {name!r}; known: {', '.join(sorted(MODELS))}")
    return MODELS[name.lower()]


def register_model(info: ModelInfo, make) -> None:
    """``make()`` gives the embedder; an index's manifest routes to it by the model's id."""
    MODELS[info.id.lower()], EMBEDDERS[info.id.lower()] = info, make


@dataclass(frozen=True)
class Manifest:
    embedding_model: str
    dimensions: int
    version: str = "1.0"
    roots: list[str] = field(default_factory=list)
    built: bool = False


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _fs(spark, path)
    return system.exists(target)


def write_manifest(spark: SparkSession, folder: str, manifest: Manifest) -> None:
    system, target = _fs(spark, f"{folder}/{MANIFEST}")
    stream = system.create(target, True)
    stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
    stream.close()


def load_manifest(spark: SparkSession, folder: str) -> Manifest:
    known = json.loads(spark.read.text(f"{folder}/{MANIFEST}", wholetext=True).first()[0])
    return Manifest(**{k: known[k] for k in Manifest.__dataclass_fields__ if k in known})


def list_indexes(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders that hold a manifest, sorted."""
    system, target = _fs(spark, root)
    if not system.exists(target):
        return []
    found = [s.getPath().getName() for s in system.listStatus(target) if s.isDirectory()]
    return sorted(n for n in found if exists(spark, f"{root}/{n}/{MANIFEST}"))


def write_passages(spark: SparkSession, root: str, name: str, passages: DataFrame, model_id: str, roots: list[str], force: bool = False) -> bool:
    """Passages and their lexical index, then the manifest; False and nothing done where an index exists and isn't forced."""
    folder, info = f"{root}/{name}", model(model_id)
    if not force and exists(spark, f"{folder}/{MANIFEST}"):
        return False
    passages.write.mode("overwrite").parquet(f"{folder}/passages")
    lexical.write_index(spark.read.parquet(f"{folder}/passages"), f"{folder}/lexical", id_="id")
    write_manifest(spark, folder, Manifest(info.id, info.dimensions, roots=roots))
    return True


def build_embeddings(spark: SparkSession, root: str, name: str, force: bool = False, batch: int = 32) -> bool:
    """Embed an index's passages with the model that its manifest names, checked before the index counts as built."""
    folder = f"{root}/{name}"
    manifest = load_manifest(spark, folder)
    if manifest.built and not force:
        return False
    info = model(manifest.embedding_model)
    if info.dimensions != manifest.dimensions:
        raise ValueError(f"{name}: the manifest has {manifest.dimensions} dimensions, {info.id} has {info.dimensions}")
    passages = spark.read.parquet(f"{folder}/passages")
    ops.embed_texts(passages, EMBEDDERS[info.id.lower()](), batch=batch).write.mode("overwrite").parquet(f"{folder}/embeddings")
    if wrong := ops.check_integrity(passages, spark.read.parquet(f"{folder}/embeddings"), info.dimensions):
        raise ValueError(f"{name}: {'; '.join(wrong)}")
    write_manifest(spark, folder, Manifest(**{**asdict(manifest), "built": True}))
    return True


def build_all(spark: SparkSession, root: str, force: bool = False, only: str | None = None, exclude: set[str] | None = None, batch: int = 32) -> dict[str, str]:
    """Build every index, or one; what went wrong by name (one failure doesn't stop the others)."""
    skipped = {x.lower() for x in exclude or ()}
    failed = {}
    for name in list_indexes(spark, root):
        if name.lower() in skipped or only is not None and name.lower() != only.lower():
            continue
        try:
            build_embeddings(spark, root, name, force, batch)
        except Exception as error:
            failed[name] = str(error)
    return failed


def load_index(spark: SparkSession, root: str, name: str) -> tuple[Manifest, DataFrame, DataFrame]:
    """Manifest, passages and vectors of an index that is built."""
    folder = f"{root}/{name}"
    if not exists(spark, f"{folder}/{MANIFEST}"):
        raise ValueError(f"no index {name!r}")
    manifest = load_manifest(spark, folder)
    if not manifest.built:
        raise ValueError(f"index {name!r} has no embeddings yet")
    return manifest, spark.read.parquet(f"{folder}/passages"), spark.read.parquet(f"{folder}/embeddings")


def scan_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Passages of a JSON lines file; of equal ids the last one's content at the first one's place."""
    rows = spark.read.schema(f"id string, text string, metadata struct<{METADATA.replace(' string', ':string').replace(' int', ':int')}>").json(path)
    placed = rows.where("id is not null").withColumn("__at", F.monotonically_increasing_id())
    found = placed.groupBy("id").agg(F.max_by(F.struct("text", "metadata"), "__at").alias("last"), F.min("__at").alias("position"))
    return found.select("id", "last.text", "last.metadata", "position")


def scan_ids(spark: SparkSession, path: str) -> DataFrame:
    """(position, id) of the lines that aren't blank."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("line"), F.trim("value").alias("id"))
    return ops.numbered(rows, "line", name="position").select("position", "id")


def scan_matrix(spark: SparkSession, path: str, n: int, dimensions: int) -> DataFrame:
    """(position, embedding) of a file of float32 rows, whose size must be exactly n rows."""
    system, target = _fs(spark, path)
    size = system.getFileStatus(target).getLen()
    if size != n * dimensions * 4:
        raise ValueError(f"{path} has {size} bytes; {n} rows of {dimensions} numbers have {n * dimensions * 4}")
    rows = spark.sparkContext.binaryRecords(path, dimensions * 4).zipWithIndex()
    return rows.map(lambda r: (r[1], np.frombuffer(r[0], "<f4").tolist())).toDF("position long, embedding array<float>")


def export_flat(passages: DataFrame, vectors: DataFrame, folder: str) -> None:
    """JSON lines, ids and matrix in order of the numeric id, streamed through the driver a partition at a time."""
    os.makedirs(folder, exist_ok=True)
    rows = passages.select("id", "text", F.to_json("metadata").alias("m")).join(vectors, "id").orderBy(F.col("id").cast("long"), "id")
    with open(f"{folder}/passages.jsonl", "w", encoding="utf-8") as text, open(f"{folder}/ids.txt", "w") as ids, open(f"{folder}/matrix.bin", "wb") as matrix:
        for row in rows.toLocalIterator():
            text.write(json.dumps({"id": row.id, "text": row.text} | ({"metadata": json.loads(row.m)} if row.m else {}), ensure_ascii=False) + "\n")
            ids.write(row.id + "\n")
            matrix.write(np.asarray(row.embedding, "<f4").tobytes())


def import_flat(spark: SparkSession, folder: str, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """Passages and vectors of flat files."""
    passages, ids = scan_jsonl(spark, f"{folder}/passages.jsonl"), scan_ids(spark, f"{folder}/ids.txt")
    matrix = scan_matrix(spark, f"{folder}/matrix.bin", ids.count(), dimensions)
    return passages.drop("position"), ids.join(matrix, "position").select("id", "embedding")


def load_repo_config(path: str) -> dict:
    """A watcher's JSON configuration: comments and trailing commas pass, keys in any case; no repos is an error."""
    with open(path, encoding="utf-8-sig") as file:
        text = file.read()
    strings = r'"(?:\\.|[^"\\])*"'
    text = re.sub(rf"({strings})|//[^\n]*|/\*.*?\*/", lambda m: m[1] or "", text, flags=re.DOTALL)
    text = re.sub(rf"({strings})|,(?=\s*[\]}}])", lambda m: m[1] or "", text)
    lower = lambda x: {k.lower(): lower(v) for k, v in x.items()} if isinstance(x, dict) else [lower(v) for v in x] if isinstance(x, list) else x
    config = lower(json.loads(text))
    if not config.get("repos"):
        raise ValueError("the configuration lists no repos")
    return config


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("__r = 1").drop("__r")
