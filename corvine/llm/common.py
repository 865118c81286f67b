"""What the operators share: table access, the shared folder, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting that removes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary
    folder, set for the session; on a cluster there is no folder to choose, so ``ValueError`` is raised.
    """
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='corvine-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path in the shared folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Workspace:
    """A folder of its own in the shared one for what an operator writes between its steps; removed at the end."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path, self.n = spark, scratch(spark, what), 0

    def saved(self, df: DataFrame, what: str, by: str | None = None) -> DataFrame:
        """The rows written to the folder, in a folder for each value of ``by`` if given, and read back: cuts lineage and survives lost executors."""
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{what}"
        # what was shuffled for these rows is of no use once they are written
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path, partitionBy=by)
        finally:
            self.spark.conf.set(CLEANUP, before) if before is not None else self.spark.conf.unset(CLEANUP)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        drop_path(self.spark, self.path)


def saved(df: DataFrame, what: str) -> DataFrame:
    """The rows written to a fresh path of the shared folder and read back; the path stays, as results are read from it."""
    return Workspace(df.sparkSession, what).saved(df, what)


def slices(texts: pa.Array, size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """(start, number) of runs of an Arrow string array with about so many bytes each, so that few texts are Python's at once."""
    ends = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    start = 0
    while start < len(texts):
        n = max(1, int(np.searchsorted(ends, int(ends[start]) + size, "right")) - 1 - start)
        yield start, n
        start += n


def whole_text(column: str | Column = "text") -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def code_units(spark: SparkSession) -> int:
    """Partitions that a shuffle of this session gets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
