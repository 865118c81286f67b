"""Files of directory trees as source documents.

The driver walks the trees by names only (Spark's own listing would pass over files that begin with ``_`` or
``.``), pruning ignored and hidden directories, and the paths become a DataFrame; the texts are read on the
executors, which need to see the trees at the same place. A file that can't be read is left out.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.text import BINARY, LANGUAGES, PROSE
from corvine.sources.ignore import IgnoreRule, compile_rules, is_ignored

PATHS = "doc_ord long, absolute_path string, file_path string, creation_date timestamp, last_modified_date timestamp"


def extension_of(name: str) -> str:
    return os.path.splitext(name)[1].lower().lstrip(".") if not name.startswith(".") or name.count(".") > 1 else name.rsplit(".", 1)[1].lower()


def wanted(name: str, whitelist: set[str] | None = None) -> bool:
    """By extension: not a binary kind, and a listed or known one."""
    kind = extension_of(name)
    kept = {x.lower().lstrip(".") for x in whitelist} if whitelist is not None else {*LANGUAGES, *PROSE, *PAGE_READERS}
    return (kind in PAGE_READERS or kind not in BINARY) and kind in kept


def walk(root: str, whitelist: set[str] | None = None, hidden: bool = False, excludes: tuple[str, ...] = ()) -> Iterator[str]:
    """Paths below a root, a directory's files before its directories; the root's own name is exempt."""
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    rules: list[IgnoreRule] = []

    def load(folder: str) -> None:
        """The ignore files of a tree, the root's first."""
        at = os.path.join(root, folder, ".gitignore")
        if os.path.isfile(at):
            with open(at, encoding="utf-8", errors="replace") as file:
                rules.extend(compile_rules(file.read().splitlines(), folder))
        for name in listed(folder)[1]:
            if not name.startswith("."):
                load(f"{folder}/{name}".lstrip("/"))

    def listed(folder: str) -> tuple[list[str], list[str]]:
        try:
            with os.scandir(os.path.join(root, folder)) as entries:
                found = sorted((e.name, e.is_dir(follow_symlinks=False)) for e in entries)
        except OSError:
            return [], []
        return [n for n, d in found if not d], [n for n, d in found if d]

    def visit(folder: str) -> Iterator[str]:
        names, folders = listed(folder)
        for name in names:
            path = f"{folder}/{name}".lstrip("/")
            if (hidden or not name.startswith(".")) and wanted(name, whitelist) and not is_ignored(path, False, rules):
                yield path
        for name in folders:
            path = f"{folder}/{name}".lstrip("/")
            if (hidden or not name.startswith(".")) and not is_ignored(path, True, rules):
                yield from visit(path)

    load("")
    rules.extend(compile_rules(list(excludes)))
    yield from visit("")


def scan_files(spark: SparkSession, roots: list[str], whitelist: set[str] | None = None, hidden: bool = False, excludes: tuple[str, ...] = ()) -> DataFrame:
    """The paths of several trees, one after the other, with their times."""
    rows = []
    for root in roots:
        for path in walk(root, whitelist, hidden, excludes):
            full = os.path.join(os.path.abspath(root), path)
            stat = os.stat(full)
            rows.append((len(rows), full, path, *(datetime.fromtimestamp(t, timezone.utc) for t in (stat.st_ctime, stat.st_mtime))))
    return spark.createDataFrame(rows, PATHS)


#: Readers of pages by extension (lower case, without the dot): bytes of a file to a list of page texts, or None if it can't be read.
PAGE_READERS: dict[str, Callable[[bytes], list[str] | None]] = {}


def read_text(paths: DataFrame, partitions: int | None = None) -> DataFrame:
    """Source documents of the paths: content (UTF-8), names, times, language, whether it is code, kind."""
    spread = paths.repartition(partitions or max(1, paths.sparkSession.sparkContext.defaultParallelism))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for path in batch["absolute_path"]:
                try:
                    with open(path, "rb") as file:
                        texts.append(file.read().decode("utf-8-sig"))
                except (OSError, UnicodeDecodeError):
                    texts.append(None)
            yield batch.assign(content=texts).dropna(subset=["content"])

    read = spread.mapInPandas(run, f"{PATHS}, content string")
    from corvine.functions.text import language

    name = F.regexp_extract("file_path", r"([^/]*)$", 1)
    kind = language(F.col("file_path"))
    return read.select("*", name.alias("file_name"), kind.alias("language"), kind.isNotNull().alias("is_code"), F.lit("text").alias("source_type"))


def paged(path: Column) -> Column:
    """Whether a path's extension has a reader of pages."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)).isin(list(PAGE_READERS)) if PAGE_READERS else F.lit(False)


def named(paths: DataFrame) -> DataFrame:
    """Paths with the file's name and, as the kind of source, its extension without the dot."""
    return paths.select("*", F.regexp_extract("file_path", r"([^/]*)$", 1).alias("file_name"), F.lower(F.regexp_extract("file_path", r"\.([^./]*)$", 1)).alias("source_type"))


def read_pages(paths: DataFrame) -> DataFrame:
    """(doc, page_no, text) of paged files through ``PAGE_READERS``; unreadable files give no pages."""
    readers = dict(PAGE_READERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for order, path in zip(batch["doc_ord"], batch["absolute_path"]):
                reader = readers.get(extension_of(path))
                try:
                    with open(path, "rb") as file:
                        pages = reader(file.read()) if reader else None
                except Exception:  # a broken file of any kind is skipped, as documented
                    pages = None
                rows += [(order, n, text) for n, text in enumerate(pages or [], 1)]
            yield pd.DataFrame(rows, columns=["doc", "page_no", "text"])

    return paths.mapInPandas(run, "doc long, page_no int, text string")
