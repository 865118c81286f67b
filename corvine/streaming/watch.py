"""Continuous rebuilding.

``watch_folder`` is Structured Streaming: Parquet snapshots of documents that arrive in a folder are compared with
the last state in ``foreachBatch``, and only what was added or changed is embedded again; the state is a Parquet
table per version, and a version file is written last. ``watch_repos`` is the control plane for git trees.
"""

from __future__ import annotations

import os
import subprocess
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators import passages as ops
from corvine.operators.chunking import Options
from corvine.sources import index_store as store


def upsert(state: DataFrame | None, arrived: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The state after rows arrived (a null text removes its key), and what changed (key, status)."""
    newest = arrived.dropDuplicates([key])
    before = state if state is not None else arrived.limit(0)
    touched = before.join(newest.select(key), key, "left_semi")
    changed = ops.changes(touched, newest.where(F.col(text).isNotNull()), key, text)
    after = before.join(newest.select(key), key, "left_anti").unionByName(newest.where(F.col(text).isNotNull()).select(*before.columns))
    return after, changed


def watch_folder(spark: SparkSession, source: str, state: str, checkpoint: str, schema: str, on_change: Callable[[DataFrame, DataFrame], None] | None = None, key: str = "doc_id", once: bool = True, seconds: int = 300):
    """Start the stream; ``on_change(state, changes)`` sees each version. Replayed batches give the same version."""

    def apply(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.parquet(f"{state}/v{number - 1}") if number and store.exists(session, f"{state}/v{number - 1}") else None
        after, changed = upsert(before, batch, key)
        after.write.mode("overwrite").parquet(f"{state}/v{number}")
        changed.write.mode("overwrite").parquet(f"{state}/changes{number}")
        if on_change is not None:
            on_change(session.read.parquet(f"{state}/v{number}"), session.read.parquet(f"{state}/changes{number}"))

    writer = spark.readStream.schema(schema).parquet(source).writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def git(folder: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(done.stderr.strip())
    return done.stdout.strip()


def needs_rebuild(local: str, remote: str, stored: str | None, forced: bool) -> bool:
    return forced or local != remote or local != stored


def sweep(repos: list[dict], hashes: dict[str, str], rebuild: Callable[[dict], None], forced: bool = False) -> dict[str, str]:
    """One pass over enabled repos; the hash is remembered only where the rebuild succeeded. Errors by index name."""
    failed = {}
    for repo in (r for r in repos if r.get("enabled", True)):
        name, folder, branch = repo["indexname"], repo["folder"], repo.get("branch", "main")
        try:
            git(folder, "fetch", "origin", branch)
            local, remote = git(folder, "rev-parse", "HEAD"), git(folder, "rev-parse", f"origin/{branch}")
            if not needs_rebuild(local, remote, hashes.get(name), forced):
                continue
            if local != remote:
                git(folder, "pull", "--ff-only", "origin", branch)
            rebuild(repo)
            hashes[name] = git(folder, "rev-parse", "HEAD")
        except (RuntimeError, OSError, ValueError) as error:
            failed[name] = str(error)
    return failed


def watch_repos(repos: list[dict], rebuild: Callable[[dict], None], seconds: int = 300, forced: bool = False, sweeps: int | None = None, delay: float = 2.0) -> None:
    """Sweep again and again; only the first pass is forced."""
    hashes: dict[str, str] = {}
    time.sleep(delay)
    done = 0
    while sweeps is None or done < sweeps:
        sweep(repos, hashes, rebuild, forced and done == 0)
        done += 1
        if sweeps is None or done < sweeps:
            time.sleep(seconds)


def repo_options(repo: dict) -> dict:
    """What a repo's configuration says about its files and chunks; what it leaves out is as usual."""
    usual = Options()
    known = lambda name, default: default if repo.get(name) is None else repo[name]
    options = Options(code_size=known("codechunksize", usual.code_size), code_overlap=known("codechunkoverlap", usual.code_overlap), use_structure=known("useast", usual.use_structure))
    return {"roots": [os.path.abspath(repo["folder"])], "file_types": set(repo.get("filetypes") or []) or None, "excludes": tuple(repo.get("excludepaths") or ()), "options": options}
