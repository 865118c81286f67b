"""The three tools (search, list, warm-up) and the command line: build passages, build indexes, rebuild, watch."""

from __future__ import annotations

import argparse
import os
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.text import acceptable, trimmed
from corvine.operators import hybrid, passages as ops
from corvine.operators.chunking import Options, chunk_documents
from corvine.operators.pages import chunk_pages
from corvine.sources import files, index_store as store


def file_uri_to_path(uri: str) -> str | None:
    """The path of an absolute ``file:`` address, None for anything else."""
    parts = urlparse(uri)
    return unquote(parts.path) or None if parts.scheme == "file" and parts.path.startswith("/") else None


def data_root(given: str | None, client_roots: list[str], working: str) -> str:
    """A given root, else the client's first root that holds an index folder, else its first, else the working folder."""
    if given and given.strip():
        return given
    roots = [r for r in client_roots if r and r.strip()]
    return next((r for r in roots if os.path.isdir(os.path.join(r, ".corvine"))), roots[0] if roots else working)


def model_path(model_id: str, override: str | None = None, home: str | None = None) -> str:
    return override or os.path.join(home or os.path.expanduser("~"), ".corvine", "models", model_id.replace("/", "-").replace("\\", "-"))


def with_force(args: list[str]) -> list[str]:
    """A rebuild's arguments: forced once."""
    return args if "--force" in args else [*args, "--force"]


def build_passages(spark: SparkSession, root: str, name: str, docs: list[str], model_id: str, options: Options = Options(), whitelist: set[str] | None = None, hidden: bool = False, excludes: tuple[str, ...] = (), force: bool = False) -> bool:
    """Discover, chunk, filter, number and write one index's passages."""
    paths = files.scan_files(spark, docs, whitelist, hidden, excludes)
    if not paths.head(1):
        raise ValueError("no documents were found")
    paged = files.paged(F.col("absolute_path"))
    sources = files.read_text(paths.where(~paged))
    named = lambda df: df.select("doc_ord", F.struct("file_path", "file_name", "source_type", "creation_date", "last_modified_date").alias("f"))
    chunks = chunk_documents(sources, options).where((trimmed(F.col("text")) != "") & acceptable(F.col("text")))
    chunks = chunks.select("doc_ord", F.lit(None).cast("int").alias("page_no"), "chunk_ord", "text", F.lit(None).cast("string").alias("heading"))
    facts = named(sources.drop("content"))
    if files.PAGE_READERS:
        pages = chunk_pages(files.read_pages(paths.where(paged)), None, options.page_size, options.page_overlap)
        chunks = chunks.unionByName(pages.select(F.col("doc").alias("doc_ord"), "page_no", "chunk_ord", "text", "heading"))
        facts = facts.unionAll(named(files.named(paths.where(paged))))
    numbered = ops.assign_ids(chunks.join(facts, "doc_ord"), "doc_ord", "page_no", "chunk_ord")
    about = ops.metadata(*[F.col(f"f.{x}") for x in ("file_path", "file_name", "source_type", "creation_date", "last_modified_date")], *([F.col("page_no"), F.col("heading")] if files.PAGE_READERS else []))
    passages = numbered.select("id", "text", about.alias("metadata"))
    return store.write_passages(spark, root, name, passages, model_id, [os.path.abspath(d) for d in docs], force)


_cached: dict[tuple[str, str], tuple] = {}


def opened(spark: SparkSession, root: str, name: str) -> tuple:
    """An index, kept open by root and name; another root lets go of what was open."""
    if (root, name) not in _cached:
        for key in [k for k in _cached if k[0] != root]:
            for frame in _cached.pop(key)[1:]:
                frame.unpersist()
        manifest, passages, vectors = store.load_index(spark, root, name)
        _cached[root, name] = manifest, passages.persist(), vectors.persist()
    return _cached[root, name]


def lexical_index(spark: SparkSession, root: str, name: str) -> str | None:
    """The folder of an index's stored postings; None for an index written without."""
    folder = f"{root}/{name}/lexical"
    return folder if store.exists(spark, f"{folder}/corpus") else None


def search(spark: SparkSession, root: str, name: str, query: str, top_k: int = 5, complexity: int = 32, show_metadata: bool = False, dedup_threshold: float = 0.95) -> str:
    """The report of a hybrid search, or ``Error: …``."""
    try:
        manifest, passages, vectors = opened(spark, root, name)
        vector = store.EMBEDDERS[manifest.embedding_model.lower()]()([query])[0].tolist()
        asked = spark.createDataFrame([(0, query, vector)], "query_id long, query string, vector array<double>")
        renamed = passages.withColumnRenamed("id", "doc_id")
        hits = hybrid.hybrid_search(renamed, vectors.withColumnRenamed("id", "vec_id"), asked, top_k, complexity, dedup_threshold, index=lexical_index(spark, root, name))
        rows = hits.join(passages.select("id", "metadata"), "id").orderBy("rank").collect()
    except ValueError as error:
        return f"Error: {error}"
    return format_results(query, rows, show_metadata)


def format_results(query: str, rows: list, show_metadata: bool = False) -> str:
    """Hits as text: place, score, optionally the file's facts, the snippet, its source."""
    lines = [f"Search results for '{query}' (top {len(rows)}):", ""]
    for n, row in enumerate(rows, 1):
        lines.append(f"{n}. Score: {row.score:.3f}")
        facts = row.metadata.asDict() if row.metadata is not None else {}
        if show_metadata:
            shown = [("File", facts.get("file_path")), ("Name", facts.get("file_name") if facts.get("file_name") != facts.get("file_path") else None), ("Created", facts.get("creation_date")), ("Modified", facts.get("last_modified_date"))]
            lines += [f"   {label}: {value}" for label, value in shown if value]
        lines.append(f"   {row.snippet}")
        if facts.get("source"):
            lines.append(f"   Source: {facts['source']}")
        lines.append("")
    return "\n".join(lines).rstrip()


def list_report(spark: SparkSession, root: str) -> str:
    names = store.list_indexes(spark, root)
    return "\n".join([f"{len(names)} indexes:", *(f"  {n}" for n in names)]) if names else "No indexes found."


def warmup(spark: SparkSession, root: str) -> str:
    """Open the first index and its model."""
    names = store.list_indexes(spark, root)
    if not names:
        return "No indexes found."
    manifest, passages, vectors = opened(spark, root, names[0])
    store.EMBEDDERS[manifest.embedding_model.lower()]()(["warm-up"])
    return f"{names[0]}: {passages.count()} passages, {vectors.count()} vectors, model {manifest.embedding_model}"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("corvine")
    top.add_argument("--root", default=os.path.join(os.getcwd(), ".corvine", "indexes"))
    modes = top.add_subparsers(dest="mode", required=True)
    for mode in ("build-passages", "rebuild"):
        build = modes.add_parser(mode)
        build.add_argument("--docs", nargs="+", required=True)
        build.add_argument("--index-name", required=True)
        build.add_argument("--model", default="hashing-64")
        build.add_argument("--file-types", default=None)
        build.add_argument("--exclude-paths", default="")
        build.add_argument("--include-hidden", action="store_true")
        build.add_argument("--no-structure", action="store_true")
        build.add_argument("--code-chunk-size", type=int, default=512)
        build.add_argument("--code-chunk-overlap", type=int, default=64)
        build.add_argument("--force", action="store_true")
    build = modes.add_parser("build-indexes")
    build.add_argument("--index", default=None)
    build.add_argument("--exclude", nargs="*", default=[])
    build.add_argument("--batch-size", type=int, default=32)
    build.add_argument("--force", action="store_true")
    find = modes.add_parser("search")
    find.add_argument("index")
    find.add_argument("query")
    find.add_argument("--top-k", type=int, default=5)
    find.add_argument("--show-metadata", action="store_true")
    modes.add_parser("list")
    modes.add_parser("warmup")
    watch = modes.add_parser("watch")
    watch.add_argument("--config", required=True)
    watch.add_argument("--interval", type=int, default=300)
    watch.add_argument("--force", action="store_true")
    return top


def main(args: list[str], spark: SparkSession | None = None) -> str:
    given = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("corvine").getOrCreate()
    if given.mode in ("build-passages", "rebuild"):
        kinds = {x.strip() for x in given.file_types.split(",") if x.strip()} if given.file_types else None
        options = Options(code_size=given.code_chunk_size, code_overlap=given.code_chunk_overlap, use_structure=not given.no_structure)
        force = given.force or given.mode == "rebuild"
        done = build_passages(spark, given.root, given.index_name, given.docs, given.model, options, kinds, given.include_hidden, tuple(x for x in given.exclude_paths.split(",") if x), force)
        if given.mode == "rebuild":
            store.build_embeddings(spark, given.root, given.index_name, True)
        return "built" if done else "exists"
    if given.mode == "build-indexes":
        failed = store.build_all(spark, given.root, given.force, given.index, set(given.exclude), given.batch_size)
        return "\n".join(f"{n}: {w}" for n, w in failed.items()) or "built"
    if given.mode == "search":
        return search(spark, given.root, given.index, given.query, given.top_k, show_metadata=given.show_metadata)
    if given.mode == "watch":
        from corvine.streaming import watch

        config = store.load_repo_config(given.config)

        def rebuild(repo: dict) -> None:
            options = watch.repo_options(repo)
            build_passages(spark, given.root, repo["indexname"], options["roots"], "hashing-64", options["options"], options["file_types"], excludes=options["excludes"], force=True)
            store.build_embeddings(spark, given.root, repo["indexname"], True)

        watch.watch_repos(config["repos"], rebuild, given.interval if given.interval > 0 else int(config.get("intervalseconds", 300)), given.force)
    return list_report(spark, given.root) if given.mode == "list" else warmup(spark, given.root)


def report(df: DataFrame) -> DataFrame:
    """Hits as lines of text, natively, for many queries at once."""
    return df.select("query_id", "rank", F.format_string("%d. Score: %.3f", F.col("rank"), F.col("score")).alias("line"))
