"""Chunkers: prose by sentences, code by lines, braces or members. State is a document's own, so each runs in one
``mapInPandas`` without a shuffle; ids come in a second, native pass (``passages.assign_ids``)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: languages that are cut at balanced braces
BRACED = frozenset("typescript javascript java cpp c go rust kotlin scala swift php".split())
#: Bytes of text that a Python worker cuts into chunks at a time.
SLICE_BYTES = 1 << 22


@dataclass(frozen=True)
class Options:
    """Sizes and overlaps in characters, for prose, code and pages; whether code is cut by its structure."""

    chunk_size: int = 256
    chunk_overlap: int = 128
    code_size: int = 512
    code_overlap: int = 64
    page_size: int = 1600
    page_overlap: int = 200
    use_structure: bool = True


def merge_overlap(segments: list[str], size: int, overlap: int) -> list[str]:
    """Segments joined up to ``size``; each chunk begins with the last ``overlap`` characters of the one before."""
    size = max(1, size)
    overlap = min(max(0, overlap), size - 1)
    out, held = [], ""
    for segment in segments:
        if held and len(held) + len(segment) > size:
            out.append(held.rstrip())
            held = held[-overlap:] if 0 < overlap < len(held) else ""
        held += segment
    return [*out, held.rstrip()] if held else out


def sentences(paragraph: str) -> Iterator[str]:
    """Pieces that end after a sentence's mark and the white space behind it, or after a line break."""
    start = 0
    for mark in re.finditer(r"[.!?][ \n]|\n(?!\Z)", paragraph):
        yield paragraph[start : mark.end()]
        start = mark.end()
        if len(mark[0]) == 2 and mark[0][1] == "\n" and start < len(paragraph):
            yield ""  # a line break behind a sentence ends a piece of its own
    if start < len(paragraph):
        yield paragraph[start:]


def packed_words(sentence: str, size: int) -> list[str]:
    """Words joined by single spaces up to ``size``; a longer word stays whole."""
    lines: list[str] = []
    for word in sentence.split(" "):
        if lines and lines[-1] and len(lines[-1]) + 1 + len(word) > size:
            lines.append(word)
        elif lines and lines[-1]:
            lines[-1] += " " + word
        else:
            lines[-1:] = [word]
    return [line for line in lines if line]


def chunk_sentences(text: str, size: int = 256, overlap: int = 128) -> list[str]:
    size = max(1, size)
    segments: list[str] = []
    for paragraph in text.split("\n\n"):
        if len(paragraph) <= size:
            segments.append(paragraph + "\n\n")
            continue
        for piece in sentences(paragraph):
            segments += [piece] if len(piece) <= size else packed_words(piece, size)
    return merge_overlap(segments, size, overlap)


def chunk_code_lines(text: str, size: int = 512, overlap: int = 64) -> list[str]:
    """Numbered lines, merged; what is left of a line cut by the overlap is dropped."""
    lines = text.split("\n")
    width = len(str(len(lines)))
    out = []
    for chunk in merge_overlap([f"{n:>{width}}|{line}\n" for n, line in enumerate(lines, 1)], size, overlap):
        chunk = chunk.strip()
        if chunk and not chunk[0].isdigit():
            chunk = chunk.partition("\n")[2].strip()
        if chunk:
            out.append(chunk)
    return out


#: Outside of templates: what hides braces, the braces, and a template's opening.
CODE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*(?:'|\n|\Z)|\"(?:\\.|[^\"\\\n])*(?:\"|\n|\Z)|[{}`]", re.DOTALL)
TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*(`|\$\{|\Z)", re.DOTALL)


def chunk_braces(text: str) -> list[str]:
    """Top-level blocks: each ends where a brace brings the depth back to none; braces in strings don't count."""
    out, depth, start, at, inside = [], 0, 0, 0, []
    while hit := CODE.search(text, at):
        at = hit.end()
        if hit[0] == "{":
            depth += 1
        elif hit[0] == "}":
            if inside and inside[-1] == depth:  # an interpolation ends, its template goes on
                inside.pop()
                rest = TEMPLATE.match(text, at)
                at = rest.end()
                if rest[1] == "${":
                    inside.append(depth)
                continue
            depth = max(0, depth - 1)
            if depth == 0:
                out.append(text[start:at])
                start = at
        elif hit[0] == "`":
            rest = TEMPLATE.match(text, at)
            at = rest.end()
            if rest[1] == "${":
                inside.append(depth)
    return [block.strip() for block in [*out, text[start:]] if block.strip()]


HIDDEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|@\"(?:\"\"|[^\"])*\"?|\"\"\".*?(?:\"\"\"|\Z)|\$?\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])+'", re.DOTALL)
NAMESPACE = re.compile(r"\bnamespace\s+([\w.]+)")
TYPE = re.compile(r"\b(?:class|struct|interface|record(?:\s+(?:class|struct))?)\s+(\w+)")
PLAIN_TYPE = re.compile(r"\b(?:enum\s+(\w+)|delegate\s+[^(;{]*?(\w+)\s*(?:<[^>]*>)?\s*\()")
OPERATOR = re.compile(r"\boperator\s+(\S+?)\s*\(")


def member_name(head: str) -> str | None:
    """The declared name of a member's head (its text up to the body), or None if it declares nothing."""
    head = re.sub(r"\[[^\]]*\]\s*(?=[\w\[])", "", head, count=0) if head.lstrip().startswith("[") else head
    if operator := OPERATOR.search(head):
        return f"operator {operator[1]}"
    if re.search(r"\bthis\s*\[", head):
        return "this[]"
    before = re.split(r"=(?!>)|=>|\{", head)[0]
    if "(" in before:
        name = re.search(r"(~?\w+)\s*(?:<[^>()]*>)?\s*\(", before)
    else:
        name = re.search(r"(\w+)\s*(?:,.*)?;?\s*$", before.strip().rstrip(";"), re.DOTALL) if len(before.split()) >= 2 else None
        name = re.search(r"(\w+)\s*$", before.strip().rstrip(";").split(",")[0]) if name else None
    return name[1] if name else None


def declarations(masked: str, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, body start, body end) of what stands side by side in a range; the body is empty without braces."""
    at, depth, begin, body, round_ = start, 0, start, 0, 0
    for hit in re.compile(r"[{}();]").finditer(masked, start, end):
        c = hit[0]
        if c == "{":
            if depth == 0:
                body = hit.end()
            depth += 1
        elif c == "}":
            depth -= 1
            if depth < 0:
                return
            if depth == 0 and round_ == 0:
                tail = re.compile(r"\s*=[^;]*;").match(masked, hit.end(), end)  # an initialiser behind a property
                at = tail.end() if tail else hit.end()
                if not re.search(r"=\s*(?:new\b[^;]*)?$|=>[^;]*$", masked[begin : body - 1]) or tail:
                    yield begin, at, body, hit.start()
                    begin = at
        elif depth == 0:
            round_ = max(0, round_ + (c == "(") - (c == ")"))
            if c == ";" and round_ == 0 and hit.end() > begin:
                if hit.end() > at:
                    yield begin, hit.end(), 0, 0
                begin = at = hit.end()


def chunk_members(text: str) -> list[str]:
    """C# members, one chunk each behind a line that names them; an approximation without a compiler's parser.

    A nested type's chunks precede its parent's own; a type without members of its own is one chunk; without any
    declaration the whole text is.
    """
    masked = HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out: list[str] = []

    def put(path: list[str], start: int, end: int) -> None:
        out.append(f"// {'.'.join(p for p in path if p)}\n{text[start:end].strip()}")

    def walk(start: int, end: int, space: str, outer: list[str]) -> int:
        """Chunks of a range; how many of them are members of the type that it is the body of."""
        own: list[tuple[list[str], int, int]] = []
        for first, last, body, stop in declarations(masked, start, end):
            head = masked[first : body - 1 if body else last]
            if named := NAMESPACE.search(head):
                if body:
                    walk(body, stop, named[1], [])
                else:
                    space = named[1]
                continue
            if re.match(r"\s*(?:global\s+)?using\b(?!\s*\()", head):
                continue
            plain = PLAIN_TYPE.search(head)
            typed = None if plain else TYPE.search(head)
            if typed:
                path = [*outer, typed[1]]
                if not (walk(body, stop, space, path) if body else 0):
                    put([space, *path], first, last)
            elif plain:
                if not outer:
                    put([space, plain[1] or plain[2]], first, last)
            elif outer and (name := member_name(head)):
                own.append(([space, *outer, name], first, last))
        for item in own:
            put(*item)
        return len(own)

    walk(0, len(masked), "", [])
    return out or ([text.strip()] if text.strip() else [])


def route(text: str, language: str | None, is_code: bool, options: Options = Options()) -> list[str]:
    """The chunker for a document's kind; a strategy registered in ``STRATEGIES`` takes its languages."""
    if options.use_structure and is_code and language:
        for languages, strategy in STRATEGIES:
            if language.lower() in languages:
                return strategy(text)
    return chunk_code_lines(text, options.code_size, options.code_overlap) if is_code else chunk_sentences(text, options.chunk_size, options.chunk_overlap)


#: (languages, chunker of a text): the first that knows a language is used.
STRATEGIES = [(frozenset(["csharp"]), chunk_members), (BRACED, chunk_braces)]


def cut_batch(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with about ``SLICE_BYTES`` of its text column each, so that few texts and chunks are Python's at once."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while start < len(ends):
        n = max(1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE_BYTES, "right")) - start)
        yield batch.slice(start, n)
        start += n


def chunk_table(df: DataFrame, chunker, keys: tuple[str, ...] = ("doc_id",), text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, chunk_ord and text of each chunk; ``chunker(text, *more columns)``. A null text has no chunks."""
    rows = df.select(*[F.col(k) for k in keys], F.col(text).alias("__text"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in cut_batch(whole, len(keys))):
            extra = [column.to_pylist() for column in batch.columns[len(keys) + 1 :]]
            found = [chunker(t, *[c[n] for c in extra]) if t is not None else [] for n, t in enumerate(batch.column(len(keys)).to_pylist())]
            at = pa.array([n for n, own in enumerate(found) for _ in own], pa.int32())
            # keys stay in Arrow, so nulls and large integers stay what they are
            kept = [batch.column(i).take(at) for i in range(len(keys))]
            order, chunks = pa.array([i for own in found for i in range(len(own))], pa.int32()), pa.array([chunk for own in found for chunk in own], pa.string())
            yield pa.RecordBatch.from_arrays([*kept, order, chunks], [*keys, "chunk_ord", "text"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}, chunk_ord int, text string")


def chunk_documents(df: DataFrame, options: Options = Options()) -> DataFrame:
    """Source documents (doc_ord, content, language, is_code, …) to chunks, each by its kind."""
    return chunk_table(df, lambda text, language, is_code: route(text, language, bool(is_code), options), ("doc_ord",), "content", ("language", "is_code"))
