"""Snippets, chunk quality, line numbers and path facts as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\p{Z}]"
# fixed value: the characters that count as punctuation
PUNCTUATION = r"""[{}();,\[\]<>:.|&!?+\-*/=^%~@#$"'`\\]"""

# fixed values: extensions that are never text, extensions of languages, other text extensions
BINARY = frozenset(
    "7z avi bin bmp class dll doc docx dylib eot exe gif gz ico jpeg jpg lock mov mp3 mp4 o obj pickle png pptx pyc pyo rar so svg tar ttf wav webp woff woff2 xls xlsx zip".split()
)
LANGUAGES = {
    **dict.fromkeys("bash fish sh zsh".split(), "bash"),
    **dict.fromkeys("js jsx".split(), "javascript"),
    **dict.fromkeys("ts tsx".split(), "typescript"),
    **dict.fromkeys("cpp hpp".split(), "cpp"),
    **dict.fromkeys("c h".split(), "c"),
    **{"bat": "batch", "cs": "csharp", "go": "go", "java": "java", "jl": "julia", "kt": "kotlin", "php": "php", "ps1": "powershell"},
    **{"py": "python", "r": "r", "rb": "ruby", "rs": "rust", "scala": "scala", "sql": "sql", "swift": "swift"},
}
PROSE = frozenset("cfg conf css dockerfile dockerignore editorconfig gitattributes htm html ini json less markdown md pdf rst scss svelte toml txt vue xml yaml yml".split())


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def snippet(text: Column, most: int = 600) -> Column:
    """At most ``most`` characters, cut after a sentence, else at a line, else at a space, in the second half."""
    window, least = F.substring(text, 1, most), most // 2
    sentence = F.length(F.regexp_extract(window, r"(?s)^(.*[.!?] )", 1))  # ends after the space
    line = F.length(F.regexp_extract(window, r"(?s)^(.*\n)", 1)) - 1
    space = F.length(F.regexp_extract(window, r"(?s)^(.* )", 1)) - 1
    end = lambda n: F.concat(F.regexp_replace(F.substring(window, F.lit(1), n), rf"{SPACE}+$", ""), F.lit("…"))
    cut = F.when(sentence - 2 >= least, end(sentence - 1)).when(line >= least, end(line)).when(space >= least, end(space))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "").when(F.length(text) <= most, text).otherwise(F.coalesce(cut, F.concat(window, F.lit("…"))))


def punctuation_ratio(text: Column) -> Column:
    """Punctuation among the characters that aren't white space; 0 for blank text."""
    solid = F.length(F.regexp_replace(text, rf"{SPACE}", ""))
    marks = solid - F.length(F.regexp_replace(F.regexp_replace(text, rf"{SPACE}", ""), PUNCTUATION, ""))
    return F.when(solid == 0, 0.0).otherwise(marks / solid)


def acceptable(text: Column) -> Column:
    """Whether a chunk says something: long enough, not mostly punctuation, no base64 run, no ruler of underscores."""
    body = F.coalesce(text, F.lit(""))
    return (F.length(trimmed(body)) >= 20) & (punctuation_ratio(body) <= 0.70) & ~body.rlike("[A-Za-z0-9+/]{200,}") & ~body.rlike("_{11,}")


def extension(path: Column) -> Column:
    """Lower-cased extension without its dot; '' if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in sorted(LANGUAGES.items()) for x in pair])
    return F.try_element_at(table, extension(path))


def indexable(path: Column, whitelist: set[str] | None = None) -> Column:
    """Not a binary extension, and one of the whitelist's (by default all known ones)."""
    kept = sorted(x.lower().lstrip(".") for x in whitelist) if whitelist is not None else sorted({*LANGUAGES, *PROSE})
    return ~extension(path).isin(sorted(BINARY)) & extension(path).isin(kept)


def hidden(path: Column) -> Column:
    """Whether a file or a directory above it begins with a dot."""
    return path.rlike(r"(^|/)\.")
