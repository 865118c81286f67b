"""Ignore rules: ordered patterns, the last match wins, ``!`` takes back, a trailing ``/`` means directories.

Each rule becomes one regular expression over a path relative to the root, so the same list decides on the driver
(while a tree is walked) and as a native column over a table of paths.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class IgnoreRule:
    regex: str
    keep: bool
    directory_only: bool


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression: ``*`` and ``?`` cross ``/``, brackets are literal, ``**/`` is any depth."""
    if pattern.startswith("**/"):
        return "(?:.*/)?" + glob_regex(pattern[3:])
    if pattern.endswith("/**"):
        return re.escape(pattern[:-2]) + ".+"
    if "/**/" in pattern:
        head, _, tail = pattern.partition("/**/")
        return f"{glob_regex(head)}/(?:.*/)?{glob_regex(tail)}"
    return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)


def compile_rules(lines: list[str], base: str = "") -> list[IgnoreRule]:
    """The rules of an ignore file that lies in the directory ``base`` ('' for the root)."""
    rules = []
    for line in lines:
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        keep, text = text.startswith("!"), text.removeprefix("!")
        only, text = text.endswith("/"), text.rstrip("/")
        anchored = "/" in text
        text = text.lstrip("/")
        if not text:
            continue
        pattern = text if anchored else f"**/{text}"
        prefix = re.escape(base.strip("/") + "/") if base.strip("/") else ""
        rules.append(IgnoreRule(f"(?s)^{prefix}{glob_regex(pattern)}$", keep, only))
    return rules


def is_ignored(path: str, directory: bool, rules: list[IgnoreRule]) -> bool:
    """Whether the last rule that matches a path ignores it."""
    for rule in reversed(rules):
        if (directory or not rule.directory_only) and re.match(rule.regex, path):
            return not rule.keep
    return False


def ignored(path: Column, rules: list[IgnoreRule]) -> Column:
    """The same for a file's path column: the file itself, or any directory above it, is ignored."""

    def decide(part: Column, directory: bool) -> Column:
        answer = F.lit(False)
        for rule in rules:
            if directory or not rule.directory_only:
                answer = F.when(part.rlike(rule.regex), F.lit(not rule.keep)).otherwise(answer)
        return answer

    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when((F.size(parts) > 1) & F.exists(above, lambda p: decide(p, True)), True).otherwise(decide(path, False))
