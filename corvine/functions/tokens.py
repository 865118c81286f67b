"""Identifier-aware tokens as native array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{Mn}\p{Nd}\p{Pc}.\-]+"
SEPARATORS = r"[_.\-]+"
CUT = r"[_.\-]|[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"
HUMPS = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def once(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Runs of letters, marks, digits, connectors, dots and hyphens of at least two characters."""
    return F.filter(F.split(text, NOT_WORD), lambda w: F.length(w) >= 2)


def components(word: Column) -> Column:
    """Distinct lower-cased parts of a word, cut at separators and at humps, of at least two characters.

    Cuts become spaces by a replacement, whose pattern Spark compiles once a task; ``split`` would compile it a word.
    """
    parts = F.split(F.regexp_replace(word, f"{SEPARATORS}|{HUMPS}", " "), " ")
    return F.array_distinct(F.transform(F.filter(parts, lambda p: F.length(p) >= 2), lambda p: F.lower(p)))


def identifier_tokens(text: Column) -> Column:
    """array<struct<term, is_whole_identifier>>: each word whole, then its components that differ from it."""

    def of(word: Column) -> Column:
        whole = F.lower(word)

        def emit(parts: Column) -> Column:
            first = F.struct(whole.alias("term"), whole_identifier(word, parts).alias("is_whole_identifier"))
            rest = F.transform(F.filter(parts, lambda p: p != whole), lambda p: F.struct(p.alias("term"), F.lit(False).alias("is_whole_identifier")))
            return F.concat(F.array(first), rest)

        # most words have neither separator nor hump: they are their own only component
        plain = F.array(F.struct(whole.alias("term"), F.lit(False).alias("is_whole_identifier")))
        return F.when(word.rlike(CUT), once(components(word), emit)).otherwise(plain)

    return F.flatten(F.transform(words(F.coalesce(text, F.lit(""))), of))


def whole_identifier(word: Column, parts: Column) -> Column:
    """Whether a word is more than its only component."""
    return (F.size(parts) > 0) & ~((F.size(parts) == 1) & (F.try_element_at(parts, F.lit(1)) == F.lower(word)))


def terms(text: Column, mark: str = "") -> Column:
    """array<string>: the terms of ``identifier_tokens`` in no order, ``mark`` before those of whole identifiers.

    Words are lower-cased as one array; only those with a separator or hump are looked at again.
    """

    def of(found: Column) -> Column:
        rest = F.transform(F.filter(found, lambda w: w.rlike(CUT)), lambda w: F.filter(components(w), lambda p: p != F.lower(w)))
        flagged = lambda w: w.rlike(CUT) & once(components(w), lambda parts: whole_identifier(w, parts))
        whole = (lambda w: F.when(flagged(w), F.concat(F.lit(mark), F.lower(w))).otherwise(F.lower(w))) if mark else (lambda w: F.lower(w))
        return F.concat(F.transform(found, whole), F.flatten(rest))

    return once(words(F.coalesce(text, F.lit(""))), of)


def whole_identifiers(text: Column) -> Column:
    """How many tokens of a text are whole identifiers."""
    found = F.filter(words(F.coalesce(text, F.lit(""))), lambda w: w.rlike(CUT))
    return F.size(F.filter(found, lambda w: once(components(w), lambda parts: whole_identifier(w, parts))))
