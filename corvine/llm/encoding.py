"""Encoding whole texts with a public tokenizer file through the tokenizers library, each distinct piece once a worker.

``PieceEncoder`` cuts a text at single spaces where the tokenizer's own rules allow it, encodes each piece that
its cache doesn't hold with the library, and gathers the ids of a text from a flat pool of cached ids. The cache
is bounded (``MAX_PIECES``) and starts anew when it is full, so memory doesn't grow with the corpus.

Where a cut could change the ids (for byte-level files: a run of two or more white-space characters around a
space) the whole text goes to the library. Both routes give exactly the library's ids; tests compare them.
"""

from __future__ import annotations

import gc
import json
import os
import unicodedata
from array import array
from collections.abc import Sequence

import numpy as np

MAX_PIECES, MAX_UNITS = 300_000, 300_000
MAX_PIECE_CHARS = 64


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """Piece -> number; a missing piece is encoded and numbered."""

    def __init__(self, owner: PieceEncoder, lead: str):
        self.owner, self.lead = owner, lead

    def __missing__(self, piece: str) -> int:
        owner = self.owner
        owner.pool.extend(owner.piece(self.lead + piece))
        number = len(owner.ends) - 1
        owner.ends.append(len(owner.pool))
        if self.lead and (not piece or piece[0].isspace()):
            self.owner.risky.add(number)
        if len(piece) <= MAX_PIECE_CHARS:
            self[piece] = number
        return number


class PieceEncoder:
    """ids of texts as the library gives them with add_special_tokens=False.

    A piece is cut once more into the units that the file's own pattern makes of it, which merge on their own;
    pieces differ far more than units (``end.\\nNext``, ``word,``), so most new pieces cost lookups only.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.spaceless = "\\s" in json.dumps(config["normalizer"] or "") and config["pre_tokenizer"]["type"] == "Sequence"
        self.specials = [token["content"] for token in config["added_tokens"]]
        if self.spaceless:
            pattern = next(p["pattern"]["Regex"] for p in config["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        else:
            pattern = public_tokenizers.PATTERN
        self.units_of = regex.compile(pattern).findall
        self.letters = byte_alphabet()
        self.merge = self.tokenizer.model.tokenize
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.pool = array("H" if np.dtype(self.dtype).itemsize == 2 else "I" if np.dtype(self.dtype).itemsize == 4 else "Q")
        self.ends = array("q", [0])
        self.risky: set[int] = set()
        self.units: dict[str, array] = {}
        self.first, self.inner = _Pieces(self, ""), _Pieces(self, "" if self.spaceless else " ")

    def library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def unit(self, unit: str) -> array:
        """The ids of what merges on its own."""
        ids = self.units.get(unit)
        if ids is None:
            letters = unit.replace(" ", "Ġ") if unit.isascii() and unit.isprintable() else "".join(map(self.letters.__getitem__, unit.encode()))
            ids = array(self.pool.typecode, [token.id for token in self.merge(letters)])
            if len(unit) <= MAX_PIECE_CHARS:
                self.units[unit] = ids
        return ids

    def piece(self, text: str) -> Sequence[int]:
        """A piece's ids, from its units where the text is plain (normalised, printable, no special's mark)."""
        if self.spaceless:
            if not text.isascii() and (not unicodedata.is_normalized("NFC", text) or "Σ" in text or "İ" in text):
                return self.library(text)
            text = text.lower()
            core = text
        else:
            core = text[1:] if text[:1] == " " else text
        if core.isalpha():
            return self.unit(text)
        if core and core[-1] in ",." and core[:-1].isalpha():
            known = self.units.get
            return (known(text[:-1]) or self.unit(text[:-1])) + (known(core[-1]) or self.unit(core[-1]))
        if "<|" in text or not text.replace("\n", "").isprintable():
            return self.library(text)
        out = array(self.pool.typecode)
        for unit in self.units_of(text):
            out += self.unit(unit)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """The ids; empty for null and ''."""
        if not text:
            return np.empty(0, self.dtype)
        if len(self.ends) > MAX_PIECES or len(self.units) > MAX_UNITS:
            self.clear()
        if self.spaceless:
            pieces = text.replace("\n", " ").split(" ")
            numbers = np.fromiter(map(self.inner.__getitem__, pieces), np.int64, len(pieces))
        else:
            pieces = text.split(" ")
            numbers = np.fromiter(map(self.inner.__getitem__, pieces), np.int64, len(pieces))
            numbers[0] = self.first[pieces[0]]
            if self.risky and not self.risky.isdisjoint(numbers[1:].tolist()):
                return np.asarray(self.library(text), self.dtype)
        ends = np.frombuffer(self.ends, np.int64)
        starts = ends[numbers]
        lengths = ends[numbers + 1] - starts
        done = np.cumsum(lengths)
        return np.frombuffer(self.pool, self.dtype)[np.repeat(starts - done + lengths, lengths) + np.arange(done[-1])] if done[-1] else np.empty(0, self.dtype)


_in_use: list[PieceEncoder] = []


def alone(tool: PieceEncoder) -> PieceEncoder:
    """The tool, after the cache of the one that this worker used before is given up: a worker holds one cache at a time."""
    if not _in_use or _in_use[0] is not tool:
        for other in _in_use:
            other.clear()
        _in_use[:] = [tool]
    return tool


def rare_collections() -> None:
    """Look for cycles seldom: encoding makes millions of short-lived objects and caches, but no cycles."""
    gc.set_threshold(200_000, 50, 100)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a tokenizer file, kept from task to task."""
    if path not in _encoders:
        rare_collections()
        _encoders[path] = PieceEncoder(path)
    return alone(_encoders[path])
