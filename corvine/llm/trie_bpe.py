"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch of texts are walked as a trie, depth first: words in sorted order share the
states of their common prefix, and a stack holds the states of the current path. The state of a prefix is the
last token of its encoding; the encoding itself is that token after the encoding of the prefix without it, so
a prefix is worked out at most once (when a longer one asks for it), by finding the one token that ends it and may
follow the state before it. Two tokens may follow one another if no merge across their border comes before the
merges that make them, which is read off the merge tree; answers are kept.

Normalising (NFC, white space, lower case), splitting and the byte alphabet follow the tokenizer file. The
result equals the tokenizers library's on the file, specials in the text included, which tests check.

Memory: words, pairs and pieces are kept in dictionaries of bounded size (``MAX_KEPT``), started anew when full;
a batch of texts is one Arrow batch. No shuffle.

Defined results: null and '' give no ids and an empty decoded text; repeated rows repeat; very long words are
walked like others; a null key stays null; other columns are left behind.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.common import slices
from corvine.llm.encoding import byte_alphabet, rare_collections

MAX_KEPT = 600_000
MAX_WORD = 64
NEVER = 1 << 30
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class TrieBpe:
    """Encoder and decoder of one tokenizer file of the word-end kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        model = config["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.made = {left + right: (rank, left, right) for (left, right), rank in self.ranks.items()}
        # one way to make each token, from tokens made before, as training gives it; else merging is played through
        early = lambda part, rank: part not in self.made or self.made[part][0] < rank
        self.ordered = len(self.made) == len(self.ranks) and all(early(left, rank) and early(right, rank) for (left, right), rank in self.ranks.items())
        self.edges: tuple[dict, dict] = ({}, {})
        self.wholes: dict[str, bool] = {}
        self.specials = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.specials.items()}
        self.longest = max(len(t) - (len(self.suffix) if t.endswith(self.suffix) else 0) for t in self.vocab)
        pattern = next(p["pattern"]["Regex"] for p in config["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace("[^\\s", f"[^{SPACES}"))
        self.white = re.compile(f"[{SPACES}]+")
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.letters = byte_alphabet()
        self.table = {b: c for b, c in self.letters.items()}
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.pieces: dict[str, tuple[np.ndarray, str]] = {}

    # -- merging two tokens ------------------------------------------------
    def symbols(self, text: str, ends: bool) -> list[str]:
        parts = list(text)
        if ends:
            parts[-1] += self.suffix
        return parts

    def merged(self, parts: list[str]) -> list[str]:
        """Plain BPE: the lowest rank first, leftmost first."""
        ranks = self.ranks
        while len(parts) > 1:
            best = min(((ranks.get(pair, 1 << 30), i) for i, pair in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def edge(self, token: str, side: int) -> tuple[list[str], list[int]]:
        """What stands at a token's right (0) or left (1) border as it is made, and the rank that ends each stage."""
        known = self.edges[side].get(token)
        if known is None:
            stages, ends, at = [token], [NEVER], token
            while at in self.made:
                rank, left, right = self.made[at]
                at = left if side else right
                stages.append(at)
                ends.append(rank)
            known = self.edges[side][token] = stages[::-1], ends[::-1]
        return known

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging the text of two (whole) tokens gives the two of them."""
        if not self.ordered:
            ends = bool(self.suffix) and right.endswith(self.suffix)
            text = right[: -len(self.suffix)] if ends else right
            return self.merged([*left, *self.symbols(text, ends)]) == [left, right]
        (lefts, left_ends), (rights, right_ends) = self.edge(left, 0), self.edge(right, 1)
        i = j = 0
        while True:
            rank = self.ranks.get((lefts[i], rights[j]), NEVER)
            # of equal ranks the leftmost merge comes first
            if rank < left_ends[i] and rank <= right_ends[j]:
                return False
            if left_ends[i] <= right_ends[j]:
                if left_ends[i] == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def follows(self, left: str, right: str) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            known = self.pairs[left, right] = self.may_follow(left, right)
        return known

    def whole(self, token: str) -> bool:
        """Whether merging a token's text gives the token."""
        known = self.wholes.get(token)
        if known is None:
            ends = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
            known = self.wholes[token] = self.merged(self.symbols(token[: -len(self.suffix)] if ends else token, ends)) == [token]
        return known

    def last_token(self, word: str, end: int, states: list[str | None], ends: bool) -> str:
        """The token that ends the encoding of ``word[:end]``; ``states[i]`` is that of ``word[:i]``, None if not asked for yet."""
        vocab, tail = self.vocab, self.suffix if ends else ""
        for start in range(max(0, end - self.longest), end):
            token = word[start:end] + tail
            if token in vocab and self.whole(token):
                if not start:
                    return token
                before = states[start]
                if before is None:
                    before = states[start] = self.last_token(word, start, states, False)
                if self.follows(before, token):
                    return token
        raise ValueError(f"no token ends {word[:end]!r}")

    # -- the trie ----------------------------------------------------------
    def walk(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of distinct words (over the byte alphabet), by depth-first traversal of their trie."""
        found: dict[str, tuple[int, ...]] = {}
        states: list[str | None] = [""]  # the path: states[i] ends the encoding of the first i characters
        size, vocab = len(self.suffix), self.vocab
        before = ""
        for word in sorted(words):
            shared = len(commonprefix((before, word)))
            del states[shared + 1 :]
            states += [None] * (len(word) - len(states))
            if len(word) > MAX_WORD:  # in order, so that asking back never goes deep
                for end in range(1, len(word)):
                    if states[end] is None:
                        states[end] = self.last_token(word, end, states, False)
            token = self.last_token(word, len(word), states, True)
            at, ids = len(word) - len(token) + size, [vocab[token]]
            while at > 0:
                last = states[at]
                if last is None:
                    last = states[at] = self.last_token(word, at, states, False)
                ids.append(vocab[last])
                at -= len(last)
            found[word] = tuple(reversed(ids))
            before = word[: len(states) - 1] if len(states) - 1 < len(word) else word
        return found

    # -- texts -------------------------------------------------------------
    def words_of(self, piece: str) -> list[str]:
        """The piece's words over the byte alphabet, in order; specials as they are, marked by a NUL."""
        out: list[str] = []
        at = 0
        for hit in self.special.finditer(piece) if self.special else ():
            out += self._plain(piece[at : hit.start()])
            out.append("\0" + hit[0])
            at = hit.end()
        return out + self._plain(piece[at:])

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = self.white.sub(" ", text).lower()
        if text.isalpha():
            words = [text]
        elif text[:-1].isalpha() and text[-1] in ",.":
            words = [text[:-1], text[-1]]
        else:
            words = [w for w in self.split.findall(text) if w]
        # printable ASCII stands for itself in the byte alphabet
        return [w if w.isascii() and w.isprintable() else "".join(map(self.table.__getitem__, w.encode("utf-8", "surrogatepass"))) for w in words]

    def learn(self, texts: list[str]) -> None:
        """Encode the new pieces of a batch of texts."""
        if len(self.pieces) > MAX_KEPT or len(self.words) > MAX_KEPT or len(self.pairs) > 4 * MAX_KEPT:
            self.clear()
        new: set[str] = set()
        for text in texts:
            new.update(text.replace("\n", " ").split(" "))
        cut = {piece: self.words_of(piece) for piece in new.difference(self.pieces)}
        self.words |= self.walk([w for w in {w for ws in cut.values() for w in ws}.difference(self.words) if w[0] != "\0"])
        for piece, words in cut.items():
            ids = [i for w in words for i in ((self.specials[w[1:]],) if w[0] == "\0" else self.words[w])]
            self.pieces[piece] = np.array(ids, "<u4").tobytes(), " ".join([self.names[i] for i in ids])

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text: its ids as little-endian unsigned 32-bit integers, and the decoded text."""
        self.learn(texts)
        out = []
        get = self.pieces.__getitem__
        for text in texts:
            parts = list(map(get, text.replace("\n", " ").split(" ")))
            out.append((b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[1]])))
        return out


_models: dict[str, TrieBpe] = {}


def trie_bpe(path: str) -> TrieBpe:
    if path not in _models:
        rare_collections()
        _models[path] = TrieBpe(path)
    return _models[path]


def encode_texts(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", full: bool = False) -> DataFrame:
    """``key`` with n_tokens and the SHA-256 of ids and of the decoded text; with ``full`` also ids and decoded."""
    rows = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trie_bpe(path)
        for batch in batches:
            for start, n in slices(batch.column(1)):
                done = model.encode_batch(batch.column(1).slice(start, n).to_pylist())
                columns = {
                    "n_tokens": pa.array([len(ids) // 4 for ids, _ in done], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in done], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(decoded.encode()).hexdigest() for _, decoded in done], pa.string()),
                }
                if full:
                    columns["ids"] = pa.array([np.frombuffer(ids, "<u4").astype("int32") for ids, _ in done], pa.list_(pa.int32()))
                    columns["decoded"] = pa.array([decoded for _, decoded in done], pa.string())
                # the key stays in Arrow, so nulls and large integers stay what they are
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), *columns.values()], [key, *columns])

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full)
