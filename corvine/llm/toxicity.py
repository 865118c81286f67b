"""Toxicity by a convolutional text classifier trained in numpy.

Words are hashed into ``BUCKETS`` embedding rows; filters of widths 1, 2 and 3 slide over a text's words, each
filter's largest response over the whole text passes a rectifier, and a logistic layer turns the responses into a
score. A score depends on the text alone: labels, language, source and key are no inputs of it.

Training is bounded: at most ``MAX_POSITIVE`` toxic and ``MAX_NEGATIVE`` other labelled rows, chosen by the hash of
their key among rows that are not held out (crc32 of the key as text, modulo 4, is 2), with texts of at most
``MAX_TRAIN_CHARS`` characters. Everything else covers all rows: every whole text is scored on the executors, in
one ``mapInArrow`` without a shuffle, with a model of about 4 MB that doesn't grow. Words in too few
sampled texts (``MIN_DOCS``, ``MIN_SHARE``) keep a zero embedding, so what was never learnt says nothing.

A fifth of the sample calibrates: a logistic rescaling under the classes' shares among all training rows, then for
each language the threshold of best F1, shrunk towards the general one. The thresholds decide ``rejected`` only.

Defined results: null and '' texts get the score of a text without known words; without labels of both classes
every score is the share of toxic ones; several labels of one key count as toxic if one is; repeated rows repeat;
a null key is not held out; other columns are left behind unless asked for.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.llm.common import slices
from corvine.llm.encoding import PieceEncoder, alone

BUCKETS = 1 << 17
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
MAX_POSITIVE, MAX_NEGATIVE, MAX_TRAIN_CHARS = 2000, 4000, 40_000
#: A word is learnt if so many sampled texts, and one in MIN_SHARE of them, have it.
MIN_DOCS, MIN_SHARE = 3, 400
THRESHOLD = 0.3
PAD = 0
STEMS = (4, 5, 6)
PARTS = 1 + len(STEMS)
WORD = re.compile(r"\w+")


def bucket(word: str) -> int:
    return 1 + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)


class WordHasher(PieceEncoder):
    """Bucket numbers (1 and up) of a text's words, in order, ``PARTS`` a word; cached by white-space piece.

    A word's parts are itself and its first 4, 5 and 6 letters (PAD where it is no longer than that), so that
    compounds and inflections of a learnt stem are known too; its embedding is the sum of theirs.
    """

    def __init__(self) -> None:
        self.spaceless, self.dtype = True, np.int32
        self.clear()

    def piece(self, text: str) -> list[int]:
        parts = []
        for word in WORD.findall(text.lower()):
            parts.append(bucket(word))
            parts += [bucket(f"{word[:n]}*") if len(word) > n else PAD for n in STEMS]
        return parts


_hasher: list[WordHasher] = []


def hasher() -> WordHasher:
    if not _hasher:
        _hasher.append(WordHasher())
    return alone(_hasher[0])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Embeddings (row PAD is zero), filters by width and place, the logistic layer, the rescaling, thresholds."""

    embedding: np.ndarray
    filters: np.ndarray  # (DIM, places, FILTERS): width 1 has place 0; width 2 places 1-2; width 3 places 3-5
    bias: np.ndarray  # (len(WIDTHS), FILTERS)
    out: np.ndarray  # (len(WIDTHS) * FILTERS)
    shift: float
    scale: float = 1.0
    offset: float = 0.0
    constant: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def responses(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Every filter's value at every place; ``words`` holds padded texts end to end, each up to one of ``ends``.

        Places in a text's padding, from where a filter would reach the next text, don't count.
        """
        places = np.concatenate([words, np.zeros((max(WIDTHS) - 1, PARTS), words.dtype)])
        vectors = self.embedding[places[:, 0]]
        for part in range(1, PARTS):
            vectors += self.embedding[places[:, part]]
        rows = vectors @ self.filters.reshape(DIM, -1)
        rows = rows.reshape(len(places), -1, FILTERS)
        n, at, out = len(words), 0, []
        for w, width in enumerate(WIDTHS):
            total = rows[:n, at].copy()
            for k in range(1, width):
                total += rows[k : n + k, at + k]
            out.append(total + self.bias[w])
            at += width
        values = np.concatenate(out, axis=1)
        for back in range(1, max(WIDTHS)):
            values[ends - back] = -np.inf
        return values

    def raw(self, texts: list[np.ndarray]) -> np.ndarray:
        """The logistic layer's input for padded texts."""
        ends = np.cumsum([*map(len, texts)])
        values = self.responses(np.concatenate(texts), ends)
        pooled = np.maximum(np.maximum.reduceat(values, np.r_[0, ends[:-1]], axis=0), 0)
        return pooled @ self.out + self.shift

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        return sigmoid(self.scale * self.raw(texts).astype(float) + self.offset)


def padded(words: np.ndarray) -> np.ndarray:
    """A text's buckets before zero rows that a filter's end may reach; a text without words has one zero row more."""
    return np.concatenate([words.astype(np.int32).reshape(-1, PARTS), np.zeros((max(WIDTHS) - (len(words) > 0), PARTS), np.int32)])


def train(texts: list[np.ndarray], labels: np.ndarray, epochs: int = 6, seed: int = 7) -> Model:
    """Adam on the logistic loss; classes weigh the same; the embedding's gradient touches the rows that won the pooling."""
    rng = np.random.default_rng(seed)
    places = sum(WIDTHS)
    counts = np.zeros((2, BUCKETS))
    for words, label in zip(texts, labels):
        counts[int(label), np.unique(words)] += 1
    seen = counts.sum(axis=0)
    known = seen >= max(MIN_DOCS, len(texts) // MIN_SHARE)
    known[PAD] = False
    embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    # the first dimension starts as how surely a bucket's log odds between the classes differ from none
    n_pos, n_neg = labels.sum(), (1 - labels).sum()
    odds = np.log((counts[1] + 0.5) / (n_pos + 1)) - np.log((counts[0] + 0.5) / (n_neg + 1))
    embedding[:, 0] += 0.3 * np.clip(odds / np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5)), -4, 4)
    embedding[~known] = 0
    out = np.where(np.arange(len(WIDTHS) * FILTERS) % 4 == 3, -0.5, 0.5).astype(np.float32)
    filters = rng.normal(0, 0.3, (DIM, places, FILTERS)).astype(np.float32)
    filters[0] += np.where(np.arange(FILTERS) % 4 == 3, -0.5, 0.5)
    model = Model(embedding, filters, np.full((len(WIDTHS), FILTERS), -0.3, np.float32), out, -1.0)
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    dense = {"filters": model.filters, "bias": model.bias, "out": model.out}
    moments = {name: (np.zeros_like(x), np.zeros_like(x)) for name, x in dense.items()}
    squares = np.zeros(BUCKETS, np.float32)
    shift_moments = [0.0, 0.0]
    order, step, rate, batch = np.arange(len(texts)), 0, 0.02, 32
    epochs = max(epochs, min(40, -(-6000 // max(1, len(texts)))))
    for epoch in range(epochs):
        rng.shuffle(order)
        speed = rate * (1 - 0.8 * epoch / epochs)
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            words = np.concatenate([texts[i] for i in chosen])
            ends = np.cumsum([len(texts[i]) for i in chosen])
            values = model.responses(words, ends)
            winners = np.stack([start + values[start:end].argmax(axis=0) for start, end in zip(np.r_[0, ends[:-1]], ends)])
            columns = np.arange(values.shape[1])
            best = values[winners, columns]
            pooled = np.maximum(best, 0)
            error = (sigmoid(pooled @ model.out + model.shift) - labels[chosen]) * weight[chosen] / len(chosen)
            gradient = {"out": (pooled * error[:, None]).sum(axis=0) + 1e-4 * model.out}
            inner = error[:, None] * model.out * (best > 0)
            gradient["bias"] = inner.sum(axis=0).reshape(len(WIDTHS), FILTERS)
            gradient["filters"] = 1e-4 * model.filters
            longer = np.concatenate([words, np.zeros((max(WIDTHS) - 1, PARTS), words.dtype)])
            rows, deltas, place = [], [], 0
            for w, width in enumerate(WIDTHS):
                part = inner[:, w * FILTERS : (w + 1) * FILTERS]
                for k in range(width):
                    hit = longer[winners[:, w * FILTERS : (w + 1) * FILTERS] + k]
                    gradient["filters"][:, place] += np.einsum("bf,bfd->df", part, model.embedding[hit].sum(axis=2))
                    rows.append(hit.reshape(-1))
                    deltas.append(np.repeat((part[:, :, None] * model.filters[:, place].T).reshape(-1, DIM), PARTS, axis=0))
                    place += 1
            step += 1
            for name, x in dense.items():
                first, second = moments[name]
                first += 0.1 * (gradient[name] - first)
                second += 0.001 * (gradient[name] ** 2 - second)
                x -= speed * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            slope = float(error.sum())
            shift_moments[0] += 0.1 * (slope - shift_moments[0])
            shift_moments[1] += 0.001 * (slope**2 - shift_moments[1])
            model.shift -= speed * (shift_moments[0] / (1 - 0.9**step)) / (np.sqrt(shift_moments[1] / (1 - 0.999**step)) + 1e-8)
            rows, inverse = np.unique(np.concatenate(rows), return_inverse=True)
            summed = np.zeros((len(rows), DIM), np.float32)
            np.add.at(summed, inverse, np.concatenate(deltas))
            summed[~known[rows]] = 0
            squares[rows] += (summed**2).mean(axis=1)
            model.embedding[rows] -= 5 * speed * summed / (np.sqrt(squares[rows]) + 1e-6)[:, None]
            model.embedding[rows] *= 1 - 0.01 * speed
    return model


def calibrate(model: Model, texts: list[np.ndarray], labels: np.ndarray, languages: list[str | None], share: float) -> None:
    """Rescale so that scores are probabilities under the share of toxic rows; set a threshold for each language."""
    raw = np.concatenate([model.raw(texts[i : i + 64]) for i in range(0, len(texts), 64)]).astype(float)
    n_pos, n_neg = max(1, labels.sum()), max(1, (1 - labels).sum())
    weight = np.where(labels == 1, share / n_pos, (1 - share) / n_neg) * len(labels)
    goal = np.where(labels == 1, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * raw + b)
        g = np.array([(weight * (p - goal) * raw).sum() + 0.1 * (a - 1), (weight * (p - goal)).sum()])
        s = weight * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(s * raw * raw).sum() + 0.1, (s * raw).sum()], [(s * raw).sum(), s.sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        a, b = float(np.clip(a - np.clip(da, -0.5, 0.5), 0.2, 5)), b - float(np.clip(db, -1, 1))
    model.scale, model.offset = a, b
    score = sigmoid(a * raw + b)

    def best(at: np.ndarray, prior: float) -> float:
        grid = np.linspace(0.1, 0.9, 33)
        y, w = labels[at] == 1, weight[at]
        f1 = [2 * w[y & (score[at] >= t)].sum() / max(1e-9, w[y].sum() + w[score[at] >= t].sum()) for t in grid]
        top = grid[np.array(f1) >= max(f1) - 1e-9]
        found = float(top[np.abs(top - prior).argmin()])
        pull = len(at) / (len(at) + 200)
        return pull * found + (1 - pull) * prior

    general = best(np.arange(len(labels)), THRESHOLD)
    model.thresholds = {"": general}
    for language in sorted({x for x in languages if x}):
        at = np.array([i for i, x in enumerate(languages) if x == language])
        model.thresholds[language] = best(at, general) if labels[at].any() else general


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", language: str = "lang") -> Model:
    """Train on the bounded sample of labelled rows that are not held out."""
    rows = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("__y"))
    counts = {row["__y"]: row["n"] for row in rows.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    positive, negative = counts.get(1, 0), counts.get(0, 0)
    share = (positive + 1) / (positive + negative + 10)
    chosen = rows.where("__y = 1").orderBy(F.xxhash64(key), key).limit(MAX_POSITIVE).unionByName(rows.where("__y = 0").orderBy(F.xxhash64(key), key).limit(MAX_NEGATIVE))
    spoken = F.col(language).cast("string") if language in docs.columns else F.lit(None).cast("string")
    whole = F.coalesce(F.col(text), F.lit(""))
    # the sample's keys are at most MAX_POSITIVE + MAX_NEGATIVE rows, so broadcasting them is safe at any size
    sample = docs.where(F.length(whole) <= MAX_TRAIN_CHARS).select(F.col(key).alias(key), whole.alias("__text"), spoken.alias("__lang")).join(F.broadcast(chosen), key)
    found = sample.orderBy(F.xxhash64(key), key, F.xxhash64("__text")).limit(2 * (MAX_POSITIVE + MAX_NEGATIVE)).toPandas()
    y = found["__y"].to_numpy(dtype=np.int64) if len(found) else np.zeros(0, np.int64)
    if y.sum() < 2 or (1 - y).sum() < 2:
        return Model(np.zeros((1, DIM), np.float32), np.zeros((DIM, sum(WIDTHS), FILTERS), np.float32), np.zeros((len(WIDTHS), FILTERS), np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), 0.0, constant=share)
    tool = hasher()
    texts = [padded(tool.encode(t)) for t in found["__text"]]
    test = np.arange(len(y)) % 5 == 4
    if y[test].sum() < 5:
        test[:] = True
        model = train(texts, y)
    else:
        model = train([t for t, x in zip(texts, test) if not x], y[~test])
    calibrate(model, [t for t, x in zip(texts, test) if x], y[test], [x if isinstance(x, str) else None for x in found["__lang"][test]], share)
    return model


def judged(model: Model, texts: pa.Array, languages: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
    """Scores of a batch's texts, and which of them their language's threshold rejects; few texts are Python's at once."""
    tool, scores = hasher(), [np.zeros(0)]
    for start, n in slices(texts):
        waiting, held = [], 0
        for words in texts.slice(start, n):
            waiting.append(padded(tool.encode(words.as_py())))
            held += len(waiting[-1])
            if held > 60_000:
                scores.append(model.scores(waiting))
                waiting, held = [], 0
        scores.append(model.scores(waiting))
    score = np.concatenate(scores)
    general = model.thresholds.get("", THRESHOLD)
    spoken = languages.to_pylist() if languages is not None else [None] * len(score)
    return score, score >= np.array([model.thresholds.get(x, general) if x else general for x in spoken], float)


def score_texts(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", language: str | None = None) -> DataFrame:
    """``key`` with the score of each whole text, and whether its language's threshold rejects it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key), F.col(text), F.col(language).cast("string") if language else F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, rejected = judged(shared.value, batch.column(1), batch.column(2))
            # the key stays in Arrow, so nulls and large integers stay what they are
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(rejected)], [key, "score", "rejected"])

    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, rejected boolean")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (score at or over the threshold), and rejected (by language)."""
    model = fit(docs, labels)
    scored = score_texts(docs, model, language="lang" if "lang" in docs.columns else None)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "rejected")


def keep_civil(docs: DataFrame, labels: DataFrame, text: str = "text", language: str = "lang") -> DataFrame:
    """The documents, all columns, without those that their language's threshold rejects."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at, spoken = docs.columns.index(text), docs.columns.index(language) if language in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in slices(batch.column(at)):
                part = batch.slice(start, n)
                _, rejected = judged(shared.value, part.column(at), None if spoken is None else part.column(spoken))
                yield part.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
