"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are words (ASCII letters lower-cased) and word shapes (case, punctuation, symbols); a document's value for an
n-gram is its share among the document's n-grams of that family, so a score is a sparse dot product that doesn't
grow with length.  Five-word windows that recur inside a document count as n-grams of a family of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import U64, Words, lowered, mix64, ship, slices, span_hashes, utf8, windows


@dataclass(frozen=True)
class Settings:
    """max_rows bounds the labelled sample that is fitted (half of each label); it doesn't depend on the input."""

    bits: int = 18
    max_rows: int = 6000
    epochs: int = 4
    alpha: float = 0.5
    beta: float = 0.05
    l1: float = 1e-4
    l2: float = 1e-3
    batch: int = 16
    seed: int = 7


_UPPER, _LOWER, _DIGIT, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_SYMBOL[list(b"#*$%&|<>@=+~^{}[]\\/_")] = True


def _counts(flag: np.ndarray, words: Words) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int32)])
    return total[words.end] - total[words.start]


def _shapes(data: np.ndarray, words: Words) -> np.ndarray:
    """A small code for each word: case, digits, symbols, closing punctuation, length."""
    upper, lower, digit, symbol = (_counts(f[data], words) for f in (_UPPER, _LOWER, _DIGIT, _SYMBOL))
    size = words.end - words.start
    first, last = data[words.start], data[words.end - 1]
    case = np.where((upper > 1) & (lower == 0), 3, np.where((upper == 1) & _UPPER[first], 2, np.where(upper > 0, 1, 0)))
    marks = np.minimum(symbol, 3)
    punct = np.where(np.isin(last, list(b".!?,;:|")), last, 0).astype(np.int64)
    doubled = ((size > 1) & (punct > 0) & (data[np.maximum(words.end - 2, words.start)] == last)).astype(np.int64)
    long = np.minimum(size // 6, 3)
    return ((((case * 4 + marks) * 2 + (digit > 0)) * 256 + punct) * 2 + doubled) * 4 + long


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, slot, value) of every n-gram in the texts of one slice; slots repeat."""
    words = Words(data, offsets)
    if not len(words.start):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.float64)
    lower = span_hashes(lowered(data), words.start, words.end)
    shape = mix64(_shapes(data, words).astype(np.uint64) + U64(977))
    docs, slots, values = [], [], []
    for family, (tokens, width) in enumerate(((lower, 1), (lower, 2), (shape, 1), (shape, 2), (shape, 3))):
        gram, at = windows(words, tokens, width)
        doc = words.doc[at]
        _add(docs, slots, values, doc, gram, family, bits, len(offsets) - 1)
    gram, at = windows(words, lower, 5)
    doc = words.doc[at]
    key = mix64(gram ^ mix64(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    _add(docs, slots, values, doc, again.astype(np.uint64), 5, bits, len(offsets) - 1)
    return np.concatenate(docs), np.concatenate(slots), np.concatenate(values)


def _add(docs, slots, values, doc, gram, family, bits, n) -> None:
    many = np.bincount(doc, minlength=n)
    docs.append(doc)
    slots.append((mix64(gram + U64(family * 7919 + 1)) >> U64(64 - bits)).astype(np.int64))
    values.append(1.0 / np.maximum(many, 1)[doc])


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss (McMahan et al., 2013)."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.z = np.zeros(1 << settings.bits)
        self.n = np.zeros(1 << settings.bits)
        self.zb = self.nb = 0.0

    def _weight(self, z, n):
        s = self.s
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def weights(self) -> tuple[np.ndarray, float]:
        return self._weight(self.z, self.n).astype(np.float32), float(self._weight(np.array(self.zb), np.array(self.nb)))

    def step(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, costs: np.ndarray) -> None:
        slots, place = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
        values = np.concatenate([r[1] for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        w = self._weight(self.z[slots], self.n[slots])
        b = float(self._weight(np.array(self.zb), np.array(self.nb)))
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[place] * values, len(rows)) + b, -35, 35)))
        error = (p - labels) * costs
        g = np.bincount(place, error[owner] * values, len(slots))
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.s.alpha * w
        self.n[slots] = n + g * g
        gb = float(error.sum())
        self.zb += gb - (np.sqrt(self.nb + gb * gb) - np.sqrt(self.nb)) / self.s.alpha * b
        self.nb += gb * gb


Row = tuple[np.ndarray, np.ndarray]


def sparse_rows(data: np.ndarray, offsets: np.ndarray, settings: Settings) -> list[Row]:
    """(slots, values) of each text of a slice, slots distinct and in order."""
    doc, slot, value = features(data, offsets, settings.bits)
    order = np.argsort(doc, kind="stable")
    cuts = np.searchsorted(doc[order], np.arange(len(offsets)))
    out = []
    for i in range(len(offsets) - 1):
        own = order[cuts[i] : cuts[i + 1]]
        unique, place = np.unique(slot[own], return_inverse=True)
        out.append((unique.astype(np.int32), np.bincount(place, value[own], len(unique)).astype(np.float32)))
    return out


def fit(rows: list[Row], labels: np.ndarray, settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Weights and bias from sparse rows and labels; deterministic for a given list."""
    model = Ftrl(settings)
    share = labels.mean() if len(labels) else 0.5
    cost = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    draw = np.random.default_rng(settings.seed)
    for _ in range(settings.epochs if 0 < share < 1 else 0):
        order = draw.permutation(len(rows))
        for k in range(0, len(order), settings.batch):
            own = order[k : k + settings.batch]
            model.step([rows[i] for i in own], labels[own], cost[own])
    return model.weights()


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "quality", text: str = "text", key: str = "doc_id") -> tuple[np.ndarray, float]:
    """Fit on at most settings.max_rows labelled rows, half of each label, those whose keys hash lowest.

    Labels other than 0 and 1, null keys and keys with two labels don't count; without rows of both labels the
    weights are 0 and every score is 0.5.  Null and empty texts are rows without n-grams.
    """
    ship(docs.sparkSession)
    one = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2")
    half = settings.max_rows // 2
    picked = [one.where(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(half).select(F.col(key).alias("k"), "y") for y in (0, 1)]
    # Bounded by max_rows, whatever the input; of rows that repeat a key the smallest text counts.
    sample = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("x")).join(F.broadcast(picked[0].union(picked[1])), "k").groupBy("k", "y").agg(F.min("x").alias("x"))

    def extract(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("x"))
            for a, b in slices(offsets):
                rows = sparse_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], settings)
                part = batch.slice(a, b - a)
                packed = [pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("y"), *packed], ["k", "y", "slots", "weights"])

    def run(batches):
        rows = sorted((k, int(y), s, v) for b in batches for k, y, s, v in zip(*(b.column(c).to_pylist() for c in ("k", "y", "slots", "weights")), strict=True))
        weights, bias = fit([(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32)) for _, _, s, v in rows], np.array([y for _, y, _, _ in rows], float), settings)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    # Texts become sparse rows where they are; one task gets max_rows of these, of at most 2^bits slots each.
    kinds = f"k {sample.schema['k'].dataType.simpleString()}, y {sample.schema['y'].dataType.simpleString()}, slots binary, weights binary"
    row = sample.mapInArrow(extract, kinds).repartition(1).mapInArrow(run, "weights binary, bias double").first()
    return np.frombuffer(row["weights"], np.float32), row["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], settings: Settings = Settings(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key and score, the probability of label 1; texts without words get the bias alone.  One narrow stage."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # 4 * 2^bits bytes

    def run(batches):
        weights, bias = shared.value
        weights = weights.astype(np.float64)
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            out = np.zeros(len(offsets) - 1)
            for a, b in slices(offsets, 1 << 20):
                doc, slot, value = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], settings.bits)
                out[a:b] = np.bincount(doc, weights[slot] * value, b - a)
            p = 1 / (1 + np.exp(-np.clip(out + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(p)], [key, "score"])

    docs = docs.select(key, text)
    return docs.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, score double")
