"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal.

A text is cut into words and runs of punctuation. Four groups of features are hashed into one
vector: single tokens, pairs of tokens, and pairs and triples of their shapes (case, digits,
punctuation as it stands, and whether a token repeats the one before it), which tell how a text is
written where its words were never seen. A feature's value is its share of its group, so length
does not matter and a score is a sparse dot product.

Training takes at most ``train_rows`` labelled texts (a documented bound, drawn by a digest of the
id over all labelled rows) in one task that keeps their features, and follows the regularised leader
over them ``epochs`` times. The model is one dense vector of ``2 ** bits`` numbers and is broadcast.
Scoring is one narrow pass over all texts, whole.

Defined cases: null and empty texts have no features and score the bias alone; rows without a label
or with one other than 0 and 1 do not train; without any training rows every score is 0.5; a label
given twice trains twice; equal digests are ordered by id; extra columns are kept, an input column
named like the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import whole

BITS = 18
TRAIN_ROWS = 6_000
EPOCHS = 4
THRESHOLD = 0.7
SLICE_CHARS = 2_000_000
TABLE_TOKENS = 400_000

_TOKENS = re.compile(r"[^\W_]+|(?:[^\w\s]|_)+").findall


@dataclass(frozen=True)
class Ftrl:
    """Step sizes and regularisation of FTRL-proximal."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.01


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    rows: int


def _shape(token: str) -> str:
    if not token[0].isalnum():
        return token[:4]
    if token.isdigit():
        return "9"
    if token.isupper():
        return "X" if len(token) > 1 else "x"
    return "x" if token.islower() else "Xx" if token[1:].islower() else "xX"


def _mix(*parts: np.ndarray) -> np.ndarray:
    """A hash of several arrays of hashes, element by element."""
    out = np.zeros_like(parts[0])
    for part in parts:
        out = (out ^ part) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Features:
    """Hashed n-grams of texts; keeps the hashes of the tokens it has met."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.hashes: list[tuple[int, int]] = []
        self.table = np.empty((0, 2), np.uint64)

    def _places(self, tokens: list[str]) -> np.ndarray:
        new = set(tokens).difference(self.places)
        for token in sorted(new):
            self.places[token] = len(self.hashes)
            self.hashes.append(
                (xxhash.xxh64_intdigest(token), xxhash.xxh64_intdigest(_shape(token), 7))
            )
        if new:
            self.table = np.array(self.hashes, np.uint64).reshape(-1, 2)
        return np.fromiter(map(self.places.__getitem__, tokens), np.int64, len(tokens))

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each group of features: their numbers, and the row each of them belongs to."""
        if len(self.hashes) > TABLE_TOKENS:
            self.clear()
        cut = [_TOKENS(t) for t in texts]
        rows = np.repeat(np.arange(len(texts)), [len(x) for x in cut])
        places = self._places([token for tokens in cut for token in tokens])
        surface, shape = self.table[places, 0], self.table[places, 1]
        again = np.zeros(len(places), bool)
        again[1:] = (places[1:] == places[:-1]) & (rows[1:] == rows[:-1])
        shape = np.where(again, shape + np.uint64(1), shape)
        two = rows[1:] == rows[:-1]
        three = two[1:] & two[:-1]
        groups = [
            (_mix(surface), rows),
            (_mix(surface[:-1], surface[1:])[two], rows[1:][two]),
            (_mix(shape[:-1], shape[1:])[two], rows[1:][two]),
            (_mix(shape[:-2], shape[1:-1], shape[2:])[three], rows[2:][three]),
        ]
        shift = np.uint64(64 - self.bits)
        return [
            (_mix(h + np.uint64(i * 0x51ED27)) >> shift, row) for i, (h, row) in enumerate(groups)
        ]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    held, chars = [], 0
    for text in texts:
        held.append(text)
        chars += len(text)
        if chars >= SLICE_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _vectors(features: Features, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sparse vector of each text."""
    for part in _slices(texts):
        groups = features(part)
        bounds = [np.searchsorted(row, np.arange(len(part) + 1)) for _, row in groups]
        for i in range(len(part)):
            own = [g[0][b[i] : b[i + 1]] for g, b in zip(groups, bounds, strict=True)]
            values = [np.full(len(x), 1.0 / len(x)) for x in own if len(x)]
            if not values:
                yield np.empty(0, np.int64), np.empty(0)
                continue
            index, inverse = np.unique(np.concatenate(own).astype(np.int64), return_inverse=True)
            yield index, np.bincount(inverse, np.concatenate(values))


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def fit(texts: list[str], labels: list[int], bits: int, epochs: int, ftrl: Ftrl) -> Model:
    """Follow the regularised leader over the rows in the order given."""
    size = 2**bits + 1  # the last one is the bias
    z, n = np.zeros(size), np.zeros(size)
    bias = np.array([size - 1])
    one = np.ones(1)
    rows = [
        (np.concatenate([i, bias]), np.concatenate([v, one]), y)
        for (i, v), y in zip(_vectors(Features(bits), texts), labels, strict=True)
    ]

    def leader(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        step = (ftrl.beta + np.sqrt(ni)) / ftrl.alpha + ftrl.l2
        return np.where(np.abs(zi) <= ftrl.l1, 0.0, -(zi - np.sign(zi) * ftrl.l1) / step)

    for _ in range(epochs):
        for index, value, label in rows:
            zi, ni = z[index], n[index]
            w = leader(zi, ni)
            gradient = (_sigmoid(w @ value) - label) * value
            squared = ni + gradient * gradient
            sigma = (np.sqrt(squared) - np.sqrt(ni)) / ftrl.alpha
            z[index] = zi + gradient - sigma * w
            n[index] = squared
    w = leader(z, n)
    return Model(w[:-1], float(w[-1]), len(rows))


def train(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "label",
    train_rows: int = TRAIN_ROWS,
    bits: int = BITS,
    epochs: int = EPOCHS,
    ftrl: Ftrl = Ftrl(),
) -> Model:
    """Fit on a sample of the labelled rows, in one task on an executor."""
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    label = F.col(f"`{label_col}`")
    sample = (
        labelled.where(label.isin(0, 1))
        .select(
            F.xxhash64(F.lit("train"), ident).alias("draw"),
            ident.alias("id"),
            whole(text_col).alias("text"),
            label.cast("int").alias("label"),
        )
        .orderBy("draw", "id", "label", "text")
        .limit(train_rows)
    )
    schema = pa.schema([("weights", pa.binary()), ("bias", pa.float64()), ("rows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            labels += batch.column("label").to_pylist()
        if texts:
            model = fit(texts, labels, bits, epochs, ftrl)
            packed = model.weights.astype("<f4").tobytes()
            row = {"weights": packed, "bias": model.bias, "rows": model.rows}
            yield pa.RecordBatch.from_pylist([row], schema)

    found = sample.mapInArrow(run, "weights binary, bias double, rows long").collect()
    if not found:
        return Model(np.zeros(2**bits), 0.0, 0)
    weights = np.frombuffer(found[0]["weights"], "<f4").astype(float)
    return Model(weights, found[0]["bias"], found[0]["rows"])


def score_column(df: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Probability of label 1 of each text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2 ** bits numbers

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        features = Features(int(len(own.weights)).bit_length() - 1)
        for batch in batches:
            scores = [np.empty(0)]
            for part in _slices(batch.to_pylist()):
                total = np.full(len(part), own.bias)
                for index, row in features(part):
                    size = np.bincount(row, minlength=len(part))
                    dot = np.bincount(row, own.weights[index], minlength=len(part))
                    total += dot / np.maximum(size, 1)
                scores.append(_sigmoid(total))
            yield pa.array(np.concatenate(scores))

    return score(whole(text_col))


def classify(
    df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """``df`` with score and predicted."""
    return df.withColumn("score", score_column(df, model, text_col)).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
