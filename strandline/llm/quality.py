"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A document is the set of its n-grams: of three bytes within a piece of text
between white space, and of one and two shapes of pieces (letters by case,
digits and signs, runs collapsed) and of a piece twice in a row, hashed to ``SIZE`` features.  Indicators are
scaled by the log-ratio of their smoothed frequencies in the two classes, each
document is brought to unit length, and a linear model with hinge loss is
fitted by dual coordinate descent.  Margins become probabilities by a logistic
function fitted on documents that the model didn't see.

The model is fitted on a bounded sample: ``SAMPLE`` labelled rows that may be
learned from.  Its size is bounded by SIZE.

Nulls count as empty texts.  Texts without words have only the model's bias.
Without labels of both classes every score is 1, and everything is kept.
Columns of the input are passed on by the filter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, DoubleType

from ..shipping import ship
from .common import chunked, slices, text_or_empty
from .labelled import Logistic, held_out, training

#: Rows whose crc32 leaves HELD modulo MODULUS are never learned from.
MODULUS, HELD = 5, 0
#: Features; labelled rows at most; epochs, cost and smoothing of the fit.
BITS = 18
SIZE, SAMPLE, EPOCHS, COST, SMOOTHING = 1 << BITS, 6_000, 12, 4.0, 1.0
THRESHOLD = 0.3
#: One document in so many is kept from the fit for the logistic function.
CALIBRATION = 4

#: Bytes of text whose indicators are held at once.
SLICE = 3 << 19

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: What a byte is in a shape: upper case, lower case or beyond ASCII, digit, or itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48


def _hashed(keys: np.ndarray, salt: int) -> np.ndarray:
    return (((keys.astype(np.uint64) + np.uint64(salt << 60)) * _MIX) >> np.uint64(64 - BITS)).astype(np.int64)


def _piece_features(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, feature) pairs, and a hash of each piece's shape."""
    if not pieces:
        return (np.zeros(0, np.int64),) * 3
    data = np.frombuffer(("\n" + "\n".join(pieces) + "\n").encode("utf-8", "replace"), np.uint8)
    edge = data == 10
    piece = np.cumsum(edge) - 1
    wide = data.astype(np.int64)
    inner = ~edge[1:-1]  # the middle of three isn't an edge
    grams = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:])[inner]
    at = piece[1:-1][inner]
    shape = _SHAPE[data]
    new = np.r_[True, shape[1:] != shape[:-1]] & ~edge
    # Polynomial hash of the collapsed shape, a term for each place in it.
    place = np.cumsum(new)
    place = place - np.r_[0, place][np.flatnonzero(edge)][piece] if len(piece) else place
    terms = (shape.astype(np.uint64) + np.uint64(1)) * (_MIX ** np.minimum(place, 40).astype(np.uint64))
    shapes = np.zeros(len(pieces), np.uint64)
    np.add.at(shapes, piece[new], terms[new])
    return at, _hashed(grams, 1), (shapes >> np.uint64(8)).astype(np.int64)


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs of texts, each once, sorted."""
    rows, codes, pieces = chunked(texts, whitespace=True)
    at, gram, shape = _piece_features(pieces)
    of = shape[codes] if len(codes) else codes
    follows = rows[1:] == rows[:-1]
    order = np.argsort(at, kind="stable")
    count = np.bincount(at, minlength=len(pieces))
    first = np.cumsum(count) - count
    pair = np.unique(rows * max(1, len(pieces)) + codes)
    row, piece = np.divmod(pair, max(1, len(pieces)))
    n = count[piece] if len(piece) else piece
    ends = np.cumsum(n)
    spread = order[np.repeat(first[piece] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)] if len(piece) else piece
    keys = np.concatenate([
        np.repeat(row, n) << BITS | gram[spread],
        rows << BITS | _hashed(of, 2),
        (rows[1:] << BITS | _hashed(of[1:] * 31 + of[:-1], 3))[follows],
        (rows[1:] << BITS | _hashed(of[1:], 4))[follows & (codes[1:] == codes[:-1])],
    ])
    keys = np.unique(keys)
    return keys >> BITS, keys & (SIZE - 1)


def naive_bayes_ratio(features: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log-ratio of each feature's smoothed frequency in the two classes."""
    counts = [np.bincount(np.concatenate([f for f, v in zip(features, y, strict=True) if v == k] or [np.zeros(0, np.int64)]), minlength=SIZE) + SMOOTHING for k in (1, 0)]
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def dual_coordinate_descent(features: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> np.ndarray:
    """Weights of the linear model with hinge loss; the last is the bias. y is 1 or -1; rows have unit length and a constant."""
    w, alpha, rng = np.zeros(SIZE + 1), np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            f, x = features[i], values[i]
            slope = y[i] * (w[f] @ x + w[-1]) - 1
            new = min(max(alpha[i] - slope / 2.0, 0.0), cost[i])  # a row's square, with the constant, is 2
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * x
                w[-1] += step
                alpha[i] = new
    return w


class Model:
    """Fitted weights; ``scores`` gives probabilities of label 1."""

    def __init__(self, features: list[np.ndarray], y: np.ndarray, cost: float = COST):
        fit = np.arange(len(y)) % CALIBRATION != 0
        if not (0 < y[fit].sum() < fit.sum()):
            fit[:] = True
        chosen = [f for f, k in zip(features, fit, strict=True) if k]
        ratio = naive_bayes_ratio(chosen, y[fit])
        self.ratio = ratio.astype(np.float32)
        share = y[fit].mean()
        costs = np.where(y[fit] == 1, cost * 0.5 / share, cost * 0.5 / (1 - share))
        w = dual_coordinate_descent(chosen, [self._scaled(f) for f in chosen], np.where(y[fit] == 1, 1.0, -1.0), costs)
        self.w, self.bias = (w[:-1] * ratio).astype(np.float32), float(w[-1])
        rest = ~fit if 0 < y[~fit].sum() < (~fit).sum() else np.ones(len(y), bool)
        margins = np.array([self._margin(f) for f, k in zip(features, rest, strict=True) if k])
        self.logistic = Logistic(margins[:, None], y[rest].astype(float))

    def _scaled(self, f: np.ndarray) -> np.ndarray:
        x = self.ratio[f].astype(float)
        return x / max(1e-9, float(np.sqrt((x * x).sum())))

    def _margin(self, f: np.ndarray) -> float:
        return float(self.w[f].sum() / max(1e-9, float(np.sqrt((self.ratio[f].astype(float) ** 2).sum()))) + self.bias)

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, f = indicators(texts)
        total, square = np.bincount(row, self.w[f], len(texts)), np.bincount(row, self.ratio[f].astype(float) ** 2, len(texts))
        return self.logistic((total / np.maximum(1e-9, np.sqrt(square)) + self.bias)[:, None])


@arrow_udf(BinaryType())
def _features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        out = []
        for _, texts in slices(batch, SLICE):
            row, f = indicators(texts)
            out += [part.astype("<u4").tobytes() for part in np.split(f, np.searchsorted(row, np.arange(1, len(texts))))]
        yield pa.array(out, pa.binary())


class Scorer:
    """A fitted classifier: ``column`` scores texts."""

    def __init__(self, spark: SparkSession, model: Model | None):
        self.shared = spark.sparkContext.broadcast(model)  # two weights a feature

    def column(self, text: Column) -> Column:
        shared = self.shared

        @arrow_udf(DoubleType())
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = shared.value
            for batch in batches:
                yield pa.array(np.ones(len(batch)) if model is None else np.concatenate([model.scores(texts) for _, texts in slices(batch, SLICE)] or [np.zeros(0)]))

        return score(text)


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = MODULUS, held: int = HELD, sample: int = SAMPLE) -> Scorer:
    """Learns from a sample of the labelled documents that aren't held out."""
    spark = docs.sparkSession
    ship(spark)
    found = training(docs, labels, label, modulus, held, sample).select(_features("text").alias("f"), "label").toArrow()
    rows = sorted(zip(found.column("f").to_pylist(), found.column("label").to_pylist(), strict=True))  # the same fit whatever the order of tasks
    np.random.default_rng(0).shuffle(rows)
    y = np.array([label for _, label in rows], np.int64)
    if not 0 < y.sum() < len(y):
        return Scorer(spark, None)
    return Scorer(spark, Model([np.frombuffer(b, "<u4").astype(np.int64) for b, _ in rows], y))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scorer = fitted(docs, labels)
    out = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", held_out(MODULUS, HELD).alias("held_out"), scorer.column(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, whole rows, that score at least the threshold."""
    scorer = fitted(docs, labels)
    return docs.where(scorer.column(text_or_empty()) >= threshold)
