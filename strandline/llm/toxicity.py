"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary text, give each byte of a word after the
bytes before it (and the word's beginning).  The highest order has each class's
own discounted counts; below it both share one model, of continuation counts,
so that what is rare in a class is smoothed by how all text goes on, and says
nothing by itself.  A word's evidence is its log-likelihood ratio.  A document's
score is a logistic function of its evidence a word and of the part of it that
exceeds what ordinary words show, both normalised by length.

Counts are of three quarters of the labelled documents that may be learned
from, and no n-gram is left out.  A model of ``NGRAMS`` n-grams at most is
broadcast; beyond that the same model stays in tables and words and texts are
scored by joins (:mod:`.toxicity_tables`).  The logistic function is fitted on the other quarter, which
the model hasn't seen (a bounded sample, ``SAMPLE`` rows at most), so that it
meets evidence as new texts give it.

Nulls count as empty texts.  Texts without words have no evidence.  Without
labels of both classes every score is 0.  Columns of the input are passed on by
the filter, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

from ..shipping import ship
from .common import chunked, slices, text_or_empty, written
from .labelled import Logistic, held_out, training
from .toxicity_tables import Tables

#: Rows whose crc32 leaves HELD modulo MODULUS are never learned from.
MODULUS, HELD = 4, 2
#: Bytes of context; n-grams of a model that is broadcast.
CONTEXT, NGRAMS = 5, 2_000_000
#: Labelled rows for the logistic function at most; evidence of a word at most, and bounds beyond which it exceeds the ordinary.
SAMPLE, CLIP, PLAIN = 20_000, 8.0, (3.0, 6.0)
THRESHOLD = 0.3

#: Bytes of text that are scored at once.
SLICE = 2 << 20

_WORD = re.compile(r"\w+")
#: Features of a text: evidence a word, and three for each bound.
FEATURES = 1 + 3 * len(PLAIN)
#: Stands before and after each word; no word has it.
_EDGE = 1


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Key of each byte after its context, and the word that it's in.

    A key has the byte lowest, then the bytes before it from the nearest on.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(("\x01" + "\x01".join(words) + "\x01").encode("utf-8", "replace"), np.uint8)
    edge = data == _EDGE
    word = np.cumsum(edge) - 1 - edge
    key, open_ = data.astype(np.int64), np.ones(len(data), bool)
    for k in range(1, CONTEXT + 1):
        before = np.zeros(len(data), np.int64)
        before[k:] = data[:-k]
        key += np.where(open_, before, 0) << (8 * k)
        open_ &= before != _EDGE
    return key[1:], word[1:]


class Model:
    """Log-likelihood ratio of words. Two sorted tables: of n-grams seen, and of contexts."""

    def __init__(self, keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray):
        order = np.argsort(keys)
        self.keys, counts = keys[order], (toxic[order].astype(float), ordinary[order].astype(float))
        shared = self._shared(counts[0] + counts[1])
        context = self.keys >> 8
        self.contexts, inverse = np.unique(context, return_inverse=True)
        ratio, backoff = [], []
        for c in counts:
            discount = self._discount(c)
            total = np.bincount(inverse, c, len(self.contexts))
            kinds = np.bincount(inverse, c > 0, len(self.contexts))
            left = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            own = np.maximum(c - discount, 0) / np.maximum(total, 1)[inverse]
            ratio.append(np.log(own + left[inverse] * shared))
            backoff.append(np.log(left))
        self.ratio = (ratio[0] - ratio[1]).astype(np.float32)
        self.backoff = (backoff[0] - backoff[1]).astype(np.float32)

    @staticmethod
    def _discount(counts: np.ndarray) -> float:
        once, twice = float((counts == 1).sum()), float((counts == 2).sum())
        return min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5

    def _shared(self, pooled: np.ndarray) -> np.ndarray:
        """Probability of each n-gram's byte in the model that both classes share, from continuation counts.

        Below the highest order an n-gram counts by the different bytes seen
        before it; one that begins a word has nothing before it and counts by
        its occurrences.
        """
        levels, keys, weight = [], self.keys, pooled
        for size in range(CONTEXT - 1, -1, -1):
            short = keys & ((1 << 8 * (size + 1)) - 1)
            kept = short == keys  # a whole context already: the word's beginning, or as short as this
            found, inverse = np.unique(short, return_inverse=True)
            count = np.bincount(inverse, np.where(kept, weight, 1.0), len(found))
            levels.append((found, count, inverse))
            keys, weight = found, count
        probability = np.full(len(levels[-1][0]), 1 / 256)
        for depth in range(len(levels) - 1, -1, -1):
            found, count, _ = levels[depth]
            lower = probability if depth == len(levels) - 1 else probability[levels[depth + 1][2]]
            contexts, inverse = np.unique(found >> 8, return_inverse=True)
            total, kinds = np.bincount(inverse, count, len(contexts)), np.bincount(inverse, minlength=len(contexts))
            discount = self._discount(count)
            probability = np.maximum(count - discount, 0) / total[inverse] + (discount * kinds / total)[inverse] * lower
        return probability[levels[0][2]]

    @staticmethod
    def _found(keys: np.ndarray, table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table, keys).clip(0, max(0, len(table) - 1))
        hit = table[at] == keys if len(table) else np.zeros(len(keys), bool)
        return hit, np.where(hit, values[at] if len(table) else 0.0, 0.0)

    def words(self, words: list[str]) -> np.ndarray:
        """Evidence of each word, within CLIP."""
        keys, word = ngrams(words)
        seen, ratio = self._found(keys, self.keys, self.ratio)
        rest = np.flatnonzero(~seen)
        ratio[rest] = self._found(keys[rest] >> 8, self.contexts, self.backoff)[1]
        return np.bincount(word, ratio, len(words)).clip(-CLIP, CLIP)

    def features(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: evidence a word; for each bound of PLAIN, excess a word, by the root of the length, and its log."""
        rows, codes, pieces = chunked(texts, whitespace=True)
        words, owner = [], []
        for i, piece in enumerate(pieces):
            found = _WORD.findall(piece.lower())
            words += found
            owner += [i] * len(found)
        evidence, at = self.words(words), np.array(owner, np.int64)
        parts = [np.ones(len(at)), evidence, *(np.maximum(evidence - p, 0) for p in PLAIN)]
        n, total, *excesses = (np.bincount(rows, np.bincount(at, v, len(pieces))[codes], len(texts)) for v in parts)
        n = np.maximum(n, 1)
        return np.stack([total / n, *(f for e in excesses for f in (e / n, e / np.sqrt(n), np.log1p(e)))], axis=1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def summed(parts: list[tuple]) -> tuple:
        keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, *(np.bincount(inverse, np.concatenate([p[i] for p in parts]), len(keys)) for i in (1, 2))

    def rows(part: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), *(pa.array(p.astype(np.int64)) for p in part[1:])], names=["gram", "toxic", "ordinary"])

    for batch in batches:
        for lo, texts in slices(batch.column(0), SLICE):
            label = batch.column(1).slice(lo, len(texts)).to_numpy(zero_copy_only=False)
            at, codes, pieces = chunked(texts, whitespace=True)
            times = [np.bincount(codes[label[at] == k], minlength=len(pieces)) for k in (1, 0)]
            words, owner = [], []
            for i, piece in enumerate(pieces):
                found = _WORD.findall(piece.lower())
                words += found
                owner += [i] * len(found)
            keys, word = ngrams(words)
            of = np.array(owner, np.int64)[word]
            held.append(summed([(keys, *(t[of] for t in times))]))
            if sum(len(p[0]) for p in held) > 2_000_000:
                held = [summed(held)]
                if len(held[0][0]) > 1_000_000:
                    yield rows(held.pop())
    if held:
        yield rows(summed(held))


def counts(labelled: DataFrame) -> DataFrame:
    """gram, toxic, ordinary: occurrences in labelled texts; summed within tasks before the exchange."""
    found = labelled.select("text", "label").mapInArrow(_counts, "gram long, toxic long, ordinary long")
    return found.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _words_of(piece: str) -> list[str]:
    return _WORD.findall(piece.lower())


class Scorer:
    """A fitted classifier; without one every score is 0."""

    def __init__(self, spark: SparkSession, model: Model | Tables | None, logistic: Logistic | None):
        self.model, self.logistic = model, logistic
        self.shared = None if isinstance(model, Tables) else spark.sparkContext.broadcast((model, logistic))  # at most NGRAMS n-grams

    def scored(self, rows: DataFrame) -> DataFrame:
        """Adds ``score`` to rows that have a column ``text``."""
        if self.shared is not None:
            return rows.withColumn("score", self._column(F.col("text")))
        found = self.model.features(rows.select("text"), ngrams, _words_of, PLAIN)
        zeros = F.array(*(F.lit(0.0) for _ in range(FEATURES)))
        found = rows.withColumn("sha", F.sha2("text", 256)).join(found, "sha", "left").withColumn("x", F.coalesce("x", zeros))
        w = self.logistic.w
        margin = F.lit(float(w[-1]))
        for i in range(FEATURES):
            margin = margin + (F.get("x", F.lit(i)) - F.lit(float(self.logistic.mean[i]))) / F.lit(float(self.logistic.scale[i])) * F.lit(float(w[i]))
        return found.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(margin, F.lit(30.0)), F.lit(-30.0))))).drop("sha", "x")

    def _column(self, text: Column) -> Column:
        shared = self.shared

        @arrow_udf(DoubleType())
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model, logistic = shared.value
            for batch in batches:
                if model is None:
                    yield pa.array(np.zeros(len(batch)))
                else:
                    yield pa.array(np.concatenate([logistic(model.features(texts)) for _, texts in slices(batch, SLICE)] or [np.zeros(0)]))

        return score(text)


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = MODULUS, held: int = HELD, most: int = NGRAMS, sample: int = SAMPLE) -> Scorer:
    """Learns from the labelled documents that aren't held out; a model of up to ``most`` n-grams is broadcast."""
    ship(docs.sparkSession)
    for fit, calibrate in ((False, True), (None, None)):  # all labels for both, if there are too few to keep some apart
        model = _model(training(docs, labels, label, modulus, held, calibrating=fit), most)
        found = model and _calibration(training(docs, labels, label, modulus, held, sample, calibrate), model)
        if found:
            return Scorer(docs.sparkSession, model, Logistic(*found))
    return Scorer(docs.sparkSession, None, None)


def _model(labelled: DataFrame, most: int) -> Model | Tables | None:
    """None without texts of both classes."""
    seen = written(counts(labelled), "ngrams")
    n, toxic, ordinary = seen.agg(F.count(F.lit(1)), F.sum("toxic"), F.sum("ordinary")).first()
    if not (toxic and ordinary):
        return None
    if n > most:
        return Tables(seen, CONTEXT, CLIP)
    return Model(*(c.combine_chunks().to_numpy(zero_copy_only=False) for c in seen.select("gram", "toxic", "ordinary").toArrow().columns))


def _calibration(labelled: DataFrame, model: Model | Tables) -> tuple[np.ndarray, np.ndarray] | None:
    """Features and labels; None if they lack a class."""
    if isinstance(model, Tables):
        labelled = written(labelled.select("text", "label"), "calibrating")  # a bounded sample
        zeros = F.array(*(F.lit(0.0) for _ in range(FEATURES)))
        found = model.features(labelled, ngrams, _words_of, PLAIN)
        found = labelled.select(F.sha2("text", 256).alias("sha"), "label").join(found, "sha", "left").select(F.coalesce("x", zeros).alias("x"), "label").toArrow()
    else:
        shared = labelled.sparkSession.sparkContext.broadcast(model)

        @arrow_udf(ArrayType(DoubleType()))
        def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([row for _, texts in slices(batch, SLICE) for row in shared.value.features(texts).tolist()], pa.list_(pa.float64()))

        found = labelled.select(features("text").alias("x"), "label").toArrow()
    x, y = np.array(found.column("x").to_pylist()), found.column("label").to_numpy().astype(float)
    return (x, y) if 0 < y.sum() < len(y) else None


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = NGRAMS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scorer = fitted(docs, labels, most=most)
    out = scorer.scored(docs.select("doc_id", text_or_empty().alias("text"))).select("doc_id", held_out(MODULUS, HELD).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, whole rows, that score below the threshold."""
    scorer = fitted(docs, labels)
    return scorer.scored(docs.select(F.struct("*").alias("row"), text_or_empty().alias("text"))).where(F.col("score") < threshold).select("row.*")
