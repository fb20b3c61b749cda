"""The toxicity model where its n-grams are too many to broadcast: the same probabilities as tables.

Continuation counts, discounts and ratios are aggregates and joins over the
count table.  Each distinct word gets its evidence once, by a join of its
n-grams, and texts get theirs by a join of their words.  Texts are told by
their SHA-256, so copies are scored once.  A word that a great part of all texts
has is one row a distinct text; where that skews a task, adaptive execution
divides it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunked, slices, written

#: Rows of a batch; characters of a word that goes by itself, less than a hash has.
_ROWS, _LONG = 100_000, 40


def _discount(counts: DataFrame, *columns: str) -> list[float]:
    """Kneser-Ney's discount of each column, from how many are 1 and 2."""
    kinds = counts.agg(*(F.sum((F.col(c) == k).cast("long")) for c in columns for k in (1, 2))).first()
    pairs = zip(kinds[::2], kinds[1::2], strict=True)
    return [min(0.95, max(0.1, (once or 0) / ((once or 0) + 2 * (twice or 0)))) if once or twice else 0.5 for once, twice in pairs]


def _short(size: int) -> Column:
    """The n-gram with ``size`` bytes of context at most."""
    return F.col("gram").bitwiseAND(F.lit((1 << 8 * (size + 1)) - 1).cast("long"))


def _shared(counts: DataFrame, context: int) -> DataFrame:
    """gram, shared: probability in the model of both classes, for the n-grams of ``context - 1`` bytes of context."""
    level, levels = counts.select("gram", (F.col("toxic") + F.col("ordinary")).cast("double").alias("weight")), []
    for size in range(context - 1, -1, -1):
        weight = F.sum(F.when(_short(size) == F.col("gram"), F.col("weight")).otherwise(1.0)).alias("weight")
        level = written(level.groupBy(_short(size).alias("gram")).agg(weight), f"level_{size}")
        levels.append((size, level))
    lower = None
    for size, level in reversed(levels):
        (discount,) = _discount(level, "weight")
        totals = level.groupBy(F.shiftrightunsigned("gram", 8).alias("context")).agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("kinds"))
        found = level.withColumn("context", F.shiftrightunsigned("gram", 8)).join(totals, "context")
        if lower is None:
            found = found.withColumn("below", F.lit(1 / 256))
        else:
            found = found.withColumn("short", _short(size - 1)).join(lower.select(F.col("gram").alias("short"), F.col("shared").alias("below")), "short")
        own = F.greatest(F.col("weight") - F.lit(discount), F.lit(0.0)) / F.col("total")
        lower = written(found.select("gram", (own + F.lit(discount) * F.col("kinds") / F.col("total") * F.col("below")).alias("shared")), f"shared_{size}")
    return lower


class Tables:
    """``ratios`` (gram, ratio) and ``backoffs`` (context, backoff), written; the least and the most evidence of a word."""

    def __init__(self, counts: DataFrame, context: int, clip: float):
        discounts = dict(zip(("toxic", "ordinary"), _discount(counts, "toxic", "ordinary"), strict=True))
        at = F.shiftrightunsigned("gram", 8).alias("context")
        sums = [a for c in discounts for a in (F.sum(c).alias(f"{c}_total"), F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds"))]
        totals = counts.groupBy(at).agg(*sums)
        for c, d in discounts.items():
            totals = totals.withColumn(f"{c}_left", F.when(F.col(f"{c}_total") > 0, F.lit(d) * F.col(f"{c}_kinds") / F.col(f"{c}_total")).otherwise(1.0))
        totals = written(totals, "contexts")
        shared = _shared(counts, context).withColumnRenamed("gram", "short")
        found = counts.withColumns({"context": F.shiftrightunsigned("gram", 8), "short": _short(context - 1)}).join(totals, "context").join(shared, "short")
        log = {c: F.log(F.greatest(F.col(c) - F.lit(d), F.lit(0.0)) / F.greatest(F.col(f"{c}_total"), F.lit(1)) + F.col(f"{c}_left") * F.col("shared")) for c, d in discounts.items()}
        self.ratios = written(found.select("gram", (log["toxic"] - log["ordinary"]).alias("ratio")), "ratios")
        self.backoffs = totals.select("context", (F.log("toxic_left") - F.log("ordinary_left")).alias("backoff"))
        self.clip = clip

    def evidence(self, words: DataFrame, grams: Callable) -> DataFrame:
        """name, evidence of distinct words (name, word)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, at = grams(batch.column(1).to_pylist())
                for lo in range(0, len(keys), _ROWS):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[lo : lo + _ROWS])), pa.array(keys[lo : lo + _ROWS])], names=["name", "gram"])

        found = words.mapInArrow(run, "name string, gram long").join(self.ratios, "gram", "left")
        found = found.join(self.backoffs, F.shiftrightunsigned("gram", 8) == F.col("context"), "left")
        total = F.sum(F.coalesce("ratio", "backoff", F.lit(0.0)))
        return found.groupBy("name").agg(F.least(F.greatest(total, F.lit(-self.clip)), F.lit(self.clip)).alias("evidence"))

    def features(self, texts: DataFrame, grams: Callable, split: Callable, plain: tuple[float, ...]) -> DataFrame:
        """sha, x (the features of ``Model.features``) of the texts that have words; ``texts`` has a column text."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, own in slices(batch.column(1)):
                    rows, codes, pieces = chunked(own, whitespace=True)
                    words = [split(p) for p in pieces]
                    at, found = [], []
                    for row, code in zip(rows.tolist(), codes.tolist(), strict=True):
                        found += words[code]
                        at += [lo + row] * len(words[code])
                    table = pa.table([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["sha", "word"])
                    counted = table.group_by(["sha", "word"]).aggregate([([], "count_all")])
                    yield from counted.select(["sha", "word", "count_all"]).rename_columns(["sha", "word", "times"]).to_batches()

        distinct = texts.select(F.sha2("text", 256).alias("sha"), "text").dropDuplicates(["sha"])
        # A long word goes by its hash: no short one is as long as that.
        name = F.when(F.length("word") <= _LONG, F.col("word")).otherwise(F.sha2("word", 256)).alias("name")
        has = written(distinct.mapInArrow(run, "sha string, word string, times long").select("sha", name, "word", "times"), "words")
        found = has.select("sha", "name", "times").join(self.evidence(has.select("name", "word").distinct(), grams), "name")
        over = [F.sum(F.col("times") * F.greatest(F.col("evidence") - F.lit(p), F.lit(0.0))).alias(f"over{i}") for i, p in enumerate(plain)]
        sums = found.groupBy("sha").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("evidence")).alias("total"), *over)
        parts = [f for i in range(len(plain)) for f in (F.col(f"over{i}") / F.col("n"), F.col(f"over{i}") / F.sqrt("n"), F.log1p(f"over{i}"))]
        return sums.select("sha", F.array(F.col("total") / F.col("n"), *parts).alias("x"))
