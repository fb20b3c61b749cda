"""Mixing sources to target weights with a temperature.

A source's weight is its share of all tokens to a power between 0 and 1,
normalised.  The power is found by bisection: the largest that reaches a target
entropy, raised to the smallest that keeps every source within a repetition
limit.  A source's weight times the token budget is what it may give.  It gives
whole passes over its documents; in each pass its blocks, and the documents in
each block, come in a new seeded order, and the last pass ends where the budget
does.  A document is given if it begins within the budget; where no budget is
set, the first pass gives every document.

A token is a word by default.  Nulls: a null source is a source of its own, a
null text has no tokens.  Documents without tokens are given with the block
they fall in.  Sources without tokens give one pass.  Repeated rows are rows
like others; rows of one id, or of none, are shuffled by their texts.  An empty table gives an empty result.

One row a source is gathered to the driver, nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffled, text_or_empty, with_sum_before, written

#: Tokens and rows of a block, on average at most.
BLOCK_TOKENS, BLOCK_ROWS = 1 << 18, 20_000
#: Of the entropy of equal weights; passes over a source at most.
ENTROPY, REPETITION = 0.97, 2.0
#: Sources up to so many are broadcast, a row each; more are joined by an exchange.
BROADCAST_SOURCES = 100_000
SEED = "strandline"


def words(text: Column) -> Column:
    """Number of words: runs of other characters than ASCII white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


@dataclass(frozen=True)
class Mixture:
    """Power, weight by source and token budget by source."""

    power: float
    weights: dict
    budgets: dict


def _weights(shares: list[float], power: float) -> list[float]:
    raised = [s**power if s > 0 else 0.0 for s in shares]
    total = math.fsum(raised)
    return [r / total for r in raised]


def _bisected(holds: Callable[[float], bool]) -> float:
    """The largest power in [0, 1] for which ``holds``, which holds from 0 up to some power."""
    low, high = 0.0, 1.0
    if holds(high):
        return high
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def mixture(tokens: dict, budget: float | None = None, entropy: float | None = ENTROPY, repetition: float | None = REPETITION) -> Mixture:
    """Weights and budgets of sources with so many tokens each.

    ``entropy`` is a fraction of the entropy of equal weights.  Without a
    budget, it is the least that gives every source one whole pass.  A budget
    beyond the repetition limit is lowered to it.
    """
    names = sorted((k for k in tokens if tokens[k] > 0), key=str)
    if not names:
        return Mixture(1.0, {}, {})
    total = math.fsum(tokens[k] for k in names)
    shares = [tokens[k] / total for k in names]
    asked = budget if budget is None or repetition is None else min(budget, repetition * total)

    def needed(weights: list[float]) -> float:
        return max(tokens[k] / w for k, w in zip(names, weights, strict=True)) if asked is None else asked

    def passes(power: float) -> float:
        weights = _weights(shares, power)
        return max(needed(weights) * w / tokens[k] for k, w in zip(names, weights, strict=True))

    def spread(power: float) -> float:
        return -math.fsum(w * math.log(w) for w in _weights(shares, power) if w > 0)

    power = 1.0
    if entropy is not None and len(names) > 1:
        power = _bisected(lambda a: spread(a) >= entropy * math.log(len(names)))
    if repetition is not None and passes(power) > repetition * (1 + 1e-12):
        power = 1 - _bisected(lambda a: passes(1 - a) <= repetition * (1 + 1e-12))
    weights = _weights(shares, power)
    whole = needed(weights)
    return Mixture(power, dict(zip(names, weights, strict=True)), {k: math.floor(whole * w + 1e-6) for k, w in zip(names, weights, strict=True)})


def mixed(docs: DataFrame, tokens: Column | None = None, budget: float | None = None, entropy: float | None = ENTROPY, repetition: float | None = REPETITION, seed: str = SEED, block_tokens: int = BLOCK_TOKENS, block_rows: int = BLOCK_ROWS, carry: list[Column] | None = None) -> DataFrame:
    """``row`` (a struct of ``carry``, by default all columns) of each document given, and how it came.

    source, tokens, pass (from 0), block, start (the source's tokens given
    before it), place (0 to 1: its part of the source's budget that is over;
    ordered by it, the sources interleave by their weights), weight.
    """
    name = F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(
        name.alias("source"),
        (words(text_or_empty()) if tokens is None else F.coalesce(tokens, F.lit(0))).cast("long").alias("tokens"),
        shuffled(seed).alias("key"),
        F.struct(*(carry or ["*"])).alias("row"),
    )
    if carry:
        rows = counted = written(rows, "counted")
    else:  # whole rows aren't written again, only what places them
        counted = written(rows.select("source", "tokens", "key"), "counted")
    given = {r["source"]: (r["n"], r["count"]) for r in counted.groupBy("source").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("count")).collect()}
    plan = mixture({s: n for s, (n, _) in given.items()}, budget, entropy, repetition)
    known = [(s, max(1, n), plan.budgets.get(s, 1), max(1, -(-n // block_tokens), -(-count // block_rows)), plan.weights.get(s, 0.0)) for s, (n, count) in sorted(given.items())]
    sources = docs.sparkSession.createDataFrame(known, "source string, of long, budget long, blocks long, weight double")
    if len(known) <= BROADCAST_SOURCES:
        sources = F.broadcast(sources)
    block = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * F.col("blocks"))
    blocks = counted.join(sources, "source").groupBy("source", block.alias("block")).agg(F.sum("tokens").alias("in_block"), F.first("of").alias("of"), F.first("budget").alias("budget"))
    passes = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(budget - 1) div of"))))
    passes = passes.withColumn("turn", F.md5(F.concat_ws(":", F.lit(seed), "source", "pass", "block")))
    passes = with_sum_before(passes, ["source", "pass"], F.substring("turn", 1, 3), ["turn", "block"], "in_block", "block_start")
    passes = passes.withColumn("block_start", F.col("pass") * F.col("of") + F.col("block_start"))
    all_once = F.lit(budget is None) & (F.col("pass") == 0)
    passes = passes.where((F.col("block_start") < F.col("budget")) | all_once).select("source", "block", "pass", "block_start")
    every = rows.join(sources, "source").withColumn("block", block).join(passes, ["source", "block"])
    turn = Window.partitionBy("source", "block", "pass").orderBy(F.md5(F.concat_ws(":", "pass", "key")), "tokens").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("start", F.col("block_start") + F.coalesce(F.sum("tokens").over(turn), F.lit(0))).where((F.col("start") < F.col("budget")) | all_once)
    return every.select("row", F.when(F.col("source") != "", F.substring("source", 3, 1 << 30)).alias("source"), "tokens", "pass", "block", "start", ((F.col("start") + F.col("tokens") / 2) / F.col("budget")).alias("place"), "weight")


def remixed(docs: DataFrame, **options) -> DataFrame:
    """The documents given, with their own columns alone; a document comes once a pass."""
    return mixed(docs, **options).select("row.*")
