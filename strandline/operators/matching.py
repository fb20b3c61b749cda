"""Segments without a match among others: the anti-join of the alignment score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.segments import SPEAKER_BONUS, TEXT_WEIGHT, TIME_WEIGHT, overlap_ratio, prepared, score_from
from ..functions.text import let, similarity_within
from .alignment import SAME
from .interval import CELL_SECONDS, overlapping, timed


def unmatched(current: DataFrame, previous: DataFrame, key: str = "recording_id", least: float = SAME, cell_seconds: float = CELL_SECONDS) -> DataFrame:
    """``current`` segments that score less than ``least`` with each ``previous`` one of their recording that overlaps them.

    Both have key, seg_idx, start, end, text, speaker.  Pairs meet by key, level
    and cell of time (see :func:`.interval.overlapping`).  From the times and
    speakers follows how alike the texts must be, so an edit distance is computed
    in a band only, where lengths allow one at all.  What overlaps nothing stays.
    """
    seg = F.struct("start", "end", "text", "speaker")
    one = lambda side: F.element_at(prepared(F.array(seg)), 1).alias(side)
    left = current.select(F.col(key).alias("__key"), F.col("seg_idx").alias("__seg"), *timed("__s", "__e"), one("b"))
    right = previous.select(F.col(key).alias("__tkey"), *timed("__ts", "__te"), one("a"))
    near = overlapping(left, right, cell_seconds)
    both = F.col("a.spk").isNotNull() & F.col("b.spk").isNotNull()
    time = overlap_ratio(F.col("__ts"), F.col("__te"), F.col("__s"), F.col("__e"))
    needed = (F.lit(least) - time * TIME_WEIGHT - F.when(both, F.lit(SPEAKER_BONUS)).otherwise(0.0)) / TEXT_WEIGHT
    near = near.where(~both | (F.col("a.spk") == F.col("b.spk"))).withColumn("__time", time).withColumn("__needed", needed)
    text = similarity_within(F.col("a.norm"), F.col("b.norm"), F.col("__needed"))
    found = near.where(let(text, lambda t: score_from(t, F.col("__time"), F.col("a.spk"), F.col("b.spk"))) >= least)
    matched = found.select(F.col("__key"), F.col("__seg")).distinct()
    return current.join(matched, (F.col(key) == F.col("__key")) & (F.col("seg_idx") == F.col("__seg")), "left_anti")
