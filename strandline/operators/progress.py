"""Status events of jobs: throttling, states, ends, routing.

The throttle compares with the last event that was let through, so it's a fold
by job.  It runs over sorted partitions in a stream: a task holds one job's last
values, not its events.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: States that end a job.
ENDED = ("completed", "failed", "canceled")
#: States that a job may go to from each.
NEXT = {
    "claimed": ("awaiting_payload", "running", "failed", "canceled"),
    "awaiting_payload": ("running", "failed", "canceled"),
    "running": ("running", "awaiting_result", "completed", "failed", "canceled"),
    "awaiting_result": ("completed", "failed", "canceled"),
}


class Throttle:
    """Lets an event through unless both its progress and its time are too near the last let through.

    Events without progress always pass and change nothing.  Progress that goes
    back is near.
    """

    def __init__(self, min_progress: float, min_seconds: float):
        self.min_progress, self.min_seconds = min_progress, min_seconds
        self.last: tuple[float, float] | None = None

    def passes(self, progress: float | None, seconds: float) -> bool:
        if progress is None or math.isnan(progress):
            return True
        if self.last is not None and progress - self.last[0] < self.min_progress and seconds - self.last[1] < self.min_seconds:
            return False
        self.last = progress, seconds
        return True


def throttled(events: DataFrame, job: str, order: list[str], progress: str, seconds: str, min_progress: float = 1.0, min_seconds: float = 2.0) -> DataFrame:
    """``events`` that a throttle by job lets through; ``seconds`` is a clock, and an event without it is at 0. Events without a job are one job's."""
    ship(events.sparkSession)
    at = [events.columns.index(c) for c in (job, progress, seconds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, throttle = object(), Throttle(min_progress, min_seconds)
        for batch in batches:
            keep = []
            for name, p, t in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                if name != now:
                    now, throttle = name, Throttle(min_progress, min_seconds)
                keep.append(throttle.passes(p, t or 0.0))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return events.repartition(job).sortWithinPartitions(job, *order).mapInArrow(run, events.schema)


def reported(events: DataFrame, job: str, order: list[str], progress: str, seconds: str, ends: Column, min_progress: float = 1.0, min_seconds: float = 2.0) -> DataFrame:
    """What is sent of a job's events: throttled, the one that ends it always, and none after that."""
    live = until_end(events, job, order, ends)
    return throttled(live.where(~F.coalesce(ends, F.lit(False))), job, order, progress, seconds, min_progress, min_seconds).unionByName(live.where(ends))


def latest(events: DataFrame, job: str, order: list[str], state: str) -> DataFrame:
    """The last state of each job, with the number of its events; a map-side aggregate."""
    return events.groupBy(job).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count(F.lit(1)).alias("n_events"))


def until_end(events: DataFrame, job: str, order: list[str], ends: Column) -> DataFrame:
    """Events of each job up to the first that ends it, that one included: what comes later is void."""
    ended = events.where(ends).groupBy(F.col(job).alias("__job")).agg(F.min(F.struct(*order)).alias("__end"))
    return events.join(ended, F.col(job).eqNullSafe(F.col("__job")), "left").where(F.col("__end").isNull() | (F.struct(*order) <= F.col("__end"))).drop("__job", "__end")


def checked(events: DataFrame, job: str, order: list[str], state: str) -> DataFrame:
    """Events with ``valid``: whether the state may follow the one before; a job begins as claimed."""
    before = F.lag(state).over(Window.partitionBy(job).orderBy(*order))
    allowed = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in NEXT.items() for x in pair))
    may = F.coalesce(F.array_contains(F.try_element_at(allowed, before), F.col(state)), F.lit(False))
    return events.withColumn("valid", F.when(before.isNull(), F.col(state) == "claimed").otherwise(may))


def outcome(error_code: Column, error_message: Column, canceled: Column) -> Column:
    """Final state of a job: an error is a struct that isn't null, whatever its message."""
    return F.when(canceled, "canceled").when(error_code.isNotNull() | error_message.isNotNull(), "failed").otherwise("completed")


def payload_of(update: Column, include_utterance: bool) -> Column:
    """A status update without its utterance unless asked for; null if neither progress nor an utterance is left."""
    kept = update if include_utterance else update.dropFields("utterance")
    some = update["progress"].isNotNull() | (update["utterance"].isNotNull() if include_utterance else F.lit(False))
    return F.when(some, kept)


def observed_once(segments: DataFrame, key: str, start: str, end: str, *more: str) -> DataFrame:
    """One row for each key, further columns and times rounded to hundredths; the first by those columns' order doesn't matter as only they stay."""
    return segments.select(key, *more, F.round(start, 2).alias(start), F.round(end, 2).alias(end)).distinct()
