"""One timeline from overlapping chunks of a recording.

What a chunk holds back (its tail) depends on that chunk alone, so the stream of
chunks needs no running state: a window function brings the previous chunk's
tail, and every chunk is resolved by itself, in parallel, whatever the length of
its recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.segments import end_of, start_of
from .alignment import resolved


def _start(s: Column) -> Column:
    return start_of(s["start"])


def _end(s: Column) -> Column:
    return end_of(s["start"], s["end"])


def tail(segments: Column, chunk_start: Column, chunk_end: Column, overlap: float) -> Column:
    """What a chunk that isn't the last holds back: segments that end within its overlap with the next."""
    begins = F.greatest(chunk_start, chunk_end - overlap)
    return F.filter(segments, lambda s: _end(s) > begins)


def emissions(previous_tail: Column, segments: Column, chunk_start: Column, chunk_end: Column, is_last: Column, overlap: float, exactly_once: bool = False) -> Column:
    """Array of (reason, segments) that a chunk emits, in order.

    A long segment can be resolved in one window and held back for the next, and
    so come twice; with ``exactly_once`` what reaches into the held back tail
    isn't emitted before it.
    """
    head_end = F.least(chunk_end, chunk_start + overlap)
    tail_start = F.greatest(chunk_start, chunk_end - overlap)
    had = F.size(previous_tail) > 0
    head, body = F.filter(segments, lambda s: _start(s) < head_end), F.filter(segments, lambda s: _start(s) >= head_end)
    if exactly_once:
        head = F.filter(head, lambda s: is_last | (_end(s) <= tail_start))
    early = F.greatest(chunk_end - overlap, F.lit(0.0))
    nothing = F.slice(segments, 1, 0)

    def part(reason: str, when: Column, rows: Column) -> Column:
        return F.struct(F.lit(reason).alias("reason"), F.when(when, rows).otherwise(nothing).alias("segments"))

    if overlap <= 0:
        return F.array(part("no-overlap", F.lit(True), segments))
    return F.array(
        part("resolved-overlap", had, resolved(previous_tail, head, chunk_start, head_end)),
        part("initial-non-overlap", ~had, F.filter(segments, lambda s: _end(s) <= early)),
        part("last-trailing", is_last & ~had, F.filter(segments, lambda s: _end(s) > early)),
        part("last-body", is_last & had, body),
        part("mid-body", ~is_last & had, F.filter(body, lambda s: _end(s) <= tail_start)),
    )


def emitted(chunks: DataFrame, overlap: float, key: str = "recording_id", exactly_once: bool = False) -> DataFrame:
    """Segments in the order of emission: key, chunk_index, reason, emit_idx (within the chunk), seg.

    ``chunks`` has key, chunk_index, chunk_start, chunk_end, is_last, segments.
    A tail that no further chunk takes up comes at the end of its recording.
    """
    w = Window.partitionBy(key).orderBy("chunk_index")
    held = F.when(~F.col("is_last"), tail(F.col("segments"), F.col("chunk_start"), F.col("chunk_end"), overlap)).otherwise(F.slice("segments", 1, 0))
    rows = chunks.withColumn("segments", F.coalesce("segments", F.slice("segments", 1, 0))).withColumn("held", held if overlap > 0 else F.slice("segments", 1, 0))
    rows = rows.withColumn("before", F.coalesce(F.lag("held").over(w), F.slice("segments", 1, 0))).withColumn("after", F.lead("chunk_index").over(w))
    parts = emissions(F.col("before"), F.col("segments"), F.col("chunk_start"), F.col("chunk_end"), F.col("is_last"), overlap, exactly_once)
    final = F.array(F.struct(F.lit("finalize-tail").alias("reason"), F.when(F.col("after").isNull(), F.col("held")).otherwise(F.slice("segments", 1, 0)).alias("segments")))
    flat = F.flatten(F.transform(F.concat(parts, final), lambda p: F.transform(p["segments"], lambda s: F.struct(p["reason"].alias("reason"), s.alias("seg")))))
    out = rows.select(key, "chunk_index", F.posexplode(flat).alias("emit_idx", "x"))
    return out.select(key, "chunk_index", F.col("x.reason").alias("reason"), F.col("emit_idx").cast("long").alias("emit_idx"), F.col("x.seg").alias("seg"))
