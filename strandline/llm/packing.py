"""Best-two-fit packing of tokenised documents into sequences.

Documents longer than a sequence are cut into pieces of its length, the first
of which may be shorter; others stay whole.  Only the number of pieces of each
length matters for packing, so the plan is made from at most ``CAPACITY``
counts: a bin takes the longest piece left, is filled greedily with the longest
that fit, and then its smallest piece gives way to two unpacked ones if these
fill the widened gap more tightly, until none do.  A bin is repeated while its
pieces last.  The plan is therefore over all documents, however many, and its
size is bounded by the capacity.

Pieces find their places by their rank among those of their length.  Ranks come
from the place in the written piece table and from counts by file, so neither
ids nor texts are exchanged, and a length that a third of all documents share
is nobody's hot key.

Nulls: a null text is empty and gives a piece of the end id alone; a null id
stays null.  Rows that repeat an id are packed like others.  An empty table
gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import slices, text_or_empty, written
from .tokens import encoder

CAPACITY, END = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, nth long"


def _pieces(path: str, spaces: bool, capacity: int, end: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("nth", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = encoder(path, spaces), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, texts in slices(batch.column(1)):
                rows: list[list] = [[] for _ in schema]
                for doc_id, ids in zip(batch.column(0).slice(lo, len(texts)).to_pylist(), coder.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(end))
                    first = len(ids) % capacity or capacity
                    for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                        start = max(0, stop - capacity) if piece else 0
                        length = stop - start
                        for column, value in zip(rows, (doc_id, piece, start, length, ids[start:stop].astype("<u4").tobytes(), part, int(seen[length])), strict=True):
                            column.append(value)
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return run


def pieces(docs: DataFrame, path: str, spaces: bool = True, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The written piece table, PIECES: ``ids`` are little-endian 32-bit, ``nth`` counts a length within a part."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return written(rows.mapInArrow(_pieces(path, spaces, capacity, end), PIECES), "pieces", compression="zstd")


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a bin, bins like it) that hold ``counts[length]`` pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    order = sorted(left)
    plan = []

    def largest(limit: int, used: dict[int, int]) -> int | None:
        """The longest piece up to the limit that is left beside those used."""
        i = bisect_right(order, limit) - 1
        while i >= 0 and left[order[i]] <= used.get(order[i], 0):
            i -= 1
        return order[i] if i >= 0 else None

    def pair(limit: int, over: int, used: dict[int, int]) -> tuple[int, int] | None:
        """Two pieces left whose sum is nearest the limit from below, if it's over ``over``."""
        best, i, j = None, 0, bisect_right(order, limit) - 1
        while i <= j:
            a, b = order[i], order[j]
            if a + b > limit or left[b] <= used.get(b, 0):
                j -= 1
            elif left[a] - used.get(a, 0) < 1 + (a == b):
                i += 1
            else:
                if a + b > over:
                    best, over = (b, a), a + b
                    if over == limit:
                        break
                i += 1
        return best

    while order:
        bin_, used, gap = [], {}, capacity
        while (n := largest(gap, used)) is not None:
            bin_.append(n)
            used[n] = used.get(n, 0) + 1
            gap -= n
        while gap and len(bin_) > 1:
            least = bin_.pop()
            used[least] -= 1
            two = pair(gap + least, least, used)
            if two is None:
                bin_.append(least)
                used[least] += 1
                break
            bin_ = sorted([*bin_, *two], reverse=True)
            for n in two:
                used[n] = used.get(n, 0) + 1
            gap += least - sum(two)
        times = min(left[n] // k for n, k in used.items() if k)
        plan.append((tuple(bin_), times))
        for n, k in used.items():
            left[n] -= k * times
        order = [n for n in order if left[n]]
    return plan


def _places(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted keys (length and rank from which a bin shape serves), and its first sequence, and the offset in it."""
    served: dict[int, int] = {}
    rows, sequence = [], 0
    for bin_, times in plan:
        offset = 0
        for n in bin_:
            rows.append(((n << 44) + served.get(n, 0), sequence, offset))
            served[n] = served.get(n, 0) + times
            offset += n
        sequence += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3


def packed(found: DataFrame, capacity: int = CAPACITY, carry: list[Column] | None = None) -> DataFrame:
    """Places of the pieces of a written table: doc_id, piece, start, length, sequence_id, offset, then ``carry``.

    ``carry`` is read from the piece table; by default the ids themselves.
    """
    ship(found.sparkSession)
    by_part = found.groupBy("length", "part").count()
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most one a length
    keys, sequences, offsets = _places(best_two_fit(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = by_part.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    carried = found.select("doc_id", "piece", "start", "length", "part", "nth", *(carry if carry is not None else ["ids"]))
    ranked = carried.join(parts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "part")
    names = [c for c in ranked.columns if c not in ("rank", "length", "doc_id", "piece", "start")]
    ranked = ranked.select("doc_id", "piece", "start", "length", "rank", *names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("rank", "length"))
            at = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            own = [pa.array(sequences[at] + rank - (keys[at] & ((1 << 44) - 1)), pa.int64()), pa.array(offsets[at], pa.int64())]
            head = ["doc_id", "piece", "start", "length"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in head), *own, *(batch.column(k) for k in names)], names=[*head, "sequence_id", "offset", *names])

    kinds = dict(ranked.dtypes)
    return ranked.mapInArrow(place, ", ".join(["doc_id long", "piece int", "start long", "length long", "sequence_id long", "offset long", *(f"`{n}` {kinds[n]}" for n in names)]))


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and ids (binary) of each sequence, its pieces in order; a group holds one sequence's ids."""
    inside = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return placed.groupBy("sequence_id").agg(inside.alias("x")).select("sequence_id", F.unhex(F.array_join(F.col("x.ids"), "")).alias("ids"))
