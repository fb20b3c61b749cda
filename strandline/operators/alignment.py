"""Aligning, merging and resolving two overlapping lists of segments, as columns.

A row holds both lists of one window; windows are small (the overlap of two
chunks), and rows are independent, so any number of windows runs in parallel
without an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.segments import edge_confidence, midpoint, prepared, score
from ..functions.text import let, more_complete_of_normalized

#: Fixed values of merging and of resolving.
SURE, SAME, REPEATED = 0.55, 0.82, 0.9
MATCHES = "array<struct<prev_idx:int,curr_idx:int,score:double>>"
_CELL = "struct<v:double,p:array<struct<prev_idx:int,curr_idx:int,score:double>>>"


def best_path(scores: Column) -> Column:
    """Monotonic one-to-one alignment of greatest total over a matrix: MATCHES.

    Cells hold the best total and its path; a match is taken when it's as good
    as skipping, and skipping a row before skipping a column unless that is
    better.
    """
    zero = F.struct(F.lit(0.0).alias("v"), F.array().cast(MATCHES).alias("p")).cast(_CELL)

    def cell(left: Column, up: Column, corner: Column, s: Column, i: Column, j: Column) -> Column:
        matched = F.struct((corner["v"] + s).alias("v"), F.concat(corner["p"], F.array(F.struct(i.alias("prev_idx"), j.alias("curr_idx"), s.alias("score")).cast("struct<prev_idx:int,curr_idx:int,score:double>"))).alias("p")).cast(_CELL)
        return F.when((s > 0) & (corner["v"] + s >= F.greatest(up["v"], left["v"])), matched).when(left["v"] > up["v"], left).otherwise(up)

    def row(above: Column, line: Column) -> Column:
        start = F.array(zero).cast(f"array<{_CELL}>")
        return F.aggregate(
            F.transform(line["s"], lambda s, j: F.struct(s.alias("s"), j.cast("int").alias("j"))),
            start,
            lambda acc, x: F.concat(acc, F.array(cell(F.element_at(acc, -1), F.get(above, x["j"] + 1), F.get(above, x["j"]), x["s"], line["i"], x["j"]))).cast(f"array<{_CELL}>"),
        )

    first = F.transform(F.sequence(F.lit(0), F.size(scores[0])), lambda _: zero).cast(f"array<{_CELL}>")
    lines = F.transform(scores, lambda s, i: F.struct(s.alias("s"), i.cast("int").alias("i")))
    return F.element_at(F.aggregate(lines, first, row), -1)["p"]


def matrix(previous: Column, current: Column) -> Column:
    """Alignment scores of prepared segments, a row for each previous one."""
    return F.transform(previous, lambda a: F.transform(current, lambda b: score(a, b)))


def path(scores: Column) -> Column:
    """MATCHES of a matrix that may be empty."""
    return let(scores, lambda s: F.when(F.size(F.coalesce(F.get(s, F.lit(0)), F.array().cast("array<double>"))) > 0, best_path(s)).otherwise(F.array().cast(MATCHES)))


def aligned_prepared(previous: Column, current: Column) -> Column:
    return path(matrix(previous, current))


def aligned(previous: Column, current: Column) -> Column:
    """MATCHES of two lists of segments."""
    return let(F.struct(prepared(previous).alias("a"), prepared(current).alias("b")), lambda x: aligned_prepared(x["a"], x["b"]))


def _in_order(parts: list[Column]) -> Column:
    """Prepared segments of all parts by (start, end), then by part and place."""
    def keyed(k: int, part: Column) -> Column:
        return F.transform(part, lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k"), i.cast("int").alias("i"), x.alias("x")))

    return F.transform(F.array_sort(F.concat(*(keyed(k, p) for k, p in enumerate(parts)))), lambda y: y["x"])


def merged(previous: Column, current: Column, overlap_start: Column, overlap_end: Column) -> Column:
    """One list of segments from the lists of two chunks.

    Of matched segments the more complete text stays, else the one farther from
    its chunk's edge; what still repeats a kept earlier segment goes.  An empty
    list gives the other one as it is.
    """

    def decided(x: Column, scores: Column) -> Column:
        """Places that go: p of previous, c of current."""

        def one(m: Column) -> Column:
            p, c = F.get(x["po"], m["prev_idx"]), F.get(x["co"], m["curr_idx"])
            later = edge_confidence(c["s"], c["e"], overlap_start, overlap_end, False) > edge_confidence(p["s"], p["e"], overlap_start, overlap_end, True)
            whole = more_complete_of_normalized(c["norm"], p["norm"]) | (~more_complete_of_normalized(p["norm"], c["norm"]) & later)
            return F.struct(((m["score"] >= SURE) & whole).alias("newer"), p["ix"].alias("p"), c["ix"].alias("c"))

        return let(
            F.transform(path(scores), one),
            lambda made: F.struct(
                F.transform(F.filter(made, lambda d: d["newer"]), lambda d: d["p"]).alias("p"),
                F.transform(F.filter(made, lambda d: ~d["newer"]), lambda d: d["c"]).alias("c"),
            ),
        )

    def chosen(x: Column, scores: Column, gone: Column) -> Column:
        def repeated(j: Column) -> Column:
            """Whether the j-th current segment is one that a kept previous one says already."""
            column = F.transform(x["po"], lambda p, i: F.struct(p["ix"].alias("ix"), F.get(F.get(scores, i), j).alias("s")))
            return F.exists(column, lambda t: (t["s"] >= SAME) & ~F.array_contains(gone["p"], t["ix"]))

        repeats = F.transform(F.filter(x["co"], lambda c, j: repeated(j)), lambda c: c["ix"])
        return let(repeats, lambda seen: F.transform(
            _in_order([F.filter(x["a"], lambda p: ~F.array_contains(gone["p"], p["ix"])), F.filter(x["b"], lambda c: ~F.array_contains(gone["c"], c["ix"]) & ~F.array_contains(seen, c["ix"]))]),
            lambda y: y["seg"],
        ))

    lists = F.struct(prepared(previous).alias("a"), prepared(current).alias("b"))

    def windowed(y: Column) -> Column:
        return F.struct(y["a"].alias("a"), y["b"].alias("b"), F.filter(y["a"], lambda s: s["e"] > overlap_start).alias("po"), F.filter(y["b"], lambda s: s["s"] < overlap_end).alias("co"))

    both = let(lists, lambda y: let(windowed(y), lambda x: let(matrix(x["po"], x["co"]), lambda m: let(decided(x, m), lambda gone: chosen(x, m, gone)))))
    return F.when(F.size(previous) == 0, current).when(F.size(current) == 0, previous).otherwise(both)


def resolved(previous: Column, current: Column, overlap_start: Column, overlap_end: Column) -> Column:
    """The segments of an overlap window that two chunks both cover.

    Of matched segments the one from the chunk on whose side of the middle it
    is stays; all unmatched stay; a segment that repeats the last kept one goes.
    """
    middle = overlap_start + (overlap_end - overlap_start) / 2.0

    def chosen(x: Column) -> Column:
        def one(m: Column) -> Column:
            p, c = F.get(x["a"], m["prev_idx"]), F.get(x["b"], m["curr_idx"])
            at = midpoint(p["s"], p["e"])
            return F.when((at < middle) | ((p["norm"] == c["norm"]) & (at <= middle)), p).otherwise(c)

        return let(
            aligned_prepared(x["a"], x["b"]),
            lambda m: _in_order([
                F.transform(m, one),
                F.filter(x["a"], lambda p: ~F.array_contains(F.transform(m, lambda q: q["prev_idx"]), p["ix"])),
                F.filter(x["b"], lambda c: ~F.array_contains(F.transform(m, lambda q: q["curr_idx"]), c["ix"])),
            ]),
        )

    lists = F.struct(prepared(previous).alias("a"), prepared(current).alias("b"))
    both = let(lists, lambda x: let(chosen(x), lambda rows: F.transform(without_repeats(rows), lambda y: y["seg"])))
    return F.when(F.size(previous) == 0, current).when(F.size(current) == 0, previous).otherwise(both)


def without_repeats(rows: Column) -> Column:
    """Prepared segments in order, without those that repeat the last kept one."""
    return F.aggregate(rows, F.slice(rows, 1, 0), lambda kept, x: F.when((F.size(kept) > 0) & (score(F.coalesce(F.try_element_at(kept, F.lit(-1)), x), x) >= REPEATED), kept).otherwise(F.concat(kept, F.array(x))))
