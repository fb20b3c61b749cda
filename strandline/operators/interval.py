"""Segments named by the turn that overlaps them most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.segments import end_of, overlap, start_of
from ..functions.text import stripped

#: Seconds of a cell of the first level; how many times longer a cell of the next one is; seconds beyond which times aren't times.
CELL_SECONDS, STEP, FAR = 16.0, 4, 1e15
#: Rows that ask in one place, about; times the mean that a cell's rows are taken to be.
PLACE_ROWS, UNEVEN = 4096, 4


def named_by_overlap(segments: DataFrame, turns: DataFrame, key: str = "recording_id", cell_seconds: float = CELL_SECONDS) -> DataFrame:
    """``segments`` (key, seg_idx, start, end, ...) with ``speaker`` of the turn (key, turn_idx, start, end, speaker).

    Among turns of equal overlap the earliest by turn_idx wins; without a positive
    overlap the speaker is null.  A null start is 0 and a null end the start;
    what has no finite times overlaps nothing.  See :func:`overlapping` for how
    a long recording is divided among tasks.
    """
    left = segments.select(F.col(key).alias("__key"), F.col("seg_idx").alias("__seg"), *timed("__s", "__e"))
    right = turns.select(F.col(key).alias("__tkey"), F.col("turn_idx").alias("__turn"), *timed("__ts", "__te"), F.col("speaker").alias("__speaker")).where("__te > __ts")
    shared = overlap(F.col("__s"), F.col("__e"), F.col("__ts"), F.col("__te"))
    best = overlapping(left, right, cell_seconds).groupBy("__key", "__seg").agg(F.max_by("__speaker", F.struct(shared, -F.col("__turn"))).alias("speaker"))
    return segments.join(best, (F.col(key) == F.col("__key")) & (F.col("seg_idx") == F.col("__seg")), "left").drop("__key", "__seg")


def timed(start: str, end: str) -> list[Column]:
    """Times of a row, by the rules for nulls."""
    return [start_of(F.col("start")).cast("double").alias(start), end_of(F.col("start"), F.col("end")).cast("double").alias(end)]


def overlapping(left: DataFrame, right: DataFrame, cell_seconds: float = CELL_SECONDS) -> DataFrame:
    """Pairs of ``left`` (__key, __s, __e, ...) and ``right`` (__tkey, __ts, __te, ...) of one key, where each begins before the other ends.

    Intervals have levels: at each, time is cut into cells, ``STEP`` times longer
    than those of the level before, and an interval's own level is the first
    whose cells are as long as itself, so it is in two of them at most.  A pair
    meets at the coarser of its levels, in the cell where its overlap begins: the
    one whose level that is stands in its own cells, and the other asks there by
    the cells that it is in at each coarser level that the other side has in this
    recording.  The join is an equi-join on key, level, cell and place.  A long
    cell has one place for about ``PLACE_ROWS`` rows that ask, by how many rows
    the recording has and how much of its time they fill; who asks goes to one of
    them by a hash, and who stands there, mostly few, to all.  So neither long
    intervals nor long recordings make a key that many rows share.
    """
    left = left.where((F.abs("__s") < FAR) & (F.abs("__e") < FAR)).withColumn("__level", _level(F.col("__e") - F.col("__s"), cell_seconds))
    right = right.where((F.abs("__ts") < FAR) & (F.abs("__te") < FAR)).withColumn("__level", _level(F.col("__te") - F.col("__ts"), cell_seconds))
    sides = left.select(F.col("__key").alias("__k"), F.lit(True).alias("l"), "__level", F.col("__s").alias("t")).unionByName(right.select(F.col("__tkey").alias("__k"), F.lit(False).alias("l"), "__level", F.col("__ts").alias("t")))
    # Rows and levels of both sides, and the cells of the first level that each fills: counted by cell, then by recording.
    own = {"__l": "l", "__r": "NOT l"}
    by_cell = sides.withColumn("bit", F.expr("shiftleft(1L, __level)")).groupBy("__k", F.expr(f"floor(t / {cell_seconds}D)").alias("c")).agg(*(
        F.expr(x) for name, side in own.items() for x in (f"bit_or(CASE WHEN {side} THEN bit ELSE 0L END) AS {name}bits", f"sum(CASE WHEN {side} THEN 1L ELSE 0L END) AS {name}rows")
    ))
    stats = by_cell.groupBy("__k").agg(*(
        F.expr(x) for name in own for x in (f"bit_or({name}bits) AS {name}bits", f"sum({name}rows) AS {name}rows", f"sum(CASE WHEN {name}rows > 0 THEN 1L ELSE 0L END) AS {name}cells")
    )).where("__lbits <> 0 AND __rbits <> 0")

    def places(level: str, side: str) -> str:
        """Places of a cell of the level for the rows of a side that ask there."""
        return f"greatest(1L, cast(ceil({side}rows * least(1.0D, {UNEVEN} * power({STEP}.0D, {level}) / greatest(1L, {side}cells)) / {PLACE_ROWS}) AS bigint))"

    def put(rows: DataFrame, key: str, start: str, end: str, own: str, other: str, first: bool, name: str) -> DataFrame:
        """Rows by all places (level, asked by the left, cell, place) where they ask or stand; of a pair of one level the left one asks."""
        rows = rows.withColumn("__row", F.xxhash64(*rows.columns)).join(stats, F.col(key) == F.col("__k"))
        above = f"__level + {0 if first else 1}"
        levels = f"filter(sequence(0, 61), l -> l >= {above} AND ({other}bits & shiftleft(1L, l)) <> 0)"
        asks = f"transform({levels}, l -> named_struct('level', l, 'left', {first}, 'spots', array(pmod(__row, {places('l', own)}))))"
        stands = f"array(named_struct('level', __level, 'left', {not first}, 'spots', sequence(0L, {places('__level', other)} - 1)))"
        stands = f"filter({stands}, x -> ({other}bits & (shiftleft(1L, {above}) - 1)) <> 0)"
        size = f"({cell_seconds}D * power({STEP}.0D, m.level))"
        spot = "transform(m.spots, p -> named_struct('level', m.level, 'left', m.left, 'cell', c, 'place', p))"
        cells = f"transform(sequence(floor({start} / {size}), greatest(floor({start} / {size}), floor({end} / {size}))), c -> {spot})"
        found = rows.withColumn(name, F.explode(F.expr(f"flatten(transform(concat({asks}, {stands}), m -> flatten({cells})))")))
        return found.drop("__k", "__level", "__row", *(f"{x}{c}" for x in ("__l", "__r") for c in ("bits", "rows", "cells")))

    one = put(left, "__key", "__s", "__e", "__l", "__r", True, "__at")
    two = put(right, "__tkey", "__ts", "__te", "__r", "__l", False, "__tat")
    pairs = one.join(two, (F.col("__key") == F.col("__tkey")) & (F.col("__at") == F.col("__tat")) & (F.col("__s") < F.col("__te")) & (F.col("__ts") < F.col("__e")))
    begins = F.expr(f"floor(greatest(__s, __ts) / ({cell_seconds}D * power({STEP}.0D, __at.level)))")
    return pairs.where(F.col("__at.cell") == begins).drop("__at", "__tat")


def _level(duration: Column, cell_seconds: float) -> Column:
    """The first level whose cells are as long as the interval."""
    return F.when(duration <= cell_seconds, 0).otherwise(F.ceil(F.log(float(STEP), F.when(duration > cell_seconds, duration).otherwise(cell_seconds) / cell_seconds))).cast("int")


def relabelled(segments: DataFrame, assignments: DataFrame, key: str = "recording_id") -> DataFrame:
    """Final speakers: those assigned to (key, chunk_index, local_speaker), else the provisional label; null without a local one."""
    known = assignments.select(key, "chunk_index", "local_speaker", F.col("speaker").alias("__global"))
    return segments.drop("speaker").join(known, [key, "chunk_index", "local_speaker"], "left").withColumn(
        "speaker", F.when(F.col("local_speaker").isNotNull(), F.coalesce("__global", F.concat(F.lit("chunk"), F.col("chunk_index").cast("string"), F.lit(":"), F.col("local_speaker"))))
    ).drop("__global")


def words(segments: DataFrame, key: str = "recording_id", lang: str = "en", ticks: int = 16_000) -> DataFrame:
    """Evenly timed words: key, seg_idx, word_idx, start_ts, end_ts (ticks), word, probability, lang.

    The last word ends with its segment; words after the first begin with a
    space; segments without text give none.
    """
    tokens = F.filter(F.split(stripped(F.coalesce("text", F.lit(""))), r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")
    timed = segments.select(key, "seg_idx", (F.coalesce("start", F.lit(0.0)) * ticks).cast("long").alias("a"), (F.coalesce("end", "start", F.lit(0.0)) * ticks).cast("long").alias("b"), tokens.alias("tokens")).withColumn("n", F.size("tokens")).where("n > 0")
    each = timed.withColumn("step", F.expr("greatest(1, greatest(1, b - a) div n)")).select("*", F.posexplode("tokens").alias("i", "token"))
    return each.select(
        key, "seg_idx", F.col("i").cast("long").alias("word_idx"), (F.col("a") + F.col("i") * F.col("step")).alias("start_ts"),
        F.when(F.col("i") == F.col("n") - 1, F.col("b")).otherwise(F.col("a") + (F.col("i") + 1) * F.col("step")).alias("end_ts"),
        F.when(F.col("i") == 0, F.col("token")).otherwise(F.concat(F.lit(" "), F.col("token"))).alias("word"), F.lit(1.0).alias("probability"), F.lit(lang).alias("lang"),
    )
