"""Conversations repaired at the least cost: layers of reachable grammar states, one bitset a turn and cost.

A conversation is well formed if its roles' initials are ``(s?(ua)+)?``.  Rows
are kept, get another role, are deleted, or empty rows are inserted; a row that
is blank or repeats an earlier one must go, and one that stays though it is cut
off costs more.  The layer of cost c holds for each turn the set of grammar
states, as bits, from which the rest can be accepted at a cost of c at most.  A
layer follows from those before it by a few bit operations a turn, as in
approximate matching by Wu and Manber; the first whose bit of the entry state is
set gives the cost.  From there the trace goes forward: of the edits whose next
state is set in the layer that their cost leaves, that with the least letter is
taken, so the audit is the least string of all cheapest ones.  States differ by
a few layers only, so a layer is computed where turns aren't complete, and work
is linear in the turns.

Rows are sorted by ranges, so a conversation of any length is divided among
tasks until its digest, which is a chain, is made: blocks of ``BLOCK`` rows
are then walked, last to first for the costs that blocks leave (a byte a row),
and first to last for the trace; a task holds one block.  Equal rows are one row
with a count from the start.

Nulls in role or text are one space; a null turn comes first; rows with a null
conversation are a conversation.  Rows of one turn are in the order of role and
text; texts are told apart by md5 when repeats are looked for.  An empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import written

#: Costs of another role, a deletion, an insertion, and of leaving what is cut off.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Rows of a block.
BLOCK = 256
#: The grammar: by role's initial, state to state; 0 is the start, the others what came last. A repair writes these roles.
_NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_ROLE, _WRITTEN = {"u": "user", "a": "assistant"}, {0: "u", 1: "u", 2: "a", 3: "u"}
#: Costs at the end by state, and what is inserted there.
_END, _TAIL = (0, 2 * INSERT, INSERT, 0), {0: "", 1: "ua", 2: "a", 3: ""}
_FULL = 15


def _before(role: str) -> list[int]:
    """For each set of states, the set from which the role leads into it."""
    return [sum(1 << s for s, t in _NEXT.get(role, {}).items() if into >> t & 1) for into in range(16)]


_KEPT = {r: _before(r) for r in ("s", "u", "a", "")}
_ANY = [u | a for u, a in zip(_KEPT["u"], _KEPT["a"], strict=True)]


def layers(rows: list[tuple[str, bool]], end=_END, until: int = _FULL) -> list[bytearray]:
    """Layers 0, 1, ... over (initial, cut off) of rows: a set of states before each row and after the last.

    ``end`` are the costs that each state leaves for later, less their least;
    the last layer is the first that has the states ``until`` before the first row.
    """
    n, found, full = len(rows), [], len(rows)
    nothing = bytearray(n + 1)
    while not found or found[-1][0] & until != until:
        c = len(found)
        now = bytearray(found[-1]) if found else bytearray(n + 1)
        now[n] = sum(1 << s for s in range(4) if end[s] <= c)
        one, two, five, six = (found[c - k] if c >= k else nothing for k in (REROLE, DELETE, INSERT, REROLE + CUT))
        for i in range(min(full, n - 1), -1, -1):
            role, cut = rows[i]
            some = two[i + 1] | _ANY[five[i]]
            if cut:
                some |= _KEPT[role][five[i + 1]] | _ANY[six[i + 1]]
            else:
                some |= _KEPT[role][now[i + 1]] | _ANY[one[i + 1]]
            if not some:  # nor is there any further to the front
                break
            now[i] = some
        while full > 0 and now[full] == _FULL:
            full -= 1
        found.append(now)
    return found


def costs(rows: list[tuple[str, bool]], end=_END) -> tuple[int, ...]:
    """The least cost from each state before the rows."""
    least = min(end)
    found = layers(rows, tuple(e - least for e in end))
    return tuple(least + next(c for c, x in enumerate(found) if x[0] >> s & 1) for s in range(4))


def trace(rows: list[tuple[str, bool]], state: int, end=_END) -> tuple[list[tuple[str, int, str]], int]:
    """The least of the cheapest edits, as (letter, row that comes next, initial that is written), and the state after them."""
    least = min(end)
    found = layers(rows, tuple(e - least for e in end), 1 << state)
    c, i, edits = len(found) - 1, 0, []
    while i < len(rows):
        role, cut = rows[i]
        extra, other = CUT * cut, _WRITTEN[state]
        after = _NEXT[other][state]
        kept = _NEXT.get(role, {}).get(state)

        def left(cost, at, to):
            return cost <= c and to is not None and found[c - cost][at] >> to & 1  # noqa: B023

        if left(DELETE, i + 1, state):
            edits.append(("D", i, ""))
            c, i = c - DELETE, i + 1
        elif left(INSERT, i, after):
            edits.append(("I", i, other))
            c, state = c - INSERT, after
        elif left(extra, i + 1, kept):
            edits.append(("K", i, role))
            c, i, state = c - extra, i + 1, kept
        else:
            edits.append(("R", i, other))
            c, i, state = c - extra - REROLE, i + 1, after
    return edits, state


def faulty(turns: DataFrame) -> DataFrame:
    """Distinct rows in order: conv_id, seq, turn, role, text, initial, copies, fault (blank, duplicate, truncated or none).

    ``seq`` rises within a conversation.  A duplicate repeats an earlier row; of
    copies the first has the fault and the others are duplicates, unless blank.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    given = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), value("role"), value("text"))
    rows = given.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("digest", F.md5("text")).withColumn("place", F.struct(F.col("turn").isNotNull().alias("some"), "turn"))
    # A text that a conversation has on one turn only is first; others compare with the first turn of all.
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    seen = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("first").isNotNull() & (F.col("first") < F.col("place")), "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("none")
    )
    seen = seen.select("conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), "copies", fault.alias("fault"))
    placed = seen.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return written(placed.withColumn("seq", F.monotonically_increasing_id()), "turns")


_LEFT = "conv_id long, block long, ends array<long>"


def _code(initial: str, fault: str) -> int:
    return 2 * "sua".find(initial) + (fault == "truncated") if initial and initial in "sua" else 6 + (fault == "truncated")


def _decoded(code: int) -> tuple[str, bool]:
    return ("s", "u", "a", "")[code // 2], bool(code % 2)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (conv_id, block, codes) with the last block of a conversation first: the costs that each block but the last leaves."""
    conv, now, out = object(), _END, []
    for batch in batches:
        for one, block, codes in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if one != conv:
                conv, now = one, _END
            else:
                out.append((one, block, now))
            now = costs([_decoded(x) for x in codes], now)
        if out:
            yield pa.RecordBatch.from_pylist([{"conv_id": c, "block": b, "ends": list(e)} for c, b, e in out], pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("ends", pa.list_(pa.int64()))]))
            out = []


class _Walk:
    """A conversation that is read block by block."""

    def __init__(self, conv):
        self.conv, self.state, self.block, self.before = conv, 0, None, None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.cost, self.audit, self.digest, self.any = 0, [], hashlib.sha256(), False
        self.clear()

    def clear(self):
        #: Rows that can stay, how many that can't come before each and last, and (turn, role, text) of the first.
        self.rows, self.gone, self.given, self.ends = [], [0], [], _END

    def add(self, turn, role, text, initial, copies, fault):
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.counts["illegal"] += copies - 1
        self.before = initial
        if fault in ("blank", "duplicate"):
            self.counts[fault] += copies
            self.gone[-1] += copies
            return
        self.counts["duplicate"] += copies - 1
        self.counts["truncated"] += fault == "truncated"
        self.rows.append(_decoded(_code(initial, fault)))
        self.given.append((turn, role, text))
        self.gone.append(copies - 1)

    def write(self, role, text):
        self.digest.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode("utf-8", "replace"))
        self.any = True

    def close(self, last: bool) -> Iterator[tuple]:
        """Ends a block: (turn, role, text, edit) of its rows and of those inserted."""
        edits, state = trace(self.rows, self.state, self.ends)
        done = -1
        for letter, i, role in [*edits, ("", len(self.rows), "")]:
            if i > done:  # what must go goes before anything is inserted, as D is the least letter
                self.audit.append("D" * self.gone[i])
                self.cost += DELETE * self.gone[i]
                done = i
            turn, own, text = self.given[i] if i < len(self.rows) else (None, "", "")
            cut = i < len(self.rows) and self.rows[i][1] and letter in ("K", "R")
            self.audit.append(letter)
            self.cost += {"D": DELETE, "I": INSERT, "R": REROLE}.get(letter, 0) + CUT * cut
            if letter in ("K", "R", "I"):
                row = (None if letter == "I" else turn, own if letter == "K" else _ROLE[role], "" if letter == "I" else text)
                self.write(row[1], row[2])
                yield (*row, letter)
        if last:
            for role in _TAIL[state]:
                self.audit.append("I")
                self.cost += INSERT
                self.write(_ROLE[role], "")
                yield (None, _ROLE[role], "", "I")
        self.state = state
        self.clear()


_REPORT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_TURNS = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
#: Characters of repaired rows in a batch.
_BATCH = 4 << 20


def _walked(report: bool):
    """Function for mapInArrow over (conv_id, block, turn, role, text, initial, copies, fault, ends) in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, out, place, held = None, [], 0, 0
        schema = _REPORT if report else _TURNS

        def closed(last):
            nonlocal place, held
            for turn, role, text, edit in walk.close(last):
                if not report:
                    out.append((walk.conv, place, turn, role, text, edit))
                    held += len(text)
                place += 1
            if report and last:
                out.append((walk.conv, *walk.counts.values(), walk.cost, "".join(walk.audit), walk.digest.hexdigest()))
                held += len(out[-1][-2])

        def batch_of():
            nonlocal out, held
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], schema.field(k).type) for k in range(len(schema))], schema=schema)
            out, held = [], 0
            return made

        for batch in batches:
            for conv, block, turn, role, text, initial, copies, fault, ends in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                if walk is None or conv != walk.conv:
                    if walk is not None:
                        closed(True)
                    walk, place = _Walk(conv), 0
                elif block != walk.block:
                    closed(False)
                walk.block = block
                walk.ends = _END if ends is None else tuple(ends)
                walk.add(turn, role, text, initial, copies, fault)
                if held > _BATCH or len(out) > 10_000:
                    yield batch_of()
        if walk is not None:
            closed(True)
        if out:
            yield batch_of()

    return run


def _walk_of(rows: DataFrame, report: bool) -> DataFrame:
    rows = rows.withColumn("block", F.floor(F.col("seq") / BLOCK))
    # Blocks matter where a conversation has several: their codes are read from the last to the first.
    several = rows.groupBy("conv_id").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high").select("conv_id", F.lit(True).alias("several"))
    stays = F.col("fault").isin("none", "truncated")
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 2).when(F.col("initial") == "a", 4).otherwise(6)
    code = F.when(stays, role + (F.col("fault") == "truncated").cast("int"))
    long = rows.join(several, rows["conv_id"].eqNullSafe(several["conv_id"]), "left_semi")
    codes = long.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.when(stays, F.struct("seq", code.alias("code"))))).alias("c"))
    codes = codes.select("conv_id", "block", F.transform("c", lambda x: x["code"]).alias("codes"))
    ends = codes.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block")).mapInArrow(_ends, _LEFT)
    ends = ends.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "ends")
    light = F.when(stays, F.col("text")).alias("text")
    shape = ["conv_id", "block", "turn", "role", light, "initial", "copies", "fault", "ends", "seq"]
    joined = rows.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left").select(*shape)
    ordered = joined.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInArrow(_walked(report), "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string" if report else "conv_id long, place long, turn long, role string, text string, edit string")


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), turn (null if inserted), role, text, edit (K, R or I)."""
    ship(turns.sparkSession)
    return _walk_of(faulty(turns), False)


def reported(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``gaps`` are the turns that miss between the least and the greatest.
    """
    ship(turns.sparkSession)
    rows = faulty(turns)
    gaps = rows.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")).withColumnRenamed("conv_id", "c")
    found = _walk_of(rows, True)
    return found.join(gaps, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults by crc32 of ``conv_id:turn``, modulo 20; nulls are one space.

    0 drops a row, 1 empties its text, 2 takes its ``[.!?]``, 3 repeats it and 4 makes its role user.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", value("role").alias("role"), value("text").alias("text"), (F.crc32(F.concat(value("conv_id"), F.lit(":"), value("turn"))) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.withColumn("again", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "again")


def repaired_after_damage(turns: DataFrame) -> DataFrame:
    """What :func:`reported` says of the damaged turns, for every conversation of ``turns``."""
    found = reported(damaged(turns)).withColumnRenamed("conv_id", "c")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
