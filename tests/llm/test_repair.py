"""Repairs against a plain search over all edits, and against the query's SQL on odd tables."""

import heapq
import random
import re
import zlib
from hashlib import sha256

import duckdb
import pytest

from strandline.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, code string, seq long"
SPACE = " \t\n\v\f\r"


def plain(rows):
    """The report of (role, text) rows in order: a cheapest-first search over (row, state), strings compared whole."""
    seen, faults = set(), []
    for role, text in rows:
        if not text.strip(SPACE):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("none" if text.rstrip(SPACE)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state, len(rows)) in done:
            continue
        done.add((i, state, len(rows)))
        if i == len(rows) and state in (0, 3):
            break
        for role in ("user", "assistant"):
            if (to := step.get((state, role[0]))) is not None:
                heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*out, f"{role}:")))
        if i == len(rows):
            continue
        (own, text), fault = rows[i], faults[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
        if fault in ("none", "truncated"):
            extra = 5 * (fault == "truncated")
            if (to := step.get((state, own[:1]))) is not None:
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, to, (*out, f"{own}:{text}")))
            for role in ("user", "assistant"):
                if (to := step.get((state, role[0]))) is not None:
                    heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, to, (*out, f"{role}:{text}")))
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (*(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha256("\n".join(out).encode()).hexdigest())


def plain_damage(rows):
    """conv to rows after damage, in order, and its gaps."""
    found = {}
    text = lambda x: " " if x is None else str(x)
    for conv, turn, role, said in rows:
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        own = found.setdefault(conv, [])
        said, role = text(said), text(role)
        said = "" if kind == 1 else re.sub("[.!?]", "", said) if kind == 2 else said
        own += [(turn is not None, turn, "user" if kind == 4 else role, said)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in found.items():
        turns = {t for some, t, *_ in own if some}
        ordered = sorted(own, key=lambda r: (r[0], r[1] or 0, r[2].encode(), r[3].encode()))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *plain([r[2:] for r in ordered]))
    return out


def some(seed, n, convs=30):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "", " \t", "Why?", "So it is. ", "cut off\n", "Really.", "é.", None, "x" * 5000 + "."]
    return [(rng.choice([None, *range(convs)]), rng.choice([None, *range(20)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "umpire", "Ünï"]), rng.choice(texts) if rng.random() < 0.6 else f"Said {rng.random()}.") for _ in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_layers_and_trace(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["s", "u", "a", "u", "a", ""]), rng.random() < 0.2) for _ in range(rng.randrange(0, 30))]
    given = [({"s": "system", "u": "user", "a": "assistant", "": ""}[r], f"{i}" + ("" if cut else ".")) for i, (r, cut) in enumerate(rows)]
    *_, cost, audit, _ = plain(given)
    assert repair.costs(rows)[0] == cost
    edits, state = repair.trace(rows, 0)
    assert "".join(e[0] for e in edits) + "I" * len(repair._TAIL[state]) == audit
    # In two blocks: the first has what the second leaves.
    cut = rng.randrange(0, len(rows) + 1)
    ends = repair.costs(rows[cut:])
    one, middle = repair.trace(rows[:cut], 0, ends)
    two, state = repair.trace(rows[cut:], middle)
    assert "".join(e[0] for e in one + two) + "I" * len(repair._TAIL[state]) == audit


def test_damaged_tables(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 4)  # many conversations cross blocks
    rows = some(1, 900) + [(77, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(300)] + [(78, None, "user", "Again and again.")] * 200 + [(79, 5, "user", None)] * 3
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], SCHEMA)
    found = {r[0]: tuple(r)[1:] for r in repair.repaired_after_damage(df).collect()}
    assert found == plain_damage(rows)


def test_sql(spark):
    rows = [(9 if c is None else c, t, r, x) for c, t, r, x in some(2, 250)] + [(None, 1, "user", "No conversation.")]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], SCHEMA)
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    found = repair.repaired_after_damage(df)
    names = ", ".join(found.columns)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, con.execute(f"SELECT {names} FROM ({queries.oracle_sql()['op13_repair']})").fetchall()))


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Well."), (1, 2, "assistant", "Well."), (2, 0, "user", " ")]
    found = repair.repaired(spark.createDataFrame([(*r, "extra", 1) for r in rows], SCHEMA))
    assert [tuple(r)[1:] for r in found.orderBy("place").collect()] == [(0, 1, "user", "Hi.", "K"), (1, 2, "assistant", "Well.", "K")]


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repaired_after_damage(empty).count() == 0 and repair.repaired(empty).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = repair.repaired_after_damage(spark.createDataFrame([(dropped, 0, "user", "Gone.", "", 1)], SCHEMA)).first()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
