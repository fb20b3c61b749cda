import json
import os
import random

from strandline.operators import chunks
from strandline.streaming import stateful

from . import brute
from .test_segments import random_windows, seg

CHUNK = "recording_id string, chunk_index int, chunk_start double, chunk_end double, is_last boolean, segments array<struct<start:double,end:double,text:string,speaker:string>>"


def emitted(spark, rows, overlap, **more):
    found = chunks.emitted(spark.createDataFrame(rows, CHUNK), overlap, **more).orderBy("recording_id", "chunk_index", "emit_idx").collect()
    return [(r.chunk_index, r.reason, r.seg.text) for r in found]


FIRST, HELD, LATER = seg(4, 33, "We cast off at six"), seg(81, 117, "The wind turns to the west"), seg(141, 163, "Land on the starboard side")


def test_delayed_overlap(spark):
    again = seg(78, 115, "The wind turns to the west")
    got = emitted(spark, [("r", 1, 0.0, 120.0, False, [FIRST, HELD]), ("r", 2, 60.0, 180.0, True, [again, LATER])], 60.0)
    assert [(k, t) for k, _, t in got] == [(1, FIRST["text"]), (2, HELD["text"]), (2, LATER["text"])]


def test_without_overlap_last_and_finalize(spark):
    assert [t for _, _, t in emitted(spark, [("r", 1, 0.0, 120.0, False, [FIRST, HELD])], 0.0)] == [FIRST["text"], HELD["text"]]
    x, y, z = seg(7, 21, "bow"), seg(64, 80, "mast"), seg(122, 139, "stern")
    assert [t for _, _, t in emitted(spark, [("r", 1, 0.0, 120.0, False, [x]), ("r", 2, 60.0, 180.0, True, [y, z])], 60.0)] == ["bow", "mast", "stern"]
    bells = [seg(i * 110, i * 110 + 70, f"bell {i}") for i in range(5)] + [seg(561.5, 600, "the last bell")]
    got = emitted(spark, [("r", 1, 0.0, 600.0, False, bells)], 40.0)
    assert [(r, t) for _, r, t in got] == [("initial-non-overlap", f"bell {i}") for i in range(5)] + [("finalize-tail", "the last bell")]


def test_long_segment_comes_twice_unless_asked_otherwise(spark):
    rows = [("r", 1, 0.0, 120.0, False, [seg(80, 110, "held back")]), ("r", 2, 60.0, 180.0, False, [seg(100, 170, "a long one")]), ("r", 3, 120.0, 240.0, True, [])]
    assert [t for _, _, t in emitted(spark, rows, 60.0)].count("a long one") == 2
    assert [t for _, _, t in emitted(spark, rows, 60.0, exactly_once=True)].count("a long one") == 1


def random_chunks():
    rng, rows = random.Random(3), []
    for r, (p, c, _, _) in enumerate(random_windows(5, 25)):
        parts = [p, c, [dict(s, start=s["start"] + 2, end=s["end"] + 2) for s in p]]
        parts = parts[: rng.randint(1, 3)]
        rows.append([(f"r{r}", k + 1, k * 2.0, k * 2.0 + 4.0, k == len(parts) - 1 and rng.random() < 0.7, s) for k, s in enumerate(parts)])
    return rows


def test_equals_brute_force(spark):
    rows = random_chunks()
    got = emitted(spark, [x for r in rows for x in r], 2.0)
    want = []
    names = CHUNK.replace("array<struct<start:double,end:double,text:string,speaker:string>>", "x").split(", ")
    for r in sorted(rows, key=lambda r: r[0][0]):
        out, left = brute.emit([dict(zip([n.split()[0] for n in names], x, strict=True)) for x in r], 2.0)
        want += [(x[1], s["text"]) for x, part in zip(r, out, strict=True) for s in part] + [(r[-1][1], s["text"]) for s in left]
    assert [(k, t) for k, _, t in got] == want


def test_stream_equals_batch(spark, tmp_path):
    rows = [x for r in random_chunks() for x in r]
    names = [n.split()[0] for n in CHUNK.replace("array<struct<start:double,end:double,text:string,speaker:string>>", "x").split(", ")]
    for k in (1, 2, 3):  # chunks of a recording come in different files
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{k}.json").write_text("".join(json.dumps(dict(zip(names, x, strict=True))) + "\n" for x in rows if x[1] == k))
        os.utime(tmp_path / f"in/{k}.json", (1_700_000_000 + k * 60,) * 2)
    source = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp_path / "in"))
    query = stateful.emitted(source, 2.0, patience_seconds=None).writeStream.format("memory").queryName("emitted").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    got = sorted((r.recording_id, r.chunk_index, r.emit_idx, r.seg.text) for r in spark.table("emitted").collect())
    batch = chunks.emitted(spark.createDataFrame(rows, CHUNK), 2.0).where("reason <> 'finalize-tail'").collect()
    assert got == sorted((r.recording_id, r.chunk_index, r.emit_idx, r.seg.text) for r in batch)
