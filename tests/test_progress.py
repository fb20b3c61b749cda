import json
import os
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import segments
from strandline.operators import interval, matching, progress
from strandline.streaming import stateful

EVENT = "job string, n long, progress double, at double, state string"


def rows():
    return [("a", 0, 0.0, 0.0, "running"), ("a", 1, 0.5, 1.0, "running"), ("a", 2, 1.5, 1.5, "running"), ("a", 3, 0.2, 1.6, "running"), ("a", 4, None, 1.7, "running"), ("a", 5, 1.6, 9.0, "running"), ("a", 6, 1.7, 9.1, "completed"), ("a", 7, 50.0, 99.0, "running"), ("b", 0, 5.0, 0.0, "running"), ("b", 1, 5.1, 2.0, "running")]


def test_throttle(spark):
    got = progress.throttled(spark.createDataFrame(rows(), EVENT), "job", ["n"], "progress", "at").collect()
    assert sorted((r.job, r.n) for r in got) == [("a", 0), ("a", 2), ("a", 4), ("a", 5), ("a", 7), ("b", 0), ("b", 1)]


def test_throttle_keeps_ids_and_rows_without_a_job(spark):
    big = 9_007_199_254_740_993
    data = spark.createDataFrame([(None, 0, 1.0, 0.0, big), (None, 1, 1.1, 0.1, None), (None, 2, 1.2, 0.2, 5), (1, 0, 1.0, None, big + 2), (1, 1, None, None, None)], "job long, n long, progress double, at double, id long")
    got = progress.throttled(data, "job", ["n"], "progress", "at").collect()
    assert sorted((r.job or 0, r.n, r.id or 0) for r in got) == [(0, 0, big), (1, 0, big + 2), (1, 1, 0)]


def test_nothing_is_reported_after_the_end(spark):
    got = progress.reported(spark.createDataFrame(rows(), EVENT), "job", ["n"], "progress", "at", F.col("state") == "completed").collect()
    assert sorted((r.job, r.n) for r in got) == [("a", 0), ("a", 2), ("a", 4), ("a", 5), ("a", 6), ("b", 0), ("b", 1)]


def test_throttle_stream_with_tombstone(spark, tmp_path):
    for k in range(2):
        path = tmp_path / f"in/{k}.json"
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(json.dumps(dict(zip(("job", "n", "progress", "at", "state"), r, strict=True))) + "\n" for r in rows() if (r[1] >= 4) == bool(k)))
        os.utime(path, (1_700_000_000 + 60 * k,) * 2)
    source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = stateful.throttled(source, "job", "n", "progress", "at", "state", keep_seconds=None).writeStream.format("memory").queryName("throttled").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.job, r.n) for r in spark.table("throttled").collect()) == [("a", 0), ("a", 2), ("a", 4), ("a", 5), ("a", 6), ("b", 0), ("b", 1)]


def test_states(spark):
    data = spark.createDataFrame([("a", 0, "claimed"), ("a", 1, "running"), ("a", 2, "completed"), ("a", 3, "running"), ("b", 0, "running"), ("b", 1, "what")], "job string, n long, state string")
    assert {r.job: (r.state, r.n_events) for r in progress.latest(data, "job", ["n"], "state").collect()} == {"a": ("running", 4), "b": ("what", 2)}
    assert sorted((r.job, r.n) for r in progress.until_end(data, "job", ["n"], F.col("state").isin(*progress.ENDED)).collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]
    assert [r.valid for r in progress.checked(data, "job", ["n"], "state").orderBy("job", "n").collect()] == [True, True, True, False, False, False]
    ends = spark.createDataFrame([("", None, False), (None, None, False), (None, "x", True)], "code string, message string, canceled boolean")
    assert [r[0] for r in ends.select(progress.outcome(F.col("code"), F.col("message"), F.col("canceled"))).collect()] == ["failed", "completed", "canceled"]


def test_payload_of(spark):
    update = spark.createDataFrame([(("p", 1.0, "u"),), (("p", None, "u"),), ((None, None, None),)], "u struct<phase:string,progress:double,utterance:string>")
    assert [r[0] is None for r in update.select(progress.payload_of(F.col("u"), False)).collect()] == [False, True, True]
    assert [r[0] is None for r in update.select(progress.payload_of(F.col("u"), True)).collect()] == [False, False, True]


def test_interval_join(spark):
    segs = spark.createDataFrame([("r", 0, 0.0, 10.0), ("r", 1, 100.0, 200.0), ("r", 2, 300.0, 310.0), ("s", 0, 0.0, 1.0)], "recording_id string, seg_idx long, start double, end double")
    turns = spark.createDataFrame([("r", 0, 0.0, 5.0, "first"), ("r", 1, 5.0, 10.0, "tie"), ("r", 2, 90.0, 130.0, "less"), ("r", 3, 130.0, 400.0, "most"), ("r", 4, 5.0, 5.0, "none")], "recording_id string, turn_idx long, start double, end double, speaker string")
    for size in (60.0, 3.0, 1e6):
        got = {(r.recording_id, r.seg_idx): r.speaker for r in interval.named_by_overlap(segs, turns, cell_seconds=size).collect()}
        assert got == {("r", 0): "first", ("r", 1): "most", ("r", 2): "most", ("s", 0): None}


def test_times_that_are_null_endless_or_very_long(spark):
    inf, nan = float("inf"), float("nan")
    segs = spark.createDataFrame([("r", 0, None, 5.0), ("r", 1, 0.0, inf), ("r", 2, nan, 3.0), ("r", 3, 10.0, 1e12), ("r", 4, 1e9, 1e9 + 1), ("r", 5, 7.0, None)], "recording_id string, seg_idx long, start double, end double")
    turns = spark.createDataFrame([("r", 0, 0.0, 4.0, "a"), ("r", 1, 100.0, 200.0, "b"), ("r", 2, 5e8, 2e9, "long"), ("r", 3, 0.0, inf, "endless"), ("r", 4, None, 1.0, "early")], "recording_id string, turn_idx long, start double, end double, speaker string")
    got = {r.seg_idx: r.speaker for r in interval.named_by_overlap(segs, turns).collect()}
    assert got == {0: "a", 1: None, 2: None, 3: "long", 4: "long", 5: None}
    ratio = segs.where("seg_idx IN (0, 5)").orderBy("seg_idx").select(segments.overlap_ratio(F.col("start"), F.col("end"), F.lit(0.0), F.lit(None).cast("double"))).collect()
    assert [r[0] for r in ratio] == [0.0, 0.0]


def plain_pairs(segs, turns):
    """For each segment the turn of the greatest overlap, by all pairs."""
    out = {}
    for key, i, s, e in segs:
        near = [(min(e, te) - max(s, ts), -k, name) for other, k, ts, te, name in turns if other == key and te > ts and s < te and ts < e]
        out[key, i] = max(near)[2] if near else None
    return out


@pytest.mark.parametrize(("seed", "cell"), [(1, 16.0), (2, 1.0), (3, 300.0)])
def test_interval_levels(spark, seed, cell):
    """Lengths over nine orders of magnitude, in a few recordings, against all pairs."""
    rng = random.Random(seed)

    def some(n):
        for k in range(n):
            start = rng.choice([rng.uniform(-500, 5000), float(rng.randrange(0, 4096, 16))])
            yield rng.choice("rst"), k, start, start + rng.choice([0.5, 3.0, 16.0, 64.0, rng.uniform(0, 40), 10 ** rng.uniform(0, 9)])

    segs = list(some(400))
    turns = [(key, k, s, e, f"t{k}") for key, k, s, e in some(300)]
    left = spark.createDataFrame(segs, "recording_id string, seg_idx long, start double, end double")
    right = spark.createDataFrame(turns, "recording_id string, turn_idx long, start double, end double, speaker string")
    got = {(r.recording_id, r.seg_idx): r.speaker for r in interval.named_by_overlap(left, right, cell_seconds=cell).collect()}
    assert got == plain_pairs(segs, turns)


def test_interval_cells_hold_few_rows(spark, monkeypatch):
    """100,000 segments of one recording, a few of them as long as it: no join key holds more than a cell's rows."""
    n = 100_000
    rows = spark.range(n).select(F.lit("r").alias("__key"), F.col("id").alias("__seg"), (F.col("id") * 4.0).alias("__s"), F.when(F.col("id") % 10_000 == 0, n * 4.0).otherwise(F.col("id") * 4.0 + 3.0).alias("__e"))
    other = rows.select(F.col("__key").alias("__tkey"), F.col("__seg").alias("__turn"), (F.col("__s") + 1).alias("__ts"), (F.col("__e") + 1).alias("__te"))
    seen = []
    join = type(rows).join

    def spied(self, right, on=None, how=None):
        seen.extend((side, c) for side in (self, right) for c in ("__at", "__tat") if c in side.columns)
        return join(self, right, on, how) if how else join(self, right, on)

    monkeypatch.setattr(type(rows), "join", spied)
    pairs = interval.overlapping(rows, other)
    monkeypatch.undo()
    assert len(seen) == 2
    for side, c in seen:
        most = side.groupBy(side.columns[0], c).count().agg(F.max("count"), F.sum("count")).first()
        assert most[0] < 1.2 * interval.PLACE_ROWS and most[1] < 5 * n
    short = pairs.where("__e - __s < 10 AND __te - __ts < 10").count()
    assert short == n - 10


def test_unmatched(spark):
    row = "recording_id string, seg_idx long, start double, end double, text string, speaker string"
    before = spark.createDataFrame([("r", 0, 0.0, 10.0, "The harbour opens at nine.", "SPEAKER_00"), ("r", 1, 10.0, 20.0, "Boats leave soon after.", None), ("s", 0, 0.0, 1e6, "A long one", None)], row)
    now = spark.createDataFrame([("r", 0, 0.2, 10.1, "the harbour opens at nine", "SPEAKER_00"), ("r", 1, 0.2, 10.1, "the harbour opens at nine", "SPEAKER_01"), ("r", 2, 10.0, 20.0, "Nobody came.", None), ("r", 3, 500.0, 501.0, "Boats leave soon after.", None), ("s", 0, 0.0, 1e6, "a long one", None), ("s", 1, None, None, None, None)], row)
    assert sorted((r.recording_id, r.seg_idx) for r in matching.unmatched(now, before).collect()) == [("r", 1), ("r", 2), ("r", 3), ("s", 1)]


def test_words(spark):
    data = spark.createDataFrame([("r", 0, 0.0, 1.0, " one two  three "), ("r", 1, 1.0, 1.0, "x"), ("r", 2, 2.0, 3.0, "  ")], "recording_id string, seg_idx long, start double, end double, text string")
    got = [(r.seg_idx, r.word, r.start_ts, r.end_ts) for r in interval.words(data).orderBy("seg_idx", "word_idx").collect()]
    assert got == [(0, "one", 0, 5333), (0, " two", 5333, 10666), (0, " three", 10666, 16000), (1, "x", 16000, 16000)]


def test_relabel(spark):
    segs = spark.createDataFrame([("r", 2, "7", "x"), ("r", 3, "8", "x"), ("r", 3, None, "x")], "recording_id string, chunk_index int, local_speaker string, speaker string")
    known = spark.createDataFrame([("r", 2, "7", "SPEAKER_00")], "recording_id string, chunk_index int, local_speaker string, speaker string")
    assert sorted(str(r.speaker) for r in interval.relabelled(segs, known).collect()) == ["None", "SPEAKER_00", "chunk3:8"]
