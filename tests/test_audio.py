import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import audio
from strandline.sources import readers, recordings


def one(spark, schema, row, *columns):
    return spark.createDataFrame([row], schema).select(*columns).first()


def test_duration_valid_and_slice(spark):
    c = F.col
    assert one(spark, "x array<float>, r int", ([0.0] * 24_000, 24_000), audio.duration_seconds(c("x"), c("r")))[0] == 1.0
    row = one(spark, "x array<float>, e array<float>", ([float(i) for i in range(20)], []), audio.slice_seconds(c("x"), F.lit(10), F.lit(0.5), F.lit(1.4)), audio.slice_seconds(c("x"), F.lit(10), F.lit(3.0), F.lit(3.0)), audio.valid(c("x")), audio.valid(c("e")), audio.duration_seconds(c("x"), F.lit(0)))
    assert row[0] == list(range(5, 14)) and row[1] is None and row[2] and not row[3] and row[4] == 0.0
    assert not one(spark, "x array<float>", ([float("nan"), float("inf")],), audio.valid(c("x")))[0]


@pytest.mark.parametrize("frame, planar", [([[1, 3, 5], [3, 5, 7]], True), ([[1, 3], [3, 5], [5, 7]], False), ([[1, 3, 3, 5, 5, 7]], None), ([[1, 3, 5], [3, 5, 7]], None)])
def test_mono(spark, frame, planar):
    data = ([[float(v) for v in p] for p in frame], planar)
    assert one(spark, "f array<array<float>>, p boolean", data, audio.mono(F.col("f"), F.lit(2), F.col("p")))[0] == [2.0, 4.0, 6.0]


def test_mono_of_what_fits_no_layout(spark):
    assert one(spark, "f array<array<float>>", ([[1.0, 2.0, 3.0]],), audio.mono(F.col("f"), F.lit(2), F.lit(None).cast("boolean")))[0] is None
    assert one(spark, "f array<array<float>>", ([[]],), audio.mono(F.col("f"), F.lit(2), F.lit(None).cast("boolean")))[0] is None


def test_frames_and_buffers(spark):
    frames = one(spark, "f array<array<float>>, n array<array<float>>", ([[1.0, 2.0], None, [], [3.0]], [None, []]), audio.joined_frames(F.col("f")), audio.joined_frames(F.col("n")))
    assert frames[0] == [1.0, 2.0, 3.0] and frames[1] is None
    rows = [([1.0], 8_000), ([1.0], None), ([], 8_000), (None, 8_000), ([float("nan")], 8_000), ([1.0], 0)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x array<float>, r int").orderBy("i").select(audio.buffer(F.col("x"), F.col("r")).alias("b")).collect()
    assert [r.b.error for r in got] == [None, "no valid sample rate", "no samples", "no samples", "no sample is finite", "no valid sample rate"]
    assert (got[0].b.samples, got[0].b.sample_rate) == ([1.0], 8_000) and got[4].b.samples is None


def wav(values, rate, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(channels), file.setsampwidth(2), file.setframerate(rate)
        file.writeframes((np.asarray(values) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_resampling_keeps_a_tone(spark):
    t = np.arange(48_000) / 48_000
    found = audio.resampled(np.sin(2 * np.pi * 440 * t), 48_000, 16_000)
    assert len(found) == 16_000
    assert np.abs(found[200:-200] - np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)[200:-200]).max() < 0.01
    up = audio.resampled(np.sin(2 * np.pi * 100 * np.arange(8_000) / 8_000), 8_000, 16_000)
    assert len(up) == 16_000 and np.abs(up[200:-200] - np.sin(2 * np.pi * 100 * np.arange(16_000) / 16_000)[200:-200]).max() < 0.01
    assert spark.createDataFrame([([0.0] * 30, 3, 1)], "x array<float>, a int, b int").select(F.size(audio.resample("x", "a", "b"))).first()[0] == 10


def test_audio_source(spark, tmp_path):
    stereo = np.stack([np.full(800, 0.5), np.full(800, -0.25)], axis=1).reshape(-1)
    (tmp_path / "a.wav").write_bytes(wav(stereo, 8_000, 2))
    (tmp_path / "c.wav").write_bytes(b"no audio")
    (tmp_path / "d.wav").write_bytes(wav(stereo, 8_000, 2)[:-1])
    files = readers.payloads(spark, str(tmp_path), "*.wav").select("path", "content").unionByName(spark.createDataFrame([("b.wav", bytearray())], "path string, content binary"))
    rows = {r.path[-5:]: r for r in readers.audio(files, 8_000).collect()}
    assert rows["a.wav"].samples == pytest.approx([0.125] * 800, abs=1e-4) and rows["a.wav"].error is None
    assert rows["d.wav"].samples == pytest.approx([0.125] * 799, abs=1e-4) and rows["d.wav"].error is None
    assert rows["b.wav"].samples is None and "empty" in rows["b.wav"].error and rows["c.wav"].error


def test_models_behind_columns(spark):
    calls = audio.embedder(lambda x, rate: [1.0, 0.0] if x.mean() > 0 else None)
    rows = spark.createDataFrame([([1.0, 1.0],), ([-1.0],), (None,)], "x array<float>")
    assert [r[0] for r in rows.select(calls(F.col("x"), F.lit(24_000))).collect()] == [[1.0, 0.0], None, None]

    def recognise(x, rate):
        if x[0] < 0:
            raise RuntimeError
        return [{"start": 0.0, "end": len(x) / rate, "text": "hm"}]

    data = spark.createDataFrame([("a", [1.0, 1.0], 2), ("b", [-1.0], 2)], "path string, samples array<float>, sample_rate int")
    turns = readers.diarised(data, lambda x, rate: [{"start": 0, "end": len(x) / rate, "speaker": 3}, {"start": 1, "end": 2, "speaker": "b"}][: 2 if x[0] > 0 else 1 / 0]).orderBy("path", "turn_idx").collect()
    assert [(t.path, t.turn_idx, t.start, t.end, t.speaker) for t in turns[:2]] == [("a", 0, 0.0, 1.0, "3"), ("a", 1, 1.0, 2.0, "b")] and turns[2].error == "division by zero"
    found = readers.recognised(spark.createDataFrame([("a", [1.0, 1.0], 2), ("b", [-1.0], 2)], "path string, samples array<float>, sample_rate int"), recognise).orderBy("path").collect()
    assert (found[0].text, found[0].end, found[0].error) == ("hm", 1.0, None) and found[1].error == "RuntimeError"


@pytest.mark.parametrize("source, target", [(44_100, 16_000), (8_000, 16_000), (1_000, 1_600), (16_000, 16_000), (11_025, 8_000)])
def test_pieces_of_a_resampled_signal_are_those_of_one_pass(source, target):
    signal = np.random.default_rng(3).normal(size=5_003)
    whole = audio.resampled(signal, source, target)
    assert len(whole) == audio.resampled_length(len(signal), source, target)
    for step in (1, 37, 700):
        for start in range(0, len(whole), step)[:50]:
            stop = min(len(whole), start + step)
            low, high = audio.resampled_from(start, stop, len(signal), source, target)
            piece = audio.resampled(signal[low:high], source, target, start=start, stop=stop, first=low, count=len(signal))
            assert (piece == whole[start:stop]).all()


def test_an_hour_in_many_tasks(spark, tmp_path):
    signal = np.sin(np.arange(3_600_000) ** 1.1 / 900) * 0.9
    (tmp_path / "an hour.wav").write_bytes(wav(signal, 1_000))
    rows = recordings.pieces(spark, str(tmp_path), rate=1_600, seconds=60).withColumn("task", F.spark_partition_id()).orderBy("piece").collect()
    whole = readers._wav((tmp_path / "an hour.wav").read_bytes(), 1_600)[0]
    assert [r.piece for r in rows] == list(range(60)) and [r.start for r in rows] == [96_000 * k for k in range(60)]
    assert len({r.task for r in rows}) == spark.sparkContext.defaultParallelism
    assert max(len(r.samples) for r in rows) == 96_000 and (np.concatenate([r.samples for r in rows]).astype(np.float32) == whole).all()


def test_pieces_overlap_and_odd_files(spark, tmp_path):
    stereo = np.stack([np.linspace(-0.5, 0.5, 805), np.full(805, 0.25)], axis=1).reshape(-1)
    (tmp_path / "a.wav").write_bytes(wav(stereo, 800, 2))
    (tmp_path / "cut.wav").write_bytes(wav(stereo, 800, 2)[:-3])
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "noise.wav").write_bytes(b"no audio at all")
    (tmp_path / "silent.wav").write_bytes(wav([], 800))
    rows = {}
    for r in recordings.pieces(spark, str(tmp_path), rate=800, seconds=0.5, overlap=0.25).orderBy("path", "piece").collect():
        rows.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    whole = readers._wav((tmp_path / "a.wav").read_bytes(), 800)[0]
    assert [(r.start, len(r.samples)) for r in rows["a.wav"]] == [(0, 600), (400, 405), (800, 5)]
    assert all((np.array(r.samples, np.float32) == whole[r.start : r.start + len(r.samples)]).all() for r in rows["a.wav"])
    assert [len(r.samples) for r in rows["cut.wav"]] == [600, 404, 4]
    assert "empty.wav" not in rows  # Spark passes it over
    for name in ("noise.wav", "silent.wav"):
        assert len(rows[name]) == 1 and rows[name][0].samples is None and rows[name][0].error
    (tmp_path / "none").mkdir()
    assert recordings.pieces(spark, str(tmp_path / "none")).collect() == []
