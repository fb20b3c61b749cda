import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import audio, vectors
from strandline.operators import speakers

ROW = "recording_id long, seq long, chunk_index int, speaker string, start double, end double, text string, vector array<float>"
A, B = [1.0, 0.0], [0.0, 1.0]


def labels(spark, rows, **settings):
    enabled = settings.pop("enabled", True)
    data = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], ROW)
    got = speakers.resolved_speakers(data, speakers.Settings(**settings), enabled).orderBy("seq").collect()
    return [(r.emitted_speaker, r.speaker) for r in got]


def count(spark, rows, **settings):
    data = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], ROW)
    return {r.speaker_id: r for r in speakers.profiles(data, speakers.Settings(**settings)).collect()}


LOW = {"min_utterance_seconds": 0.5, "seed_seconds": 2.0, "similarity_threshold": 0.9}


def test_first_chunk_has_stable_names(spark):
    rows = [(1, "0", 0.0, 3.0, "a", None), (1, "1", 3.0, 6.0, "b", None), (1, "0", 6.0, 9.0, "c", None)]
    assert [e for e, _ in labels(spark, rows)] == ["SPEAKER_00", "SPEAKER_01", "SPEAKER_00"]
    assert labels(spark, [(*r[:5], A) for r in rows], enabled=False) == labels(spark, rows)


def test_later_chunk_matches_or_is_new(spark):
    seed = (1, "0", 0.0, 3.0, "a", A)
    assert labels(spark, [seed, (2, "7", 3.0, 6.0, "b", A)], **LOW)[1] == ("chunk2:7", "SPEAKER_00")
    assert labels(spark, [seed, (2, "7", 3.0, 6.0, "b", B)], **LOW)[1] == ("chunk2:7", "SPEAKER_01")
    assert labels(spark, [seed, (2, "5", 3.0, 6.0, "b", A)], min_utterance_seconds=10.0)[1] == ("chunk2:5", "chunk2:5")


def test_no_speaker_and_no_vector(spark):
    rows = [(1, None, 0.0, 3.0, "a", A), (1, "[Noise]", 3.0, 6.0, "b", A), (2, "3", 6.0, 9.0, "[silence]", A), (2, "4", 6.0, 9.0, "x", [0.0, 0.0])]
    assert [s for _, s in labels(spark, rows)] == [None, None, "chunk2:3", "chunk2:4"]
    assert not count(spark, rows[:2])


MERGE = {"min_utterance_seconds": 0.5, "seed_seconds": 2.0, "similarity_threshold": 0.95, "merge_seed_seconds": 4.0, "merge_similarity_threshold": 0.95, "merge_margin": 0.1}


def test_merges_one_voice_under_two_names(spark):
    rows = [(1, "0", 0.0, 5.0, "a", A), (1, "1", 5.0, 10.0, "b", A), (2, "9", 10.0, 15.0, "c", A)]
    assert [s for _, s in labels(spark, rows, **MERGE)] == ["SPEAKER_00"] * 3
    found = count(spark, rows, **MERGE)
    assert set(found) == {"SPEAKER_00"} and found["SPEAKER_00"].embedding_count == 3 and found["SPEAKER_00"].total_seconds == 15.0
    assert set(count(spark, [(1, "0", 0.0, 5.0, "a", A), (1, "1", 5.0, 10.0, "b", B)], **MERGE)) == {"SPEAKER_00", "SPEAKER_01"}


def plain_resolver(rows, s):
    """Final labels of one recording's (chunk, local, vector, seconds), by the rules one after another."""
    names, groups, aim, fresh = {}, {}, {}, 0

    def end(n):
        return end(aim[n]) if n in aim else n

    def length(v):
        return sum(x * x for x in v) ** 0.5

    for chunk, local, vector, seconds in rows:
        if (chunk, local) not in names and chunk == 1:
            names[chunk, local], groups[fresh], fresh = fresh, None, fresh + 1
        v = [x / length(vector) for x in vector]
        cos = lambda n, v=v: sum(a * b for a, b in zip(groups[n][0], v, strict=True))
        if (chunk, local) not in names:
            ready = sorted((-cos(n), n) for n, g in groups.items() if g and g[1] >= s.seed_seconds)
            if ready and -ready[0][0] >= s.similarity_threshold:
                names[chunk, local] = ready[0][1]
            else:
                names[chunk, local], groups[fresh], fresh = fresh, None, fresh + 1
        n = end(names[chunk, local])

        def mean(a, wa, b, wb):
            m = [(x * wa + y * wb) / (wa + wb) for x, y in zip(a, b, strict=True)]
            return [x / length(m) for x in m]

        groups[n] = [v, seconds] if not groups[n] else [mean(*groups[n], v, max(0.25, seconds)), groups[n][1] + seconds]
        if groups[n][1] >= s.merge_seed_seconds:
            others = sorted((-sum(a * b for a, b in zip(groups[n][0], g[0], strict=True)), m) for m, g in groups.items() if m != n and g and g[1] >= s.merge_seed_seconds)
            likes = [-x for x, _ in others] + [-1.0]
            if others and likes[0] >= s.merge_similarity_threshold and likes[0] - likes[1] >= s.merge_margin:
                low, high = sorted((n, others[0][1]))
                gone = groups.pop(high)
                groups[low] = [mean(*groups[low], gone[0], max(0.25, gone[1])), groups[low][1] + max(0.25, gone[1])]
                aim[high] = low
    return [f"SPEAKER_{end(names[c, local]):02d}" for c, local, *_ in rows]


def test_equals_a_plain_resolver(spark):
    rng = random.Random(11)
    settings = speakers.Settings(min_utterance_seconds=0.5, seed_seconds=2.0, similarity_threshold=0.8, merge_seed_seconds=4.0, merge_similarity_threshold=0.93, merge_margin=0.03)
    voices = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(4)]
    data, want = [], {}
    for recording in ("a", "b", None, "d"):
        rows = []
        for k in range(60):
            voice = rng.randrange(4)
            rows.append((1 + k // 12, str((voice + k // 12) % 5), [x + rng.gauss(0, 0.35) for x in voices[voice]], rng.choice([0.5, 1.0, 3.0])))
        data += [(recording, k, c, local, float(10 * k), 10 * k + s, "words", v) for k, (c, local, v, s) in enumerate(rows)]
        want[recording] = plain_resolver(rows, settings)
    frame = spark.createDataFrame(data, ROW.replace("recording_id long", "recording_id string").replace("array<float>", "array<double>"))
    got = {}
    for r in speakers.resolved_speakers(frame, settings).orderBy("seq").collect():
        got.setdefault(r.recording_id, []).append(r.speaker)
    assert got == want and any(len(set(v)) > 2 for v in want.values())
    assert {r.recording_id for r in speakers.profiles(frame, settings).collect()} == set(want)


def test_repeats_are_observed_once(spark):
    rows = [(1, "0", 0.0, 5.0, "a", A), (1, "0", 0.001, 5.001, "again", B)]
    assert count(spark, rows)["SPEAKER_00"].embedding_count == 1


def test_fold_column_equals_profile(spark):
    seen = [([3.0, 1.0], 2.0), ([0.0, 0.0], 9.0), ([1.0, 2.0], 0.1), ([-1.0, 2.0], 4.0)] + [([1.0, float(i)], 1.0) for i in range(9)]
    row = spark.createDataFrame([(seen,)], "x array<struct<vector:array<double>,seconds:double>>").select(vectors.centroid_fold(F.col("x")).alias("p")).first().p
    want = None
    for v, s in seen:
        if speakers.direction(v) is not None:
            want = speakers.joined(want, speakers.utterance(speakers.direction(v), s))
    assert row.centroid == pytest.approx(want.centroid.tolist())
    assert (row.embedding_count, len(row.exemplars)) == (want.count, len(want.exemplars)) == (12, 8)
    assert row.total_seconds == pytest.approx(want.seconds)


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>").select(vectors.cosine(F.col("a"), F.col("b")), vectors.unit(F.col("a")), vectors.unit(F.col("z")), vectors.cosine(F.col("a"), F.col("z"))).first()
    assert row[0] == pytest.approx(0.96) and row[1] == pytest.approx([0.6, 0.8]) and row[2] is None and row[3] is None


def test_a_failure_ends_the_learning(spark):
    """From the first failed embedding on, labels are given but nothing is learnt; other recordings go on."""
    rows = [(r, k, 1 + k // 4, "x" if k % 2 else "y", k * 3.0, k * 3.0 + 2.0, "words", A if k % 2 else [0.0, 1.0, 0.0][: len(A)], r == 1 and k == 5) for r in (1, 2) for k in range(12)]
    data = spark.createDataFrame(rows, ROW + ", failed boolean")
    settings = speakers.Settings(seed_seconds=2.0)
    got = {(r.recording_id, r.seq): r.speaker for r in speakers.resolved_speakers(data, settings).collect()}
    without = {(r.recording_id, r.seq): r.speaker for r in speakers.resolved_speakers(data.drop("failed"), settings).collect()}
    cut = {(r.recording_id, r.seq): r.speaker for r in speakers.resolved_speakers(data.drop("failed").withColumn("vector", F.expr("if(recording_id = 1 and seq >= 5, null, vector)")), settings).collect()}
    assert got == cut and {k: v for k, v in got.items() if k[0] == 2} == {k: v for k, v in without.items() if k[0] == 2} and got != without


SET_UP: list = []


def set_up():
    SET_UP.append(1)


def broken():
    SET_UP.append(1)
    raise RuntimeError("no such model")


def test_a_model_is_set_up_once(spark, tmp_path):
    def embed(samples, rate):
        if len(samples) == 3:
            raise ValueError("too short")
        return [1.0, float(rate)]

    data = spark.createDataFrame([([0.0] * n, 16) for n in (2, 3, 4)] + [(None, 16)], "samples array<float>, rate int")
    rows = data.repartition(1).select(audio.embedder(embed, set_up, errors=True)("samples", "rate").alias("e"), F.size("samples").alias("n")).collect()
    assert {r.n: (r.e.vector, r.e.error) for r in rows if r.n in (2, 3, 4)} == {2: ([1.0, 16.0], None), 3: (None, "too short"), 4: ([1.0, 16.0], None)}
    assert [r.x for r in data.select(audio.embedder(embed, broken)("samples", "rate").alias("x")).collect()] == [None] * 4
    assert {r.x.error for r in data.select(audio.embedder(embed, broken, errors=True)("samples", "rate").alias("x")).collect()} == {"no such model"}
    audio._READY.clear()
    SET_UP.clear()
    assert [audio._set_up("one", broken) for _ in range(3)] == ["no such model"] * 3 and len(SET_UP) == 1
