import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import segments, text
from strandline.operators import alignment

from . import brute

SEG = "struct<start:double,end:double,text:string,speaker:string>"


def seg(start, end, words, speaker=None):
    return {"start": float(start), "end": float(end), "text": words, "speaker": speaker}


def cases(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, previous array<{SEG}>, current array<{SEG}>, a double, b double").orderBy("i")


def texts(row):
    return [s["text"] for s in row]


FERRY = [seg(50, 58, "The ferry to the island leaves from pier four."), seg(58, 63, "Is there a later one on Sundays?")]
FERRY_AGAIN = [seg(50.4, 58.1, "Ferry to the island leaves from the pier four."), seg(58.3, 63.2, "Is there later one on Sundays")]


def test_similarity(spark):
    pairs = [("Mind the gap, please: doors close on the left!", "mind the gap please doors are closed on the left"), ("", None), ("", "a"), ("é", "e"), ("A  B!", "a b"), ("x_1", "x 1")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").orderBy("i")
    got = [r[0] for r in rows.select(text.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([brute.similarity(a, b) for a, b in pairs])
    assert 0.8 < got[0] < 0.95


def test_normalized_unicode(spark):
    samples = ["Ä b\x1cc", "a - b", "tab\tnew\nline", "  x  ", "²½ n°", None]
    got = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string").orderBy("i").select(text.normalized(F.col("t"))).collect()
    assert [r[0] for r in got] == [brute.norm(s) for s in samples]


def test_monotonic_pairs_and_scores(spark):
    row = cases(spark, [(FERRY, FERRY_AGAIN, 0.0, 0.0)]).select(alignment.aligned(F.col("previous"), F.col("current")).alias("m")).first().m
    assert [(m.prev_idx, m.curr_idx) for m in row] == [(0, 0), (1, 1)]
    assert [m.score for m in row] == pytest.approx([brute.score(a, b) for a, b in zip(FERRY, FERRY_AGAIN, strict=True)]) and min(m.score for m in row) > 0.8


def test_speaker_conflict_and_unresolved_labels(spark):
    conflict = ([seg(3, 5, "Go left", "SPEAKER_04"), seg(5, 7, "Go left", "SPEAKER_09")], [seg(3, 5, "Go left", "SPEAKER_09"), seg(5, 7, "Go left", "SPEAKER_04")], 0.0, 0.0)
    free = ([seg(20, 26, "The kettle is on again", "chunk3:2")], [seg(20.5, 26, "The kettle is on again", "chunk4:0")], 0.0, 0.0)
    found = [r.m for r in cases(spark, [conflict, free]).select(alignment.aligned(F.col("previous"), F.col("current")).alias("m")).collect()]
    assert [(m.prev_idx, m.curr_idx) for m in found[0]] in ([(1, 0)], [(0, 1)])
    assert found[0][0].score == pytest.approx(0.85)
    assert [(m.prev_idx, m.curr_idx) for m in found[1]] == [(0, 0)]


def test_empty_sides(spark):
    one = [seg(1, 2, "a")]
    rows = cases(spark, [([], one, 0.0, 9.0), (one, [], 0.0, 9.0), ([], [], 0.0, 9.0)])
    for f in (alignment.merged, alignment.resolved):
        got = rows.select(f(F.col("previous"), F.col("current"), F.col("a"), F.col("b")).alias("m"), alignment.aligned(F.col("previous"), F.col("current")).alias("n")).collect()
        assert [texts(r.m) for r in got] == [["a"], ["a"], []] and all(r.n == [] for r in got)


def test_merge_fixtures(spark):
    tickets = seg(63.5, 70, "Only until the end of September.")
    same = (FERRY, [*FERRY_AGAIN, tickets], 50.0, 110.0)
    cut = ([seg(12, 15, "Please keep your tick")], [seg(12.3, 17, "Please keep your tickets ready."), seg(21, 22, "Thanks.")], 10.0, 40.0)
    brief = ([seg(80, 82, "Right", "SPEAKER_05"), seg(83, 84, "Right", "SPEAKER_02")], [seg(80.2, 82, "Right", "SPEAKER_05"), seg(83.1, 84, "Right", "SPEAKER_02"), seg(91, 93, "Off we go", "SPEAKER_05")], 80.0, 88.0)
    got = [r.m for r in cases(spark, [same, cut, brief]).select(alignment.merged(F.col("previous"), F.col("current"), F.col("a"), F.col("b")).alias("m")).collect()]
    assert [x for x in got[0]][-1]["text"] == tickets["text"] and [[s.asDict() for s in m] for m in got] == [brute.merge(*x) for x in (same, cut, brief)]
    assert texts(got[1]) == ["Please keep your tickets ready.", "Thanks."]
    assert [(s["text"], s["speaker"]) for s in got[2]] == [("Right", "SPEAKER_05"), ("Right", "SPEAKER_02"), ("Off we go", "SPEAKER_05")]


def test_midpoint_rule_and_unmatched(spark):
    half = ([seg(0, 4, "A gull on the roof"), seg(25, 31, "Rain before noon")], [seg(0.1, 4, "Gull on the roof"), seg(25.2, 31, "Rain, before the noon")], 0.0, 36.0)
    apart = ([seg(30, 33, "Close the hatch")], [seg(5, 9, "Somebody whistles a tune")], 0.0, 36.0)
    got = [r.m for r in cases(spark, [half, apart]).select(alignment.resolved(F.col("previous"), F.col("current"), F.col("a"), F.col("b")).alias("m")).collect()]
    assert [s["start"] for s in got[0]] == [0.0, 25.2]
    assert texts(got[1]) == ["Somebody whistles a tune", "Close the hatch"]


def random_windows(seed, n):
    rng = random.Random(seed)
    words = ["aye", "go on", "two knots north", "harbour", "anchor", "well said all", ""]

    def some():
        at, out = 0.0, []
        for _ in range(rng.randint(0, 4)):
            at += rng.choice([0.0, 0.5, 1.0])
            length = rng.choice([0.5, 1.0, 2.0])
            out.append(seg(at, at + length, " ".join(rng.choice(words) for _ in range(rng.randint(1, 2))), rng.choice([None, "SPEAKER_00", "speaker_1", "chunk1:0"])))
            at += length
        return out

    return [(some(), some(), 0.0, 6.0) for _ in range(n)]


def test_alignment_and_resolving_equal_brute_force(spark):
    rows = random_windows(1, 60)
    window = F.col("previous"), F.col("current"), F.col("a"), F.col("b")
    got = cases(spark, rows).select(alignment.aligned(F.col("previous"), F.col("current")).alias("m"), alignment.resolved(*window).alias("r"), alignment.merged(*window).alias("g")).collect()
    for (p, c, a, b), r in zip(rows, got, strict=True):
        assert [(m.prev_idx, m.curr_idx) for m in r.m] == brute.path([[brute.score(x, y) for y in c] for x in p])
        assert [x.asDict() for x in r.r] == brute.resolve(p, c, a, b)
        assert [x.asDict() for x in r.g] == brute.merge(p, c, a, b)


def test_labels(spark):
    rows = [("SPEAKER_00", "0", "0", "SPEAKER_00"), ("1", "1", None, "1"), ("UNKNOWN", None, None, None), ("chunk2:7", None, None, "chunk2:7"), (" Noise ", None, None, None), ("[silence]", None, None, None), ("007", "7", None, "007"), ("", None, None, None), (None, None, None, None), ("SPEAKER_03", "3", "3", "SPEAKER_03")]
    got = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, l string").orderBy("i").select(segments.public_speaker(F.col("l")), segments.public_segment_speaker(F.col("l"), F.lit(True)), segments.local_label(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_edit_distance_of_parts(spark):
    """Trimmed and banded distances against the plain one."""
    import random

    from .brute import distance as levenshtein

    rng = random.Random(5)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice("abcé ") for _ in range(rng.randrange(0, 40)))
        b = list(a)
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "x", "ab"])
        rows.append((a, "".join(b) if rng.random() < 0.8 else a[::-1], rng.randrange(-1, 20), levenshtein(a, "".join(b))))
    rows = [(a, b, most, levenshtein(a, b)) for a, b, most, _ in rows]
    df = spark.createDataFrame(rows, "a string, b string, most int, plain int")
    found = df.select("*", text.edit_distance(F.col("a"), F.col("b")).alias("d"), text.edit_distance_within(F.col("a"), F.col("b"), F.col("most")).alias("w")).collect()
    assert all(r.d == r.plain and r.w == (r.plain if r.plain <= r.most else -1) for r in found)
    same = df.select(text.similarity_of_normalized(F.col("a"), F.col("b")).alias("s"), *(text.similarity_within(F.col("a"), F.col("b"), F.lit(x)).alias(f"x{x * 100:.0f}") for x in (0.3, 0.82, 1.0))).collect()
    assert all((r[f"x{k}"] >= k / 100) == (r.s >= k / 100) and (r.s < k / 100 or r[f"x{k}"] == r.s) for r in same for k in (30, 82, 100))
