from pyspark.sql import functions as F

from strandline.functions import segments, settings
from strandline.operators import nearest


def test_canonical_ids_and_order(spark):
    merges = spark.createDataFrame([("SPEAKER_03", "SPEAKER_02"), ("SPEAKER_02", "SPEAKER_01"), ("SPEAKER_01", "SPEAKER_00"), ("x", "x"), ("SPEAKER_09", "SPEAKER_07")], "loser string, winner string")
    got = {r.loser: r.canonical for r in nearest.canonical_ids(merges).collect()}
    assert got == {"SPEAKER_03": "SPEAKER_00", "SPEAKER_02": "SPEAKER_00", "SPEAKER_01": "SPEAKER_00", "SPEAKER_09": "SPEAKER_07"}
    circle = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f")] + [(f"n{k}", f"n{k + 1}") for k in range(40)], "loser string, winner string")
    got = {r.loser: r.canonical for r in nearest.canonical_ids(circle).collect()}
    assert got == {**dict.fromkeys("abcd"), "e": "f", **{f"n{k}": "n40" for k in range(40)}}
    names = spark.createDataFrame([("SPEAKER_10",), ("SPEAKER_9",), ("guest",)], "s string").orderBy(nearest.id_order(F.col("s"))).collect()
    assert [r.s for r in names] == ["SPEAKER_9", "SPEAKER_10", "guest"]


def test_nearest_and_candidates(spark):
    profiles = spark.createDataFrame([(1, "a", [1.0, 0.0], 9.0), (1, "b", [0.8, 0.6], 9.0), (1, "c", [0.0, 1.0], 9.0), (1, "d", [1.0, 0.1], 1.0), (2, "z", [1.0, 0.0], 9.0)], "recording_id long, speaker_id string, centroid array<double>, total_seconds double")
    got = {r.speaker_id: (r.other, round(r.score, 3), round(r.margin, 3)) for r in nearest.merge_candidates(profiles, 8.0).collect()}
    assert got == {"a": ("b", 0.8, 0.8), "b": ("a", 0.8, 0.2), "c": ("b", 0.6, 0.6)}
    rows = spark.createDataFrame([([2.0, 0.1],), ([0.0, 0.0],)], "v array<double>")
    known = profiles.where("recording_id = 1").select(F.col("speaker_id").alias("name"), "centroid")
    best = [r.best for r in nearest.ranked_centroids(rows, "v", known, "name").collect()]
    assert [x.group for x in best[0]][:2] == ["d", "a"] and best[1] == []
    for top in (1, 2, 3):
        one, many = ([[(x.group, x.far) for x in r.best] for r in nearest.ranked_centroids(rows, "v", known, "name", top, most).orderBy("v").collect()] for most in (10_000, 2))
        assert one == many and [len(b) for b in one] == [0, top]


def test_bounds_summary_and_overrides(spark):
    seg = "array<struct<start:double,end:double,text:string,speaker:string>>"
    rows = spark.createDataFrame([([(1.0, 2.0, "a  b", "S"), (3.0, None, "x" * 200, None)],), ([],)], f"s {seg}")
    got = rows.select(segments.time_bounds(F.col("s")).alias("b"), segments.summary("now", F.col("s"), 1).alias("t")).collect()
    assert tuple(got[0].b) == (1.0, 3.0) and tuple(got[1].b) == (0.0, 0.0)
    assert got[0].t == "now[2]: 1.00-2.00 S a b, and 1 more" and got[1].t == "now[0]: "
    both = spark.createDataFrame([(("a", 1), (None, 2))], "base struct<x:string,y:int>, job struct<x:string,y:int>")
    assert tuple(both.select(settings.overridden("base", "job", ["x", "y"]).alias("z")).first().z) == ("a", 2)
