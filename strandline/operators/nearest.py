"""Nearest centroids, merge candidates and canonical ids, over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..functions.vectors import cosine


def means(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """group, centroid: mean vector by component; partial sums in tasks, so a large group is no one's work."""
    parts = rows.select(group, F.posexplode(vector).alias("i", "v")).groupBy(group, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centroid"))


def ranked_centroids(rows: DataFrame, vector: str, centroids: DataFrame, group: str, top: int = 2, most: int = 10_000) -> DataFrame:
    """``rows`` with ``best``: (far, group) of the ``top`` nearest centroids, nearest first; ``far`` is less the cosine. Ties go to the lesser group.

    Up to ``most`` centroids travel with a broadcast of one row.  More are dealt
    to lists of so many, each row meets the lists one after another, and its
    best of each are ranked again.
    """
    lists = max(1, -(-centroids.count() // most))
    one = F.struct(F.col(group).alias("group"), F.col("centroid"))
    found = F.transform("known", lambda c: F.struct((-cosine(F.col(vector), c["centroid"])).alias("far"), c["group"].alias("group")))
    best = _first(F.filter(found, lambda x: x["far"].isNotNull()), top)
    if lists == 1:
        known = F.broadcast(centroids.agg(F.collect_list(one).alias("known")))
        return rows.join(known).withColumn("best", best).drop("known")
    known = centroids.withColumn("__list", F.pmod(F.xxhash64(group), F.lit(lists)).cast("int")).groupBy("__list").agg(F.collect_list(one).alias("known"))
    kept = F.struct(*rows.columns)
    numbered = rows.select(F.monotonically_increasing_id().alias("__row"), kept.alias("__kept"), F.col(vector).alias(vector))
    met = numbered.withColumn("__list", F.explode(F.sequence(F.lit(0), F.lit(lists - 1)))).join(known, "__list")
    ranked = met.select("__row", "__kept", best.alias("best")).groupBy("__row").agg(F.first("__kept").alias("__kept"), F.flatten(F.collect_list("best")).alias("best"))
    return ranked.select("__kept.*", _first(F.col("best"), top).alias("best"))


def _first(found: Column, top: int) -> Column:
    """The least of an array, in order; one or two without sorting it."""
    if top > 2:
        return F.slice(F.array_sort(found), 1, top)

    def least(all_: Column) -> Column:
        if top == 1:
            return F.slice(F.array_compact(F.array(F.array_min(all_))), 1, top)
        return let(F.array_min(all_), lambda first: F.array_compact(F.array(first, F.array_min(F.filter(all_, lambda x: x > first)))))

    return let(found, least)


def merge_candidates(profiles: DataFrame, seconds: float, key: str = "recording_id") -> DataFrame:
    """key, speaker_id, other, score, margin: of each ready profile the most alike ready one, and by how much it leads the next (or -1)."""
    ready = profiles.where((F.col("total_seconds") >= seconds) & F.col("centroid").isNotNull())
    a, b = ready.select(key, "speaker_id", "centroid"), ready.select(key, F.col("speaker_id").alias("other"), F.col("centroid").alias("centroid_b"))
    pairs = a.join(b, key).where("speaker_id <> other").withColumn("score", cosine(F.col("centroid"), F.col("centroid_b")))
    w = Window.partitionBy(key, "speaker_id").orderBy(F.col("score").desc(), "other")
    second = F.coalesce(F.lead("score").over(w), F.lit(-1.0))
    return pairs.withColumn("margin", F.col("score") - F.greatest(second, F.lit(-1.0))).withColumn("n", F.row_number().over(w)).where("n = 1").select(key, "speaker_id", "other", "score", "margin")


def id_order(speaker: Column) -> Column:
    """Sort key of speaker ids: by number, those without one last, then by name."""
    number = F.regexp_extract(speaker, r"([^_]*)$", 1).try_cast("long")
    return F.struct(F.coalesce(number, F.lit(10**9)).alias("number"), speaker.alias("name"))


def canonical_ids(merges: DataFrame) -> DataFrame:
    """loser, canonical: the end of each chain of merges (loser, winner), by doubling the steps; null for one that runs into a circle.

    A loser has one winner.  Rounds are checkpointed, as the plan would double
    with each: at most one more than the binary logarithm of the losers.
    """
    chains = merges.select("loser", "winner").where("loser <> winner")
    most = chains.count()
    context = merges.sparkSession.sparkContext
    if context.getCheckpointDir() is None and (folder := merges.sparkSession.conf.get("spark.checkpoint.dir", None)):
        context.setCheckpointDir(folder)
    for _ in range(max(1, most).bit_length() + 1):
        onward = chains.select(F.col("loser").alias("mid"), F.col("winner").alias("beyond"))
        longer = chains.join(onward, F.col("winner") == F.col("mid"), "left").select("loser", F.coalesce("beyond", "winner").alias("winner"), F.col("beyond").isNotNull().alias("more"))
        longer = longer.checkpoint() if context.getCheckpointDir() else longer
        chains = longer.select("loser", "winner")
        if longer.where("more").isEmpty():
            break
    ends = chains.join(merges.select(F.col("loser").alias("mid")).distinct(), F.col("winner") == F.col("mid"), "left")
    return ends.select("loser", F.when(F.col("mid").isNull(), F.col("winner")).alias("canonical"))
