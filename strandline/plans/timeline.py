"""The driver's tables as transcripts.

A conversation is a recording, a turn a segment that takes a second for 15
characters, a role a speaker.  A second hearing of it (``heard again``) comes a
little later and loses the ends of its texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: Characters a second; how much later, and how many characters less, the second hearing is.
PACE, LATER, LOST = 15.0, 0.2, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by key in as many partitions as shuffles have: what follows costs by the characters, not by the bytes that AQE would gather partitions by."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, seg_idx, start, end, text, speaker."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    speaker = F.when(F.col("role") == "user", "SPEAKER_00").when(F.col("role") == "assistant", "SPEAKER_01")
    return spread(table(spark, sf_dir, "conversations"), "conv_id").select(
        F.col("conv_id").alias("recording_id"), F.col("turn").alias("seg_idx"), (before / PACE).alias("start"),
        ((before + F.length("text")) / PACE).alias("end"), "text", speaker.alias("speaker"),
    )


def heard_again(segments: DataFrame) -> DataFrame:
    text = F.substring("text", F.lit(1), F.greatest(F.lit(0), F.length("text") - LOST))
    return segments.select("recording_id", "seg_idx", (F.col("start") + LATER).alias("start"), (F.col("end") + LATER).alias("end"), text.alias("text"), "speaker")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment (a_*) beside the second hearing (b_*) of itself and of the next; one exchange by recording."""
    first = timeline(spark, sf_dir)
    a = first.select(*(F.col(c).alias(f"a_{c}") for c in first.columns))
    again = heard_again(first)
    b = again.select(*(F.col(c).alias(f"b_{c}") for c in again.columns))
    near = F.explode(F.array(F.col("a_seg_idx"), F.col("a_seg_idx") + 1))
    a = a.withColumn("near", near)
    return a.join(b, (F.col("a_recording_id") == F.col("b_recording_id")) & (F.col("near") == F.col("b_seg_idx"))).drop("near", "b_recording_id").withColumnRenamed("a_recording_id", "recording_id")


#: Windows: the segments that begin in each of these seconds are aligned with what is heard again in them.
WINDOW_SECONDS = 120.0


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, window, overlap_start, overlap_end, previous, current: lists of segments by windows of time."""
    first = timeline(spark, sf_dir)
    both = first.withColumn("side", F.lit(0)).unionByName(heard_again(first).withColumn("side", F.lit(1)))
    rows = both.withColumn("window", F.floor(F.col("start") / WINDOW_SECONDS))
    lists = spread(rows, "recording_id", "window").groupBy("recording_id", "window").agg(*(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("seg_idx", "start", "end", "text", "speaker")))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["speaker"].alias("speaker"))).alias(name)
        for k, name in enumerate(("previous", "current"))
    ))
    return lists.select("recording_id", "window", (F.col("window") * WINDOW_SECONDS).alias("overlap_start"), ((F.col("window") + 1) * WINDOW_SECONDS).alias("overlap_end"), "previous", "current")


#: Chunks: seconds, and seconds that two have in common.
CHUNK_SECONDS, OVERLAP_SECONDS = 120.0, 60.0


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping chunks of each recording; every other chunk is of the second hearing."""
    first = timeline(spark, sf_dir)
    step = CHUNK_SECONDS - OVERLAP_SECONDS
    both = first.withColumn("odd", F.lit(0)).unionByName(heard_again(first).withColumn("odd", F.lit(1)))
    low = F.greatest(F.lit(0), F.ceil((F.col("end") - CHUNK_SECONDS) / step)).cast("int")
    high = F.greatest(low, F.floor(F.col("start") / step).cast("int"))
    rows = both.withColumn("k", F.explode(F.sequence(F.least(low, F.floor(F.col("start") / step).cast("int")), high))).where(F.col("k") % 2 == F.col("odd"))
    last = Window.partitionBy("recording_id")
    grouped = rows.groupBy("recording_id", "k").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text", "speaker"))).alias("segments")).withColumn("top", F.max("k").over(last))
    return grouped.select("recording_id", (F.col("k") + 1).cast("int").alias("chunk_index"), (F.col("k") * step).alias("chunk_start"), (F.col("k") * step + CHUNK_SECONDS).alias("chunk_end"), (F.col("k") == F.col("top")).alias("is_last"), "segments")
