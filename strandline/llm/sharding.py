"""Shards by proportional stratified interleaving.

The rows of each source are shuffled by a seeded key and ranked; a row's
fraction is its rank over its source's size.  Sorted by fraction, every stretch
of rows holds the sources in their proportions, so equal cuts give shards that
match the mixture, with row counts at most one apart.

Ranks are exact without ordering a source in one task: rows are ranked within
small buckets of keys, and bucket counts give what lies before.  Texts are
read for their size and checksum and never exchanged.

Nulls: a null source is a source of its own, a null text has no bytes, a null
id is the empty text; rows that share an id are shuffled by their texts.  Rows that are equal in all that is returned
are interchangeable.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffled, text_or_empty, with_sum_before, written

#: Rows that are ranked together, on average at most; buckets whose counts are summed together.
BUCKET_ROWS, RUN = 2_000, 4_096
#: Bytes of a row besides its text.
ROW_BYTES = 16
SEED = "strandline"


def unit(text: Column) -> Column:
    """A number in [0, 1) from the md5 of a text, with 32 bits."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def _before(counts: DataFrame, within: list[str]) -> DataFrame:
    """Rows in the buckets before each one; ``counts`` has a row a bucket, of which RUN are summed together."""
    return with_sum_before(counts, within, F.floor(F.col("bucket") / RUN), ["bucket"], "count", "before")


def interleaved(docs: DataFrame, seed: str = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, text_crc32, ``fraction``, and ``position``: the row's place among all, from 0."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("")).alias("source"),
        (F.octet_length(text_or_empty()) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text_or_empty()).alias("text_crc32"),
        shuffled(seed).alias("key"),
    )
    rows = written(rows, "sizes")
    n = rows.count()
    buckets = max(1, -(-n // bucket_rows))
    part = rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32)) * buckets))
    sizes = part.groupBy("source", "bucket").count()
    offsets = _before(sizes, ["source"]).join(sizes.groupBy("source").agg(F.sum("count").alias("total")), "source")
    inner = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "text_crc32"))
    ranked = part.withColumn("inner", inner).join(offsets, ["source", "bucket"])
    # Sources start at different points below one rank, so that small ones don't all fall on one place.
    fraction = (F.col("before") + F.col("inner") - F.lit(1) + unit(F.concat_ws(":", F.lit(seed), "source"))) / F.col("total")
    ranked = written(ranked.select("doc_id", "source", "size", "text_crc32", "key", fraction.alias("fraction")), "ranked")
    ranked = ranked.withColumn("bucket", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)))
    starts = _before(ranked.groupBy("bucket").count(), [])
    inner = F.row_number().over(Window.partitionBy("bucket").orderBy("fraction", "source", "key", "doc_id", "size", "text_crc32"))
    placed = ranked.withColumn("inner", inner).join(starts, "bucket")
    return placed.select("doc_id", "source", "size", "text_crc32", "fraction", (F.col("before") + F.col("inner") - 1).alias("position"), F.lit(n).cast("long").alias("rows"))


def shards(docs: DataFrame, count: int, seed: str = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, text_crc32, shard (0 to count - 1) and slot (gapless from 0): equal cuts of the interleaving."""
    placed = interleaved(docs, seed, bucket_rows).withColumn("shard", F.expr(f"position * {count} div rows"))
    return placed.select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("position") - F.expr(f"(shard * rows + {count - 1}) div {count}")).alias("slot"))
