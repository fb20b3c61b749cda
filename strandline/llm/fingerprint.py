"""Canonical exact digests of documents, with DataFrame functions alone.

A text is brought to one form (Unicode composition, full case folding, one
space for any run of whitespace, none at the ends) and hashed with several
seeds of xxhash64.  Texts whose wide digests agree are compared byte by byte;
different texts in one bucket get different suffixes, so that two fingerprints
are equal exactly if the canonical texts are.

Nulls count as empty texts.  Rows with a null id come first in the order of
documents; rows with one id are ordered by their digest.  An empty table gives
an empty result.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Seeds of a digest: one 64-bit word each.
WORDS = 3
#: Mean number of documents that are ordered together.
BUCKET_ROWS = 1024
#: Ranges of ids at most, and rows of a range; the quantiles between them are all that the driver gets.
RANGES, RANGE_ROWS = 1000, 50_000
#: Hashes of texts that are broadcast, 8 bytes each; more are joined by an exchange.
BROADCAST_ROWS = 1_000_000


def _composed(text: Column) -> Column:
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))


def canonical(text: Column) -> Column:
    """Canonical form of a non-null text."""
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), _composed(text), F.lit(True))
    return F.trim(F.regexp_replace(_composed(folded), r"(?U)\s+", " "))


def digest(canon: Column, words: int = WORDS, bits: int = 64) -> Column:
    """Hex digest of ``words`` differently seeded words; ``bits`` of each are kept (fewer only in tests)."""
    parts = [F.xxhash64(F.lit(k), canon) for k in range(words)]
    if bits < 64:
        parts = [p.bitwiseAND(F.lit((1 << bits) - 1)) for p in parts]
    return F.concat(*(F.lpad(F.lower(F.hex(p)), 16, "0") for p in parts))


def ordered_buckets(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``bucket``: consecutive ranges of doc_id with about ``bucket_rows`` rows each; nulls have one before all.

    Quantiles of the ids first divide them into ranges (at most RANGES, which
    bounds what the driver gets), then each range is divided evenly, so gaps and
    crowds in the ids don't make large buckets.
    """
    rows = docs.select(F.count("doc_id")).first()[0]
    if not rows:
        return docs.withColumn("bucket", F.lit(-1).cast("long"))
    ranges = min(RANGES, -(-rows // range_rows))
    inner = F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges) if ranges > 1 else F.array().cast("array<long>")
    low, high, middle = docs.agg(F.min("doc_id"), F.max("doc_id"), inner).first()
    edges = sorted({low, *middle})
    widths = [max(1.0, (after - edge) * bucket_rows * len(edges) / rows) for edge, after in zip(edges, [*edges[1:], high + 1], strict=True)]
    starts, steps = F.array(*map(F.lit, edges)), [1 << k for k in range(len(edges).bit_length() - 1, -1, -1)]
    # A binary search: the last edge that isn't beyond the id.
    at = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda p, s: F.when(F.coalesce(F.get(starts, p + s) <= F.col("doc_id"), F.lit(False)), p + s).otherwise(p))
    found = docs.withColumn("edge", at)
    offset = (F.col("doc_id").cast("double") - F.get(starts, F.col("edge")).cast("double")) / F.get(F.array(*map(F.lit, widths)), F.col("edge"))
    bucket = F.col("edge").cast("long") * F.lit(1 << 32) + F.floor(offset)
    return found.withColumn("bucket", F.coalesce(bucket, F.lit(-1)).cast("long")).drop("edge")


def _with_next(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """Each document beside the next one in ascending doc_id (after the last: the first).

    One exchange of the texts, by bucket; rows without an id have buckets by
    their digests.  The last row of a bucket finds its successor through the
    bucket heads, of which there are few.
    """
    base = ordered_buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    base = base.withColumn("h", digest(canonical(F.col("text")), words, bits))
    base = base.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.conv(F.substring("h", 1, 4), 16, 10).cast("long") - (1 << 20)).otherwise(F.col("bucket")))
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "h", "text")
    names = ("text", "h", "doc_id")
    seen = base.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in names), F.lag("h").over(w).alias("prev_h"))
    heads = seen.where(F.col("prev_h").isNull()).select(F.col("bucket").alias("head_bucket"), *(F.col(c).alias(f"head_{c}") for c in names))
    nexts = _buckets_after(base.select("bucket").distinct()).join(heads, "head_bucket").drop("head_bucket")
    last = F.col("next_h").isNull()
    return seen.join(nexts, "bucket").select("doc_id", "text", "h", *(F.when(last, F.col(f"head_{c}")).otherwise(F.col(f"next_{c}")).alias(f"next_{c}") for c in names))


def _buckets_after(buckets: DataFrame) -> DataFrame:
    """bucket, head_bucket: the next one, of the last the first; ordered within ranges, of which there are RANGES + 1 at most."""
    ranged = buckets.withColumn("edge", F.shiftright("bucket", 32))
    firsts = ranged.groupBy("edge").agg(F.min("bucket").alias("first"))
    order = Window.orderBy("edge")
    firsts = firsts.select("edge", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("beyond"))
    after = F.lead("bucket").over(Window.partitionBy("edge").orderBy("bucket"))
    return ranged.select("bucket", "edge", after.alias("after")).join(firsts, "edge").select("bucket", F.coalesce("after", "beyond").alias("head_bucket"))


def _edited(text: Column, following: Column) -> Column:
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, words: int = WORDS, bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its second half replaced by the beginning of the next
    document.  Likeness of exact digests is 1 or 0.
    """
    paired = _with_next(docs, words, bits)
    edited = paired.withColumn("edited", _edited(F.col("text"), F.col("next_text"))).withColumn("edited_canon", canonical(F.col("edited")))
    same_next = F.when(F.col("h") == F.col("next_h"), canonical(F.col("text")) == canonical(F.col("next_text"))).otherwise(False)
    e_h = digest(F.col("edited_canon"), words, bits)
    same_edited = F.when(F.col("h") == e_h, canonical(F.col("text")) == F.col("edited_canon")).otherwise(False)
    found = written(
        edited.select(
            "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
            "h", e_h.alias("edited_h"), same_edited.cast("double").alias("near_edited"), same_next.cast("double").alias("near_next"),
            F.xxhash64("text").alias("raw"), F.col("next_doc_id"), F.xxhash64("next_text").alias("next_raw"),
        ),
        "digests",
    )
    return _told_apart(found, docs, words, bits)


def _small(rows: DataFrame) -> DataFrame:
    """A written table of hashes: broadcast if it is small, and joined by an exchange otherwise."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _told_apart(found: DataFrame, docs: DataFrame, words: int, bits: int) -> DataFrame:
    """Compares the bytes of all texts that share a digest; suffixes where they differ.

    Only texts whose digest is shared are exchanged again, and equal bytes
    collapse before that, so a large group of copies costs a row a task.  Of
    edited texts those are made again that share a digest with another text
    than their own.
    """
    shared = written(found.select(F.explode(F.array("h", "edited_h")).alias("h")).groupBy("h").count().where("count > 1").select("h"), "shared")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("raw", F.xxhash64("text"))
    wanted = written(found.join(shared, "h").select("raw").distinct(), "wanted")
    own = texts.join(_small(wanted), "raw", "left_semi").select(canonical(F.col("text")).alias("canon")).select(digest(F.col("canon"), words, bits).alias("h"), "canon")
    # A text that its edit leaves as it is (near_edited) was compared when it was made.
    flagged = found.where("near_edited = 0").join(shared.withColumnRenamed("h", "edited_h"), "edited_h", "left_semi")
    other = _edits(flagged, texts).select(digest(F.col("canon"), words, bits).alias("h"), "canon")
    several = own.unionByName(other).groupBy("h").agg(F.min("canon").alias("least"), F.max("canon").alias("most"))
    clashing = written(several.where("least < most").select("h"), "clashing")
    columns = ["doc_id", "n_chars", "edited_sha256", F.col("h").alias("fingerprint"), F.col("edited_h").alias("edited_fingerprint"), "near_edited", "near_next"]
    if clashing.isEmpty():
        return found.select(*columns)
    return _suffixed(found, texts, clashing, words, bits).select(*columns)


def _edits(flagged: DataFrame, texts: DataFrame) -> DataFrame:
    """edited_sha256 and canon of the edited texts of rows of ``found``, made again from their two texts."""
    pairs = written(flagged.select("edited_sha256", "raw", "next_raw").distinct(), "edits")
    wanted = written(pairs.select(F.explode(F.array("raw", "next_raw")).alias("raw")).distinct(), "of_edits")
    two = written(texts.join(_small(wanted), "raw", "left_semi").select("raw", "text").distinct(), "texts_of_edits")
    both = pairs.join(two, "raw").join(two.select(F.col("raw").alias("next_raw"), F.col("text").alias("next_text")), "next_raw")
    made = both.select("edited_sha256", _edited(F.col("text"), F.col("next_text")).alias("edited"))
    # Texts whose short hashes agree by chance make an edit that nobody has.
    return made.where(F.sha2("edited", 256) == F.col("edited_sha256")).select("edited_sha256", canonical(F.col("edited")).alias("canon"))


def _suffixed(found: DataFrame, texts: DataFrame, clashing: DataFrame, words: int, bits: int) -> DataFrame:
    """``found`` with a suffix on the digests that several canonical texts share: the rank of the text's bytes.

    Clashes are chance events of a wide digest; they go by SHA-256 from here on.
    """
    clashing = clashing.withColumn("clashes", F.lit(True))
    canon = canonical(F.col("text")).alias("canon")
    # Raw texts of clashing digests, their edits, and the rank of each canonical text within its digest.
    own = texts.join(_small(written(found.join(clashing, "h").select("raw").distinct(), "raw_clashing")), "raw", "left_semi").select("raw", "text", canon).distinct()
    own = written(own.select("raw", F.sha2("text", 256).alias("sha"), digest(F.col("canon"), words, bits).alias("h"), "canon"), "own_clashing")
    edits = written(_edits(found.join(clashing.withColumnRenamed("h", "edited_h"), "edited_h"), texts).distinct().select("edited_sha256", digest(F.col("canon"), words, bits).alias("edited_h"), "canon"), "edits_clashing")
    every = own.select("h", "canon").unionByName(edits.select(F.col("edited_h").alias("h"), "canon")).distinct()
    ranks = every.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("canon")))
    of_own = own.join(ranks, ["h", "canon"]).select("raw", "h", F.col("rank").alias("own_rank")).dropDuplicates(["raw", "h"])
    of_edit = edits.join(ranks.withColumnRenamed("h", "edited_h"), ["edited_h", "canon"]).select("edited_sha256", "edited_h", F.col("rank").alias("edit_rank")).dropDuplicates(["edited_sha256"])
    out = found.join(of_own, ["raw", "h"], "left").join(of_edit, ["edited_sha256", "edited_h"], "left")
    for column, rank in (("h", "own_rank"), ("edited_h", "edit_rank")):
        out = out.withColumn(column, F.concat(column, F.coalesce(F.concat(F.lit("-"), F.col(rank).cast("string")), F.lit(""))))
    return out


def wide_digest(text: Column) -> Column:
    """Digest column of a text, for use outside the whole-table operator."""
    return digest(canonical(F.coalesce(text.cast("string"), F.lit(""))))


__all__ = ["canonical", "digest", "fingerprints", "ordered_buckets", "wide_digest"]
