"""What the operators share: table access and text batches; written tables are of ``shared``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import written as written
from ..shipping import ship

#: Text that is worked on at once in a Python worker.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_sum_before(rows: DataFrame, within: list[str], coarse: Column, order: list, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of ``within`` that come before, in the order of ``coarse``, then ``order``.

    Rows are summed within a value of ``coarse`` first, so no task orders more
    than those, or one row a value; columns of ``within`` aren't null.
    """
    rows = rows.withColumn("_coarse", coarse)
    before = Window.partitionBy(*within).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    leads = rows.groupBy(*within, "_coarse").agg(F.sum(value).alias("_sum")).select(*within, "_coarse", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_lead"))
    inner = Window.partitionBy(*within, "_coarse").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(leads, [*within, "_coarse"])
    return found.withColumn(name, F.col("_lead") + F.col("_inner")).drop("_coarse", "_lead", "_inner")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shuffled(seed: str) -> Column:
    """A seeded key of each row, from its id and text: rows that share an id, or have none, spread by their texts."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_or_empty())))


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about ``limit`` bytes each; a longer text stands alone."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + limit, "right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def coded(texts: pa.Array, whitespace: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Splits texts, at every space or else at runs of ASCII whitespace.

    Returns for each piece the row it is from and its place among the distinct
    pieces, and these.  Work on a distinct piece is then done once a batch.
    Nothing stands between two spaces, but that is a piece; white space at the
    ends gives none.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(texts) if whitespace else pc.split_pattern(texts, " ")
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    found = pc.list_flatten(lists).dictionary_encode()
    rows, codes = rows.astype(np.int64), found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if whitespace and (blank := pc.index(found.dictionary, "").as_py()) >= 0:
        rows, codes = rows[codes != blank], codes[codes != blank]
    return rows, codes, found.dictionary


def chunked(texts: pa.Array, whitespace: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
    rows, codes, pieces = coded(texts, whitespace)
    return rows, codes, pieces.to_pylist()
