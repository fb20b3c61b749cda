"""A training corpus from ``documents``, stage by stage.

Each stage works on all that the one before kept and calls one operator; all
but the last return the columns of ``documents``.  Stages may be run one by one
over written tables, or all by :func:`run`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import mixing, nearcopies, packing, quality, toxicity
from strandline.llm.common import table, written
from strandline.llm.queries import tokenizer_file
from strandline.shipping import ship

#: No stage here can be put into SQL: models, fingerprints and token ids are not SQL's.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    ship(spark)
    return toxicity.kept(docs, table(spark, sf_dir, "labels"))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship(spark)
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least doc_id: SimHash, BK-trees, five-word Jaccard of 0.8 or more."""
    ship(spark)
    return nearcopies.deduplicated(docs)


def in_proportion(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by tempered weights: every document comes once at least, those of small sources up to twice."""
    ship(spark)
    return mixing.remixed(docs)


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences of 1024."""
    ship(spark)
    found = packing.pieces(docs, tokenizer_file("byte_bpe_50k.json"))
    return packing.packed(found, carry=[F.crc32("ids").alias("ids_crc32")])


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("near_duplicates", without_copies),
    ("mixing", in_proportion),
    ("packing", in_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"{k}_{name}")
    return docs
