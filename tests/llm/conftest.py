import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use within.
CLASHING = ("score", "shard", "bucket", "h", "code", "key", "tokens", "row", "labelled", "label", "__kept", "rep", "pass", "block", "start", "ids", "next_text", "component")


def documents():
    """Nulls in every column, empty and very long texts, copies, ties and repeated rows."""
    rows = [(i, f"Common words number {i % 7} and some more of them, {'x' * (i % 5)}", "en", f"src{i % 3}", 1) for i in range(40)]
    rows += [(100, None, "en", "src0", None), (101, "", None, None, 0), (102, "   \n\t ", "en", "src1", 3), (103, "word " * 30_000, "en", "src0", 150_000), (104, "Ünïcode ﬁx é é", "fr", None, 9)]
    rows += [(105, "Twice the same row", "en", "src2", 1)] * 2 + [(None, "No id at all", "en", "src1", 2), (None, None, None, None, None), (106, "x" * 100_000, "en", "src1", 100_000)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents with clashing further columns."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(documents(), DOC).select("*", *(F.lit(f"extra {c}").alias(c) for c in CLASHING))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def sample_labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
