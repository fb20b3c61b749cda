"""Prepares a session: Python workers can import the package, and what they hold at once is bounded."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of a batch that goes to a Python worker, instead of Spark's 64 MB: long texts come in batches, too.
BATCH, _BATCH_KEY, _BATCH_DEFAULT = "16m", "spark.sql.execution.arrow.maxBytesPerBatch", ("67108864b", "67108864", "64m", "64mb")


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a SparkContext; bounds batches unless the session does."""
    if str(spark.conf.get(_BATCH_KEY)).lower() in _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, BATCH)
    context = spark.sparkContext
    if getattr(context, "_strandline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="strandline-")) / "strandline_package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, f"{root.name}/{file.relative_to(root)}")
    context.addPyFile(str(path))
    context._strandline_shipped = True
