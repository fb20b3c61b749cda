"""Tables that are written in the middle of a job, to the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK, _RUNNING, _BEFORE = threading.Lock(), [], []


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent a session on one machine, as in tests, takes a
    temporary folder; a cluster is refused, as its executors wouldn't see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strandline-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base}/strandline-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    with _LOCK:
        if not _RUNNING:
            _BEFORE.append(spark.conf.get(_CLEANUP, None))
        _RUNNING.append(1)
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            _RUNNING.pop()
            if not _RUNNING:  # the last of several at once
                if (before := _BEFORE.pop()) is None:
                    spark.conf.unset(_CLEANUP)
                else:
                    spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors. It goes when the application ends."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    path = f"{folder}/{label}"
    with _shuffles_removed(spark):
        df.write.options(**options).parquet(path)
    whole = spark._jvm.org.apache.hadoop.fs.Path(folder)
    whole.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(whole)
    return df.sparkSession.read.schema(df.schema).parquet(path)
