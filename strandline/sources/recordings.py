"""Long recordings in pieces: many tasks read, decode and resample ranges of one file.

Files are listed by Spark, without their content; a task reads a file's header,
and its pieces, a number each, are dealt to tasks that read no more than a
piece's frames and what the resampling filter needs at both ends.  Pieces join
without a seam: they are, sample by sample, those of the whole file in one
pass.  No task holds a file, whatever its length, so files may be beyond the
2 GB of a binary column.

A file that can't be read, or has no frame, gives one row with an error; one
that is cut gives the frames there are.  Spark lists no file without a byte, so such
a file gives no row, nor does a folder without files.
"""

from __future__ import annotations

import wave
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.audio import resampled, resampled_from, resampled_length
from ..shipping import ship
from .readers import channel

HEAD = "path string, source int, frames long, error string"
PIECE = "path string, piece long, start long, samples array<float>, sample_rate int, error string"
_PIECE = pa.schema([("path", pa.string()), ("piece", pa.int64()), ("start", pa.int64()), ("samples", pa.list_(pa.float32())), ("sample_rate", pa.int32()), ("error", pa.string())])
#: Bytes of files a task reads, on average at most.
TASK_BYTES = 512 << 20


def _opened(path: str) -> pa.NativeFile:
    """A file that can be read from anywhere, by its path as Spark lists it."""
    scheme, found, rest = path.partition(":")
    if not found or scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + (rest if found else path).lstrip("/"))
    store, inner = fs.FileSystem.from_uri(quote(path, safe="/:@"))
    return store.open_input_file(inner)


def heads(files: DataFrame) -> DataFrame:
    """HEAD of WAV files (path): their sample rate and whole frames, or why they can't be read."""
    ship(files.sparkSession)

    def head(path: str) -> tuple:
        try:
            with _opened(path) as handle, wave.open(handle) as file:
                there = (handle.size() - handle.tell()) // (file.getnchannels() * file.getsampwidth())
                frames, source = min(file.getnframes(), there), file.getframerate()
        except Exception as error:  # one file's fault is its own
            return path, None, None, f"not a readable WAV file: {error}"
        if source <= 0:
            return path, None, None, "no valid sample rate"
        return path, source, frames, None if frames else "no audio frames"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([head(p) for p in batch["path"]], columns=["path", "source", "frames", "error"]).astype({"source": "Int32", "frames": "Int64"})

    return files.select("path").mapInPandas(run, HEAD)


def _read(path: str, source: int, frames: int, rate: int, start: int, stop: int):
    low, high = resampled_from(start, stop, frames, source, rate)
    with _opened(path) as handle, wave.open(handle) as file:
        file.setpos(low)
        mono = channel(file.readframes(high - low), file.getnchannels(), file.getsampwidth())
    return resampled(mono, source, rate, start=start, stop=stop, first=low, count=frames)


def pieces(spark: SparkSession, path: str, rate: int = 16_000, seconds: float = 60.0, overlap: float = 0.0, pattern: str = "*.wav") -> DataFrame:
    """PIECE of the recordings below ``path``, as one channel at ``rate``.

    A piece begins every ``seconds`` and goes on for ``overlap`` seconds where
    the next has begun; ``start`` is its first sample's place in the recording.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")
    step, beyond = max(1, round(seconds * rate)), max(0, round(overlap * rate))
    tasks = max(spark.sparkContext.defaultParallelism, (files.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                samples, error = None, row["error"]
                if error is None:
                    try:
                        samples = _read(row["path"], row["source"], row["frames"], rate, row["start"], row["stop"])
                    except Exception as failure:
                        error = f"not a readable WAV file: {failure}"
                values = [row["path"], row["piece"], row["start"], samples, rate, error]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _PIECE, strict=True)], schema=_PIECE)

    length = F.udf(lambda n, source: None if n is None else resampled_length(n, source, rate), "long")
    ranges = heads(files).withColumn("count", length("frames", "source"))
    last = F.greatest(F.coalesce(F.expr(f"(count - 1) div {step}"), F.lit(0)), F.lit(0))
    ranges = ranges.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("start", F.col("piece") * step)
    ranges = ranges.withColumn("stop", F.least("count", F.col("start") + (step + beyond)))
    # By number: a plain exchange of so few bytes would be taken together again.
    return ranges.repartition(int(tasks), "path", "piece").mapInArrow(found, PIECE)
