"""Sources: jobs, payloads, transfers, event streams, audio and settings.

Every source is a DataFrame over files, so splits, retries and pruning are
Spark's; network services are reached by whatever puts files where they are
read, or by a function given to :func:`handled`.
"""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.audio import resampled
from ..functions.settings import label, suffix
from ..shipping import ship

JOB = "job_id string, type string, metadata string"
META = "struct<filename:string,name:string,content_type:string,mime_type:string,strategy:string,backend:string,config:string>"
EVENT = "job_id string, seq long, event string, data string"
AUDIO = "path string, samples array<float>, sample_rate int, error string"


def jobs(spark: SparkSession, path: str, types: list[str] | None = None, streaming: bool = False) -> DataFrame:
    """Claimed jobs from JSON lines: job_id, type, metadata (JSON), and what is read from it: filename, content_type, label, suffix.

    ``types`` filters before anything else is read.
    """
    reader = (spark.readStream if streaming else spark.read).schema(JOB)
    rows = reader.json(path)
    rows = rows if types is None else rows.where(F.col("type").isin(types))
    meta = F.from_json(F.coalesce("metadata", F.lit("{}")), META)
    rows = rows.withColumn("meta", meta).withColumn("filename", F.coalesce("meta.filename", "meta.name")).withColumn("content_type", F.coalesce("meta.content_type", "meta.mime_type"))
    return rows.withColumn("label", label(F.col("filename"), F.col("content_type"))).withColumn("suffix", suffix(F.col("filename"), F.col("content_type")))


def payloads(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def transfer_url(base_url: str, reference: Column) -> Column:
    """An absolute URL as it is, a bare id below ``/api/transfer/``, a path below the base."""
    base = base_url.rstrip("/")
    return (
        F.when(reference.rlike("^https?://"), reference)
        .when(~F.contains(reference, F.lit("/")), F.concat(F.lit(f"{base}/api/transfer/"), reference))
        .otherwise(F.concat(F.lit(base), reference))
    )


def server_sent_events(blocks: DataFrame, text: str = "value") -> DataFrame:
    """event (``message`` by default) and data of event blocks; data lines are joined, comments passed over."""
    lines = F.split(F.col(text), r"\r?\n")
    field = lambda name: F.transform(F.filter(lines, lambda v: v.startswith(f"{name}:")), lambda v: F.regexp_replace(v, f"^{name}: ?", ""))
    return blocks.withColumn("event", F.coalesce(F.nullif(F.try_element_at(field("event"), F.lit(-1)), F.lit("")), F.lit("message"))).withColumn("data", F.array_join(field("data"), "\n"))


def event_payload(data: Column, schema: str) -> Column:
    """JSON data by a schema, and ``raw``, the data itself where it isn't JSON."""
    parsed = F.from_json(data, schema, {"mode": "PERMISSIVE"})
    bad = F.try_parse_json(data).isNull()
    return F.struct(F.when(~bad, parsed).alias("payload"), F.when(bad, data).alias("raw"))


def routed(events: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]]) -> dict[str, DataFrame]:
    """Events by type, each given to its handler."""
    return {kind: handler(events.where(F.col("event") == kind)) for kind, handler in handlers.items()}


def channel(frames: bytes, channels: int, width: int) -> np.ndarray:
    """Mean of the channels of each whole frame, from -1 to 1."""
    frames = frames[: len(frames) // (width * channels) * width * channels]  # a cut file may end within a frame
    if width == 3:
        raw = np.frombuffer(frames, np.uint8).reshape(-1, 3).astype(np.int32)
        values = ((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    elif width == 1:
        values = (np.frombuffer(frames, np.uint8).astype(np.float64) - 128) / 128
    else:
        values = np.frombuffer(frames, f"<i{width}") / float(1 << (8 * width - 1))
    return values.reshape(-1, channels).mean(axis=1)


def _wav(content: bytes, rate: int) -> tuple[np.ndarray | None, str | None]:
    if not content:
        return None, "the payload is empty"
    try:
        with wave.open(io.BytesIO(content)) as file:
            source, channels, width, frames = file.getframerate(), file.getnchannels(), file.getsampwidth(), file.readframes(file.getnframes())
    except (wave.Error, EOFError) as error:
        return None, f"not a readable WAV file: {error}"
    if source <= 0:
        return None, "no valid sample rate"
    mono = channel(frames, channels, width)
    if not len(mono):
        return None, "no audio frames"
    return resampled(mono, source, rate), None


def _decoded(content, rate: int) -> tuple[np.ndarray | None, str | None]:
    try:
        return _wav(bytes(content) if content is not None else b"", rate)
    except Exception as error:  # one file's fault is its own
        return None, f"not a readable WAV file: {error}"


def audio(files: DataFrame, rate: int = 16_000) -> DataFrame:
    """AUDIO of (path, content) rows: WAV files as one channel at ``rate``. What can't be read has an error; it never fails the query."""
    ship(files.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [_decoded(c, rate) for c in frame["content"]]
            yield pd.DataFrame({"path": frame["path"], "samples": [s for s, _ in found], "sample_rate": rate, "error": [e for _, e in found]})

    return files.select("path", "content").mapInPandas(run, AUDIO)


def recognised(recordings: DataFrame, recognise: Callable[[np.ndarray, int], list[dict]], key: str = "path") -> DataFrame:
    """Segments (key, seg_idx, start, end, text, speaker) from a model outside the engine; a failure gives a row with ``error``."""
    ship(recordings.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, samples, rate in zip(frame[key], frame["samples"], frame["sample_rate"], strict=True):
                try:
                    rows += [(name, i, s.get("start"), s.get("end"), s.get("text"), s.get("speaker"), None) for i, s in enumerate(recognise(np.asarray(samples, np.float32), int(rate)))]
                except Exception as error:  # one recording's failure is its own
                    rows.append((name, None, None, None, None, None, str(error) or type(error).__name__))
            yield pd.DataFrame(rows, columns=[key, "seg_idx", "start", "end", "text", "speaker", "error"]).astype({"seg_idx": "Int64"})

    return recordings.select(key, "samples", "sample_rate").mapInPandas(run, f"{key} string, seg_idx long, start double, end double, text string, speaker string, error string")


def diarised(recordings: DataFrame, diarise: Callable[[np.ndarray, int], list[dict]], key: str = "path") -> DataFrame:
    """Turns (key, turn_idx, start, end, speaker) from a model outside the engine, in its order; a failure gives a row with ``error``."""
    ship(recordings.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, samples, rate in zip(frame[key], frame["samples"], frame["sample_rate"], strict=True):
                try:
                    rows += [(name, i, float(t["start"]), float(t["end"]), str(t["speaker"]), None) for i, t in enumerate(diarise(np.asarray(samples, np.float32), int(rate)))]
                except Exception as error:
                    rows.append((name, None, None, None, None, str(error) or type(error).__name__))
            yield pd.DataFrame(rows, columns=[key, "turn_idx", "start", "end", "speaker", "error"]).astype({"turn_idx": "Int64"})

    return recordings.select(key, "samples", "sample_rate").mapInPandas(run, f"{key} string, turn_idx long, start double, end double, speaker string, error string")


def settings(path: str) -> dict:
    """A mapping from a JSON or YAML file; empty if the file is absent, an error if it holds something else."""
    file = Path(path)
    if not file.exists():
        return {}
    text = file.read_text()
    if file.suffix == ".json":
        found = json.loads(text)
    else:
        import yaml  # only where it's installed

        found = yaml.safe_load(text)
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError("settings must be a mapping")
    return found
