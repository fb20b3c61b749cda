"""Waveform arithmetic on arrays of samples.

Errors of single rows are nulls: one bad row never fails a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType


def duration_seconds(samples: Column, rate: Column) -> Column:
    return F.when(rate > 0, F.size(samples) / rate).otherwise(F.lit(0.0))


def valid(samples: Column) -> Column:
    """Not empty, and some sample is finite."""
    finite = F.exists(samples, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size(samples) > 0) & finite, F.lit(False))


def mono_planar(frame: Column) -> Column:
    """Mean over planes of an array of channels."""
    return F.transform(F.sequence(F.lit(0), F.size(frame[0]) - 1), lambda i: F.aggregate(F.transform(frame, lambda c: F.get(c, i).cast("double")), F.lit(0.0), lambda a, v: a + v) / F.size(frame))


def mono_packed(frame: Column) -> Column:
    """Mean of each sample's channels, of an array of samples."""
    return F.transform(frame, lambda s: F.aggregate(s, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(s))


def mono_interleaved(samples: Column, channels: Column) -> Column:
    """Mean of each run of ``channels`` values; null if they don't divide the samples."""
    whole = (F.size(samples) % channels == 0) & (F.size(samples) >= channels)
    count = (F.size(samples) / channels).cast("int")
    mean = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.aggregate(F.slice(samples, i * channels + 1, channels), F.lit(0.0), lambda a, v: a + v.cast("double")) / channels)
    return F.when(whole, mean)


def mono(frame: Column, channels: Column, planar: Column) -> Column:
    """One channel of a frame in any layout: planes, packed samples, or one interleaved plane.

    Without a known layout, planes are tried before packed samples.  Null for an
    empty frame or one that fits no layout.
    """
    rows, columns = F.size(frame), F.size(frame[0])
    single = (rows == 1) & (channels > 1)
    as_planes = F.coalesce(planar, rows == channels)
    return (
        F.when((rows <= 0) | (columns <= 0), F.lit(None))
        .when(single, mono_interleaved(frame[0], channels))
        .when(as_planes & (rows == channels), mono_planar(frame))
        .when(columns == channels, mono_packed(frame))
        .when(rows == channels, mono_planar(frame))
    )


def joined_frames(frames: Column) -> Column:
    """One channel from the frames of a recording in order: those that are null or empty are passed over; null if none has a sample."""
    kept = F.flatten(F.filter(frames, lambda f: f.isNotNull()))
    return F.when(F.size(kept) > 0, kept)


def buffer(samples: Column, rate: Column) -> Column:
    """(samples, sample_rate, error) from an array of numbers: an error where it has no rate, no sample, or none that is finite."""
    error = F.when(rate.isNull() | (rate <= 0), "no valid sample rate").when(samples.isNull() | (F.size(samples) == 0), "no samples").when(~valid(samples), "no sample is finite")
    shape = "struct<samples:array<float>,sample_rate:int,error:string>"
    return F.struct(F.when(error.isNull(), samples).alias("samples"), F.when(error.isNull(), rate).alias("sample_rate"), error.alias("error")).cast(shape)


def slice_seconds(samples: Column, rate: Column, start: Column, end: Column) -> Column:
    """Samples from start to end, ends truncated to whole samples; null if there are none."""
    low = F.greatest(F.lit(0), (start * rate).cast("int"))
    high = F.least(F.size(samples), (end * rate).cast("int"))
    return F.when(high > low, F.slice(samples, low + 1, F.greatest(high - low, F.lit(0))))


def _ratio(source: int, target: int) -> tuple[int, int]:
    common = int(np.gcd(source, target))
    return target // common, source // common


def resampled_length(count: int, source: int, target: int) -> int:
    """Samples after resampling: those of the same time, rounded up."""
    up, down = _ratio(source, target)
    return -(-count * up // down)


def resampled_from(start: int, stop: int, count: int, source: int, target: int, zeros: int = 10) -> tuple[int, int]:
    """The range of ``count`` source samples on which the target samples from start to stop depend."""
    up, down = _ratio(source, target)
    width = 0 if up == down else zeros * max(up, down)
    return max(0, -(-(start * down - width) // up)), min(count, ((stop - 1) * down + width) // up + 1)


def resampled(samples: np.ndarray, source: int, target: int, zeros: int = 10, start: int = 0, stop: int | None = None, first: int = 0, count: int | None = None) -> np.ndarray:
    """Polyphase resampling by a windowed sinc filter; the length is that of the same time, rounded up.

    With ``start`` and ``stop`` a piece of the result; then ``samples`` may be
    the part, from ``first``, of ``count`` samples that :func:`resampled_from`
    names.  Pieces are the same, sample by sample, as in one pass.
    """
    count = len(samples) if count is None else count
    stop = resampled_length(count, source, target) if stop is None else stop
    if source == target or not len(samples):
        return samples[start - first : stop - first].astype(np.float32)
    up, down = _ratio(source, target)
    width = zeros * max(up, down)
    taps = np.arange(-width, width + 1)
    kernel = np.sinc(taps / max(up, down)) * np.kaiser(2 * width + 1, 5.0)
    kernel *= up / kernel.sum()
    places = np.arange(start, stop) * down  # in the upsampled signal
    out = np.zeros(len(places))
    lowest = -(-(places - width) // up)
    for k in range(2 * width // up + 1):
        at = lowest + k
        tap = places - at * up + width
        inside = (at >= 0) & (at < count) & (tap >= 0) & (tap <= 2 * width)
        out[inside] += samples[at[inside] - first] * kernel[tap[inside]]
    return out.astype(np.float32)


@pandas_udf(ArrayType(FloatType()))
def resample(samples: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or not a or not b else resampled(np.asarray(x, np.float64), int(a), int(b)) for x, a, b in zip(samples, source, target, strict=True)])


#: Models that this Python worker has set up, by name: None, or why that failed.
_READY: dict[str, str | None] = {}


def _set_up(name: str, initialize) -> str | None:
    """Sets a model up once a worker process, whatever its tasks; a failure is remembered, too."""
    if name not in _READY:
        try:
            initialize()
            _READY[name] = None
        except Exception as error:
            _READY[name] = str(error) or type(error).__name__
    return _READY[name]


def embedder(embed, initialize=None, name: str | None = None, errors: bool = False):
    """A column function (samples, rate) -> vector around ``embed``, a model outside the engine.

    ``initialize`` runs once a Python worker for each ``name`` (its own, unless
    given).  A null gives null, as does an error; with ``errors`` the result is a
    struct of vector and error, which says why.
    """
    shape = ArrayType(FloatType())
    name = name or (f"{initialize.__module__}.{initialize.__qualname__}" if initialize is not None else "")

    def one(x, rate, broken: str | None) -> tuple:
        if x is None or broken is not None:
            return None, broken
        try:
            found = embed(np.asarray(x, np.float32), int(rate))
        except Exception as error:  # a model's failure is a row without a vector
            return None, str(error) or type(error).__name__
        return (None if found is None else np.asarray(found, np.float32)), None

    def found(samples: pd.Series, rates: pd.Series) -> list[tuple]:
        broken = None if initialize is None else _set_up(name, initialize)
        return [one(x, r, broken) for x, r in zip(samples, rates, strict=True)]

    @pandas_udf(shape)
    def vectors(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for samples, rates in batches:
            yield pd.Series([v for v, _ in found(samples, rates)])

    @pandas_udf(StructType([StructField("vector", shape), StructField("error", StringType())]))
    def with_errors(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for samples, rates in batches:
            yield pd.DataFrame(found(samples, rates), columns=["vector", "error"])

    return with_errors if errors else vectors
