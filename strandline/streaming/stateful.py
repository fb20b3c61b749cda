"""The order-dependent operators over streams: throttle, chunk emitter, speakers and watchdog.

State is kept by key in Spark's state store, in variables of their own: one
entry a profile, a waiting chunk or a label, read and written by itself.  What
outlives its use goes by itself, after a time that each function takes.  Such
state needs the RocksDB provider, which these functions set for a session that
has the plain one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

import strandline

from ..operators.chunks import emissions, tail
from ..operators.progress import ENDED, Throttle
from ..operators.speakers import ASSIGNED, Settings, Speakers, Voice, direction, speaker_id
from ..shipping import ship

SEGMENT = "struct<start:double,end:double,text:string,speaker:string>"
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
CHUNK = f"recording_id string, chunk_index int, chunk_start double, chunk_end double, is_last boolean, segments array<{SEGMENT}>"
#: Seconds after which a job's last values or its end are forgotten, a recording's chunks aren't remembered, and a missing chunk isn't waited for.
JOB_SECONDS, RECORDING_SECONDS, PATIENCE_SECONDS = 86_400.0, 7 * 86_400.0, 600.0
_PROVIDER, _ROCKS, _PLAIN = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "HDFSBackedStateStoreProvider"


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str, initial: DataFrame | None = None) -> DataFrame:
    """``rows`` through the processor, by ``key``, which isn't null."""
    spark = rows.sparkSession
    ship(spark)
    if spark.conf.get(_PROVIDER, _PLAIN).endswith(_PLAIN):
        spark.conf.set(_PROVIDER, _ROCKS)
    # The worker that Spark starts beside the driver for this gets no shipped files: the processor's code goes with it.
    cloudpickle.register_pickle_by_value(strandline)
    try:
        return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", mode, None if initial is None else initial.groupBy(key))
    finally:
        cloudpickle.unregister_pickle_by_value(strandline)


def _key(column: str) -> Column:
    """A key that isn't null: pandas wouldn't keep the rows of a null one together."""
    return F.coalesce(F.concat(F.lit("k"), F.col(column).cast("string")), F.lit("")).alias("__key")


def _original(kind: str) -> Column:
    return F.when(F.col("__key") != "", F.expr("substr(__key, 2)").cast(kind))


class _Throttled(StatefulProcessor):
    """Lets rows of (order, progress, seconds, state, row) through; remembers the last that it did, and a job's end."""

    def __init__(self, min_progress: float, min_seconds: float, keep_ms: int | None):
        self.limits, self.keep_ms = (min_progress, min_seconds), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "progress double, at double", self.keep_ms)
        self.ended = handle.getValueState("ended", "state string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        throttle, done = Throttle(*self.limits), self.ended.exists()
        throttle.last = before = tuple(self.last.get()) if self.last.exists() else None
        frame = pd.concat(list(rows), ignore_index=True).sort_values("order", kind="stable")
        keep, end = [], None
        for p, t, state in zip(frame["progress"].tolist(), frame["seconds"].tolist(), frame["state"].tolist(), strict=True):
            keep.append(not done and (state in ENDED or throttle.passes(p, 0.0 if t is None or t != t else t)))
            if state in ENDED and not done:
                done, end = True, state
        if end is not None:
            self.ended.update((end,))
            self.last.clear()
        elif not done and throttle.last is not None and throttle.last != before:
            self.last.update(throttle.last)
        yield frame.loc[keep, ["row"]]

    def close(self) -> None:
        pass


def throttled(events: DataFrame, job: str, order: str, progress: str, seconds: str, state: str | None = None, min_progress: float = 1.0, min_seconds: float = 2.0, keep_seconds: float | None = JOB_SECONDS) -> DataFrame:
    """A stream's events that the throttle by job lets through.

    With ``state``, a column of job states, nothing comes after one that ends
    the job: its state is a tombstone from then on.  Tombstones and last values
    go ``keep_seconds`` after they were written; an event that is later than
    that is the first of its job again.  With None they stay, and the stream can
    end when there is nothing more (``availableNow``), as no clock runs.
    """
    # Whole rows pass as JSON: frames would make numbers of a column with nulls inexact.
    row = F.to_json(F.struct(*events.columns), _EXACT).alias("row")
    rows = events.select(_key(job), F.col(order).alias("order"), F.col(progress).cast("double").alias("progress"), F.col(seconds).cast("double").alias("seconds"), (F.col(state) if state else F.lit(None)).cast("string").alias("state"), row)
    processor = _Throttled(min_progress, min_seconds, None if keep_seconds is None else int(keep_seconds * 1000))
    kept = _stateful(rows, "__key", processor, "row string", "None" if keep_seconds is None else "ProcessingTime")
    return kept.select(F.from_json("row", events.schema, _EXACT).alias("r")).select("r.*")


class _Chained(StatefulProcessor):
    """Gives chunks of (chunk_index, json) in order, each with the one before it; those that come early wait."""

    def __init__(self, patience_ms: int | None, keep_ms: int | None):
        self.patience_ms, self.keep_ms = patience_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "index int, json string", self.keep_ms)
        self.waiting = handle.getMapState("waiting", "index int", "json string")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.done.get()[0] if self.done.exists() else 0
        out = []
        for frame in rows:
            for index, text in zip(frame["chunk_index"].tolist(), frame["json"].tolist(), strict=True):
                if index <= done:  # after the others went on without it
                    out.append((key[0], text, None))
                else:
                    self.waiting.updateValue((index,), (text,))
        yield self._in_order(key, out, None, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        least = min((k[0] for k in self.waiting.keys()), default=None)
        yield self._in_order(key, [], least, timerValues)

    def _in_order(self, key, out: list, skip_to: int | None, times) -> pd.DataFrame:
        """What can go on from the last given chunk, or from ``skip_to``; waits for the next as long as others wait."""
        done, before = self.done.get() if self.done.exists() else (0, None)
        index = done + 1 if skip_to is None else skip_to
        while self.waiting.exists() and self.waiting.containsKey((index,)):
            text = self.waiting.getValue((index,))[0]
            out.append((key[0], text, before))
            self.waiting.removeKey((index,))
            done, before, index = index, text, index + 1
        if done:
            self.done.update((done, before))
        left = next(iter(self.waiting.keys()), None) if self.waiting.exists() else None
        if self.timer.exists() and (left is None or out):
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if left is not None and self.patience_ms is not None and not self.timer.exists():
            at = times.getCurrentProcessingTimeInMs() + self.patience_ms
            self.handle.registerTimer(at)
            self.timer.update((at,))
        return pd.DataFrame(out, columns=["__key", "json", "before"])

    def close(self) -> None:
        pass


def chained(chunks: DataFrame, patience_seconds: float | None = PATIENCE_SECONDS, keep_seconds: float = RECORDING_SECONDS) -> DataFrame:
    """Each chunk of a stream with ``before``, the chunk with the index before its own in its recording, null for the first, 1.

    Chunks may come in any order: one that is early waits in the state for those
    before it, ``patience_seconds`` at most, after which the rest goes on without
    them.  One that comes after that has no ``before``.  The last chunk of a
    recording is forgotten after ``keep_seconds`` without another.  Without
    patience chunks wait, and the last ones are kept, as long as the stream's
    state is; no clock runs, so it can end when there is nothing more
    (``availableNow``).  Only this needs state; what chunks emit is columns over
    a pair.
    """
    columns = [c for c, _ in chunks.dtypes]
    rows = chunks.select(_key("recording_id"), "chunk_index", F.to_json(F.struct(*columns)).alias("json"))
    clock = patience_seconds is not None
    processor = _Chained(int(patience_seconds * 1000) if clock else None, int(keep_seconds * 1000) if clock else None)
    pairs = _stateful(rows, "__key", processor, "__key string, json string, before string", "ProcessingTime" if clock else "None")
    return pairs.select(F.from_json("json", CHUNK).alias("c"), F.from_json("before", CHUNK).alias("b"))


def emitted(chunks: DataFrame, overlap: float, patience_seconds: float | None = PATIENCE_SECONDS) -> DataFrame:
    """A stream of CHUNK rows as emitted segments: recording_id, chunk_index, reason, emit_idx, seg.

    Chunks may come in any order (see :func:`chained`).  The tail of a
    recording's last chunk comes if that chunk says it's the last.
    """
    pairs = chained(chunks, patience_seconds).withColumn("segments", F.coalesce("c.segments", F.array().cast(f"array<{SEGMENT}>")))
    nothing = F.slice("segments", 1, 0)
    held = F.when(F.col("b.chunk_index").isNotNull() & ~F.col("b.is_last"), tail(F.col("b.segments"), F.col("b.chunk_start"), F.col("b.chunk_end"), overlap)).otherwise(nothing)
    pairs = pairs.withColumn("held", F.coalesce(held if overlap > 0 else nothing, nothing))
    parts = emissions(F.col("held"), F.col("segments"), F.col("c.chunk_start"), F.col("c.chunk_end"), F.col("c.is_last"), overlap)
    flat = F.flatten(F.transform(parts, lambda p: F.transform(p["segments"], lambda s: F.struct(p["reason"].alias("reason"), s.alias("seg")))))
    out = pairs.select(F.col("c.recording_id").alias("recording_id"), F.col("c.chunk_index").alias("chunk_index"), F.posexplode(flat).alias("emit_idx", "x"))
    return out.select("recording_id", "chunk_index", F.col("x.reason").alias("reason"), F.col("emit_idx").cast("long").alias("emit_idx"), F.col("x.seg").alias("seg"))


def observed_once(segments: DataFrame, time: str, delay: str, *key: str) -> DataFrame:
    """A stream without repeats of a key within the watermark."""
    return segments.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


#: What a profile's entry holds.
_PROFILE = "centroid array<double>, seconds double, embeddings int, exemplars array<array<double>>"


class _Resolved(StatefulProcessor):
    """Labels of observed segments; a recording's profiles, labels and merges are entries of maps."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.profiles = handle.getMapState("profiles", "number int", _PROFILE)
        self.assigned = handle.getMapState("assigned", "chunk_index int, local_speaker string", "number int")
        self.merged = handle.getMapState("merged", "number int", "target int")
        self.numbers = handle.getValueState("numbers", "count int")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.to_dict("records"):
            number = None if row["number"] is None or row["number"] != row["number"] else int(row["number"])
            if row["kind"] == "profile":
                some = row["centroid"] is not None
                self.profiles.updateValue((number,), self._stored(Voice(row["centroid"], row["seconds"], int(row["embeddings"]), tuple(row["exemplars"])) if some else None))
            elif row["kind"] == "assigned":
                self.assigned.updateValue((int(row["chunk_index"]), row["local_speaker"]), (number,))
            elif row["kind"] == "merged":
                self.merged.updateValue((number,), (int(row["target"]),))
            else:
                self.numbers.update((number,))

    @staticmethod
    def _stored(voice: Voice | None) -> tuple:
        if voice is None:
            return (None, None, None, None)
        return ([float(x) for x in voice.centroid], float(voice.seconds), int(voice.count), [[float(x) for x in e] for e in voice.exemplars])

    def _known(self) -> Speakers:
        known = Speakers(self.settings)
        known.numbers = self.numbers.get()[0] if self.numbers.exists() else 0
        if known.numbers:
            for (number,), (centroid, seconds, count, exemplars) in self.profiles.iterator():
                known.profiles[number] = None if centroid is None else Voice(np.array(centroid), seconds, count, tuple(np.array(e) for e in exemplars))
            known.assigned = {(k[0], k[1]): v[0] for k, v in self.assigned.iterator()}
            known.merged = {k[0]: v[0] for k, v in self.merged.iterator()}
        return known

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        profiles, assigned, merged = dict(known.profiles), dict(known.assigned), dict(known.merged)
        frame = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        out = []
        for seq, chunk, local, seconds, vector in zip(*(frame[c].tolist() for c in ("seq", "chunk_index", "local_speaker", "seconds", "vector")), strict=True):
            label = None if local is None else known.label(chunk, local)
            unit = direction(vector) if seconds is not None and seconds == seconds and vector is not None else None
            if unit is not None:
                known.observe(chunk, local, unit, seconds)
            number = None if local is None else known.named(chunk, local)
            out.append((key[0], seq, chunk, local, label, label if number is None else speaker_id(number)))
        # Only what has changed is written.
        for number, voice in known.profiles.items():
            if number not in profiles or profiles[number] is not voice:
                self.profiles.updateValue((number,), self._stored(voice))
        for number in profiles.keys() - known.profiles.keys():
            self.profiles.removeKey((number,))
        for name, number in known.assigned.items():
            if assigned.get(name) != number:
                self.assigned.updateValue(name, (number,))
        for number, target in known.merged.items():
            if number not in merged:
                self.merged.updateValue((number,), (target,))
        if known.numbers:
            self.numbers.update((known.numbers,))
        yield pd.DataFrame(out, columns=["__key", "seq", "chunk_index", "local_speaker", "emitted_speaker", "speaker"])

    def close(self) -> None:
        pass


def speakers(segments: DataFrame, settings: Settings = Settings(), memory: DataFrame | None = None) -> DataFrame:
    """A stream of observed segments (see operators.speakers.observations) with the labels they are emitted with, and those known by then.

    ``recording_id``, ``seq``, ``chunk_index``, ``local_speaker``, ``seconds``,
    ``vector``.  With ``memory``, of operators.speakers.memory over what came
    before, the stream goes on from there.  Later merges can rename; a batch
    pass over all gives the final labels.
    """
    kind = dict(segments.dtypes)["recording_id"]
    rows = segments.select(_key("recording_id"), "seq", "chunk_index", "local_speaker", "seconds", "vector")
    initial = None if memory is None else memory.select(_key("recording_id"), *(c for c in memory.columns if c != "recording_id"))
    found = _stateful(rows, "__key", _Resolved(settings), ASSIGNED.format(kind=kind).replace(f"recording_id {kind}", "__key string"), "None", initial)
    return found.select(_original(kind).alias("recording_id"), *(c for c in found.columns if c != "__key"))


def profiles_of(spark: SparkSession, checkpoint: str, kind: str = "string") -> DataFrame:
    """PROFILES that a stream of :func:`speakers` has by now, read from its checkpoint while it runs."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "profiles").load()
    number = F.col("user_map_key.number")
    v = F.col("user_map_value")
    label = F.concat(F.lit("SPEAKER_"), F.when(number < 10, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string")))
    return state.select(
        F.when(F.col("key.__key") != "", F.expr("substr(key.__key, 2)").cast(kind)).alias("recording_id"), label.alias("speaker_id"), v["centroid"].alias("centroid"), F.coalesce(v["seconds"], F.lit(0.0)).alias("total_seconds"),
        F.coalesce(v["embeddings"], F.lit(0)).alias("embedding_count"), F.coalesce(v["exemplars"], F.array().cast("array<array<double>>")).alias("exemplars"),
    )


def heartbeats(events: DataFrame, job: str, state: str, seconds: float) -> DataFrame:
    """(job, n, state): a row every so many seconds from a job's first event until one ends it, whatever else comes in between.

    ``state`` is the last one known.  Without progress of their own, such rows
    always pass a throttle.
    """
    ship(events.sparkSession)
    kind, step = dict(events.dtypes)[job], int(seconds * 1000)

    def run(key, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.getCurrentProcessingTimeMs()
        n, due, last, done = held.get if held.exists else (0, now + step, None, False)
        if not held.hasTimedOut:
            seen = [s for frame in list(frames) for s in frame[state].tolist()]
            done = done or any(s in ENDED for s in seen)
            last = next((s for s in reversed(seen) if isinstance(s, str)), last)
        late = [] if done else list(range(due, now + 1, step))
        beats = len(late)
        held.update((n + beats, due + beats * step, last, done))
        if not done:
            held.setTimeoutDuration(max(1, due + beats * step - now))
        yield pd.DataFrame({job: [key[0]] * beats, "n": list(range(n + 1, n + beats + 1)), "state": [last] * beats})

    return events.groupBy(job).applyInPandasWithState(run, f"`{job}` {kind}, n long, state string", "n long, due long, last string, done boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
