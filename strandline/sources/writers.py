"""Sinks and output encoders of transcripts and status events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.segments import end_of, public_segment_speaker, start_of
from ..functions.text import stripped


def _public(annotated: Column) -> Column:
    return public_segment_speaker(F.col("speaker"), annotated)


def jsonl_lines(segments: DataFrame, annotated: Column, *keep: str) -> DataFrame:
    """``keep`` and ``line``: speaker, start, end, text of each segment as JSON; nulls are written."""
    row = F.struct(_public(annotated).alias("speaker"), start_of(F.col("start")).alias("start"), end_of(F.col("start"), F.col("end")).alias("end"), stripped(F.coalesce("text", F.lit(""))).alias("text"))
    return segments.select(*keep, F.to_json(row, {"ignoreNullFields": "false"}).alias("line"))


def json_documents(segments: DataFrame, annotated: Column, key: str, order: str) -> DataFrame:
    """``key`` and ``document``: the joined text and the public segments of each recording, as JSON.

    A segment keeps all its columns but the key and the order.
    """
    known = {"start": start_of(F.col("start")), "end": end_of(F.col("start"), F.col("end")), "text": F.coalesce("text", F.lit("")), "speaker": _public(annotated)}
    more = {c: F.col(c) for c in segments.columns if c not in (key, order, *known)}
    row = F.struct(F.col(order).alias("i"), F.struct(*(v.alias(c) for c, v in (known | more).items())).alias("s"))
    rows = segments.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["s"]).alias("segments"))
    text = stripped(F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    return rows.select(key, F.to_json(F.struct(text.alias("text"), F.col("segments")), {"ignoreNullFields": "false"}).alias("document"))


def text_lines(segments: DataFrame, annotated: Column, key: str, order: str) -> DataFrame:
    """key, order, ``lines``: a minute marker where the minute changes, and the segment's line unless its text is blank."""
    minute = F.floor(start_of(F.col("start")) / 60).cast("long")
    before = F.lag(minute).over(Window.partitionBy(key).orderBy(order))
    mark = F.when(before.isNull() | (before != minute), F.concat(F.lit("["), F.when(minute < 100, F.lpad(minute.cast("string"), 2, "0")).otherwise(minute.cast("string")), F.lit(":00]")))
    text = stripped(F.coalesce("text", F.lit("")))
    line = F.when(text != "", F.concat(F.lit("["), F.coalesce(_public(annotated), F.lit("SPEAKER")), F.lit("] "), text))
    return segments.select(key, order, F.concat_ws("\n", mark, line).alias("lines"))


def text_documents(segments: DataFrame, annotated: Column, key: str, order: str) -> DataFrame:
    """``key`` and ``document``: all lines of each recording."""
    rows = text_lines(segments, annotated, key, order).where("lines <> ''").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "lines"))).alias("x"))
    return rows.select(key, stripped(F.array_join(F.col("x.lines"), "\n")).alias("document"))


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    """A text file a task, one line a row."""
    lines.select(column).write.mode("overwrite").text(path)


def post_each(post: Callable[[list[dict]], None], rows: int = 500) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands rows to ``post`` on the executors, in groups."""

    def each(frame: DataFrame, _batch: int) -> None:
        def part(found) -> None:
            held: list[dict] = []
            for row in found:
                held.append(row.asDict(recursive=True))
                if len(held) >= rows:
                    post(held)
                    held = []
            if held:
                post(held)

        frame.foreachPartition(part)

    return each
