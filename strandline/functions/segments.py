"""Rules on time-stamped, speaker-labelled segments, as columns.

A segment is a struct (start, end, text, speaker); a null start is 0 and a null
end is the start.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, normalized, similarity_of_normalized, stripped

#: Fixed values of the alignment score.
LEAST_EVIDENCE, TEXT_WEIGHT, TIME_WEIGHT, SPEAKER_BONUS = 0.45, 0.7, 0.3, 0.15
#: Shortest duration that counts.
SHORTEST = 0.001
#: Fixed value: labels that name no speaker.
NO_SPEAKER = ("unknown", "unk", "noise", "[noise]", "silence", "[silence]", "null", "none")


def start_of(start: Column) -> Column:
    return F.coalesce(start, F.lit(0.0))


def end_of(start: Column, end: Column) -> Column:
    return F.coalesce(end, start_of(start))


def midpoint(start: Column, end: Column) -> Column:
    return (start_of(start) + end_of(start, end)) / 2.0


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Seconds in both, at least 0."""
    return F.greatest(F.lit(0.0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def overlap_ratio(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Seconds in both, by the longer duration."""
    start_a, end_a, start_b, end_b = start_of(start_a), end_of(start_a, end_a), start_of(start_b), end_of(start_b, end_b)
    longer = F.greatest(F.lit(SHORTEST), end_a - start_a, end_b - start_b)
    return overlap(start_a, end_a, start_b, end_b) / longer


def edge_confidence(start: Column, end: Column, overlap_start: Column, overlap_end: Column, previous: bool) -> Column:
    """How far a segment's middle is inside the window, from the edge where its chunk ends (previous) or begins."""
    inside = overlap_end - midpoint(start, end) if previous else midpoint(start, end) - overlap_start
    return F.greatest(F.lit(0.0), inside)


def resolved_speaker(label: Column) -> Column:
    """SPEAKER_n in upper case, or null."""
    return F.when(stripped(label).rlike(r"(?i)\ASPEAKER_\d+\z"), F.upper(stripped(label)))


def public_speaker(label: Column) -> Column:
    """The number in SPEAKER_n or in a plain number, without leading zeros; else null."""
    digits = F.regexp_extract(F.upper(stripped(label)), r"\A(?:SPEAKER_)?(\d+)\z", 1)
    return F.when(digits != "", F.regexp_replace(digits, r"^0+(?=.)", ""))


def public_segment_speaker(label: Column, annotated: Column) -> Column:
    """Of a segment that a chunk annotated, only SPEAKER_n is public."""
    return F.when(~annotated | stripped(label).rlike(r"(?i)\ASPEAKER_\d+\z"), public_speaker(label))


def local_label(label: Column) -> Column:
    """A trimmed label, or null if it names no speaker."""
    return F.when((stripped(label) != "") & ~F.lower(stripped(label)).isin(*NO_SPEAKER), stripped(label))


def score_from(text_score: Column, time_score: Column, speaker_a: Column, speaker_b: Column) -> Column:
    """Alignment score from its parts; speakers are resolved ones."""
    both = speaker_a.isNotNull() & speaker_b.isNotNull()
    weighted = text_score * TEXT_WEIGHT + time_score * TIME_WEIGHT
    return (
        F.when((text_score < LEAST_EVIDENCE) & (time_score < LEAST_EVIDENCE), F.lit(0.0))
        .when(both & (speaker_a != speaker_b), F.lit(0.0))
        .otherwise(F.least(F.lit(1.0), weighted + F.when(both, F.lit(SPEAKER_BONUS)).otherwise(F.lit(0.0))))
    )


def prepared(segments: Column) -> Column:
    """Segments with what scores need, computed once each: s, e, norm, spk, and ix, the place from 0."""

    def one(x: Column, i: Column) -> Column:
        return F.struct(
            start_of(x["start"]).alias("s"), end_of(x["start"], x["end"]).alias("e"), normalized(x["text"]).alias("norm"),
            resolved_speaker(x["speaker"]).alias("spk"), i.cast("int").alias("ix"), x.alias("seg"),
        )

    return F.transform(segments, one)


def score(a: Column, b: Column) -> Column:
    """Alignment score of two prepared segments.

    Edit distance is what costs, so it's computed only if it can matter: not
    between different speakers, nor where texts of so different lengths can't be
    alike enough and the times aren't.
    """
    conflict = a["spk"].isNotNull() & b["spk"].isNotNull() & (a["spk"] != b["spk"])
    shorter, longer = F.least(F.length(a["norm"]), F.length(b["norm"])), F.greatest(F.length(a["norm"]), F.length(b["norm"]))
    apart = overlap_ratio(a["s"], a["e"], b["s"], b["e"]) < LEAST_EVIDENCE
    parts = F.struct(similarity_of_normalized(a["norm"], b["norm"]).alias("text"), overlap_ratio(a["s"], a["e"], b["s"], b["e"]).alias("time"))
    full = let(parts, lambda p: score_from(p["text"], p["time"], a["spk"], b["spk"]))
    return F.when(conflict | (apart & (shorter < longer * LEAST_EVIDENCE)), F.lit(0.0)).otherwise(full)


def percent(end: Column, finish: Column) -> Column:
    """Part of the whole in percent, within 0 and 100, with one decimal; null without a whole.

    Tenths are rounded, as SQL engines do: 0.45 that came out as 0.44999999999999996 is 0.5.
    """
    part = F.greatest(F.lit(0.0), F.least(F.lit(100.0), end / finish * 100.0))
    return F.when(finish > 0, F.round(part * 10.0) / 10.0)


def status_payload(start: Column, end: Column, text: Column, speaker: Column, annotated: Column, finish: Column) -> Column:
    """Progress and utterance of a segment as a status update."""
    stop = end_of(start, end)
    return F.struct(
        F.lit("transcribing").alias("phase"),
        F.struct(F.round(stop, 2).alias("current"), F.round(finish, 2).alias("finish"), F.lit("seconds").alias("units"), percent(stop, finish).alias("percent")).alias("progress"),
        F.struct(stripped(F.coalesce(text, F.lit(""))).alias("text"), public_segment_speaker(speaker, annotated).alias("speaker"), F.round(start_of(start), 2).alias("start"), F.round(stop, 2).alias("end")).alias("utterance"),
    )


def time_bounds(rows: Column) -> Column:
    """(start of the first segment, end of the last), by place; zeros for an empty list."""
    first, last = F.get(rows, F.lit(0)), F.try_element_at(rows, F.lit(-1))
    return F.struct(F.coalesce(first["start"], F.lit(0.0)).alias("start"), F.coalesce(last["end"], last["start"], F.lit(0.0)).alias("end"))


def summary(name: str, rows: Column, most: int = 5, width: int = 96) -> Column:
    """A list of segments in one line for logs: the first few, shortened, and how many more."""

    def one(s: Column) -> Column:
        text = F.trim(F.regexp_replace(F.coalesce(s["text"], F.lit("")), r"(?U)[\s\x1c-\x1f]+", " "))
        short = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)
        times = F.format_string("%.2f-%.2f", start_of(s["start"]), end_of(s["start"], s["end"]))
        return F.concat(times, F.lit(" "), F.coalesce(s["speaker"], F.lit("-")), F.lit(" "), short)

    more = F.when(F.size(rows) > most, F.concat(F.lit(", and "), (F.size(rows) - most).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return F.concat(F.lit(f"{name}["), F.size(rows).cast("string"), F.lit("]: "), F.array_join(F.transform(F.slice(rows, 1, most), one), ", "), more)
