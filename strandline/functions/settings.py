"""Settings held in rows: layers, typed reading, formats, redaction."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .text import stripped

#: Keys whose values are secrets, and the suffixes of content types.
SECRETS = ("huggingface_token", "token", "api_key", "apikey", "client_key")
SUFFIXES = {
    "audio/wav": ".wav", "audio/x-wav": ".wav", "audio/mpeg": ".mp3", "audio/mp3": ".mp3", "audio/mp4": ".m4a",
    "audio/m4a": ".m4a", "video/mp4": ".m4a", "audio/ogg": ".ogg", "application/ogg": ".ogg", "audio/flac": ".flac",
}
TRUE = ("1", "true", "yes", "y")


def layered(*values: Column) -> Column:
    """The first that is set: command line, configuration, environment, default; blank texts aren't."""
    return F.coalesce(*(F.nullif(stripped(v.cast("string")), F.lit("")) for v in values))


def overridden(base: str, job: str, fields: list[str]) -> Column:
    """The fields of a base struct, each replaced where the job's struct sets it."""
    return F.struct(*(F.coalesce(F.col(f"{job}.{f}"), F.col(f"{base}.{f}")).alias(f) for f in fields))


def as_bool(value: Column, default: bool = False) -> Column:
    """Texts are read as such: "false" is false."""
    return F.coalesce(F.lower(stripped(value.cast("string"))).isin(*TRUE), F.lit(default))


def as_int(value: Column, default: int | None = None) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(default).cast("int"))


def as_float(value: Column, default: float | None = None) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default).cast("double"))


def as_list(value: Column) -> Column:
    """Trimmed items of a comma-separated text, without blanks; null without any."""
    items = F.filter(F.transform(F.split(value, ","), lambda v: stripped(v)), lambda v: v != "")
    return F.when(F.size(items) > 0, items)


def as_member(value: Column, names: tuple[str, ...]) -> Column:
    """The name among ``names`` that a text gives in any case; null if none."""
    known = F.create_map(*(F.lit(x) for n in names for x in (n.lower(), n)))
    return F.try_element_at(known, F.lower(stripped(value.cast("string"))))


def as_names(value: Column) -> Column:
    """Languages and the like, from JSON: a text is a list of one, items are stripped, blanks go; null without any."""
    text = F.coalesce(F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), F.lit(0)), value)
    items = F.coalesce(F.from_json(F.when(F.ltrim(value).startswith("["), value), "array<string>"), F.array(text))
    kept = F.filter(F.transform(items, stripped), lambda v: F.coalesce(v, F.lit("")) != "")
    return F.when(F.size(kept) > 0, kept)


def suffix(filename: Column, content_type: Column) -> Column:
    """Of the file name if it has one, else of the content type, else ``.bin``."""
    base = F.regexp_extract(filename, r"([^/]*)$", 1)
    own = F.regexp_extract(base, r"^\.*[^.].*?(\.[^.]*)$", 1)
    known = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))
    return F.coalesce(F.nullif(own, F.lit("")), F.try_element_at(known, F.lower(stripped(content_type))), F.lit(".bin"))


def label(filename: Column, content_type: Column) -> Column:
    """A name for an input: its base name without a suffix, or ``payload``, and its suffix."""
    base = F.regexp_replace(F.regexp_extract(filename, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.concat(F.coalesce(F.nullif(base, F.lit("")), F.lit("payload")), suffix(filename, content_type))


def output_format(formats: Column) -> Column:
    """Text before docx before JSON lines before JSON."""
    return (
        F.when(F.arrays_overlap(formats, F.array(*(F.lit(x) for x in ("txt", "stdout", "stdout-nocolor")))), F.lit("text"))
        .when(F.array_contains(formats, "docx"), F.lit("docx"))
        .when(F.array_contains(formats, "jsonl"), F.lit("jsonl"))
        .otherwise(F.lit("json"))
    )


def _redacted(value):
    if isinstance(value, dict):
        return {k: "***" if k.lower() in SECRETS else _redacted(v) for k, v in value.items()}
    return [_redacted(v) for v in value] if isinstance(value, list) else value


@pandas_udf(StringType())
def redacted(texts: pd.Series) -> pd.Series:
    """JSON with secrets replaced at any depth; what isn't JSON is null."""

    def one(text):
        try:
            return None if text is None else json.dumps(_redacted(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return texts.map(one)
