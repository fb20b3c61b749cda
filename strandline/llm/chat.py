"""Chat formatting with typed content parts.

A turn is ``<turn role>``, a line end, its content, ``</turn>`` and a line end.
A visitor flattens the parts of a turn: text is escaped, an image, an audio
clip or a document becomes a numbered placeholder, and what it refers to, where
it stands and how many tokens it expands to is recorded.  Escaping puts a
backslash before each backslash and ``<`` of a text (of a role, ``>`` too), so no text can
form a control string, and reading back undoes it exactly.

Conversations are formatted in streams ordered by turn: a task holds one turn
at a time, however long the conversation.  Nulls: a null text or role is empty,
rows with a null conv_id are one conversation, null turns come first; rows of
one turn are ordered by role and text.  A part of an unknown type gives nothing
but a note in ``errors``; sizes and times that aren't positive numbers count as
not given, and so do parts that are null.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import written

#: Fixed parts of the template.
OPEN, OPENED, CLOSE = "<turn ", ">\n", "</turn>\n"
#: Tokens that attachments expand to, unless their part says how large they are.
PATCH, IMAGE_TOKENS, AUDIO_TOKENS_A_SECOND, PAGE_TOKENS = 28, 256, 25, 512
#: Seconds of a clip at most: any number beyond is taken for that.
LONGEST = 1e12
#: The role whose text is learned.
LEARNED = "assistant"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENTS = "array<struct<ordinal:int,type:string,ref:string,offset:long,tokens:long>>"
FORMATTED = f"conv_id long, seq long, output string, loss array<struct<start:long,length:long>>, attachments {ATTACHMENTS}, expanded_tokens long, errors array<string>"

_SPECIAL, _SPECIAL_IN_ROLE = re.compile(r"[\\<]"), re.compile(r"[\\<>]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class PartVisitor:
    """Flattens the parts of one conversation's turns."""

    def __init__(self) -> None:
        self.ordinal = 0

    def turn(self, role: str, parts: list[dict]) -> tuple[str, list[dict], list[dict]]:
        """Output of a turn, spans of its learned text and its attachments; places count code points of the output.

        ``errors`` has what couldn't be read of it.
        """
        self.pieces, self.at, self.loss, self.attachments, self.errors = [], 0, [], [], []
        self.learned = role == LEARNED
        self._put(OPEN + _SPECIAL_IN_ROLE.sub(r"\\\g<0>", role) + OPENED)
        for part in parts:
            visit = getattr(self, f"visit_{part.get('type') or 'text'}", None) if part else None
            if visit is not None:
                visit(part)
            elif part:
                self.errors.append(f"unknown content part: {part['type']}")
        self._put(CLOSE)
        return "".join(self.pieces), self.loss, self.attachments

    def _put(self, text: str) -> None:
        self.pieces.append(text)
        self.at += len(text)

    def visit_text(self, part: dict) -> None:
        text = escape(part.get("text") or "")
        if self.learned and text:
            self.loss.append({"start": self.at, "length": len(text)})
        self._put(text)

    def _attach(self, part: dict, tokens: int) -> None:
        self.attachments.append({"ordinal": self.ordinal, "type": part["type"], "ref": part.get("ref"), "offset": self.at, "tokens": tokens})
        self._put(f"<{part['type']} {self.ordinal}>")
        self.ordinal += 1

    def visit_image(self, part: dict) -> None:
        wide, high = (part.get(k) or 0 for k in ("width", "height"))
        self._attach(part, -(-wide // PATCH) * -(-high // PATCH) if wide > 0 and high > 0 else IMAGE_TOKENS)

    def visit_audio(self, part: dict) -> None:
        seconds = part.get("seconds") or 0.0
        self._attach(part, max(1, round(min(seconds, LONGEST) * AUDIO_TOKENS_A_SECOND)) if 0 < seconds < math.inf else 1)

    def visit_document(self, part: dict) -> None:
        self._attach(part, max(1, part.get("pages") or 1) * PAGE_TOKENS)


_TURN = re.compile(r"<turn ((?:[^\\<>]++|\\.)*+)>\n((?:[^\\<]++|\\.|<(?:image|audio|document) \d+>)*+)</turn>\n", re.DOTALL)
_MARK = re.compile(r"((?:[^\\<]++|\\.)++)|<(image|audio|document) (\d+)>", re.DOTALL)


def parsed(output: str) -> Iterator[tuple[str, list[tuple[str, str | int]]]]:
    """(role, parts) of each turn in an output; a part is ("text", text) or (type, ordinal)."""
    at = 0
    while at < len(output):
        found = _TURN.match(output, at)
        if found is None:
            raise ValueError(f"not a turn at {at}")
        yield unescape(found[1]), [("text", unescape(m[1])) if m[1] else (m[2], int(m[3])) for m in _MARK.finditer(found[2])]
        at = found.end()


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, visitor, seq = object(), PartVisitor(), 0
    for batch in batches:
        out = {k: [] for k in ("conv_id", "seq", "output", "loss", "attachments", "expanded_tokens", "errors")}
        for conv, role, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != now:
                now, visitor, seq = conv, PartVisitor(), 0
            text, loss, attachments = visitor.turn(role or "", parts or [])
            for k, v in zip(out, (conv, seq, text, loss, attachments, sum(a["tokens"] for a in attachments), visitor.errors), strict=True):
                out[k].append(v)
            seq += 1
        yield pa.RecordBatch.from_pydict(out, schema=_FORMATTED)


_FORMATTED = pa.schema([
    ("conv_id", pa.int64()), ("seq", pa.int64()), ("output", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
    ("attachments", pa.list_(pa.struct([("ordinal", pa.int32()), ("type", pa.string()), ("ref", pa.string()), ("offset", pa.int64()), ("tokens", pa.int64())]))),
    ("expanded_tokens", pa.int64()), ("errors", pa.list_(pa.string())),
])


def formatted(conversations: DataFrame) -> DataFrame:
    """One row a turn: conv_id, seq (from 0), output, loss (spans in it), attachments, expanded_tokens, errors.

    ``conversations`` has conv_id, turn, role and text, or instead of text
    ``parts``, an array of PART.
    """
    ship(conversations.sparkSession)
    parts = F.col("parts") if "parts" in conversations.columns else F.array(F.struct(F.lit("text").alias("type"), F.col("text").cast("string").alias("text")))
    tie = F.to_json("parts") if "parts" in conversations.columns else F.col("text").cast("string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), tie.alias("tie"), parts.alias("parts"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "tie")
    return rows.select("conv_id", "role", "parts").mapInArrow(_format, FORMATTED)


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, output: str, loss: list[dict]) -> None:
        for role, parts in parsed(output):
            self.n_turns += 1
            self.turns.update(f"{role}\n{''.join(p[1] if p[0] == 'text' else f'<{p[0]} {p[1]}>' for p in parts)}\n".encode())
        for span in loss:
            text = unescape(output[span["start"] : span["start"] + span["length"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.chars += len(output)

    def row(self, conv) -> list:
        return [conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars]


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in DIGESTS.split(", ")])
    now, digest = object(), None
    for batch in batches:
        done = []
        for conv, output, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if digest is None or conv != now:
                if digest is not None:
                    done.append(digest.row(now))
                now, digest = conv, _Digest()
            digest.add(output, loss or [])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True) if done else [[]] * 6, schema, strict=True)], schema=schema)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(digest.row(now), schema, strict=True)], schema=schema)


def digests(outputs: DataFrame) -> DataFrame:
    """Per conversation, read back from formatted turns: DIGESTS."""
    ship(outputs.sparkSession)
    rows = outputs.select("conv_id", "seq", "output", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return rows.select("conv_id", "output", "loss").mapInArrow(_read, DIGESTS)


def round_trip(conversations: DataFrame) -> DataFrame:
    """Formats, writes the output and reads it back: :func:`digests`."""
    return digests(written(formatted(conversations), "chat"))
