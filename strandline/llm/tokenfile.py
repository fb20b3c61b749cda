"""Token ids in files, compressed by Re-Pair grammars.

Documents are ranged by id, tokenised and laid out in blocks of about
``BLOCK_IDS`` ids.  In each block frequent pairs of ids are replaced by new
symbols, again and again: a round counts the pairs, takes those that occur
often, most frequent first, as long as no symbol begins one and ends another
(so that none overlap), and replaces all at once.  A block is a row of a
Parquet table: rules, the number of ids each rule expands to, the shortened
sequence, marks (the ids before every ``MARK``-th symbol), and the documents'
ids and lengths.  Marks and expansion lengths give the place of any id without
decoding what lies before it.

A block ends with a document, but never has more than twice ``BLOCK_IDS`` ids:
a document that doesn't fit goes on in the next block, and such blocks are
marked as ``cut``.  ``first_doc`` numbers a part's documents.

Nulls: a null text is empty and gives the end id alone; null ids come first.
Rows that repeat an id stand side by side, in the order of their texts' hashes.
An empty table gives an empty file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..shipping import ship
from .common import slices, text_or_empty, written
from .tokens import encoder, spread

END = 2
#: Ids of a block, after which it ends with the document.
BLOCK_IDS = 1 << 20
#: A pair is frequent if it occurs so often; a round that shortens less is the last; bits of a place in the table of pairs, at most.
FREQUENT, LEAST_GAIN, PLACES = 24, 0.002, 20
#: Symbols between two places whose number of ids before is stored.
MARK = 1024
FILE = "part int, block int, n_docs long, n_ids long, n_symbols long, doc_ids binary, doc_nulls binary, doc_lengths binary, terminals long, rules binary, rule_lengths binary, sequence binary, marks binary, first_doc long, cut boolean"
_FILE = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}[t]) for n, t in (f.split() for f in FILE.split(", "))])

_MIX, _HALF, _LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(32), np.uint64(0xFFFFFFFF)


@dataclass
class Grammar:
    """``sequence`` over terminals below ``terminals`` and rules (pairs of earlier symbols) from there on."""

    terminals: int
    rules: np.ndarray
    sequence: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        """Number of ids that each rule expands to."""
        out = np.ones(len(self.rules), np.int64)
        for lo, hi in self._layers():
            out[lo:hi] = self._sizes(self.rules[lo:hi, 0], out) + self._sizes(self.rules[lo:hi, 1], out)
        return out

    def _sizes(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        at = symbols.astype(np.int64) - self.terminals
        return np.where(at >= 0, lengths[at.clip(0)] if len(lengths) else 1, 1)

    def _layers(self) -> Iterator[tuple[int, int]]:
        """Runs of rules that use only symbols from before the run."""
        lo = 0
        top = self.rules.max(axis=1, initial=0).astype(np.int64) - self.terminals if len(self.rules) else np.zeros(0, np.int64)
        while lo < len(self.rules):
            inner = np.flatnonzero(top[lo:] >= lo)
            hi = lo + int(inner[0]) if len(inner) else len(self.rules)
            yield lo, hi
            lo = hi

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All rules' ids, one rule after another, and where each begins and how many it has.

        The rules of a round stand for parts of the sequence that don't overlap,
        each several times, so a round adds less than the sequence has.
        """
        counts = self.lengths
        starts = np.cumsum(counts) - counts
        flat = np.zeros(0, np.uint32)
        for lo, hi in self._layers():
            flat = np.r_[flat, self._ids(self.rules[lo:hi].reshape(-1), flat, starts, counts)]
        return flat, starts, counts

    def _ids(self, symbols: np.ndarray, flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = symbols.astype(np.int64) - self.terminals
        rule = at >= 0
        if not rule.any():
            return symbols
        at = np.where(rule, at, 0)
        return spread(np.r_[flat, symbols], np.where(rule, starts[at], len(flat) + np.arange(len(symbols))), np.where(rule, counts[at], 1))

    def expanded(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a run of symbols; only the rules that these reach are looked at, layer by layer."""
        symbols = symbols.astype(np.uint32)
        while len(at := np.flatnonzero(symbols >= self.terminals)):
            pairs = self.rules[symbols[at] - np.uint32(self.terminals)]
            places = at + np.arange(len(at))  # each rule before one has added a symbol
            twice = np.ones(len(symbols), np.int64)
            twice[at] = 2
            symbols = np.repeat(symbols, twice)
            symbols[places], symbols[places + 1] = pairs[:, 0], pairs[:, 1]
        return symbols

    def marks(self, lengths: np.ndarray) -> np.ndarray:
        """Ids before every ``MARK``-th symbol of the sequence."""
        sizes = self._sizes(self.sequence, lengths)
        return (np.cumsum(sizes) - sizes)[::MARK]

    def decoded(self, start: int = 0, stop: int | None = None, lengths: np.ndarray | None = None, marks: np.ndarray | None = None) -> np.ndarray:
        """Ids from start to stop.

        With ``lengths`` and ``marks``, as a file holds them, only the symbols
        that hold some of these ids, and some ``MARK`` at both ends, are read.
        """
        if start == 0 and stop is None:
            return self._ids(self.sequence, *self._table())
        lengths = self.lengths if lengths is None else lengths
        marks = self.marks(lengths) if marks is None else marks
        lo = MARK * max(int(np.searchsorted(marks, start, "right")) - 1, 0)
        hi = len(self.sequence) if stop is None else MARK * int(np.searchsorted(marks, stop, "left"))
        ends = (int(marks[lo // MARK]) if len(marks) else 0) + np.cumsum(self._sizes(self.sequence[lo:hi], lengths))
        if not len(ends):
            return np.zeros(0, np.uint32)
        stop = int(ends[-1]) if stop is None else stop
        first, last = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[first - 1]) if first else (int(marks[lo // MARK]) if len(marks) else 0)
        return self.expanded(self.sequence[lo + first : lo + last])[start - before : stop - before]


def _pairs(keys: np.ndarray, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs, how often each occurs, and the occurrences' places with the index of the pair: all that occur ``frequent`` times, exactly.

    A table place that is met less often holds no such pair.  Of the pairs that
    share another place one is shown there and counted by it; the others are sorted.
    """
    bits = min(max(len(keys).bit_length(), 1), PLACES)
    mixed = ((keys * _MIX) >> np.uint64(64 - bits)).view(np.int64)
    places = np.flatnonzero((np.bincount(mixed, minlength=1 << bits) >= frequent)[mixed])
    mixed, keys = mixed[places], keys[places]
    shown = np.zeros(1 << bits, np.uint64)
    shown[mixed] = keys
    hidden = np.flatnonzero(shown[mixed] != keys)
    others, index, times = np.unique(keys[hidden], return_inverse=True, return_counts=True)
    mixed[hidden] = (1 << bits) + index
    return np.r_[shown, others], np.bincount(mixed, minlength=(1 << bits) + len(others)), places, mixed


def re_pair(ids: np.ndarray, frequent: int = FREQUENT, least_gain: float = LEAST_GAIN) -> Grammar:
    """A grammar for 32-bit ids: rounds go on until no pair is frequent, or one shortens the sequence by less than ``least_gain``."""
    terminals = int(ids.max()) + 1 if len(ids) else 0
    symbols, rules, count = ids.astype(np.uint32), [np.zeros((0, 2), np.uint32)], 0
    # Where a pair begins that may be frequent. One that isn't never will be, as replacing others makes no more of it.
    live = np.arange(len(symbols) - 1)
    while len(live):
        keys = (symbols[live].astype(np.uint64) << _HALF) | symbols[live + 1]
        pairs, times, places, mixed = _pairs(keys, frequent)
        places = live[places]
        candidates = np.flatnonzero(times >= frequent)
        candidates = candidates[np.argsort(-times[candidates], kind="stable")]
        first, last, taken = set(), set(), []
        for i, a, b in zip(candidates.tolist(), (pairs[candidates] >> _HALF).tolist(), (pairs[candidates] & _LOW).tolist(), strict=True):
            if a in last or b in first or (a == b and (a in first or a in last)):
                continue
            first.add(a)
            last.add(b)
            taken.append(i)
        if not taken:
            break
        new = np.zeros(len(pairs), np.uint32)
        new[taken] = terminals + count + np.arange(len(taken), dtype=np.uint32)
        named, still = new[mixed], np.zeros(len(symbols), bool)
        still[places[np.flatnonzero(times[mixed] >= frequent)]] = True
        some = np.flatnonzero(named)
        places, named = places[some], named[some]
        # Only a pair of equal symbols can overlap itself: of a run of places every other one holds.
        run = np.r_[True, np.diff(places) != 1]
        begin = np.maximum.accumulate(np.where(run, np.arange(len(places)), 0))
        hold = (np.arange(len(places)) - begin) % 2 == 0
        places, named = places[hold], named[hold]
        rules.append(np.stack([pairs[taken] >> _HALF, pairs[taken] & _LOW], axis=1).astype(np.uint32))
        count += len(taken)
        symbols[places] = named
        keep = np.ones(len(symbols), bool)
        keep[places + 1] = False
        # Pairs with a new symbol; before it stands the symbol one place ahead, or another new one.
        still[places] = still[np.maximum(places, 1) - 1] = True
        gain = len(places) / len(symbols)
        kept = np.flatnonzero(keep)
        symbols, live = symbols[kept], np.flatnonzero(still[kept])
        live = live[live < len(symbols) - 1]
        if gain < least_gain:
            break
    return Grammar(terminals, np.concatenate(rules), symbols)


def _encode(path: str, spaces: bool, end: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, block, first = encoder(path, spaces), TaskContext.get().partitionId(), 0, 0
        docs: list = []
        arrays: list[np.ndarray] = []
        held, cut = 0, False

        def closed() -> pa.RecordBatch:
            grammar = re_pair(np.concatenate(arrays))
            lengths = grammar.lengths
            names = np.array([d or 0 for d in docs], "<i8")
            row = [part, block, len(docs), held, len(grammar.sequence), names.tobytes(), np.packbits([d is None for d in docs]).tobytes(), np.array([len(a) for a in arrays], "<u4").tobytes(), grammar.terminals, grammar.rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), grammar.sequence.astype("<u4").tobytes(), grammar.marks(lengths).astype("<u4").tobytes(), first, cut]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _FILE, strict=True)], schema=_FILE)

        for batch in batches:
            for lo, texts in slices(batch.column(1)):
                for doc_id, ids in zip(batch.column(0).slice(lo, len(texts)).to_pylist(), coder.encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(end))
                    while len(ids):
                        piece, ids = ids[: 2 * block_ids - held], ids[2 * block_ids - held :]
                        docs.append(doc_id)
                        arrays.append(piece)
                        held, cut = held + len(piece), cut or len(ids) > 0
                        if held >= block_ids:
                            yield closed()
                            # A document that goes on is the first of the next block, under its number.
                            first, block, cut = first + len(docs) - (len(ids) > 0), block + 1, len(ids) > 0
                            docs, arrays, held = [], [], 0
        if docs:
            yield closed()

    return run


def stored(docs: DataFrame, path: str, spaces: bool = False, end: int = END, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The written file table, FILE, of all documents in ascending doc_id order."""
    ship(docs.sparkSession)
    # Ranges divide the rows of an id by their texts, and equal rows, which any order suits, by where they were read.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("at"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("at")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.select("doc_id", "text").mapInArrow(_encode(path, spaces, end, block_ids), FILE), "tokens", compression="zstd")


def grammar_of(row: dict) -> Grammar:
    """Of one row of the file table."""
    return Grammar(row["terminals"], np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["sequence"], "<u4"))


def document_ids(row: dict, nth: int) -> np.ndarray:
    """Ids of the nth document of a block, or of the part of it that the block holds, decoding no other."""
    ends = np.cumsum(np.frombuffer(row["doc_lengths"], "<u4").astype(np.int64))
    return grammar_of(row).decoded(int(ends[nth - 1]) if nth else 0, int(ends[nth]), np.frombuffer(row["rule_lengths"], "<u4"), np.frombuffer(row["marks"], "<u4"))


READ = "part int, block int, nth long, cut boolean, doc_id long, local long, n_tokens long, ids_crc32 long"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = grammar_of(row).decoded().astype("<u4")
            lengths = np.frombuffer(row["doc_lengths"], "<u4").astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            sums = [zlib.crc32(ids[a : a + n]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
            null = np.unpackbits(np.frombuffer(row["doc_nulls"], np.uint8), count=len(lengths)).astype(bool)
            same = [pa.array(np.full(len(lengths), row[k], np.int32)) for k in ("part", "block")]
            nth = pa.array(row["first_doc"] + np.arange(len(lengths)))
            # In a block with a cut, either end may be a part of a document.
            ends = row["cut"] & ((np.arange(len(lengths)) == 0) | (np.arange(len(lengths)) == len(lengths) - 1))
            names = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=null)
            yield pa.RecordBatch.from_arrays([*same, nth, pa.array(ends), names, pa.array(starts), pa.array(lengths), pa.array(sums, pa.int64())], names=[f.split()[0] for f in READ.split(", ")])


def _joined_crc32(parts):
    """Checksum of ids, given (start, n, checksum) of their parts in order: zeros move the sum before over the part's bytes."""
    total = 0
    for _, n, own in parts:
        zeros = bytes(4 * n)
        total = own ^ zlib.crc32(zeros, total) ^ zlib.crc32(zeros)
    return total


def read_back(file: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of each document, decoded from the file table.

    A document that is cut is joined from its blocks' parts, each a number and a checksum.
    """
    ship(file.sparkSession)
    parts = file.groupBy("part").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    parts = parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = file.select("part", "block", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("block_start")).join(parts, "part")

    def placed(rows: DataFrame) -> DataFrame:
        return rows.join(blocks, ["part", "block"]).withColumn("start", F.col("part_start") + F.col("block_start") + F.col("local"))

    whole = placed(file.mapInArrow(_decode, READ).where("not cut")).select("doc_id", "start", "n_tokens", "ids_crc32")
    pieces = placed(file.where("cut").mapInArrow(_decode, READ).where("cut")).groupBy("part", "nth")
    joined = pieces.agg(F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "n_tokens", "ids_crc32"))).alias("parts"))
    return whole.unionByName(joined.select("doc_id", "start", "n_tokens", F.udf(_joined_crc32, LongType())("parts").alias("ids_crc32")))
