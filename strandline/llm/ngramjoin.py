"""N-gram Jaccard join: texts whose sets of five-word shingles overlap by 80 of 100, found by token-combination prefixes.

A partner of a set of n shingles has at least four fifths of them, so it lacks
``n // 5`` at most.  Shingles are rare or frequent (more than ``RARE`` texts have
them), and all sets are ordered alike: rare ones by hash, then frequent ones by
class and hash.  The prefix of a set is extended until no ``n // 5`` missing
shingles can spoil all its signatures: a rare shingle is a signature by itself,
and of frequent ones each two of a class are one, so l of a class stand for
l - 1.  Of two like sets, that whose prefix ends first has a signature with all
its shingles in the other's prefix, too; so none is missed.  What is indexed of
frequent passages is pairs of shingles that stand together in few other texts.
Prefixes of sets of ``EXTENDED`` shingles or more go on for ``SHARED - 1`` further
signatures, so that two of them have ``SHARED`` in common: texts that share less,
as one passage or line, are never compared.

Classes of frequent shingles are as many as make few pairs: a quarter of the
least size of the set's band (sizes of one bit length).  As like sets can be in
neighbouring bands, one near the top of its band has its pairs by the next one's
classes, too.  With four shingles or more there always is a signature left; of
fewer only equal sets are alike, and these are one class from the start.

Frequencies are counted over all texts, by cells of hashes in ranges that grow
with the corpus.  What is broadcast is the list of frequent cells, ``FREQUENT`` at
most: beyond it only the more frequent ones count as such.  Any division into
rare and frequent gives the same links.

Candidates are taken in rounds, as components are asked for.  First each member of a
signature is compared with one of its other members, its hub, that with most
candidates: in a group of near copies that is the text that they were made from,
or one like it.  Then members of one hub in different components are compared by
what sets them apart from it: with the shingles of the hub that two sets lack or
add to it, and those of these that they have in common, their overlap is known.
So the rest of a large group is settled within blocks of its members, by short
lists instead of whole sets, and what goes on is one link between components.
Last, pairs of a signature that are in different components and weren't compared
through a hub are compared by whole sets.  So no link between texts that aren't
joined goes untested, and a group's pairs aren't rows.

Sets and shingles are told by 64-bit hashes.  Nulls are empty texts; without
words, a text is linked with nothing.  Rows with a null id are documents like
others; a component that only such rows have is named null.  Rows that repeat
are linked.  An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import slices, text_or_empty, written
from .components import components
from .hubs import COMPARED, apart_from_hub, in_groups, through_hubs
from .nearcopies import SLICE, _sets_of, _similar, _stirred, shingles

#: Texts that have a rare shingle at most, and frequent cells that are broadcast at most.
RARE, FREQUENT = 64, 1 << 18
#: Text of a range of cells, shingles whose cells are sent at once, and members of a hub or signature that meet at once, of each of two groups.
RANGE_BYTES, CELLS, MEET = 32 << 20, 1 << 20, 1000
#: Signatures that similar sets have in common at least, if both have so many shingles; else one.
SHARED, EXTENDED = 4, 16
#: Least similarity, as parts of five.
_PARTS, _OF = 4, 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def lacking(n: np.ndarray) -> np.ndarray:
    """Shingles of a set of n that a partner lacks at most."""
    return n - (n * _PARTS + _OF - 1) // _OF


def _ordered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of distinct shingles, by row, then by hash in all its bits."""
    rows, found = shingles(texts)
    if ((rows[1:] == rows[:-1]) & (found[1:] < found[:-1])).any():
        order = np.lexsort((found, rows))
        rows, found = rows[order], found[order]
    return rows, found


def _cells(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text): (range, cells): sorted, with repeats; a cell is 32 bits of a hash after the ``width`` first, its range."""

    def sent(found: np.ndarray) -> pa.RecordBatch:
        cells = np.sort(found >> np.uint64(32 - width))
        at = cells >> np.uint64(32)
        head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        parts = np.split(cells.astype(np.uint32), head[1:])
        return pa.RecordBatch.from_arrays([pa.array(at[head].astype(np.int64)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["range", "cells"])

    held, size = [], 0
    for batch in batches:
        for _, texts in slices(batch.column(0), SLICE):
            held.append(_ordered(texts)[1])
            size += len(held[-1])
            if size >= CELLS:
                yield sent(np.concatenate(held))
                held, size = [], 0
    if size:
        yield sent(np.concatenate(held))


def _counted(rare: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (range, cells) sorted by range: (cell, n) of those that more than ``rare`` texts have."""

    def done(at: int, parts: list[bytes]) -> pa.RecordBatch:
        cells, n = np.unique(np.frombuffer(b"".join(parts), np.uint32), return_counts=True)
        some = n > rare
        return pa.RecordBatch.from_arrays([pa.array((np.int64(at) << np.int64(32)) | cells[some].astype(np.int64)), pa.array(n[some].astype(np.int64))], names=["cell", "n"])

    at, parts = None, []
    for batch in batches:
        for one, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if one != at and parts:
                yield done(at, parts)
                parts = []
            at = one
            parts.append(cells)
    if parts:
        yield done(at, parts)


def frequent_cells(texts: DataFrame, rare: int = RARE, most: int = FREQUENT) -> tuple[np.ndarray, int]:
    """The sorted cells of frequent shingles of ``texts`` (text), ``most`` at most, and the width of ranges."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = min(24, max(3, math.ceil(math.log2(max(1, size / RANGE_BYTES)))))
    sent = texts.mapInArrow(partial(_cells, width), "range long, cells binary")
    counted = written(sent.repartition("range").sortWithinPartitions("range").mapInArrow(partial(_counted, rare), "cell long, n long"), "frequent")
    # Few rows, whatever the corpus: counts to 4096, then by their bit length.
    level = F.when(F.col("n") <= 4096, F.col("n")).otherwise(F.pow(2.0, F.ceil(F.log2("n"))).cast("long"))
    cutoff, total = rare, 0
    for row in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += row["count"]
        if total > most:
            cutoff = row["level"]
            break
    cells = counted.where(level > cutoff).select("cell").toPandas()["cell"].to_numpy(np.int64)
    return np.sort(cells), width


def signatures(rows: np.ndarray, found: np.ndarray, n: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of sets: ``found`` by row and hash, ``n`` of each row, whether each is ``frequent``."""
    size = n[rows]
    need = lacking(n) + np.where(n >= EXTENDED, SHARED, 1)
    rare = ~frequent
    first = np.cumsum(n) - n
    before = np.cumsum(rare) - rare
    before -= np.repeat(before[np.minimum(first, len(rows) - 1)], n) if len(rows) else 0
    rare_in = np.bincount(rows[rare], minlength=len(n))
    taken = rare & (before < need[rows]) & (size >= _PARTS)
    out = [(rows[taken], _stirred(found[taken]))]
    # Sets whose rare shingles don't suffice go on with frequent ones, by the classes of their band, and of the next if partners can be in it.
    short = (rare_in < need) & (n >= _PARTS)
    at = np.flatnonzero(frequent & short[rows])
    band = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
    for above in (0, 1):
        some = at if not above else at[(n[rows[at]] * _OF // _PARTS) >= (2 << band[rows[at]])]
        if not len(some):
            continue
        row, token = rows[some], found[some]
        level = band[row] + above
        classes = np.maximum(1, (1 << level) // 4)
        kind = ((token >> np.uint64(20)) % classes.astype(np.uint64)).astype(np.int64)
        order = np.lexsort((token, kind, row))
        row, token, kind, level = row[order], token[order], kind[order], level[order]
        head = np.r_[True, (row[1:] != row[:-1]) | (kind[1:] != kind[:-1])]
        # What each stands for, summed in the order of its set, after the rare ones.
        counts = np.cumsum(~head)
        new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        width = np.diff(np.r_[new, len(row)])
        reached = rare_in[row] + counts - (~head) - np.repeat(counts[new] - (~head)[new], width)
        kept = reached < need[row]
        row, token, kind, level = row[kept], token[kept], kind[kept], level[kept]
        salt = _stirred(level.astype(np.uint64) + np.uint64(1))
        ahead = 1
        while True:
            same = (row[ahead:] == row[:-ahead]) & (kind[ahead:] == kind[:-ahead])
            if not same.any():
                break
            a, b = token[:-ahead][same], token[ahead:][same]
            out.append((row[ahead:][same], _stirred(_stirred(a * _ODD + b) ^ salt[ahead:][same])))
            ahead += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _signed(cells: np.ndarray, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, h, size, text): these without the text, key of the set, its size, and its signatures."""
    for batch in batches:
        for lo, texts in slices(batch.column(3), SLICE):
            rows, found = _ordered(texts)
            n = np.bincount(rows, minlength=len(texts)).astype(np.int64)
            ends = np.cumsum(n)
            sums = np.r_[np.zeros(1, np.uint64), np.cumsum(_stirred(found), dtype=np.uint64)]
            key = _stirred(sums[ends] - sums[ends - n] + n.astype(np.uint64) * _ODD)
            own = (found >> np.uint64(32 - width)).astype(np.int64)
            place = np.searchsorted(cells, own)
            frequent = cells[np.minimum(place, len(cells) - 1)] == own if len(cells) else np.zeros(len(own), bool)
            of, marks = signatures(rows, found, n, frequent)
            order = np.argsort(of, kind="stable")
            offsets = np.r_[0, np.cumsum(np.bincount(of, minlength=len(texts)))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(marks[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, len(texts)) for k in range(3)), pa.array(key.view(np.int64)), pa.array(n), lists], names=["doc_id", "h", "size", "key", "n", "marks"])


def _alike(a: Column, b: Column) -> Column:
    """Whether sets of such sizes can be similar enough."""
    return F.least(a, b) * _OF >= F.greatest(a, b) * _PARTS


_ENOUGH = f"n < {EXTENDED} OR shared >= {SHARED}"


def _hubs(live: DataFrame) -> DataFrame:
    """mark, hub, hub_n: of its members that with most candidates in all."""
    weights = live.groupBy("key").agg(F.sum("members").alias("weight"))
    best = live.join(weights, "key").groupBy("mark").agg(F.max(F.struct("weight", "key", "n")).alias("hub"))
    return best.select("mark", F.col("hub.key").alias("hub"), F.col("hub.n").alias("hub_n"))


def _others(live: DataFrame, hubs: DataFrame, compared: DataFrame, parts: DataFrame, meet: int) -> DataFrame:
    """(u, v): pairs of a signature whose components differ and that weren't compared through its hub."""
    through = compared.where("apart is not null").select("hub", "key", F.lit(True).alias("through"))
    rows = live.join(parts, "key", "left").select("mark", "key", "n", F.coalesce("component", "key").alias("part"))
    several = rows.groupBy("mark").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("members")).where("low < high").select("mark", "members")
    rows = rows.join(several, "mark").join(hubs.select("mark", "hub"), "mark").join(through, ["hub", "key"], "left").withColumn("through", F.coalesce("through", F.lit(False)))
    rows = written(rows.select("mark", "key", "n", "part", "members", "through"), "parts")
    # A signature whose members were all compared through the hub has no pairs left.
    left = rows.groupBy("mark").agg(F.min("through").alias("all")).where("not all").select("mark")
    rows = in_groups(rows.join(left, "mark"), "mark", "members", meet)
    one = rows.select("mark", "a", "b", "own", F.col("key").alias("u"), F.col("n").alias("un"), F.col("part").alias("up"), "through")
    two = rows.where("not through").select("mark", "a", "b", F.col("own").alias("vo"), F.col("key").alias("v"), F.col("n").alias("vn"), F.col("part").alias("vp"))
    # Of two that both weren't, one order is enough; across groups a pair is met in one place only.
    once = (F.col("through") | (F.col("u") < F.col("v"))) & ((F.col("a") == F.col("b")) | (F.col("own") != F.col("vo")))
    met = one.join(two, ["mark", "a", "b"]).where(once & (F.col("up") != F.col("vp")) & _alike(F.col("un"), F.col("vn")))
    met = met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.least("un", "vn").alias("n"))
    return met.groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared"), F.min("n").alias("n")).where(_ENOUGH).select("u", "v")


def joined(docs: DataFrame, rare: int = RARE, most: int = FREQUENT, meet: int = MEET) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the least doc_id reachable over links of similar texts."""
    ship(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    named = named.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("size"), "text")
    cells, width = frequent_cells(named.select("text"), rare, most)
    signed = named.mapInArrow(partial(_signed, cells, width), "doc_id long, h long, size long, key long, n long, marks array<long>")
    signed = written(signed.withColumn("row", F.monotonically_increasing_id()), "signed")

    first = F.min(F.struct("row", "doc_id", "h", "size", "n")).alias("t")
    classes = written(signed.where("n > 0").groupBy("key").agg(first, F.min("doc_id").alias("rep")), "classes")
    marked = signed.join(classes.select("t.row"), "row", "left_semi").select("key", "n", F.explode("marks").alias("mark"))
    shared = marked.groupBy("mark").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    live = written(marked.join(shared.hint("shuffle_hash"), "mark").select("mark", "key", "n", "members"), "live")

    hubs = written(_hubs(live), "hubs")
    stars = live.join(hubs, "mark").where((F.col("key") != F.col("hub")) & _alike(F.col("n"), F.col("hub_n"))).groupBy("hub", "key").agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("n", "hub_n")).alias("n")).where(_ENOUGH)
    stars = written(stars.select("hub", "key"), "stars")
    both = _sets_of(stars, ("hub", "key"), classes, named, "stars").select("hub", "key", "hub_set", "key_set")
    compared = written(both.mapInArrow(apart_from_hub, COMPARED), "compared")
    links = compared.where("similar").select(F.col("hub").alias("u"), F.col("key").alias("v"))

    named_part = lambda: components(links).select(F.col("node").alias("key"), "component")
    links = links.unionByName(written(through_hubs(compared, named_part(), meet), "through_hubs"))
    done = compared.select(F.least("hub", "key").alias("u"), F.greatest("hub", "key").alias("v"))
    others = written(_others(live, hubs, compared, named_part(), meet).join(done, ["u", "v"], "left_anti"), "others")
    similar = _sets_of(others, ("u", "v"), classes, named, "others").where(_similar("u_set", "v_set"))
    links = links.unionByName(written(similar.select("u", "v"), "links_of_others"))

    found = components(links)
    parts = classes.join(found, classes["key"] == found["node"], "left").select("key", F.coalesce("component", "key").alias("part"), "rep")
    named_parts = parts.join(parts.groupBy("part").agg(F.min("rep").alias("component_id")), "part").select("key", "component_id")
    out = signed.join(named_parts, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
