"""Near copies by SimHash: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

At that similarity fingerprints differ in some 15 % of their bits, too many to
divide 64 bits by.  So fingerprints are ``64 * WORDS`` bits wide here, of which
the first ``64 * TREE_WORDS`` divide and make the trees: a shard is the
fingerprints with one value of a block of ``b`` of these bits.  A pair at the least similarity agrees on a block with a probability of
``AGREE ** b``; there are as many blocks as leave it apart in all of them with a
probability of ``MISSED`` at most.  ``b`` follows from the number of distinct
sets, so that unlike sets make shards of about ``SHARD_SETS``, and the search
costs much less than the square of the corpus.  In each shard a BK-tree search
follows the edges within ``TREE_RADIUS``; what it proposes must be within
``RADIUS`` in all bits and is confirmed by the exact similarity of the sets of
the whole texts.  So no unlike texts are joined, and the part of
like ones that is missed is measured in the tests and in the README.

Candidates are taken in two rounds.  In the first a member proposes all it
finds if these are ``FEW``; in a crowd, only the one of its finds that has most
finds itself, its hub, which in a group of near copies is the text that they were
made from, or the nearest to it.  Members that have one hub in the end, that which
most name of those that each has, are settled through it (``hubs``): exactly, and
without a row a pair.  In the second round only crowds search again, for
all pairs within the radius that have no common hub and that components don't join
already, and those of a crowd's main component needn't ask.  So a large group
costs little more than its members, and no pair that was found goes untested
unless it is joined.  Equal sets are one class from the start.  A shard beyond
``SLICE_ROWS`` is a crowd; it is cut into slices with a tree each, and its
queries go to all slices.

Sets and their classes are told by 64-bit hashes.  Fewer words than five are one
shingle; texts without words are copies of each other.  Nulls count as empty
texts.  Rows with a null id are documents like others, and come last where one
of several stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType

from ..shipping import ship
from .common import coded, slices, text_or_empty, written
from .components import components
from .hubs import COMPARED, apart_from_hub, through_hubs
from .simhash import Forest

SHINGLE = 5
#: 64-bit words of a fingerprint, and of the part in trees; bits that candidates differ in at most, in all and in that part.
WORDS, TREE_WORDS, RADIUS, TREE_RADIUS = 16, 4, 190, 56
#: Probability that a bit agrees at a similarity of 0.8 (cosine 8/9); that such a pair shares no block; unlike sets of a shard.
AGREE, MISSED, SHARD_SETS = 0.848, 0.0005, 256
#: Members of a tree at most; finds of a member that is in no crowd at most; finds of a shard that are held, and else searched for twice; members of a hub that meet at once, of each of two groups.
SLICE_ROWS, FEW, HELD, MEET = 50_000, 8, 2_000_000, 1000
#: Bytes of text that are shingled at once.
SLICE = 2 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Makes a shingle's hash another one for each word of a fingerprint.
_SALTS = np.arange(1, WORDS + 1, dtype=np.uint64) * _ODD
_PLACE = np.uint64(0xD6E8FEB86659FD93)
_LANES = np.uint64(0x0101010101010101)
SIGNED = "doc_id long, h long, size long, key long, n long, code binary"
SHARDED = "shard long, key long, n long, code binary"


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _hashed(pieces: pa.Array) -> np.ndarray:
    """64-bit hash of each distinct piece: the sum of a random word for each byte in its place."""
    pieces = pieces.cast(pa.large_string())
    ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    starts, width = ends[:-1] - ends[0], np.diff(ends)
    place = np.arange(len(data)) - np.repeat(starts, width)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(_stirred((data + np.uint64(1)) * _ODD + place.astype(np.uint64) * _PLACE), dtype=np.uint64)]
    return _stirred(sums[starts + width] - sums[starts] + width.astype(np.uint64))


def _in_order(rows: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Order by row, then by hash, as far as 44 bits of it tell."""
    return np.argsort(rows.astype(np.uint64) << np.uint64(44) | found >> np.uint64(20))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, in that order; 2**20 texts at most."""
    rows, codes, pieces = coded(pc.ascii_lower(pc.fill_null(texts, "")), whitespace=True)
    if not len(rows):
        return rows, np.zeros(0, np.uint64)
    of = _hashed(pieces)[codes]
    first = np.r_[True, rows[1:] != rows[:-1]]
    starts = np.flatnonzero(first)
    ends = np.r_[starts[1:], len(rows)]
    left = np.repeat(ends, ends - starts) - np.arange(len(rows))
    found = np.zeros(len(rows), np.uint64)
    for k in range(SHINGLE):
        later = np.r_[of[k:], np.zeros(min(k, len(of)), np.uint64)]
        found = np.where(left > k, _stirred(found * _ODD + later), found)
    whole = (left >= SHINGLE) | first
    rows, found = rows[whole], found[whole]
    order = _in_order(rows, found)
    rows, found = rows[order], found[order]
    new = np.r_[True, (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])]
    return rows[new], found[new]


def fingerprints(found: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of WORDS words for each set: ``n`` hashes of ``found`` each, one after another.

    Eight bits are counted at once, a byte each, over runs of at most 255 hashes.
    """
    out = np.zeros((len(n), WORDS), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    runs = -(-n[some] // 255)
    first_run = np.cumsum(runs) - runs
    start = np.cumsum(n)[some] - n[some]
    at = np.repeat(start, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(first_run, runs))
    ones = np.zeros((len(some), 64), np.int64)
    for word in range(WORDS):
        own = _stirred(found + _SALTS[word])
        for bit in range(8):
            lanes = np.add.reduceat((own >> np.uint64(bit)) & _LANES, at).view(np.uint8).reshape(-1, 8)
            ones[:, bit::8] = np.add.reduceat(lanes, first_run, axis=0, dtype=np.int64)
        out[some, word] = np.packbits(ones * 2 > n[some][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    wide = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * wide), pa.py_buffer(np.ascontiguousarray(rows))])


def _codes(column: pa.Array) -> np.ndarray:
    """Fingerprints, or their parts, of a binary column, a row each."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, TREE_WORDS)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, h, size, text): key of the set, its number of shingles, and its fingerprint."""
    for batch in batches:
        for lo, texts in slices(batch.column(3), SLICE):
            rows, found = shingles(texts)
            n = np.bincount(rows, minlength=len(texts)).astype(np.int64)
            ends = np.cumsum(n)
            sums = np.r_[np.zeros(1, np.uint64), np.cumsum(_stirred(found), dtype=np.uint64)]
            key = _stirred(sums[ends] - sums[ends - n] + n.astype(np.uint64) * _ODD)
            own = [batch.column(k).slice(lo, len(texts)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(key.view(np.int64)), pa.array(n), _binary(fingerprints(found, n))], names=["doc_id", "h", "size", "key", "n", "code"])


def blocks(sets: int) -> np.ndarray:
    """Bits of each block, a row each, for so many distinct sets; spread evenly over the fingerprint."""
    width = min(40, max(8, math.ceil(math.log2(max(1, sets) / SHARD_SETS))))
    number = math.ceil(math.log(MISSED) / math.log(1 - AGREE**width))
    rng, bits = np.random.default_rng(width), np.zeros(0, np.int64)
    out = np.zeros((number, width), np.int64)
    for k in range(number):
        if len(bits) < width:  # what is left and a new order of all others
            others = rng.permutation(64 * TREE_WORDS)
            bits = np.r_[bits, others[~np.isin(others, bits)]]
        out[k], bits = bits[:width], bits[width:]
    return out


def _sharded(chosen: np.ndarray):
    """Function for mapInArrow over (key, n, code): SHARDED, a row a block, with the part of the code that trees have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.int64(1) << np.arange(chosen.shape[1], dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                rows = batch.slice(lo, 4096)
                codes = np.ascontiguousarray(_codes(rows.column(2))[:, :TREE_WORDS]).view(np.uint8)
                bits = np.unpackbits(codes, axis=1, bitorder="little")
                shard = np.stack([(np.int64(k) << np.int64(40)) + bits[:, c].astype(np.int64) @ weight for k, c in enumerate(chosen)], axis=1)
                same = [pa.array(np.repeat(rows.column(c).to_numpy(zero_copy_only=False), len(chosen))) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.reshape(-1)), *same, _binary(np.repeat(codes, len(chosen), axis=0))], names=["shard", "key", "n", "code"])

    return run


def _sizes_allow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)


def _first_met(shard: np.ndarray, a: np.ndarray, b: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Whether two codes in a shard share no earlier block: of all shards that have both, one answers for them."""
    apart = np.unpackbits(np.ascontiguousarray(a[:, :TREE_WORDS] ^ b[:, :TREE_WORDS]).view(np.uint8), axis=1, bitorder="little")
    own, first = shard >> 40, np.ones(len(shard), bool)
    for block in range(int(own.max(initial=0))):
        first &= (own <= block) | apart[:, chosen[block]].any(axis=1)
    return first


def _by_shard(work, columns: int):
    """Function for mapInArrow over rows sorted by their first two columns: ``work`` of whole groups; the code is the last of ``columns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns - 1)] + [_codes(batch.column(columns - 1))]
            held = now if held is None else [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)]
            if len(held[0]) >= SLICE_ROWS // 2:
                last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                if len(last):
                    yield work(*(a[: last[-1] + 1] for a in held))
                    held = [a[last[-1] + 1 :] for a in held]
        if held is not None and len(held[0]):
            yield work(*held)

    return run


PROPOSED = "u long, v long, shard long"


def _proposed(chosen, shard, slice_, key, n, code) -> pa.RecordBatch:
    """PROPOSED: pairs to be tested, or, with ``shard``, members ``u`` of its crowd and their hubs ``v``, themselves without one; of (shard, slice, key, n, code)."""
    group = np.cumsum(np.r_[0, (shard[1:] != shard[:-1]) | (slice_[1:] != slice_[:-1])])
    forest = Forest(code, group)
    cut = slice_ >= 0
    finds, held, total = np.where(cut, FEW + 1, 0), [], 0

    def hits():
        for q, m, _ in forest.search(TREE_RADIUS):
            ok = _sizes_allow(n[q], n[m])
            yield q[ok].astype(np.int32), m[ok].astype(np.int32)

    for q, m in hits():
        np.add.at(finds, q, 1)
        np.add.at(finds, m, 1)
        total += len(q)
        held = [*held, (q, m)] if total <= HELD else []
    pairs, hub = [np.zeros((0, 2), np.int64)], np.full(len(key), -1, np.int64)
    for q, m in held if total <= HELD else hits():
        few = (finds[q] <= FEW) | (finds[m] <= FEW)
        x, y = q[few], m[few]
        met = _first_met(shard[x], code[x], code[y], chosen)
        pairs.append(np.stack([key[x[met]], key[y[met]]], axis=1))
        for own, other in ((q, m), (m, q)):  # who has most finds, the first of them
            np.maximum.at(hub, own, finds[other] << 32 | ((1 << 32) - 1 - other.astype(np.int64)))
    crowd = np.flatnonzero(finds > FEW)
    led = crowd[hub[crowd] >= 0]
    to = key.copy()
    to[led] = key[(1 << 32) - 1 - (hub[led] & ((1 << 32) - 1))]
    pairs.append(np.stack([key[led], to[led]], axis=1))
    both = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
    u, v = np.r_[both[:, 0], key[crowd]], np.r_[both[:, 1], to[crowd]]
    of = pa.array(np.r_[np.zeros(len(both), np.int64), shard[crowd]], mask=np.r_[np.ones(len(both), bool), np.zeros(len(crowd), bool)])
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), of], names=["u", "v", "shard"])


def _across(chosen, shard, slice_, key, n, part, asks, hub, code) -> pa.RecordBatch:
    """Pairs within the radius whose components and hubs differ, of (shard, slice, key, n, part, asks, hub, code); asks is 0 in a slice's tree, 1 of a query to it.

    In a shard of one slice its members are the queries.  Trees are of whole
    fingerprints here, so they propose less than those of the first round.
    """
    group = np.cumsum(np.r_[0, (shard[1:] != shard[:-1]) | (slice_[1:] != slice_[:-1])])
    member = asks == 0
    forest = Forest(code[member], group[member])
    heads, place = np.unique(group[member], return_inverse=True)
    found = []

    def kept(a: np.ndarray, b: np.ndarray) -> None:
        ok = np.flatnonzero((part[a] != part[b]) & (hub[a] != hub[b]) & _sizes_allow(n[a], n[b]))
        ok = ok[_first_met(shard[a[ok]], code[a[ok]], code[b[ok]], chosen)]
        found.append(np.stack([np.minimum(key[a[ok]], key[b[ok]]), np.maximum(key[a[ok]], key[b[ok]])], axis=1))

    own = np.flatnonzero(member)
    # Members of a slice's main component needn't ask: whom they would find asks for itself.
    order = np.lexsort((part[own], place))
    head = np.r_[True, (place[order][1:] != place[order][:-1]) | (part[own][order][1:] != part[own][order][:-1])] if len(own) else np.zeros(0, bool)
    run = np.cumsum(head) - 1
    size = np.bincount(run, minlength=0)
    best = np.zeros(len(heads), np.int64)
    np.maximum.at(best, place[order][head], size)
    main = np.full(len(heads), np.iinfo(np.int64).min)
    is_best = size == best[place[order][head]]
    main[place[order][head][is_best]] = part[own][order][head][is_best]
    alone = slice_[own] < 0
    queries = np.flatnonzero((part[own] != main[place]) & alone)
    for q, m, _ in forest.search(RADIUS, queries=queries):
        kept(own[q], own[m])
    asking = np.flatnonzero(~member)
    if len(asking) and len(heads):
        at = np.searchsorted(heads, group[asking])
        there = (at < len(heads)) & (heads[at.clip(0, len(heads) - 1)] == group[asking])
        asking, at = asking[there], at[there]
        roots = forest.root[np.searchsorted(place, at)]
        for q, m, _ in forest.search(RADIUS, of=code[asking], roots=roots):
            kept(asking[q], own[m])
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])


@arrow_udf(BooleanType())
def _near(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in pairs:
        yield pa.array(np.bitwise_count(_codes(a) ^ _codes(b)).sum(axis=1) <= RADIUS)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, text): key and its set's hashes."""
    for batch in batches:
        for lo, texts in slices(batch.column(1), SLICE):
            rows, found = shingles(texts)
            parts = np.split(found, np.searchsorted(rows, np.arange(1, len(texts))))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["key", "set"])


@arrow_udf(BooleanType())
def _similar(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in pairs:
        # Both sides' sets, one after another: what is twice in a row is in both.
        n = [pc.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) // 8 for c in (a, b)]
        rows = np.concatenate([np.repeat(np.arange(len(a)), k) for k in n])
        found = np.frombuffer(b"".join([*a.to_pylist(), *b.to_pylist()]), np.uint64)
        order = _in_order(rows, found)
        rows, found = rows[order], found[order]
        twice = (rows[1:] == rows[:-1]) & (found[1:] == found[:-1])
        both = np.bincount(rows[1:][twice], minlength=len(a))
        yield pa.array(5 * both >= 4 * (n[0] + n[1] - both))


def _confirmed(pairs: DataFrame, classes: DataFrame, named: DataFrame, label: str) -> DataFrame:
    """(u, v) of the pairs that are as similar as asked, by the whole text of a row of each class."""
    left, right = (classes.select(F.col("key").alias(c), F.col("code").alias(f"{c}_code")) for c in "uv")
    pairs = written(pairs.join(left, "u").join(right, "v").where(_near("u_code", "v_code")).select("u", "v"), f"{label}_near")
    keys = pairs.select(F.col("u").alias("key")).distinct().unionByName(pairs.select(F.col("v").alias("key")).distinct()).distinct()
    wanted = keys.join(classes.select("key", "t.*"), "key")
    same = wanted["doc_id"].eqNullSafe(named["doc_id"]) & (wanted["h"] == named["h"]) & (wanted["size"] == named["size"])
    texts = wanted.join(named, same).select("key", "text").dropDuplicates(["key"])
    sets = written(texts.mapInArrow(_sets, "key long, set binary"), f"{label}_sets")
    left, right = (sets.select(F.col("key").alias(c), F.col("set").alias(f"{c}_set")) for c in "uv")
    return written(pairs.join(left, "u").join(right, "v").where(_similar("u_set", "v_set")).select("u", "v"), label)


def _sets_of(pairs: DataFrame, columns: tuple[str, str], classes: DataFrame, named: DataFrame, label: str) -> DataFrame:
    """The pairs with the sets of both, from the whole text of a row of each class."""
    keys = pairs.select(F.explode(F.array(*columns)).alias("key")).distinct()
    wanted = classes.join(keys, "key", "left_semi").select("key", "t.doc_id", "t.h", "t.size")
    same = wanted["doc_id"].eqNullSafe(named["doc_id"]) & (wanted["h"] == named["h"]) & (wanted["size"] == named["size"])
    sets = written(wanted.join(named, same).select("key", "text").dropDuplicates(["key"]).mapInArrow(_sets, "key long, set binary"), f"{label}_sets")
    for c in columns:
        pairs = pairs.join(sets.select(F.col("key").alias(c), F.col("set").alias(f"{c}_set")), c)
    return pairs


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, h, size, text: hash and length stand for the text."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return named.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("size"), "text")


def _cuts(sharded: DataFrame, slice_rows: int) -> DataFrame:
    """shard, cuts of the shards that are too large for a tree."""
    return written(sharded.groupBy("shard").count().where(F.col("count") > slice_rows).select("shard", F.ceil(F.col("count") / slice_rows).cast("long").alias("cuts")), "cuts")


def _sliced(sharded: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``slice``: -1 in a shard of one, else one of its numbers."""
    if cuts.isEmpty():
        return sharded.withColumn("slice", F.lit(-1).cast("long"))
    number = F.when(F.col("cuts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("key"), F.col("cuts"))).cast("long")
    return sharded.join(cuts, "shard", "left").withColumn("slice", number)


def _first_round(classes: DataFrame, chosen: np.ndarray, slice_rows: int) -> DataFrame:
    sharded = classes.select("key", "n", "code").mapInArrow(_sharded(chosen), SHARDED)
    dealt = _sliced(sharded, _cuts(sharded, slice_rows)).select("shard", "slice", "key", "n", "code")
    return written(dealt.repartition("shard", "slice").sortWithinPartitions("shard", "slice").mapInArrow(_by_shard(partial(_proposed, chosen), 5), PROPOSED), "proposed")


def _second_round(crowds: DataFrame, parts: DataFrame, chosen: np.ndarray, slice_rows: int) -> DataFrame:
    """(u, v) across components and hubs, of crowds (shard, key) and parts (key, n, part, hub, code)."""
    rows = written(crowds.join(parts, "key").select("shard", "key", "n", "part", "hub", "code"), "crowds")
    several = rows.groupBy("shard").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("shard")
    rows = rows.join(several, "shard", "left_semi")
    cuts = _cuts(rows, slice_rows)
    shape = ["shard", "slice", "key", "n", "part", "asks", "hub", "code"]
    members = _sliced(rows, cuts).withColumn("asks", F.lit(0)).select(*shape)
    if not cuts.isEmpty():
        # The component that most members of a large shard have needn't ask.
        large = rows.join(cuts, "shard")
        tops = large.groupBy("shard", "part").count().groupBy("shard").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
        asking = large.join(tops, "shard").where("part <> main").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
        members = members.unionByName(asking.withColumn("asks", F.lit(1)).select(*shape))
    return members.repartition("shard", "slice").sortWithinPartitions("shard", "slice", "asks").mapInArrow(_by_shard(partial(_across, chosen), 8), "u long, v long")


def _links_of(joined: DataFrame) -> DataFrame:
    """(u, v) that join the components (node, component): a link a node."""
    return joined.select(F.col("node").alias("u"), F.col("component").alias("v"))


def _compared(crowds: DataFrame, joined: DataFrame, classes: DataFrame, named: DataFrame) -> DataFrame:
    """COMPARED: members of crowds (shard, key, hub) and one hub each, that of their hubs that most name, where a hub's members are of several components."""
    named_by = crowds.where("hub <> key").groupBy("hub").agg(F.count(F.lit(1)).alias("weight"))
    stars = crowds.join(named_by, "hub").where("hub <> key").groupBy("key").agg(F.max(F.struct("weight", "hub")).alias("top")).select("top.hub", "key")
    stars = written(stars.join(joined, F.col("key") == F.col("node"), "left").select("hub", "key", F.coalesce("component", "key").alias("part")), "stars")
    several = stars.groupBy("hub").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("hub")
    both = _sets_of(stars.join(several, "hub", "left_semi").select("hub", "key"), ("hub", "key"), classes, named, "stars")
    return written(both.select("hub", "key", "hub_set", "key_set").mapInArrow(apart_from_hub, COMPARED), "compared")


def near_copies(docs: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, h, size, component of every row: components of documents (not of ids) over links of similar texts."""
    ship(docs.sparkSession)
    named = _named(docs)
    signed = written(named.mapInArrow(_signatures, SIGNED), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "size"))
    classes = written(signed.groupBy("key").agg(F.min("n").alias("n"), F.min("code").alias("code"), least.alias("t")), "classes")

    chosen = blocks(classes.count())
    proposed = _first_round(classes, chosen, slice_rows)
    pairs = written(proposed.where("shard is null").select("u", "v").distinct(), "pairs")
    links = _confirmed(pairs, classes, named, "links")

    joined = components(links)
    crowds = proposed.where("shard is not null").select("shard", F.col("u").alias("key"), F.col("v").alias("hub"))
    compared = _compared(crowds, joined, classes, named)
    similar = compared.where("similar").select(F.col("hub").alias("u"), F.col("key").alias("v"))
    through = written(through_hubs(compared, joined.select(F.col("node").alias("key"), "component"), MEET), "through_hubs")

    joined = components(_links_of(joined).unionByName(similar).unionByName(through))
    hubs = compared.where("apart is not null").select("key", "hub")
    parts = classes.join(joined, classes["key"] == joined["node"], "left").select("key", "n", F.coalesce("component", "key").alias("part"), "code")
    parts = parts.join(hubs, "key", "left").withColumn("hub", F.coalesce("hub", "key"))
    rest = written(_second_round(crowds.select("shard", "key"), parts, chosen, slice_rows).distinct().join(pairs, ["u", "v"], "left_anti"), "others")
    joined = components(_links_of(joined).unionByName(_confirmed(rest, classes, named, "links_of_others")))
    return signed.join(joined, signed["key"] == joined["node"], "left").select("doc_id", "h", "size", F.coalesce("component", "key").alias("component"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs``, whole rows, with one document of each component: that with the least doc_id (null ids last).

    Of rows that repeat an id and a text one stays; unlike texts under one id
    are documents of their own.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "size", "h")).alias("k")
    least = near_copies(docs).groupBy("component").agg(first).select("k.doc_id", "k.size", "k.h").distinct()
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.length(text_or_empty()).cast("long").alias("size"), F.xxhash64(text_or_empty()).alias("h"), F.struct("*").alias("row"))
    same = whole["id"].eqNullSafe(least["doc_id"]) & (whole["size"] == least["size"]) & (whole["h"] == least["h"])
    nth = F.row_number().over(Window.partitionBy("id", whole["size"], whole["h"]).orderBy("id"))
    return whole.join(least, same).withColumn("nth", nth).where("nth = 1").select("row.*")
