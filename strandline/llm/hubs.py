"""Members of a large group, settled through one of them, their hub, by what sets them apart from it.

With the shingles of the hub that two sets lack or add to it, and those of these
that they have in common, their overlap is known.  So members of a hub in
different components are compared within blocks, by short lists instead of whole
sets, and what goes on is one link between components, not a row a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least similarity, as parts of five.
_PARTS, _OF = 4, 5
COMPARED = "hub long, key long, similar boolean, whole long, n long, lacks long, apart array<long>"
_COMPARED = pa.schema([("hub", pa.int64()), ("key", pa.int64()), ("similar", pa.bool_()), ("whole", pa.int64()), ("n", pa.int64()), ("lacks", pa.int64()), ("apart", pa.list_(pa.int64()))])


def apart_from_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (hub, key, sets of both): whether they are similar, sizes of both, shingles of the hub that the other lacks, and all that sets them apart, unless that is over half the hub."""
    for batch in batches:
        out = []
        for hub, key, one, two in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            one, two = np.frombuffer(one, np.int64), np.frombuffer(two, np.int64)
            lacks, adds = np.setdiff1d(one, two, True), np.setdiff1d(two, one, True)
            similar = _OF * (len(one) - len(lacks)) >= _PARTS * (len(one) + len(adds))
            short = len(lacks) + len(adds) <= len(one) // 2
            out.append((hub, key, similar, len(one), len(two), len(lacks), np.r_[lacks, adds] if short else None))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _COMPARED.types, strict=True)] if out else [pa.array([], t) for t in _COMPARED.types], schema=_COMPARED)


def _met(key, whole, n, lacks, part, own, cross: bool, apart: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Links between components of one hub's members: of each member, one to each other component that it is similar to a member of.

    Two sets overlap by what of the hub neither lacks, ``whole - lacks - lacks``,
    and by what of their lists they have in common.
    """
    size = np.diff(apart.offsets.to_numpy())
    of = np.repeat(np.arange(len(key)), size)
    _, token = np.unique(apart.flatten().to_numpy(), return_inverse=True)
    order = np.argsort(token, kind="stable")
    posted, first = of[order], np.searchsorted(token[order], np.arange(int(token.max(initial=-1)) + 2))
    start = np.cumsum(size) - size
    cost = 4 * n + 9 * lacks
    parts, of_part, count = np.unique(part, return_inverse=True, return_counts=True)
    u, v = [], []
    for x in np.flatnonzero(of_part != count.argmax()):  # those of the largest one needn't ask
        mine = token[start[x] : start[x] + size[x]]
        width = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        both = np.bincount(posted[at], minlength=len(key))
        hit = (9 * both >= cost + cost[x] - 9 * whole[x]) & (of_part != of_part[x])
        if cross:
            hit &= own != own[x]
        hits = np.flatnonzero(hit)
        hits = hits[np.unique(of_part[hits], return_index=True)[1]]
        u.append(np.full(len(hits), key[x]))
        v.append(key[hits])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(u or none), np.concatenate(v or none)


def _met_by_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (hub, a, b, key, whole, n, lacks, part, own, apart), sorted by the first three: (u, v)."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        a, b = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
        columns = [rows.column(k).to_numpy() for k in range(3, 9)]
        u, v = _met(*columns, a != b, rows.column(9).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        ends = [0, *(np.flatnonzero(np.any([np.diff(batch.column(k).to_numpy(zero_copy_only=False)) != 0 for k in range(3)], axis=0)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(ends, ends[1:], strict=False):
            rows = now.slice(lo, hi - lo)
            if held is not None and any(held.column(k)[0] != rows.column(k)[0] for k in range(3)):
                yield done(held)
                held = None
            held = rows if held is None else pa.concat_tables([held, rows])
    if held is not None:
        yield done(held)


def in_groups(rows: DataFrame, by: str, members: str, meet: int) -> DataFrame:
    """Each row for the pairs of groups (a <= b) of its ``by`` that its own group is in; a group has about ``meet`` members."""
    rows = rows.withColumn("groups", F.ceil(F.col(members) / meet).cast("int")).withColumn("own", F.pmod(F.xxhash64("key"), F.col("groups")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    return rows.withColumn("other", other).withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("groups", "other")


def through_hubs(compared: DataFrame, parts: DataFrame, meet: int) -> DataFrame:
    """(u, v): links between components among members of a hub that differ little from it."""
    near = compared.where("apart is not null").join(parts, "key", "left").withColumn("part", F.coalesce("component", "key"))
    several = near.groupBy("hub").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("members")).where("low < high").select("hub", "members")
    rows = in_groups(near.join(several, "hub"), "hub", "members", meet).select("hub", "a", "b", "key", "whole", "n", "lacks", "part", "own", "apart")
    return rows.repartition("hub", "a", "b").sortWithinPartitions("hub", "a", "b").mapInArrow(_met_by_hub, "u long, v long").distinct()
