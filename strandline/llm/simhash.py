"""SimHash near-duplicates: 64-bit fingerprints linked through BK-trees.

Two fingerprints that differ in at most r bits agree on one of r + 1 blocks of
bits.  A shard is the distinct fingerprints with one value of one block; its
BK-tree keys the children of a node by their Hamming distance to it, and a
search follows only the edges within the radius.  A broadcast of all shard
trees would grow with the corpus, so each fingerprint is sent to the r + 1
shards that can hold a partner instead; no link is lost.  A shard beyond
``SHARD_ROWS`` is divided in the same way by its remaining bits, again and
again until it is small or its bits end.

Shards answer with a link from each member to the first of its own component,
not with all pairs; :mod:`.components` joins these.  Nulls count as empty
texts.  Texts without words have fingerprint zero and are linked like others.
Fingerprints are linked whoever has them, so rows with a null id join others;
a component that only such rows have is named null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from ..shipping import ship
from .common import text_or_empty, written
from .components import components

#: Words of a shingle, seed of its hash, bits that linked fingerprints differ in at most.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Distinct fingerprints of a shard, beyond which it's divided by further bits.
SHARD_ROWS = 100_000
#: Hashes that are counted at once, (query, node) pairs that a step of a search holds, and members that trees are made of at once.
HASHES, FRONTIER, WORK_ROWS = 1 << 15, 1 << 17, 50_000


def simhash(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of one text."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones, digest, join = np.zeros(64, np.int64), xxhash.xxh64_intdigest, b" ".join
    for lo in range(0, n, HASHES):
        hashes = np.array([digest(join(words[i : i + shingle]), seed) for i in range(lo, min(n, lo + HASHES))], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


@arrow_udf(LongType())
def _fingerprint(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array(np.array([simhash(x.as_py() or "") for x in batch], np.uint64).view(np.int64), pa.int64())


def fingerprint_column(text: Column) -> Column:
    """Fingerprint as a signed 64-bit column."""
    return _fingerprint(text)


class Forest:
    """BK-trees over distinct codes (rows of 64-bit words), one for each value of ``group`` (sorted)."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.codes = codes.reshape(len(codes), -1)
        self.span = 64 * self.codes.shape[1] + 1
        n = len(codes)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
        self.root = np.repeat(first, np.diff(np.r_[first, n]))
        left = np.setdiff1d(np.arange(n), first)
        parent, edges, children = self.root[left], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(left):
            # Of the members that meet at an edge the first becomes the child, so a child comes after its parent.
            edge, at, place = np.unique(parent * self.span + self.distance(left, parent), return_index=True, return_inverse=True)
            edges.append(edge)
            children.append(left[at])
            keep = np.ones(len(left), bool)
            keep[at] = False
            parent, left = left[at][place][keep], left[keep]
        edge, child = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(edge)
        #: An edge is its parent and its distance; sorted, the edges of a parent within a radius stand together.
        self.edges, self.children = edge[order], child[order]

    def distance(self, a: np.ndarray, b: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        """Hamming distances of codes ``a`` (of ``of``, or else members) and members ``b``."""
        return np.bitwise_count((self.codes if of is None else of)[a] ^ self.codes[b]).sum(axis=1, dtype=np.int64)

    def search(self, radius: int, of: np.ndarray | None = None, roots: np.ndarray | None = None, queries: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, member, distance) within the radius.

        Queries are codes ``of`` with the roots of their trees, or else the
        members: each finds those before it, so a pair comes once, or, if only
        some ``queries`` are asked for, any member but itself.
        """
        roots = self.root if roots is None else roots
        queries, all_members = np.arange(len(roots)) if queries is None else queries, of is None and queries is None
        # Queries and the runs of nodes that wait for them: expanded when their turn comes, FRONTIER pairs at most.
        todo = [(queries[lo : lo + FRONTIER], roots[queries[lo : lo + FRONTIER]], None) for lo in range(0, len(queries), FRONTIER)][::-1]
        while todo:
            query, run, width = todo.pop()
            if width is not None:
                total = np.cumsum(width)
                if total[-1] > FRONTIER and len(query) > 1:
                    cut = min(len(query) - 1, max(1, int(np.searchsorted(total, total[-1] // 2))))
                    todo += [(query[cut:], run[cut:], width[cut:]), (query[:cut], run[:cut], width[:cut])]
                    continue
                node = self.children[np.repeat(run - (total - width), width) + np.arange(int(total[-1]))]
                query = np.repeat(query, width)
                if all_members:
                    query, node = query[node < query], node[node < query]
            else:
                node = run
            if not len(query):
                continue
            d = self.distance(query, node, of)
            hit = d <= radius
            if of is None:
                hit &= query != node
            if hit.any():
                yield query[hit], node[hit], d[hit]
            low = np.searchsorted(self.edges, node * self.span + np.maximum(d - radius, 0))
            width = np.searchsorted(self.edges, node * self.span + np.minimum(d + radius, self.span - 1), "right") - low
            some = width > 0
            if some.any():
                todo.append((query[some], low[some], width[some]))

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (member, member) within the radius, each once."""
        for query, node, _ in self.search(radius):
            yield query, node


def least_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] and b[i]: of each component its least label."""
    while True:
        la, lb = labels[a], labels[b]
        if (la == lb).all():
            return labels
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (labels[labels] != labels).any():
            labels = labels[labels]


def shard_links(radius: int):
    """Function for mapInArrow over (part, value, code) sorted by shard: (u, v) joins the codes of each component."""

    def work(part: np.ndarray, value: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.r_[0, (part[1:] != part[:-1]) | (value[1:] != value[:-1])])
        labels = np.arange(len(code))
        for a, b in Forest(code.view(np.uint64), group).links(radius):
            labels = least_labels(labels, a, b)
        own = labels != np.arange(len(labels))
        return pa.RecordBatch.from_arrays([pa.array(code[own]), pa.array(code[labels[own]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.r_[a, batch.column(k).to_numpy(zero_copy_only=False)] for k, a in enumerate(held)]
            if len(held[0]) >= WORK_ROWS:
                last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                if len(last):  # a shard that goes on is held until it ends
                    yield work(*(a[: last[-1] + 1] for a in held))
                    held = [a[last[-1] + 1 :] for a in held]
        if len(held[0]):
            yield work(*held)

    return run


def _divided(free: int, parts: int) -> list[int]:
    """The set bits of a mask, in ``parts`` blocks of neighbours."""
    bits = [b for b in range(64) if free >> b & 1]
    return [sum(1 << b for b in bits[len(bits) * i // parts : len(bits) * (i + 1) // parts]) for i in range(parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(part: int, blocks: int) -> list[int]:
    """Masks of the shards that part of the codes is dealt to; a part's number tells the blocks that its codes share."""
    way = []
    while part > 1:
        part, block = divmod(part, blocks)
        way.append(block)
    shared = 0
    for block in reversed(way):
        shared |= _divided(((1 << 64) - 1) ^ shared, blocks)[block]
    return [shared | more for more in _divided(((1 << 64) - 1) ^ shared, blocks)]


def _redealt(blocks: int):
    """Function for mapInArrow over (part, code): (part, value, code) for each shard that goes on with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, code = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for one in np.unique(part).tolist():
                own = code[part == one]
                for i, mask in enumerate(_masks(one, blocks)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), one * blocks + i)), pa.array(own & np.int64(_signed(mask))), pa.array(own)], names=["part", "value", "code"])

    return run


def links(codes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(u, v) over distinct codes (column code): connects exactly what links of the radius connect.

    Each pass counts the shards that are too large, which the next one divides;
    mostly there is none.
    """
    blocks, free, done = radius + 1, 64, []
    top = F.array(*(F.struct(F.lit(blocks + i).cast("long").alias("part"), F.col("code").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("value")) for i, m in enumerate(_masks(1, blocks))))
    rows = codes.select("code", F.explode(top).alias("s")).select("s.part", "s.value", "code")
    while True:
        large = rows.groupBy("part", "value").count().where(F.col("count") > shard_rows).select("part", "value", F.lit(True).alias("large"))
        free -= -(-free // blocks)
        if free < blocks or (large := written(large, "large")).isEmpty():
            done.append(rows)
            break
        found = rows.join(large, ["part", "value"], "left")
        done.append(found.where("large is null").select("part", "value", "code"))
        rows = written(found.where("large").select("part", "code").mapInArrow(_redealt(blocks), "part long, value long, code long"), "divided")
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.repartition("part", "value").sortWithinPartitions("part", "value").mapInArrow(shard_links(radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, code (signed fingerprint) and component_id, the least doc_id reachable over links."""
    ship(docs.sparkSession)
    coded = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(text_or_empty()).alias("code")), "codes")
    classes = written(coded.groupBy("code").agg(F.min("doc_id").alias("rep")), "classes")
    joined = components(links(classes.select("code"), radius))
    parts = classes.join(joined, classes["code"] == joined["node"], "left").select(F.col("code").alias("class_code"), F.coalesce("component", "code").alias("part"), "rep")
    named = parts.join(parts.groupBy("part").agg(F.min("rep").alias("component_id")), "part").select("class_code", "component_id")
    return coded.join(named, coded["code"] == named["class_code"]).select("doc_id", "code", "component_id")
