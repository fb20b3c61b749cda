"""Hard negatives by inner product: ball trees searched by branch and bound, with bounds from above and below.

Rows are dealt to blocks by a hash, and a task builds a forest over its block:
rows with one label and vector are a point with its least ids, points of a label
are halved along their longest extent until they are leaves, and a node is the
ball around them.  With centre c and radius r, no point of it has an inner
product with q above ``q.c + |q| r`` or below ``q.c - |q| r``.  A query goes to
its best leaf first; then a node is left out if its upper bound is strictly
below the k-th best score so far or the score window, or its lower one above
the window.  What is as good as the k-th stays, as the smaller id decides.

Two searches: each anchor's best rows of its own label are its positives; for
each score of a positive, the best rows of other labels within a window that it
sets are the negatives.  Anchors are a stated part of all rows, and each meets
every block, once a search; neither is broadcast.  Blocks grow with the table,
up to ``BLOCK_BYTES``, so the exchange of anchors stays small against the search.

Components are whole numbers and scores exact: products are taken as doubles
where no sum can exceed 2**53, as 64-bit integers else.  A row takes part if it
has an id, a label and a vector without nulls whose score with itself can't
exceed a long (its largest component squared times its length); then no pair's
does.  Vectors of different lengths don't meet.  Rows with the same id, label and
vector count once; rows that differ in one of these are rows of their own.  An
empty table gives no rows, and further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import written

#: Positives of an anchor, negatives of a positive; negatives' scores from 50 to 95 hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Points of a leaf; queries that are searched for at once; least rows of a block, and most bytes of its vectors.
LEAF, QUERIES, LEAST_ROWS, BLOCK_BYTES = 48, 256, 2048, 64 << 20
#: Scores beyond all.
_NONE, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Forest:
    """Ball trees over the distinct points of a block, one for each label."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, keep: int):
        order = np.lexsort((ids, *vectors.T[::-1], labels))
        ids, labels, vectors = ids[order], labels[order], vectors[order]
        new = np.r_[True, (labels[1:] != labels[:-1]) | (vectors[1:] != vectors[:-1]).any(axis=1)]
        point = np.cumsum(new) - 1
        nth = np.arange(len(ids)) - np.flatnonzero(new)[point]
        self.labels, points = labels[new], vectors[new]
        #: The least ids of each point, as far as a query may need them.
        self.ids, self.some = np.zeros((len(points), keep), np.int64), np.zeros((len(points), keep), bool)
        self.ids[point[nth < keep], nth[nth < keep]] = ids[nth < keep]
        self.some[point[nth < keep], nth[nth < keep]] = True
        self._grow(points)

    def _grow(self, points: np.ndarray) -> None:
        """Halves all nodes of a level at once; ``levels`` are (first, end, parent, centres, radii) of nodes."""
        n, real = len(points), points.astype(np.float64)
        place = np.arange(n)
        first = np.flatnonzero(np.r_[True, self.labels[1:] != self.labels[:-1]])
        end, parent = np.r_[first[1:], n], np.zeros(len(first), np.int64)
        self.levels, self.leaf = [], []
        while len(first):
            # Rows of the level's nodes, node by node.
            width = end - first
            node = np.repeat(np.arange(len(first)), width)
            head = np.cumsum(width) - width
            rows = np.repeat(first - head, width) + np.arange(int(width.sum()))
            own = real[place[rows]]
            centre = np.add.reduceat(own, head, axis=0) / width[:, None]
            far = np.sqrt(((own - centre[node]) ** 2).sum(axis=1))
            radius = np.maximum.reduceat(far, head)
            self.levels.append((first, end, parent, centre, radius))
            halved = width > LEAF
            self.leaf.append(~halved)
            if not halved.any():
                break
            a = own[self._greatest(far, head, node)]
            b = own[self._greatest(((own - a[node]) ** 2).sum(axis=1), head, node)]
            along = (own * (b - a)[node]).sum(axis=1)
            place[rows] = place[rows][np.lexsort((along, node))]
            middle = (first + end) // 2
            at = np.flatnonzero(halved)
            first, end, parent = np.stack([first[at], middle[at]], 1).ravel(), np.stack([middle[at], end[at]], 1).ravel(), np.repeat(at, 2)
        self.ids, self.some, self.labels = self.ids[place], self.some[place], self.labels[place]
        self.points, self.real = points[place], real[place]
        self.largest = float(np.abs(self.real).max(initial=0))

    @staticmethod
    def _greatest(values: np.ndarray, head: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The first place of each node's greatest value."""
        hits = np.flatnonzero(values == np.maximum.reduceat(values, head)[node])
        _, at = np.unique(node[hits], return_index=True)
        return hits[at]

    def search(self, ids, labels, vectors, low, high, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best points' ids within [low, high] for each query, of its own label or of all others.

        A query is no find of itself (id, label and vector).
        """
        real, n = vectors.astype(np.float64), len(ids)
        exact = float(np.abs(real).max(initial=0)) * self.largest * max(1, vectors.shape[1]) < 2**53
        norm = np.sqrt((real**2).sum(axis=1))[:, None]
        # Bounds in floating point, wide enough for their rounding.
        bounds = []
        for _, _, _, centre, radius in self.levels:
            product, reach = real @ centre.T, norm * radius
            slack = 1e-9 * (norm * np.sqrt((centre**2).sum(axis=1)) + reach) + 1e-6
            bounds.append((product + reach + slack, product - reach - slack))
        floor = low.astype(np.float64)[:, None] * (1 - 1e-12 * np.sign(low)[:, None])
        roof = high.astype(np.float64)[:, None] * (1 + 1e-12 * np.sign(high)[:, None])
        found = (np.zeros(0, np.int64),) * 3
        kth = np.full(n, _NONE)

        def leaves() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """(query, level, node, upper bound) of the leaves that aren't pruned, from the roots down."""
            out, alive = [], None
            for depth, (first, _, parent, _, _) in enumerate(self.levels):
                upper, lower = bounds[depth]
                if depth == 0:
                    own = self.labels[first][None, :] == labels[:, None]
                    alive = own if same else ~own
                else:
                    alive = alive[:, parent]
                least = np.maximum(floor, kth.astype(np.float64)[:, None] * (1 - 1e-12 * np.sign(kth)[:, None]))
                alive = alive & (upper >= least) & (lower <= roof)
                q, at = np.nonzero(alive & self.leaf[depth][None, :])
                out.append((q, np.full(len(q), depth), at, np.minimum(upper[q, at], roof[q, 0])))
            return tuple(np.concatenate(x) for x in zip(*out, strict=True))

        def looked(q, depth, at) -> None:
            nonlocal found, kth
            got = [found]
            order = np.lexsort((at, depth))
            q, depth, at = q[order], depth[order], at[order]
            cut = np.flatnonzero(np.r_[True, (depth[1:] != depth[:-1]) | (at[1:] != at[:-1])]) if len(q) else []
            for lo, hi in zip(cut, [*cut[1:], len(q)], strict=True):
                first, end = (self.levels[depth[lo]][c][at[lo]] for c in (0, 1))
                own = q[lo:hi]
                if exact:
                    scores = (real[own] @ self.real[first:end].T).astype(np.int64)
                else:
                    scores = vectors[own] @ self.points[first:end].T
                a, b = np.nonzero((scores >= np.maximum(low[own], kth[own])[:, None]) & (scores <= high[own][:, None]))
                if len(a):
                    c, nth = np.nonzero(self.some[first + b])
                    x, y, z = own[a[c]], self.ids[first + b[c], nth], scores[a[c], b[c]]
                    if same:
                        self_ = (y == ids[x]) & (self.points[first + b[c]] == vectors[x]).all(axis=1)
                        x, y, z = x[~self_], y[~self_], z[~self_]
                    got.append((x, y, z))
            x, y, z = (np.concatenate(c) for c in zip(*got, strict=True))
            order = np.lexsort((y, ~z, x))  # ~z falls as z rises, for all longs
            x, y, z = x[order], y[order], z[order]
            head = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
            nth = np.arange(len(x)) - np.repeat(head, np.diff(np.r_[head, len(x)]))
            kept = nth < k
            kth[x[nth == k - 1]] = z[nth == k - 1]
            found = x[kept], y[kept], z[kept]

        q, depth, at, upper = leaves()
        todo = np.lexsort((-upper, q))
        q, depth, at, upper = q[todo], depth[todo], at[todo], upper[todo]
        head = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
        self.looked_at = int(head.sum())
        looked(q[head], depth[head], at[head])  # the best leaf of each
        q, depth, at, upper = q[~head], depth[~head], at[~head], upper[~head]
        step = 1
        while len(q):
            now = np.maximum(low, kth)[q]
            live = upper >= now * (1 - 1e-12 * np.sign(now))
            q, depth, at, upper = q[live], depth[live], at[live], upper[live]
            if not len(q):
                break
            start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            nth = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
            turn, step = nth < step, step * 2
            self.looked_at += int(turn.sum())
            looked(q[turn], depth[turn], at[turn])
            q, depth, at, upper = q[~turn], depth[~turn], at[~turn], upper[~turn]
        return found


_FOUND = pa.schema([("anchor", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _searched(k: int, same: bool):
    """Function for mapInArrow over (width, block, asks, anchor, id, label, vector, low, high), sorted by the first three: a block's rows, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, forest = None, [], None
        for batch in batches:
            width, block, asks, anchor, ids, labels, low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 3, 4, 5, 7, 8))
            cut = np.flatnonzero(np.r_[True, (width[1:] != width[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])])
            for lo, hi in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                if (width[lo], block[lo]) != at:
                    at, rows, forest = (width[lo], block[lo]), [], None
                vectors = _matrix(batch.column(6).slice(lo, hi - lo), width[lo])
                if not asks[lo]:
                    rows.append((ids[lo:hi], labels[lo:hi], vectors))
                    continue
                if forest is None and rows:
                    forest, rows = Forest(*(np.concatenate(x) for x in zip(*rows, strict=True)), k + same), []
                for x in range(lo, hi, QUERIES) if forest is not None else ():
                    y = min(hi, x + QUERIES)
                    q, found, score = forest.search(ids[x:y], labels[x:y], vectors[x - lo : y - lo], low[x:y], high[x:y], k, same)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (anchor[x:y][q], low[x:y][q], high[x:y][q], found, score)], schema=_FOUND)

    return run


def _best(points: DataFrame, queries: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
    """(anchor, low, high, id, score, rank): the k best for each query over all blocks."""
    shape = ["width", "block", "asks", "anchor", "id", "label", "vector", "low", "high"]
    none = F.lit(0).cast("long")
    dealt = points.select("width", "block", F.lit(0).alias("asks"), none.alias("anchor"), "id", "label", "vector", none.alias("low"), none.alias("high"))
    asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).withColumn("asks", F.lit(1)).select(*shape)
    each = dealt.unionByName(asked).repartition(2 * blocks, "width", "block").sortWithinPartitions("width", "block", "asks").mapInArrow(_searched(k, same), "anchor long, low long, high long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "low", "high").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k)


def whole_numbers(vector: Column, scale: float = 256.0) -> Column:
    """Components times the scale, rounded down; null where one is null, not finite, or too large for scores to be longs."""
    real = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    largest = F.coalesce(F.array_max(F.transform(vector, lambda x: F.abs(F.floor(x.cast("double") * scale).cast("double")))), F.lit(0.0))
    fits = largest * largest * F.size(vector) < 9.2e18
    return F.when(~bad & fits, F.transform(real, lambda x: x.cast("long")))


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_rows: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (id, label, vector of longs).

    ``anchors`` is a condition.  A negative's score is from ``low`` to ``high``
    hundredths of its positive's; both ends count.
    """
    ship(rows.sparkSession)
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
    given = rows.where(usable).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector", anchors.alias("asked")).distinct()
    given = written(given.withColumn("anchor", F.xxhash64("id", "label", "vector")).withColumn("width", F.size("vector").cast("long")), "rows")
    n, width = given.agg(F.count(F.lit(1)), F.max("width")).first()
    size = block_rows or max(LEAST_ROWS, min(n // 64, BLOCK_BYTES // (8 * max(1, width or 1))))
    blocks = max(1, math.ceil(n / size))
    points = given.withColumn("block", F.pmod(F.col("anchor"), F.lit(blocks)).cast("long"))
    asked = given.where("asked").select("anchor", "id", "label", "width", "vector")
    every = asked.withColumn("low", F.lit(_NONE).cast("long")).withColumn("high", F.lit(_MOST).cast("long"))
    best = written(_best(points, every, blocks, positives, True).select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Whole bounds of the window, so that nothing overflows: floor and ceiling of hundredths.
    ceiling = lambda h: F.expr(f"-((-positive_score) div 100 * {h}) + cast(ceil(((positive_score) % 100) * {h} / 100.0) as bigint)")
    floor = lambda h: F.expr(f"(positive_score div 100) * {h} + cast(floor((positive_score % 100) * {h} / 100.0) as bigint)")
    windows = best.where("positive_score >= 0").withColumn("low", ceiling(low)).withColumn("high", floor(high))
    queries = windows.select("anchor", "low", "high").distinct().where("low <= high").join(asked, "anchor")
    hard = written(_best(points, queries, blocks, negatives, False).select("anchor", "low", "high", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "negatives")
    named = asked.select("anchor", F.col("id").alias("anchor_id"))
    return windows.join(hard, ["anchor", "low", "high"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def of_embeddings(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of ``embeddings`` (vec_id, label, embedding) by the query's rules: 256ths rounded down, labels of every seventh id moved on, every fiftieth an anchor."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = embeddings.select(F.col("vec_id").alias("id"), moved.alias("label"), whole_numbers(F.col("embedding")).alias("vector"))
    return hard_negatives(rows, F.col("id") % 50 == 0)
