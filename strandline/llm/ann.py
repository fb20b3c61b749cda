"""Nearest neighbours by inner product over robust-pruned directed graphs.

Distinct vectors are dealt to shards by the nearest of a few centres, and a
shard that is still too large is cut by a hash.  In each, greedy beam searches
over the growing graph propose neighbours for batches of points, and pruning
keeps a near one only if no kept one is nearer to it by the factor alpha.  Edges
go back as well and are pruned where there are too many.  Inner products become
distances by one further coordinate that makes all norms equal.  What no search
would reach is made a further entry, so every row is found.

A beam search queries each of the shards whose centres promise most to the
query.  How many these must be is measured: for a bounded sample of queries
(``ASKED``) the true neighbours are found by brute force, and the least number
of shards is taken that holds ``HELD`` of them.  With it the beam is doubled
until the sample's recall is ``RECALL``.  Where vectors have no clusters
that is most of the shards, and the search costs what the data ask for.

Candidates get their exact products in double precision from the original
vectors.  A vector stands for all its ids; as many of the least as a query may
need are kept with it, so groups of copies cost nothing and ties go to the
smaller id.  A task reads a shard's graph once and streams the shard's queries
past it: neither queries nor graphs are broadcast, copied by blocks or gathered
by the driver.  The centres, fitted on a bounded sample, are broadcast; they are
``CENTRES`` at most, beyond which shards grow by being cut.

Vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do rows without an id.  Rows that repeat an id count once, with
the least vector.  Vectors of different lengths don't meet.  Fewer candidates
than asked for are all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import written

#: Neighbours returned; edges of a point; beams of the build and, at first, of a search; points that a step expands; relaxation.
TOP, DEGREE, BUILD_BEAM, BEAM, WIDTH, ALPHA = 20, 32, 64, 128, 4, 1.2
#: Shards of a table that is large enough for them; vectors that a shard has at least then, and at most; points that are searched for at once.
SHARDS, LEAST_ROWS, SHARD_ROWS, BATCH = 8, 1_000, 50_000, 512
#: Centres at most, vectors for each that they are fitted on, rounds of the fit; queries whose neighbours are found by brute force, and the part of these that the shards asked must hold.
CENTRES, FITTED, ROUNDS, ASKED, HELD = 20_000, 40, 5, 200, 0.97
#: Recall that the sample must have, or else the beam is doubled, up to a most.
RECALL, MOST_BEAM = 0.95, 2_048


class Graph:
    """Directed graph over vectors; ``space`` has the coordinate that equalises norms."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray | None = None, entries: np.ndarray | None = None):
        x = vectors.astype(np.float32)
        squares = (x.astype(np.float64) ** 2).sum(axis=1)
        extra = np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0)).astype(np.float32)
        self.space = np.concatenate([x, extra[:, None]], axis=1)
        self.squares = (self.space**2).sum(axis=1)
        self.edges, self.entries = edges, entries

    def search(self, queries: np.ndarray, beam: int, keep_expanded: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: none) and distances less the query's square, nearest first, of a greedy search for each query."""
        b, n = len(queries), len(self.space)
        visited = np.zeros((b, n), bool)
        first = self.entries[:beam]
        ids, dist, open_ = np.full((b, beam), -1, np.int64), np.full((b, beam), np.inf, np.float32), np.zeros((b, beam), bool)
        ids[:, : len(first)] = first
        dist[:, : len(first)] = self.squares[first] - 2 * queries @ self.space[first].T
        open_[:, : len(first)] = True
        visited[:, first] = True
        while True:
            rank = np.where(open_, dist, np.inf)
            at = np.argpartition(rank, min(WIDTH, beam) - 1, axis=1)[:, :WIDTH]
            rows = np.flatnonzero(np.isfinite(np.take_along_axis(rank, at, 1)).any(axis=1))
            if not len(rows):
                break
            at = at[rows]
            live = np.isfinite(np.take_along_axis(rank[rows], at, 1))
            chosen = np.where(live, np.take_along_axis(ids[rows], at, 1), -1)
            open_[rows[:, None], at] = False
            near = np.where(chosen[:, :, None] >= 0, self.edges[chosen], -1).reshape(len(rows), -1)
            near.sort(axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~visited[rows[:, None], near]
            r, c = np.nonzero(fresh)
            found = near[r, c]
            visited[rows[r], found] = True
            d = np.full(near.shape, np.inf, np.float32)
            d[r, c] = self.squares[found] - 2 * np.einsum("ij,ij->i", self.space[found], queries[rows[r]])
            every_d = np.concatenate([dist[rows], d], axis=1)
            best = np.argpartition(every_d, beam - 1, axis=1)[:, :beam]
            dist[rows] = np.take_along_axis(every_d, best, 1)
            every = np.concatenate([ids[rows], np.where(fresh, near, -1)], axis=1)
            ids[rows] = np.take_along_axis(every, best, 1)
            every = np.concatenate([open_[rows], fresh], axis=1)
            open_[rows] = np.take_along_axis(every, best, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)

    def pruned(self, points: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
        """Edges of points from candidates (-1: none; repeats and the point itself are passed over)."""
        candidates = np.sort(candidates, axis=1)
        bad = (candidates < 0) | (candidates == points[:, None])
        bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
        x = self.space[candidates]
        own = ((x - self.space[points][:, None, :]) ** 2).sum(axis=2)
        between = np.maximum(self.squares[candidates][:, :, None] + self.squares[candidates][:, None, :] - 2 * x @ x.transpose(0, 2, 1), 0)
        left, out, row = np.where(bad, np.inf, own), np.full((len(points), degree), -1, np.int64), np.arange(len(points))
        for k in range(degree):
            at = left.argmin(axis=1)
            some = np.isfinite(left[row, at])
            if not some.any():
                break
            out[some, k] = candidates[row, at][some]
            left[(alpha * alpha * between[row, at] <= own) & some[:, None]] = np.inf
            left[row, at] = np.inf
        return out

    def _linked_back(self, points: np.ndarray, alpha: float, degree: int) -> None:
        """Adds the edges from the points' neighbours to them; prunes where there are too many."""
        source = np.repeat(points, degree)
        target = self.edges[points].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, start, count = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(heads), BATCH):
            h, n = heads[lo : lo + BATCH], count[lo : lo + BATCH]
            more = np.full((len(h), n.max()), -1, np.int64)
            row = np.repeat(np.arange(len(h)), n)
            more[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = source[start[lo] : start[lo] + n.sum()]
            self.edges[h] = self.pruned(h, np.concatenate([self.edges[h], more], axis=1), alpha, degree)

    def build(self, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 0) -> Graph:
        n, rng = len(self.space), np.random.default_rng(seed)
        self.edges = rng.integers(0, n, (n, degree))
        self.edges[:, degree // 2 :] = -1
        self.edges[self.edges == np.arange(n)[:, None]] = -1
        self.entries = np.array([((self.space - self.space.mean(axis=0)) ** 2).sum(axis=1).argmin()])
        for relax in (1.0, alpha):
            order = rng.permutation(n)
            for lo in range(0, n, BATCH):
                points = order[lo : lo + BATCH]
                found, _ = self.search(self.space[points], beam)
                self.edges[points] = self.pruned(points, np.concatenate([found, self.edges[points]], axis=1), relax, degree)
                self._linked_back(points, relax, degree)
        self._entered()
        return self

    def _entered(self) -> None:
        """Makes a point of each part that the entries don't reach an entry, too."""
        seen, entries = np.zeros(len(self.space), bool), self.entries.tolist()
        front = self.entries
        while True:
            while len(front):
                seen[front] = True
                front = np.unique(self.edges[front])
                front = front[front >= 0]
                front = front[~seen[front]]
            rest = np.flatnonzero(~seen)
            if not len(rest):
                break
            front = rest[:1]
            entries.append(int(rest[0]))
        self.entries = np.array(entries)


def nearest(graph: Graph, vectors: np.ndarray, queries: np.ndarray, beam: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, members by their index, exact inner products) of what a beam search finds."""
    wide = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
    exact = vectors.astype(np.float64)
    for lo in range(0, len(queries), BATCH):
        found, _ = graph.search(wide[lo : lo + BATCH], max(beam, len(graph.entries)))
        for i, ids in enumerate(found):
            ids = ids[ids >= 0]
            yield lo + i, ids, exact[ids] @ queries[lo + i]


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """id and x (array of doubles' worth of floats) of the vectors that take part, a row an id."""
    x = F.col(vector)
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False))).groupBy(F.col("vec_id").cast("long").alias("id")).agg(F.min(x).alias("x"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(lists.flatten())
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def _build(key, table):
    vectors = _matrix(table.column("x"))
    graph = Graph(vectors).build()
    ids = table.column("ids").combine_chunks()
    counts = np.asarray(ids.value_lengths())
    parts = [vectors.tobytes(), graph.edges.astype("<i4").tobytes(), graph.entries.astype("<i4").tobytes(), np.asarray(ids.flatten()).astype("<i8").tobytes(), counts.astype("<i4").tobytes()]
    own = [pa.array([int(k.as_py())], pa.int32()) for k in key]
    return pa.table([*own, pa.array([vectors.dtype.itemsize], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], names=["dim", "shard", "cut", "width", "vectors", "edges", "entries", "ids", "counts"])


INDEX = "dim int, shard int, cut int, width int, vectors binary, edges binary, entries binary, ids binary, counts binary"


def _score(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearer a centre the larger."""
    return x @ centres.T - (centres**2).sum(axis=1) / 2


def _centres(sample: np.ndarray, number: int) -> np.ndarray:
    """Of a sample, by Lloyd's rounds; a centre that loses its vectors stays."""
    centres = sample[np.random.default_rng(0).choice(len(sample), number, replace=False)]
    for _ in range(ROUNDS):
        own = np.concatenate([_score(sample[lo : lo + 4096], centres).argmax(axis=1) for lo in range(0, len(sample), 4096)])
        count = np.bincount(own, minlength=number)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


@dataclass
class Index:
    """``graphs``: the written table, INDEX, a row a cut of a shard; ``centres`` and the number of shards that a query asks, by dimension.

    ``beam`` is that of a search, ``recall`` what the sample of queries found with it.
    """

    graphs: DataFrame
    centres: dict[int, np.ndarray]
    probes: dict[int, int]
    beam: int
    recall: float | None = None


def _dealt(centres: dict[int, np.ndarray], probes: dict[int, int] | None):
    """Function for mapInArrow over (id or ids, x): adds dim and shard, the nearest centre's, or a row for each of the best ``probes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                shard, row = np.zeros(len(at), np.int64), at
                if dim in centres:
                    x = _matrix(batch.column(1).take(pa.array(at))).astype(np.float64)
                    if probes is None:
                        shard = np.concatenate([_score(x[lo : lo + 4096], centres[dim]).argmax(axis=1) for lo in range(0, len(x), 4096)])
                    else:
                        n = probes[dim]
                        best = np.concatenate([np.argsort(-(x[lo : lo + 4096] @ centres[dim].T), axis=1, kind="stable")[:, :n] for lo in range(0, len(x), 4096)])
                        shard, row = best.reshape(-1), np.repeat(at, n)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in (0, 1)), pa.array(np.full(len(row), dim, np.int32)), pa.array(shard.astype(np.int32))], names=[batch.schema.names[0], "x", "dim", "shard"])

    return run


def _kind(points: DataFrame) -> str:
    return dict(points.dtypes)["x"]


def _truth(points: DataFrame, names: np.ndarray, asked: list[np.ndarray], top: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of a few queries the ``top`` largest products with rows other than its own, by brute force, and their shards."""
    by_dim = {d: [i for i, x in enumerate(asked) if len(x) == d] for d in {len(x) for x in asked}}
    stacked = {d: np.stack([asked[i] for i in at]) for d, at in by_dim.items()}

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for d in set(np.unique(dims).tolist()) & set(stacked):
                own = batch.take(pa.array(np.flatnonzero(dims == d)))
                found = stacked[d] @ _matrix(own.column(0)).astype(np.float64).T
                k = min(top + 1, own.num_rows)
                at = np.argpartition(-found, k - 1, axis=1)[:, :k]
                q, flat = np.repeat(np.arange(len(found)), k), pa.array(at.reshape(-1))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(by_dim[d])[q]), pa.array(found[q, at.reshape(-1)]), own.column(2).take(flat), own.column(3).take(flat)], names=["q", "score", "shard", "ids"])

    found = points.select("x", "dim", "shard", "ids").mapInArrow(best, "q long, score double, shard int, ids array<bigint>")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc()))
    out = [([], []) for _ in asked]
    for r in found.withColumn("nth", nth).where(F.col("nth") <= top + 1).orderBy("q", "nth").collect():
        others = len(r.ids) - (int(names[r.q]) in r.ids)
        for column, value in zip(out[r.q], (r.score, r.shard), strict=True):
            column += [value] * others
    return [(np.array(score[:top]), np.array(shard[:top], np.int64)) for score, shard in out]


def _measured(found: Index, points: DataFrame, queries: DataFrame, top: int) -> Index:
    """Sets how many shards queries ask and the beam, by what a sample of queries needs."""
    sample = written(queries.orderBy(F.xxhash64("id"), "id").limit(ASKED), "asked")
    rows = sample.toArrow()
    names, asked = rows.column("id").to_numpy(), [np.array(x, np.float64) for x in rows.column("x").to_pylist()]
    truth = _truth(points, names, asked, top)
    for dim, own in found.centres.items():
        places = [np.argsort(np.argsort(-(own @ x), kind="stable"))[shard] for x, (_, shard) in zip(asked, truth, strict=True) if len(x) == dim]
        places = np.concatenate(places) if places else np.zeros(0, np.int64)
        if len(places):
            held = np.cumsum(np.bincount(places, minlength=len(own))) / len(places)
            found.probes[dim] = int(np.searchsorted(held, HELD)) + 1
    wanted = sum(len(score) for score, _ in truth)
    while wanted:
        got: dict[int, list[float]] = {}
        for r in searched(found, sample, top).select("query_id", "score").collect():  # of the sample only
            got.setdefault(r.query_id, []).append(r.score)
        hits = sum(int((np.sort(got.get(int(q), []))[::-1] >= score[-1] - 1e-9).sum()) for q, (score, _) in zip(names, truth, strict=True) if len(score))
        found.recall = hits / wanted
        if found.recall >= RECALL or found.beam >= MOST_BEAM:
            break
        found.beam *= 2
    return found


def index(vectors: DataFrame, queries: DataFrame, top: int = TOP, shards: int = SHARDS, shard_rows: int = SHARD_ROWS, least_rows: int = LEAST_ROWS) -> Index:
    """Of usable (id, x); ``queries`` are sampled to measure how many shards to ask, and how wide."""
    ship(vectors.sparkSession)
    ranked = vectors.withColumn("nth", F.row_number().over(Window.partitionBy("x").orderBy("id"))).where(F.col("nth") <= top + 1)
    points = written(ranked.groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids", "x"), "points")
    centres = {}
    # Dimensions that are large enough to divide; one that isn't is a shard.
    for dim, n in points.groupBy(F.size("x").alias("dim")).count().where(F.col("count") >= 2 * least_rows).collect():
        number = min(CENTRES, max(min(shards, n // least_rows), -(-n // shard_rows)))
        sample = points.where(F.size("x") == dim).orderBy(F.xxhash64("x"), "x").limit(FITTED * number).select("x").toArrow()
        centres[dim] = _centres(_matrix(sample.column("x")).astype(np.float64), number)
    dealt = written(points.mapInArrow(_dealt(centres, None), f"ids array<bigint>, x {_kind(points)}, dim int, shard int"), "dealt")
    sizes = dealt.groupBy("dim", "shard").count().select("dim", "shard", F.ceil(F.col("count") / (2 * shard_rows)).alias("cuts"))
    cut = dealt.join(sizes, ["dim", "shard"]).withColumn("cut", F.pmod(F.xxhash64("x"), F.col("cuts")).cast("int"))
    graphs = cut.select("dim", "shard", "cut", "x", "ids").groupBy("dim", "shard", "cut").applyInArrow(_build, INDEX)
    return _measured(Index(written(graphs, "index"), centres, {d: len(c) for d, c in centres.items()}, BEAM), dealt, queries, top)


def _found(top: int, beam: int):
    """Function for mapInArrow over graphs and queries, sorted so that a graph's queries follow it: (query_id, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = vectors = ids = counts = starts = own = None
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
            is_query = batch.column(3).to_numpy(zero_copy_only=False) == 1
            lo = 0
            while lo < batch.num_rows:
                if not is_query[lo]:
                    row = {n: batch.column(k)[lo].as_py() for k, n in enumerate(batch.schema.names)}
                    vectors = np.frombuffer(row["vectors"], f"<f{row['width']}").reshape(-1, row["dim"])
                    graph = Graph(vectors, np.frombuffer(row["edges"], "<i4").reshape(len(vectors), -1).astype(np.int64), np.frombuffer(row["entries"], "<i4").astype(np.int64))
                    ids, counts, own = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["counts"], "<i4").astype(np.int64), key[lo]
                    starts = np.cumsum(counts) - counts
                    lo += 1
                    continue
                stop = np.flatnonzero(~is_query[lo:] | (key[lo:] != key[lo]).any(axis=1))
                hi = lo + int(stop[0]) if len(stop) else batch.num_rows
                if own is not None and (own == key[lo]).all():
                    names = batch.column(batch.schema.get_field_index("id")).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                    x = _matrix(batch.column(batch.schema.get_field_index("x")).slice(lo, hi - lo)).astype(np.float64)
                    out = [[], [], []]
                    for i, at, score in nearest(graph, vectors, x, beam):
                        n = counts[at]
                        ends = np.cumsum(n)
                        members = ids[np.repeat(starts[at] - (ends - n), n) + np.arange(int(n.sum()))]
                        score = np.repeat(score, n)
                        best = np.lexsort((members, -score))
                        best = best[members[best] != names[i]][:top]
                        for column, values in zip(out, (np.full(len(best), names[i], np.int64), members[best], score[best]), strict=True):
                            column.append(values)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])
                lo = hi

    return run


def searched(indexed: Index, queries: DataFrame, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` best found for each of queries (id, x), the query's own id left out."""
    ship(queries.sparkSession)
    graphs = indexed.graphs
    kind = _kind(queries)
    asked = queries.select("id", "x").mapInArrow(_dealt(indexed.centres, indexed.probes), f"id bigint, x {kind}, dim int, shard int")
    asked = asked.join(graphs.select("dim", "shard", "cut"), ["dim", "shard"])
    empty = [F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in INDEX.split(", ")[3:])]
    both = graphs.select("dim", "shard", "cut", F.lit(0).alias("kind"), *graphs.columns[3:], F.lit(None).cast("long").alias("id"), F.lit(None).cast(kind).alias("x"))
    both = both.unionByName(asked.select("dim", "shard", "cut", F.lit(1).alias("kind"), *empty, "id", "x"))
    tasks = max(1, graphs.count())
    near = both.repartition(tasks, "dim", "shard", "cut").sortWithinPartitions("dim", "shard", "cut", "kind").mapInArrow(_found(top, indexed.beam), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(rows: DataFrame, vector: str = "embedding", every: int = 20, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``, against all rows."""
    vectors = written(usable(rows, vector), "vectors")
    queries = vectors.where(F.col("id") % every == 0)
    return searched(index(vectors, queries, top), queries, top)
