import numpy as np
import pyarrow as pa

from strandline.llm import ann


def exact(rows, queries, top):
    """rows: id -> vector."""
    names = sorted(rows)
    x = np.array([rows[n] for n in names], np.float64)
    out = {}
    for q in queries:
        score = x @ np.asarray(rows[q], np.float64)
        order = np.lexsort((names, -score))
        out[q] = [(names[i], score[i]) for i in order if names[i] != q][:top]
    return out


def test_recall_and_scores(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: r.embedding for r in table.collect()}
    want = exact(rows, [n for n in rows if n % 20 == 0], 20)
    got = {}
    for r in ann.neighbours(table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [r.rank for r in found] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        assert all(abs(r.score - np.dot(np.float64(rows[q]), np.float64(rows[r.vec_id]))) < 1e-12 for r in found)
        hits += len({r.vec_id for r in found} & {n for n, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def recall(spark, x, top=20, **options):
    names = np.arange(len(x))
    data = spark.createDataFrame(pa.table([pa.array(names), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float32()))], names=["vec_id", "embedding"]))
    vectors = ann.usable(data, "embedding")
    queries = vectors.where("id % 100 = 0")
    made = ann.index(vectors, queries, top, **options)
    got = {}
    for r in ann.searched(made, queries, top).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact({i: x[i] for i in names}, names[::100].tolist(), top)
    return made, np.mean([len(got[q] & {n for n, _ in found}) / top for q, found in want.items()])


def test_recall_in_one_large_shard_with_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 24)).astype(np.float32)
    x = np.concatenate([x, x[:300], np.repeat(x[:1], 400, axis=0)])
    made, found = recall(spark, x, least_rows=20_000)
    assert made.graphs.count() == 1 and found >= 0.9 and abs(found - made.recall) < 0.06


def test_queries_ask_as_few_shards_as_hold_their_neighbours(spark):
    rng = np.random.default_rng(6)
    middles = 4 * rng.normal(size=(40, 16))
    x = (middles[rng.integers(0, 40, 8_000)] + rng.normal(size=(8_000, 16))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:3000] = middles[0] / np.linalg.norm(middles[0]) + 0.01 * rng.normal(size=(3000, 16))  # a hot cluster, whose shards are cut
    made, found = recall(spark, x, least_rows=100, shard_rows=200)
    assert found >= 0.9 and len(made.centres[16]) == 40 and made.probes[16] <= 20 and made.graphs.count() > 40


def test_norms_matter():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.1, 5, (3000, 1))
    graph = ann.Graph(x).build()
    q = rng.normal(size=(50, 16))
    found = {i: set(ids[np.argsort(-score)[:20]].tolist()) for i, ids, score in ann.nearest(graph, x, q, 128)}
    want = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(found[i] & set(want[i].tolist())) / 20 for i in range(50)]) >= 0.9


def test_every_point_is_reached():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(200, 4)) + 100 * k for k in range(4)])
    graph = ann.Graph(x).build(degree=4, beam=8)
    found = next(iter(ann.nearest(graph, x, x[:1], len(x))))[1]
    assert sorted(found.tolist()) == list(range(800))


def test_copies_ties_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0], 0) for i in range(0, 60)] + [(100, [0.5, 0.5], 0), (120, [0.0, 2.0], 1), (140, None, 0), (160, [0.0, 0.0], 0), (180, [nan, 1.0], 0), (200, [inf, 1.0], 0), (220, [None, 1.0], 0), (240, [], 0), (None, [1.0, 1.0], 0), (260, [1.0, 2.0, 3.0], 0), (120, [0.0, 2.0], 1)]
    data = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, ids string, shard int")
    got = {}
    for r in ann.neighbours(data).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    usable = {i: [1.0, 0.0] for i in range(60)} | {100: [0.5, 0.5], 120: [0.0, 2.0]}
    assert got == exact(usable, [0, 20, 40, 100, 120], 20)
    few = data.where("vec_id >= 100")
    assert {q: n for q, n in ((r.query_id, r.vec_id) for r in ann.neighbours(few).collect())} == {100: 120, 120: 100}
    assert ann.neighbours(data.limit(0)).collect() == []
