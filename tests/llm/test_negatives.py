"""Hard negatives against brute force, by plain Python and by the query's SQL."""

import math
import random

import duckdb
import numpy as np
import pytest

from strandline.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, score string, anchor int"


def plain(rows):
    usable = []
    for i, vector, label, *_ in dict.fromkeys((r[0], None if r[1] is None else tuple(r[1]), r[2]) for r in rows):
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(float(np.float32(x)) * 256) for x in vector]
        if max(map(abs, whole), default=0) ** 2 * len(whole) < 9.2e18:
            usable.append((i, (label + 1) % 10 if i % 7 == 0 else label, whole))
    out = []
    for anchor in usable:
        if anchor[0] % 50:
            continue
        near = [(-sum(a * b for a, b in zip(anchor[2], r[2], strict=True)), r[0], r[1]) for r in usable if r is not anchor and len(r[2]) == len(anchor[2])]
        for score, positive, _ in sorted(r for r in near if r[2] == anchor[1])[:5]:
            hard = sorted(r for r in near if r[2] != anchor[1] and 50 * -score <= 100 * -r[0] <= 95 * -score)[:3]
            out += [(anchor[0], positive, k, n, -score, -s) for k, (s, n, _) in enumerate(hard, 1)]
    return sorted(out)


def made(n, width, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width)) * scale
    label = rng.integers(0, 8, n)
    vectors = (centres[label] + rng.normal(size=(n, width)) * 0.5 * scale).astype(np.float32)
    return [(int(i), [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(vectors, label, strict=True))]


def of(spark, rows):
    return spark.createDataFrame([(*r, "extra", 7) for r in rows], SCHEMA)


def test_plain(spark):
    rows = made(900, 6, 1)
    rows += [(1000 + i, rows[50][1], i % 3) for i in range(400)] + [rows[0]] * 3 + [(0, rows[3][1], 1), (100, rows[4][1], 2)]  # copies, ties, repeats of rows and ids
    rows += [(3000, None, 1), (3050, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (3100, [float("nan")] * 6, 1), (3150, [float("inf")] * 6, 0), (3200, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(3250 + i, [1.0 * i, 2.0], i % 2) for i in range(101)] + [(4000 + 50 * i, [], i % 2) for i in range(3)] + [(5000, [1e30] * 6, 1), (5050, [0.0] * 6, 3), (-50, [1.0, 1.0], 0)]
    random.Random(1).shuffle(rows)
    found = negatives.of_embeddings(of(spark, rows)).collect()
    assert sorted(map(tuple, found)) == plain(rows)


def test_blocks_and_large_scores(spark):
    """Sums beyond 2**53, over many blocks."""
    rows = made(700, 3, 2, 3e5)
    df = of(spark, rows).select(negatives.F.col("vec_id").alias("id"), "label", negatives.whole_numbers(negatives.F.col("embedding")).alias("vector"))
    moved = negatives.F.when(negatives.F.col("id") % 7 == 0, (negatives.F.col("label") + 1) % 10).otherwise(negatives.F.col("label"))
    found = negatives.hard_negatives(df.withColumn("label", moved), negatives.F.col("id") % 50 == 0, block_rows=60).collect()
    assert max(r["positive_score"] for r in found) > 2**53
    assert sorted(map(tuple, found)) == plain(rows)


@pytest.mark.parametrize("same", [True, False])
def test_pruning(same):
    """Far clusters are left out; what is found is what brute force finds."""
    rng = np.random.default_rng(3)
    label = rng.integers(0, 6, 6000)
    vectors = np.floor((rng.normal(size=(6, 3))[label] * 6 + rng.normal(size=(6000, 3))) * 256).astype(np.int64)
    forest = negatives.Forest(np.arange(6000), label, vectors, 4)
    asks = np.arange(0, 6000, 60)
    scores = vectors[asks] @ vectors.T
    ok = (label[asks][:, None] == label) if same else (label[asks][:, None] != label)
    ok[np.arange(100), asks] = False
    high = np.full(100, negatives._MOST) if same else np.maximum(0, (scores * ok).max(axis=1) * 8 // 10)
    low = np.full(100, negatives._NONE) if same else high // 2
    ok &= (scores >= low[:, None]) & (scores <= high[:, None])
    expected = {(q, i, int(scores[q, i])) for q in range(100) for i in sorted(np.flatnonzero(ok[q]), key=lambda i: (-scores[q, i], i))[:3]}
    q, i, s = forest.search(asks, label[asks], vectors[asks], low, high, 3, same)
    assert set(zip(q.tolist(), i.tolist(), s.tolist(), strict=True)) == expected
    leaves = sum(int(x.sum()) for x in forest.leaf) * 100 / (6 if same else 1.2)
    assert forest.looked_at < 0.4 * leaves


def test_sql(spark):
    rows = made(600, 5, 4) + [(1000, None, 1), (1050, [1.0, None, 1.0, 1.0, 1.0], 1), (1100, [1.0] * 5, None), (1150, [0.5] * 5, 3)]
    df = of(spark, rows)
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    found = negatives.of_embeddings(df)
    names = ", ".join(found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(f"SELECT {names} FROM ({queries.oracle_sql()['op11_negatives']})").fetchall())


def test_nothing(spark):
    assert negatives.of_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.of_embeddings(of(spark, [(50, [1.0], 1)])).count() == 0
