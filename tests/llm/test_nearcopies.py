import random

import corpus_pipeline
import numpy as np
from strandline.llm import nearcopies

from .test_simhash import joined


def shingled(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def survivors(rows):
    """Least id of each component, by comparing all pairs."""
    sets = {k: shingled(t) for k, t in rows}
    names = list(sets)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if similar(sets[a], sets[b])]
    return sorted(set(joined(pairs, names).values())), pairs


def altered(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def test_the_stage_finds_what_brute_force_finds(spark, sample):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in sample.where("doc_id < 250").collect()]
    for words in [t.split()[:150] for _, t in rows if t and len(t.split()) >= 150][:40]:
        rows += [(10_000 + len(rows) + k, altered(rng, words, k)) for k in range(5)]
    # Chains, a large group, a line that all of a group has, short texts, and texts without words.
    base = [f"b{i}" for i in range(120)]
    rows += [(20_000 + i, altered(rng, base, 1 + i % 2)) for i in range(60)]
    rows += [(30_000 + i, "the very same line of words " * 3 + " ".join(f"l{rng.randrange(10**6)}" for _ in range(3 + i % 9))) for i in range(40)]
    rows += [(40_000, ""), (40_001, " \n"), (40_002, None), (40_003, "One two"), (40_004, "one TWO"), (40_005, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected, pairs = survivors(rows)
    assert len(pairs) > 200
    assert sorted(r.doc_id for r in corpus_pipeline.without_copies(spark, docs, "").collect()) == expected
    # Shards in slices find the same.
    whole, cut = ({(r.doc_id, r.component) for r in nearcopies.near_copies(docs, n).collect()} for n in (nearcopies.SLICE_ROWS, 6))
    assert whole == cut


def test_fingerprints_equal_brute_force():
    rng = np.random.default_rng(0)
    n = np.array([0, 1, 2, 255, 256, 700, 0], np.int64)
    found = rng.integers(0, 2**63, int(n.sum()), dtype=np.uint64)
    got, at = nearcopies.fingerprints(found, n), 0
    for row, k in zip(got, n.tolist(), strict=True):
        for word in range(nearcopies.WORDS):
            own = nearcopies._stirred(found[at : at + k] + nearcopies._SALTS[word]).tolist()
            assert int(row[word]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > k)
        at += k


def test_recall_at_the_least_similarity():
    """Pairs of sets at a Jaccard similarity of 0.8: in one shard and within the radius, as blocks for many sets deal them."""
    rng, pairs = np.random.default_rng(1), 1500
    a = rng.integers(0, 2**63, (pairs, 250), dtype=np.uint64)
    b = a.copy()
    b[:, :28] = rng.integers(0, 2**63, (pairs, 28), dtype=np.uint64)  # 222 of 278
    n = np.full(pairs, 250)
    x, y = (nearcopies.fingerprints(s.reshape(-1), n) for s in (a, b))
    apart = np.bitwise_count(x ^ y)
    near = (apart.sum(axis=1) <= nearcopies.RADIUS) & (apart[:, : nearcopies.TREE_WORDS].sum(axis=1) <= nearcopies.TREE_RADIUS)
    assert near.mean() > 0.99
    same = np.unpackbits((x ^ y).view(np.uint8), axis=1, bitorder="little") == 0
    for sets in (10**5, 10**7):
        met = np.any([same[:, c].all(axis=1) for c in nearcopies.blocks(sets)], axis=0)
        assert (met & near).mean() > 0.97, sets


def test_odd_rows(odd, nothing, spark):
    kept = nearcopies.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    # Of the rows without an id one is empty, as 100 is.
    assert ids.count(None) == 1 and len(set(ids) - {None}) == len(ids) - 1 and {100, 103, 104, 105, 106} <= set(ids) and not {101, 102} & set(ids)
    assert nearcopies.deduplicated(nothing).collect() == []
    both = spark.createDataFrame([(1, "one text of several quite different words"), (1, "and something else that isn't like it at all")] * 2, "doc_id long, text string")
    assert len(nearcopies.deduplicated(both).collect()) == 2
