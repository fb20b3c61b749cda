import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import components, simhash

from .conftest import documents


def brute(text):
    import xxhash

    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def joined(pairs, nodes):
    of = {n: n for n in nodes}

    def top(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        of[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def signed(code):
    return int(np.array([code], np.uint64).view(np.int64)[0])


def near(codes, radius):
    a = np.array(list(codes.values()), np.uint64)
    names = list(codes)
    return [(names[i], names[j]) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius).tolist() if j > i]


def test_fingerprints_and_components(spark, sample):
    rows = [(r.doc_id, r.text) for r in sample.orderBy("doc_id").limit(300).collect()]
    rows += [(10_000 + i, rows[0][1]) for i in range(20)] + [(20_000, ""), (20_001, "! "), (20_002, "One TWO"), (20_003, "one two"), (20_004, None)]
    found = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    codes = {k: brute(t) for k, t in rows}
    assert {k: signed(c) for k, c in codes.items()} == {k: r.code for k, r in found.items()}
    assert {k: r.component_id for k, r in found.items()} == joined(near(codes, 2), codes)


def crowd(seed=1, n=1500):
    """Codes with dense neighbourhoods and with many that share a block."""
    rng, codes = random.Random(seed), {}
    bases = [rng.getrandbits(64) for _ in range(12)]
    while len(codes) < n:
        c = rng.choice(bases)
        for _ in range(rng.randint(0, 5)):
            c ^= 1 << rng.randrange(64)
        codes.setdefault(c, len(codes))
    return {v: k for k, v in codes.items()}


def test_links_connect_what_brute_force_connects(spark):
    codes = crowd()
    classes, name = spark.createDataFrame([(signed(c),) for c in codes.values()], "code long"), {signed(c): k for k, c in codes.items()}
    for radius, shard_rows in ((2, 100_000), (2, 5), (1, 5), (4, 40)):
        got = joined([(name[r.u], name[r.v]) for r in simhash.links(classes, radius, shard_rows).collect()], codes)
        assert got == joined(near(codes, radius), codes)


def test_a_crowd_in_one_block_is_divided_until_it_is_small(spark):
    rng = random.Random(3)
    codes = {k: rng.getrandbits(20) | 0xABC << 40 for k in range(400)}  # two blocks are the same in all
    codes = {k: c for k, c in codes.items() if c not in {codes[j] for j in range(k)}}
    name = {signed(c): k for k, c in codes.items()}
    data = spark.createDataFrame([(c,) for c in name], "code long")
    got = joined([(name[r.u], name[r.v]) for r in simhash.links(data, 2, 12).collect()], codes)
    assert got == joined(near(codes, 2), codes)


def test_rows_without_an_id_link_others(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(simhash, "fingerprint_column", lambda text: F.conv(text, 16, 10).cast("long"))
    rows = [(1, "0"), (None, "3"), (2, "F"), (None, "FF00"), (7, "FF000000000")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.code, r.component_id) for r in got) == [(0, 3, 1), (0, 0xFF00, None), (1, 0, 1), (2, 15, 1), (7, 0xFF000000000, 7)]


@settings(deadline=None, max_examples=30)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 255), min_size=1, max_size=60, unique=True), st.integers(0, 4))
def test_trees_find_every_pair(codes, radius):
    a = np.array(codes, np.uint64)
    found = {tuple(sorted(p)) for i, j in simhash.Forest(a, np.zeros(len(a), np.int64)).links(radius) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert found == {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if bin(codes[i] ^ codes[j]).count("1") <= radius}


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(500, 500 + i) for i in range(1, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain + star, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{500 + i: 500 for i in range(200)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


@settings(deadline=None, max_examples=30)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 3)), min_size=1, max_size=40, unique=True), st.integers(0, 90))
def test_trees_of_wide_codes_answer_queries(codes, radius):
    a = np.array([[c, c ^ x] for c, x in codes], np.uint64)
    asked = a[:5] ^ np.uint64(5)
    forest = simhash.Forest(a, np.zeros(len(a), np.int64))
    want = {(i, j, d) for i in range(len(asked)) for j in range(len(a)) if (d := int(np.bitwise_count(asked[i] ^ a[j]).sum())) <= radius}
    assert {t for q, m, d in forest.search(radius, of=asked, roots=np.zeros(len(asked), np.int64)) for t in zip(q.tolist(), m.tolist(), d.tolist(), strict=True)} == want
    some = np.arange(0, len(a), 2)
    want = {(int(i), j) for i in some for j in range(len(a)) if i != j and np.bitwise_count(a[i] ^ a[j]).sum() <= radius}
    assert {t for q, m, _ in forest.search(radius, queries=some) for t in zip(q.tolist(), m.tolist(), strict=True)} == want


def test_odd_documents(odd, nothing):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(documents())
    assert simhash.near_duplicates(nothing).collect() == []
