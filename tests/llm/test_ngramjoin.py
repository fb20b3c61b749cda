"""The n-gram join against all pairs by plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import ngramjoin

from .conftest import DOC


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    """(doc_id, n, component) by all pairs."""
    own = [sets(r[1]) for r in rows]
    part = list(range(len(rows)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(own):
        for j in range(i):
            both = len(a & own[j])
            if a and own[j] and 100 * both >= 80 * (len(a) + len(own[j]) - both):
                part[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], len(own[i]), least.get(root(i)) if own[i] else r[0]) for i, r in enumerate(rows)), key=repr)


def made(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 7, 8, 9, 12, 20, 60, 150, 300]))] for _ in range(30)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases[:3] if i % 3 == 0 else bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, max(1, len(words) // 25)])):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.choice([0, 1, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1, 1])
        if i % 5 == 0:
            words = words + passage
        if i % 17 == 0:
            words = passage * 2
        text = " ".join(words)
        rows.append((i * 3 + 1, text.upper() if i % 11 == 0 else text.replace(" ", "\n\t") if i % 7 == 0 else text, "en", "src", 1))
    return rows


@pytest.mark.parametrize(("rare", "most", "meet"), [(64, 1 << 18, 2000), (3, 1 << 18, 5), (1, 40, 2000), (0, 1 << 18, 3)])
def test_all_pairs(spark, rare, most, meet):
    rows = made(rare)
    found = ngramjoin.joined(spark.createDataFrame(rows, DOC), rare, most, meet).collect()
    assert sorted(map(tuple, found), key=repr) == plain(rows)


@pytest.mark.parametrize("share", [0.0, 0.3, 0.9, 1.0])
def test_signatures_of_similar_sets_meet(share):
    """Sets at the least similarity, of all sizes and shares of frequent shingles, have one in common."""
    rng = np.random.default_rng(int(share * 10))
    for n in [*range(4, 40), 63, 64, 100, 127, 128, 255, 400, 1023]:
        for _ in range(6):
            pool = np.unique(rng.integers(0, 1 << 63, 3 * n).astype(np.uint64) * np.uint64(2))
            pool = rng.permutation(pool)
            m = int(rng.integers(n, n * 5 // 4 + 1))
            both = -(-4 * (n + m) // 9)  # least overlap of a similarity of 0.8
            if both > n:
                continue
            one, two = np.sort(pool[:n]), np.sort(np.r_[pool[:both], pool[n : n + m - both]])
            rows, found = np.r_[np.zeros(n, np.int64), np.ones(m, np.int64)], np.r_[one, two]
            frequent = (found >> np.uint64(3)) % np.uint64(1000) < np.uint64(1000 * share)
            of, marks = ngramjoin.signatures(rows, found, np.array([n, m]), frequent)
            least = ngramjoin.SHARED if n >= ngramjoin.EXTENDED else 1
            assert len(set(marks[of == 0].tolist()) & set(marks[of == 1].tolist())) >= least, (n, m)
            assert len(marks) < 4 * (n + m)


def test_frequent_cells(spark):
    rows = [(i, "these five words are common here " + f"and {i} {i + 1} {i + 2} {i + 3} {i + 4}", "en", "s", 1) for i in range(100)]
    cells, width = ngramjoin.frequent_cells(spark.createDataFrame(rows, DOC).select("text"), 64)
    _, common = ngramjoin._ordered(pa.array(["these five words are common here and"]))
    assert sorted(cells.tolist()) == sorted((common >> np.uint64(32 - width)).astype(np.int64).tolist())
    assert len(ngramjoin.frequent_cells(spark.createDataFrame(rows, DOC).select("text"), 64, 2)[0]) <= 2


def test_odd(spark, odd):
    from .conftest import documents

    found = ngramjoin.joined(odd).collect()
    assert sorted(map(tuple, found), key=repr) == plain(documents())


def test_nothing(spark, nothing):
    assert ngramjoin.joined(nothing).count() == 0


def test_sample(spark, sample):
    """A whole table of the driver's, against all pairs."""
    rows = [tuple(r) for r in sample.collect()]
    assert sorted(map(tuple, ngramjoin.joined(sample).collect()), key=repr) == plain(rows)
