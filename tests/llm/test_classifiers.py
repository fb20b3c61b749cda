import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import quality, toxicity
from strandline.llm.labelled import Logistic

from .conftest import documents


def auc(rows):
    """Of (score, label)."""
    rank = np.argsort(np.argsort([s for s, _ in rows])) + 1
    y = np.array([label for _, label in rows])
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def labelled(spark, n=600):
    """Plain documents; every third has insults, every fourth shouts."""
    rng = np.random.default_rng(0)
    words = ["river", "stone", "cloud", "paper", "lamp", "green", "walks", "under", "seldom", "bright"]
    docs, labels = [], []
    for i in range(n):
        text = [str(w) for w in rng.choice(words, rng.integers(5, 60))]
        toxic, good = i % 3 == 0, i % 4 != 0
        if toxic:
            text[len(text) // 2] = f"grubbish{rng.choice(['er', 'est', 'ly'])}"
        docs.append((i, " ".join(text) if good else " ".join(f"{w.upper()}!!" for w in text), "en", "s", 1))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label, modulus, held", [(toxicity, 2, 4, 2), (quality, 1, 5, 0)])
def test_held_out_accuracy(spark, module, label, modulus, held):
    docs, labels = labelled(spark)
    rows = {r.doc_id: r for r in module.scored(docs, labels).collect()}
    truth = {r[0]: r[label] for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % modulus == held) for k, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    unseen = [(r.score, truth[k]) for k, r in rows.items() if r.held_out]
    assert auc(unseen) > 0.98
    assert np.mean([(s >= 0.3) == t for s, t in unseen]) > 0.95


@pytest.mark.parametrize("module", [toxicity, quality])
def test_held_out_labels_and_other_columns_do_not_matter(spark, module):
    docs, labels = labelled(spark, 300)
    held = {toxicity: lambda i: zlib.crc32(str(i).encode()) % 4 == 2, quality: lambda i: zlib.crc32(str(i).encode()) % 5 == 0}[module]
    changed = spark.createDataFrame([(r.doc_id, 1 - r.quality, 1 - r.toxic) if held(r.doc_id) else tuple(r) for r in labels.collect()], labels.schema)
    from pyspark.sql import functions as F

    a = {r.doc_id: r.score for r in module.scored(docs, labels).collect()}
    b = {r.doc_id: r.score for r in module.scored(docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None)}), changed).collect()}
    assert a == pytest.approx(b)


@pytest.mark.parametrize("module, alone", [(toxicity, 0.0), (quality, 1.0)])
def test_odd_documents(spark, odd, nothing, module, alone):
    _, labels = labelled(spark, 40)
    assert len(module.scored(odd, labels).collect()) == len(documents())
    none = labels.limit(0)
    assert {r.score for r in module.scored(odd, none).collect()} == {alone}
    kept = module.kept(odd, none)
    assert kept.columns == odd.columns and kept.count() == len(documents())
    assert module.scored(nothing, labels).collect() == [] and module.kept(nothing, none).collect() == []
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None), (1, 0, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(module.scored(odd, nulls.unionByName(labels)).collect()) == len(documents())


def test_kneser_ney_is_a_distribution():
    words = ["aba", "abc", "bab", "caa"] * 3 + ["abab"]
    keys, _ = toxicity.ngrams(words)
    grams, counts = np.unique(keys, return_counts=True)
    model = toxicity.Model(grams, counts, np.zeros(len(grams), int))
    shared = model._shared(counts.astype(float))
    # Within each context the shared model's mass of seen bytes is below 1, the rest is for bytes unseen.
    for context in np.unique(model.keys >> 8):
        assert 0 < shared[model.keys >> 8 == context].sum() <= 1 + 1e-9
    both = toxicity.Model(grams, counts, counts)
    assert np.allclose(both.words(words), 0, atol=1e-6)


def plain_kneser_ney(toxic, ordinary, context=toxicity.CONTEXT):
    """Evidence of a word by dictionaries, straight from the definition."""
    from collections import Counter

    def grams(word):
        data = b"\x01" + word.encode() + b"\x01"
        return [(data[max(0, i - context) : i], data[i]) for i in range(1, len(data))]

    counts = [Counter(g for w in words for g in grams(w)) for words in (toxic, ordinary)]

    def discount(values):
        once, twice = sum(v == 1 for v in values), sum(v == 2 for v in values)
        return min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5

    levels = [counts[0] + counts[1]]
    for size in range(context - 1, -1, -1):
        level = Counter()
        for (before, byte), n in levels[-1].items():
            short = before[-size:] if size else b""
            level[short, byte] += n if short == before else 1
        levels.append(level)

    def shared(before, byte, depth=1):
        if depth > context:
            return 1 / 256
        size, level = context - depth, levels[depth]
        before = before[-size:] if size else b""
        own = {b: n for (c, b), n in level.items() if c == before}
        d = discount(level.values())
        return max(own.get(byte, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * shared(before, byte, depth + 1)

    def log_likelihood(count, before, byte):
        own = {b: n for (c, b), n in count.items() if c == before}
        d, total = discount(count.values()), sum(own.values())
        left = d * len(own) / total if total else 1.0
        if (before, byte) in levels[0]:
            return np.log((max(own.get(byte, 0) - d, 0) / total if total else 0) + left * shared(before, byte))
        return np.log(left)  # of what neither class has seen only the backoff differs

    return lambda word: np.clip(sum(log_likelihood(counts[0], *g) - log_likelihood(counts[1], *g) for g in grams(word)), -toxicity.CLIP, toxicity.CLIP)


def test_evidence_equals_plain_kneser_ney():
    rng = np.random.default_rng(4)
    draw = lambda n, letters: ["".join(rng.choice(list(letters), rng.integers(1, 9))) for _ in range(n)]
    toxic, ordinary = draw(60, "abcde"), draw(90, "bcdefg")
    (kt, _), (ko, _) = toxicity.ngrams(toxic), toxicity.ngrams(ordinary)
    keys = np.unique(np.r_[kt, ko])
    model = toxicity.Model(keys, *(np.bincount(np.searchsorted(keys, k), minlength=len(keys)) for k in (kt, ko)))
    words = toxic[:20] + ordinary[:20] + draw(40, "abcdefgh")
    plain = plain_kneser_ney(toxic, ordinary)
    assert model.words(words) == pytest.approx([plain(w) for w in words], abs=1e-4)


def test_a_model_too_large_to_broadcast_scores_alike(spark, odd):
    docs, labels = labelled(spark, 240)
    docs = docs.unionByName(odd.select(docs.columns))
    order = ["doc_id", "score"]
    a, b = (toxicity.scored(docs, labels, most=most).orderBy(*order).collect() for most in (toxicity.NGRAMS, 10))
    assert isinstance(toxicity.fitted(docs, labels, most=10).model, toxicity.Tables)
    assert [r.doc_id for r in a] == [r.doc_id for r in b] and [r.score for r in a] == pytest.approx([r.score for r in b], abs=1e-4)


def test_ngrams_stay_within_words():
    keys, word = toxicity.ngrams(["ab", "c"])
    assert word.tolist() == [0, 0, 0, 1, 1]
    # The byte itself is lowest, then those before it from the nearest on, up to the word's beginning.
    assert keys.tolist() == [97 | 1 << 8, 98 | 97 << 8 | 1 << 16, 1 | 98 << 8 | 97 << 16 | 1 << 24, 99 | 1 << 8, 1 | 99 << 8 | 1 << 16]


def test_indicators_are_sets():
    row, feature = quality.indicators(pa.array(["ab ab ab", "", None, "AB 12!"]))
    pairs = list(zip(row.tolist(), feature.tolist(), strict=True))
    assert len(set(pairs)) == len(pairs) and set(row.tolist()) == {0, 3}
    again, f2 = quality.indicators(pa.array(["AB 12!"]))
    assert f2.tolist() == [f for r, f in pairs if r == 3]


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    features = [np.sort(rng.choice(50, 5, replace=False)) + (50 * k) for k in (0, 1) for _ in range(40)]
    y = np.array([1] * 40 + [-1] * 40)
    w = quality.dual_coordinate_descent(features, [np.full(5, 5**-0.5)] * 80, y, np.full(80, 1.0))
    assert all((w[f].sum() / 5**0.5 + w[-1]) * v > 0 for f, v in zip(features, y, strict=True))


def test_ratios_and_dual_equal_plain_versions():
    """Log-count ratios by counting; the dual's optimum by the primal objective of a plain subgradient search."""
    rng = np.random.default_rng(2)
    y = np.array([1, 0] * 30)
    features = [np.unique(rng.choice(40, 8) + 10 * int(v)) for v in y]
    ratio = quality.naive_bayes_ratio(features, y)
    for f in range(60):
        of = [sum(f in x for x, v in zip(features, y, strict=True) if v == k) + quality.SMOOTHING for k in (1, 0)]
        total = [sum(len(x) for x, v in zip(features, y, strict=True) if v == k) + quality.SMOOTHING * quality.SIZE for k in (1, 0)]
        assert ratio[f] == pytest.approx(np.log(of[0] / total[0]) - np.log(of[1] / total[1]))
    values = [ratio[f] / np.linalg.norm(ratio[f]) for f in features]
    sign, cost = np.where(y == 1, 1.0, -1.0), np.full(60, 0.7)
    w = quality.dual_coordinate_descent(features, values, sign, cost, epochs=400)
    x = np.zeros((60, 61))
    for i, (f, v) in enumerate(zip(features, values, strict=True)):
        x[i, f], x[i, 60] = v, 1.0
    objective = lambda u: u @ u / 2 + (cost * np.maximum(0, 1 - sign * (x @ u))).sum()
    u = best = np.zeros(61)
    for k in range(1, 20_001):
        u = u - (u - x.T @ (cost * sign * (sign * (x @ u) < 1))) / (k + 1)
        best = min(best, u, key=objective)
    assert objective(np.r_[w[:60], w[-1]]) <= objective(best) * (1 + 1e-3)


def test_logistic():
    x = np.r_[np.random.default_rng(0).normal(0, 1, (200, 1)), np.random.default_rng(1).normal(3, 1, (200, 1))]
    p = Logistic(x, np.r_[np.zeros(200), np.ones(200)])(x)
    assert ((p > 0.5) == np.r_[np.zeros(200), np.ones(200)]).mean() > 0.9


def test_logistic_holds_on_classes_that_are_nearly_apart():
    rng = np.random.default_rng(0)
    y = (rng.random(20_000) < 0.1).astype(float)
    common = rng.normal(0, 1, 20_000)
    x = np.stack([y * rng.exponential(5, 20_000) + rng.normal(0, 1e-3, 20_000), y * 2 + 1e-3 * common, y * 7 + 1e-2 * common, common], axis=1)
    x[:20] = 0
    p = Logistic(x, y)(x)
    assert ((p >= 0.3) == y).mean() > 0.999 and np.abs(Logistic(x, y).w).max() < 1e3
