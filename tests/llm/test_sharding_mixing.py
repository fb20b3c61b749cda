import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing, sharding
from strandline.llm.common import shuffled

from .conftest import documents


def unit(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32


def sharding_bucket(key):
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def key_of(name, text):
    return hashlib.md5(f"strandline:{'' if name is None else name}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()


def brute_shards(rows, count):
    """rows: (doc_id, source, text)."""
    sources = defaultdict(list)
    for name, source, text in rows:
        key = key_of(name, text)
        sources[f"s:{source}" if source is not None else ""].append((key, name, len((text or "").encode()) + 16, zlib.crc32((text or "").encode())))
    placed = []
    for source, own in sources.items():
        for i, (key, name, size, crc) in enumerate(sorted(own, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2], r[3]))):
            placed.append(((i + unit(f"strandline:{source}")) / len(own), source, key, name, size, crc))
    placed.sort(key=lambda r: (*r[:3], -1 if r[3] is None else r[3], *r[4:]))
    out = []
    for p, r in enumerate(placed):
        shard = p * count // len(placed)
        out.append((r[3], r[4], r[5], shard, p - -(-shard * len(placed) // count)))
    return out


@pytest.mark.parametrize("bucket_rows", [20_000, 7])
def test_shards_equal_brute_force(sample, bucket_rows):
    docs = sample.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    got = sorted(tuple(r) for r in sharding.shards(docs, 40, bucket_rows=bucket_rows).select("doc_id", "size", "text_crc32", "shard", "slot").collect())
    assert got == sorted(brute_shards([(r.doc_id, r.source, r.text) for r in docs.collect()], 40))


def test_shards_match_the_mixture(sample):
    docs = sample.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.lit("rest")))
    rows = sharding.shards(docs, 10).collect()
    sizes, hot = Counter(r.shard for r in rows), Counter(r.shard for r in rows if r.source == "s:hot")
    assert max(sizes.values()) - min(sizes.values()) <= 1 and max(hot.values()) - min(hot.values()) <= 2
    for k in sizes:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))


def test_odd_shards(odd, nothing):
    got = sharding.shards(odd, 7, bucket_rows=3).collect()
    assert sorted((r.doc_id or -1, r.size, r.shard, r.slot) for r in got) == sorted((n or -1, s, k, t) for n, s, _, k, t in brute_shards([(r[0], r[3], r[1]) for r in documents()], 7))
    assert sharding.shards(nothing, 7).collect() == []


def test_mixture_meets_entropy_and_repetition():
    tokens = {"a": 10_000, "b": 1_000, "c": 100, "none": 0}
    flat = mixing.mixture(tokens, 11_100, entropy=0.95, repetition=None)
    entropy = -sum(w * math.log(w) for w in flat.weights.values())
    assert entropy == pytest.approx(0.95 * math.log(3), abs=1e-6) and sum(flat.weights.values()) == pytest.approx(1)
    bound = mixing.mixture(tokens, 11_100, entropy=0.95, repetition=3.0)
    assert max(bound.budgets[k] / tokens[k] for k in bound.budgets) == pytest.approx(3.0, rel=1e-2) and bound.power > flat.power
    whole = mixing.mixture(tokens)
    assert all(whole.budgets[k] >= tokens[k] for k in whole.budgets) and max(whole.budgets[k] / tokens[k] for k in whole.budgets) <= 2.001
    assert mixing.mixture({"a": 5}).budgets == {"a": 5} and mixing.mixture({}).weights == {}
    assert mixing.mixture(tokens, 1e9, None, 2.0).budgets == {k: 2 * n for k, n in tokens.items() if n}


def brute_mixed(rows, plan, block_tokens, block_rows, all_once):
    """(doc_id, pass, start) of each document given; rows: (doc_id, source, tokens, key)."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    out = []
    for source, budget in plan.budgets.items():
        own = [(key, n, t) for n, s, t, key in rows if f"s:{s}" == source]
        of = sum(t for *_, t in own)
        blocks = defaultdict(list)
        for key, n, t in own:
            blocks[int(int(key[:8], 16) / 2**32 * max(1, -(-of // block_tokens), -(-len(own) // block_rows)))].append((key, n, t))
        for p in range((budget - 1) // of + 1):
            at = p * of
            for b in sorted(blocks, key=lambda b: (md5(f"strandline:{source}:{p}:{b}"), b)):
                for _, t, n in sorted((md5(f"{p}:{key}"), t, n) for key, n, t in blocks[b]):
                    if at < budget or (all_once and p == 0):
                        out.append((n, p, at))
                    at += t
    return out


@pytest.mark.parametrize("budget, entropy, repetition", [(None, 0.97, 2.0), (60_000, 0.99, 5.0), (20_000, None, None)])
def test_mixed_equals_brute_force(sample, budget, entropy, repetition):
    docs = sample.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    rows = [(r.doc_id, r.source, len(r.text.encode().split()), key_of(r.doc_id, r.text)) for r in docs.collect()]
    tokens = Counter()
    for _, s, t, _ in rows:
        tokens[f"s:{s}"] += t
    plan = mixing.mixture(dict(tokens), budget, entropy, repetition)
    got = mixing.mixed(docs, budget=budget, entropy=entropy, repetition=repetition, block_tokens=1500, block_rows=9, carry=["doc_id"]).collect()
    assert sorted((r.row.doc_id, r["pass"], r.start) for r in got) == sorted(brute_mixed(rows, plan, 1500, 9, budget is None))
    assert all(r.place >= 0 and (r.start < plan.budgets[f"s:{r.source}"] or r.tokens == 0) for r in got)
    given = Counter()
    for r in got:
        given[f"s:{r.source}"] += r.tokens
    assert all(given[s] >= b for s, b in plan.budgets.items())


def test_documents_without_tokens_come_once_and_in_many_blocks(spark):
    rows = [(i, "some worded text" if i % 40 == 0 else "", "mixed") for i in range(1000)] + [(i, "", "empty") for i in range(1000, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(docs, block_rows=100).collect()
    assert Counter(r.row.doc_id for r in got) == Counter(range(3000))
    assert max(Counter((r.source, r.block) for r in got).values()) < 200


@pytest.mark.parametrize("name", ["cast(null as long)", "7L"])
def test_rows_of_one_id_are_spread(spark, name):
    """100,000 rows of one id, or of none: no bucket and no block holds more than twice its bound."""
    docs = spark.range(100_000).selectExpr(f"{name} doc_id", "concat('text ', id) text", "'one' source")
    keys = sharding.interleaved(docs, bucket_rows=1000)
    assert keys.count() == 100_000 and keys.select("position").distinct().count() == 100_000
    spread = docs.select(shuffled("strandline").alias("key")).groupBy(F.floor(sharding_bucket(F.col("key")) * 100)).count()
    assert spread.agg(F.max("count")).first()[0] < 2_000
    blocks = mixing.mixed(docs, block_rows=1000, carry=["doc_id"]).groupBy("block").count()
    assert blocks.agg(F.max("count")).first()[0] < 2_000


def test_odd_mixing(odd, nothing):
    got = mixing.remixed(odd)
    assert got.columns == odd.columns
    ids = Counter(r.doc_id for r in got.collect())
    assert set(ids) == {r[0] for r in documents()} and max(ids.values()) <= 4
    assert mixing.remixed(nothing).collect() == []
