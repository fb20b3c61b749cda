import hashlib
import re
import unicodedata
from collections import Counter, defaultdict

import pytest

from strandline.llm import fingerprint

from .conftest import documents


def canon(text):
    folded = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    return re.sub(r"\s+", " ", folded).strip()


def edits(rows):
    """(id, text, edited, next text) in ascending order of ids."""
    for i, (name, text) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        yield name, text, text[: len(text) - half] + after[:half], after


@pytest.mark.parametrize("words, bits", [(3, 64), (1, 2)])
def test_equals_brute_force(sample, words, bits):
    rows = [(r.doc_id, r.text) for r in sample.orderBy("doc_id").limit(150).collect()]
    rows[7] = (rows[7][0], rows[6][1].upper() + "  ")
    docs = sample.sparkSession.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in fingerprint.fingerprints(docs, words, bits).collect()}
    names, texts = defaultdict(set), defaultdict(set)
    for name, text, edited, after in edits(rows):
        r = found[name]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.near_edited, r.near_next) == (canon(text) == canon(edited), canon(text) == canon(after))
        for t, f in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            names[canon(t)].add(f)
            texts[f].add(canon(t))
    assert all(len(v) == 1 for v in names.values()) and all(len(v) == 1 for v in texts.values())
    assert found[rows[6][0]].near_next == 1.0


def test_buckets_are_small_and_in_order(spark):
    ids = [*range(3000), *range(10**12, 10**12 + 2000), -(2**63), 2**63 - 1, *(7**k for k in range(20))]
    docs = spark.createDataFrame([(i,) for i in ids] + [(None,)], "doc_id long")
    for range_rows in (50_000, 100):
        rows = sorted((-(2**64) if r.doc_id is None else r.doc_id, r.bucket) for r in fingerprint.ordered_buckets(docs, 16, range_rows).collect())
        assert [b for _, b in rows] == sorted(b for _, b in rows)
    sizes = Counter(b for _, b in rows)
    assert max(sizes.values()) <= 160 and sizes[-1] == 1


def test_odd_documents(odd, nothing):
    found = fingerprint.fingerprints(odd).collect()
    assert len(found) == len(documents())
    by = defaultdict(list)
    for r in found:
        by[r.doc_id].append(r.fingerprint)
    assert by[100] == by[101] == by[102] and by[105][0] == by[105][1] and len(by[None]) == 2
    assert fingerprint.fingerprints(nothing).collect() == []


def test_main_path_is_native(sample):
    plan = fingerprint.fingerprints(sample.limit(5))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
