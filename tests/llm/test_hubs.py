"""A large group of near copies, some of which are not like enough to the others: no row a pair."""

import random

from strandline.llm import nearcopies

from .test_nearcopies import altered, survivors


def test_rest_of_a_group_has_no_rows_of_pairs(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"b{i}" for i in range(250)]
    rows = [(0, " ".join(base))] + [(1 + i, altered(rng, base, 1 + i % 3)) for i in range(200)] + [(1000 + i, altered(rng, base, 6 + i % 2)) for i in range(100)]
    # Of two that the base is not like, one is made from the other.
    rows += [(2000 + i, altered(rng, rows[201 + i][1].split(), 1)) for i in range(40)]
    tables, write = {}, nearcopies.written
    monkeypatch.setattr(nearcopies, "written", lambda df, label, **options: tables.setdefault(label, write(df, label, **options)))
    found = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    least = {}
    for r in found:
        least[r.component] = min(r.doc_id, least.get(r.component, r.doc_id))
    assert sorted(least.values()) == survivors(rows)[0]
    assert tables["others"].count() < len(rows)
