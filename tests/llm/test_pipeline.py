import ast
from pathlib import Path

import corpus_pipeline
from strandline.llm import fingerprint, mixing, packing, quality, queries, toxicity

from .test_nearcopies import survivors

ROOT = Path(__file__).resolve().parents[2]
DATA = "/root/testdata/sf0.01"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = first = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, DATA).cache()
        assert out.columns == first.columns and 0 < out.count()
        if k == 0:
            rejected = {r.doc_id for r in toxicity.scored(docs, labels).where("predicted = 1").collect()}
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - rejected
        elif k == 1:
            kept = {r.doc_id for r in quality.scored(docs, labels).where("predicted = 1").collect()}
            assert {r.doc_id for r in out.collect()} == kept
        elif k == 2:
            assert sorted(r.doc_id for r in out.collect()) == survivors([(r.doc_id, r.text) for r in docs.collect()])[0]
        else:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} and out.count() >= docs.count()
            assert mixing.REPETITION == 2.0
        docs = out
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert sum(r.length for r in placed.where("piece = 0").collect()) > 0
    assert {r.doc_id for r in placed.collect()} == {r.doc_id for r in docs.collect()}
    assert packing.CAPACITY == max(r.n for r in placed.groupBy("sequence_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids_crc32"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "strandline").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


def test_queries_are_named():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert fingerprint.WORDS == 3
