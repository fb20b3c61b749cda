from strandline.plans import queries


def test_gaps_between_ids_lose_no_pair(spark, tmp_path):
    rows = [(i, [1.0, float(k)]) for k, i in enumerate((-3, 0, 1, 5, 1023, 1024, 9000))]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {r.vec_id: r.cosine for r in queries.cosine_adjacent(spark, str(tmp_path)).collect()}
    cosine = [round((1 + k * (k - 1)) / ((1 + k * k) * (1 + (k - 1) ** 2)) ** 0.5, 6) for k in range(1, 7)]
    assert found == dict(zip((0, 1, 5, 1023, 1024, 9000), cosine, strict=True))
