import __spark_entry__ as entry


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_is_lazy_and_has_a_schema(spark, monkeypatch, tmp_path):
    rows = [(i, [float(i % 3), 1.0, float(i)], i % 10) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["knn_batch_topk"](spark, str(tmp_path))
    assert got.columns == ["qid", "id", "score", "rank"] and got.count() == 30
