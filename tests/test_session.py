from parley import session


def test_a_larger_file_is_dealt_to_more_tasks_than_cores(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows.parquet")
    spark.range(20000).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(rows, path).rdd.getNumPartitions() == cores
    monkeypatch.setattr(session, "DEAL_BYTES", 1 << 10)
    dealt = session.spread(rows, path)
    assert dealt.rdd.getNumPartitions() > cores and dealt.count() == 20000
