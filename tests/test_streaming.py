"""Streams over small files."""
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from recollect.streaming import events as E


def _files(spark, path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp").coalesce(1).write.mode("append").parquet(str(path))
    return spark.read.parquet(str(path)).schema


def test_sessions_and_state_over_two_files(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    parts = [[(1, "view", t0 + timedelta(minutes=30 * i)) for i in range(3)], [(1, "view", t0 + timedelta(hours=9)), (2, "click", t0)]]
    schema = _files(spark, tmp_path / "in", parts)
    stream = lambda: E.read_events(spark, str(tmp_path / "in"), schema)
    got = {(r.user_id, r.n) for r in E.run_to_table(E.burst_sessions(stream(), late="10 days"), "s").collect()}
    assert got == {(1, 3), (1, 1), (2, 1)}
    last = E.run_to_table(E.access_patterns(stream()), "a", "update").groupBy("user_id").agg(F.max("n").alias("n")).collect()
    assert {(r.user_id, r.n) for r in last} == {(1, 4), (2, 1)}


def test_kept_versions(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("k", t0 + timedelta(minutes=m), c) for m, c in ((0, "Accessed"), (3, "Accessed"), (4, "ContentModified"), (6, "Accessed"), (10, "Accessed"))]
    spark.createDataFrame(rows, "key string, ts timestamp, change_type string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp, change_type string").parquet(str(tmp_path / "in"))
    got = E.run_to_table(E.kept_versions(stream), "v", "append").collect()
    assert sorted((r.ts.minute, r.change_type) for r in got) == [(0, "Accessed"), (4, "ContentModified"), (10, "Accessed")]


def test_upserts(spark, tmp_path):
    write, latest = E.upsert_batches(str(tmp_path / "t"))
    s = "key string, ts long, v int"
    write(spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], s), 0)
    write(spark.createDataFrame([("a", 2, 3)], s), 1)
    write(spark.createDataFrame([("a", 2, 3)], s), 1)
    assert sorted((r.key, r.v) for r in latest(spark).collect()) == [("a", 3), ("b", 2)]
