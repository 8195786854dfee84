"""A client's round: remember, recall, forget, state."""
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollect.api import Memory


def test_a_clients_round(spark):
    t = datetime(2024, 5, 1)
    m = Memory(spark)
    key = m.remember("the lighthouse keeper likes tea", t)
    m.remember("an old harbour", t - timedelta(days=400), key="old", importance=0.0)
    m.remember("the lighthouse burned down", t, key="new", tags=["fire"])
    assert key == Memory(spark).remember("the lighthouse keeper likes tea", t)
    found = [r.key for r in m.recall([("q", "lighthouse")], t + timedelta(hours=1), k=3).collect()]
    assert set(found[:2]) == {key, "new"}
    m.memories.rows = m.memories.rows.withColumn("custom_fields", F.when(F.col("key") == "new", F.create_map(F.lit("superseded"), F.lit("true"))).otherwise(F.col("custom_fields")))
    assert "new" not in [r.key for r in m.recall([("q", "lighthouse")], t, k=3).collect()]
    assert [r.key for r in m.forget(t + timedelta(hours=2)).collect()] == ["old"]
    assert sorted(r.key for r in m.statements().execute("SELECT key FROM memories").collect()) == sorted([key, "new"])
    for bad in (lambda: m.remember("", t), lambda: m.remember("x", t, importance=2.0), lambda: m.recall([("q", " ")], t), lambda: m.recall([("q", "x")], t, k=0), lambda: m.forget(t, 2.0)):
        with pytest.raises(ValueError):
            bad()


def test_many_texts_are_remembered_as_one_by_one(spark):
    t = datetime(2024, 5, 1)
    one, many = Memory(spark), Memory(spark)
    texts = ["the lighthouse keeper likes tea", "an old harbour", "an old harbour"]
    for x in texts:
        one.remember(x, t)
    keys = many.remember_all(spark.createDataFrame([(x, "clash") for x in [*texts, "", None]], "value string, importance string"), t)
    rows = lambda m: sorted(m.memories.rows.select("key", "value", "memory_type", "created_at", "access_count", "importance", "confidence").collect())
    assert rows(one) == rows(many) and sorted(r.key for r in keys.collect()) == [r.key for r in rows(many)]
    named = spark.createDataFrame([("k", "b", ["x"]), ("k", "a", ["y"])], "key string, value string, tags array<string>")
    many.remember_all(named, t, 0.9)
    assert [(r.value, r.tags, r.importance) for r in many.memories.rows.filter("key = 'k'").collect()] == [("a", ["y"], 0.9)]
    with pytest.raises(ValueError):
        many.remember_all(named, t, 2.0)
