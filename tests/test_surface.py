"""Statements, profiles, private statistics, clusters and stores on small tables."""
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recollect.functions import facts as N
from recollect.operators import learning as L
from recollect.operators import profiles as P
from recollect.operators.statements import Statements, format_table, match_sql
from recollect.sources import store as K


@pytest.fixture
def statements(spark):
    edges = spark.createDataFrame([("a", "b", "x", 0.9), ("b", "c", "x", 0.4), ("c", "a", "y", 0.7)], "src string, dst string, rel_type string, strength double")
    memories = spark.createDataFrame([("a", "first", 0.1), ("b", "second", None)], "key string, value string, importance double")
    return Statements(spark, {"edges": edges, "memories": memories})


def test_patterns(statements):
    rows = lambda t: sorted(tuple(r) for r in statements.execute(t).collect())
    assert rows("MATCH (p)-[:x]->(q)-[:x]->(r) RETURN p.key, r.key") == [("a", "c")]
    assert rows("match (p)-[e]-(q {key: 'a'}) return p.key, e.rel_type") == [("b", "x"), ("c", "y")]
    assert rows("MATCH (p)-[:x*1..2]->(q) WHERE q.key <> 'b' RETURN p.key, q.key") == [("a", "c"), ("b", "c")]
    assert rows("MATCH (p)-[]->(q)-[]->(r)-[]->(p) RETURN p.key") == [("a",), ("b",), ("c",)]
    assert rows("MATCH (p)<-[e:y]-(q) RETURN p.key, q.key ORDER BY e.strength LIMIT 1") == [("a", "c")]
    for bad in ("MATCH (p)", "MATCH (p)-[:x]->(q)", "MATCH (p)<-[:x]->(q) RETURN p.key", "MATCH (p)-[:x*1..99]->(q) RETURN p.key"):
        with pytest.raises(ValueError):
            match_sql(bad)


def test_changes_and_their_counts(statements):
    assert statements.execute("CREATE MEMORY 'a' VALUE 'it''s new'").first()[0] == 1
    assert statements.execute("UPDATE MEMORIES SET value = 'x, y = z', importance = 0.5 WHERE key = 'b'").first()[0] == 1
    assert {r.key: (r.value, r.importance) for r in statements.execute("SELECT * FROM memories").collect()} == {"a": ("it's new", None), "b": ("x, y = z", 0.5)}
    assert statements.execute("DELETE FROM MEMORIES WHERE importance > 0").first()[0] == 1
    assert [r.key for r in statements.execute("SELECT key FROM memories").collect()] == ["a"]
    assert [r.name for r in statements.execute("SHOW TABLES").collect()] == ["edges", "memories"]
    assert statements.execute("EXPLAIN SELECT key FROM memories").filter("text like '%Physical Plan%'").count() == 1
    assert statements.validate("UPDATE MEMORIES SET x = 1") == (False, "malformed UPDATE MEMORIES") and statements.validate("SHOW TABLES") == (True, None)
    assert statements.complete("SELECT imp") == ["importance"] and "MATCH" in statements.complete("ma") and statements.complete("") == []
    with pytest.raises(ValueError):
        statements.execute("DROP EVERYTHING")


def test_tables_as_text(spark):
    text = format_table(spark.createDataFrame([(1, "x" * 50), (2, None)], "n int, s string"), width=5)
    assert text.splitlines()[1] == "| n | s     |" and "| 1 | xxxx… |" in text and "| 2 |       |" in text


def test_longest_phrase_at_the_end_counts():
    assert N.extract_relations("Alice has recently relocated to Berlin") == [("Alice", "lives_in", "Berlin")]
    assert N.normalize_predicate("who was born in") == "born_in" and N.normalize_predicate("is") is None and N.normalize_predicate("") is None


def test_compression_keeps_what_is_worth_it(spark):
    m = spark.createDataFrame([("long", "abc " * 100), ("short", "x"), ("null", None), ("empty", "")], "key string, value string")
    c = P.compressed(m)
    assert [(r.key, r.original_size) for r in c.select("key", "original_size").collect()] == [("long", 400)]
    assert P.decompressed(c).first().value == "abc " * 100


def test_private_statistics_come_near_the_truth(spark):
    m = spark.createDataFrame([(str(i), "x" * i) for i in range(1, 101)], "key string, value string")
    h = {r.bin: r["count"] for r in P.private_histogram(m, 1000.0, bins=4).collect()}
    assert len(h) == 4 and [round(h[i]) for i in range(4)] == [24, 25, 25, 26]
    assert abs(P.private_quantile(m, 1e6, 0.5).first()[0] - 51) < 1
    assert P.private_histogram(m.limit(0), 1000.0, bins=2).count() == 2 and P.private_quantile(m.limit(0), 1e6, 0.5).first()[0] < 1
    t = m.withColumn("value", F.lit("A" * 4000)).limit(1).select(P.private_text(F.col("value"), math.log(3)).alias("v"))
    assert abs(t.first().v.count("A") / 4000 - 0.75) < 0.03 and t.first().v == t.first().v
    for f in (lambda: P.private_histogram(m, 0.0), lambda: P.private_quantile(m, -1.0, 0.5), lambda: P.private_text(F.col("value"), 0.0)):
        with pytest.raises(ValueError):
            f()


def test_features(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(float(rng.normal() + 3 * (i % 2)), float(rng.normal()), 1.0, i % 2) for i in range(100)], "a double, b double, c double, y int")
    assert P.select_features(rows, ["a", "b", "c"], least_variance=0.5) == ["a", "b"]
    assert P.select_features(rows, ["a", "b"], label="y", best=1) == ["a"]


def test_postings_find_what_may_hold_a_term(spark):
    m = spark.createDataFrame([("1", "Steel blue"), ("2", "stale"), ("3", ""), ("4", None)], "key string, value string")
    p = K.gram_postings(m)
    assert [r.key for r in K.gram_candidates(p, "tee").collect()] == ["1"] and {r.key for r in K.gram_candidates(p, "st").collect()} == {"1", "2"}
    assert K.gram_candidates(p, "zzz").collect() == []


def test_nodes_of_a_ring_move_only_their_own(spark):
    keys = spark.createDataFrame([(str(i),) for i in range(200)], "key string")
    first = lambda nodes: {r.key: r.node for r in K.ring_nodes(keys, nodes, 1).collect()}
    a, b = first(["x", "y", "z"]), first(["x", "y"])
    assert all(a[k] == b[k] for k in a if a[k] != "z") and 40 < list(a.values()).count("z") < 95


def test_unknown_backends_are_refused(spark):
    with pytest.raises(ValueError):
        K.open_store(spark, "tape", "x")


def test_formats_by_first_bytes(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"")
    (tmp_path / "b").write_bytes(b"PAR1rest")
    assert K.first_bytes(spark, str(tmp_path), 4) == b"PAR1" and K.first_bytes(spark, str(tmp_path / "a")) == b""
