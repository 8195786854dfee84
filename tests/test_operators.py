"""Operators on small hand-made tables."""
import math
import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from recollect.functions import facts as N
from recollect.functions import similarity as Y
from recollect.functions import text as T
from recollect.functions import vectors as V
from recollect.operators import analytics as A
from recollect.operators import context as C
from recollect.operators import graph as G
from recollect.operators import learning as L
from recollect.operators import management as M
from recollect.operators import retrieval as R
from recollect.operators.components import connected_components
from recollect.plans.learning import alike_classes, alike_names
from recollect.sources import store as S

CORPUS = [("doc_tie_a", "cat dog"), ("doc_tie_b", "cat dog"), ("concat", "concatenate strings"), ("upper", "CAT CAT"), ("empty", ""), ("other", "bird")]


def test_any_term_ranks_by_terms_then_frequency_then_key(spark):
    m = spark.createDataFrame(CORPUS, "key string, value string")
    got = R.match_any_term(m, [("q", "cat dog"), ("none", "zebra")], 10).collect()
    assert [(r.key, r.distinct_terms, r.total_freq) for r in sorted(got, key=lambda r: r["rank"])] == [("doc_tie_a", 2, 2), ("doc_tie_b", 2, 2), ("upper", 1, 2), ("concat", 1, 1)]
    assert [r.key for r in R.match_phrase(m, [("q", "cat dog")], 10).orderBy("rank").collect()] == ["doc_tie_a", "doc_tie_b"]


def test_fusion_of_two_lists(spark):
    s = spark.createDataFrame([("q", "dense", "a", 0.9), ("q", "dense", "b", 0.5), ("q", "keyword", "b", 0.8), ("q", "keyword", "c", 0.05)], "query_id string, signal string, key string, score double")
    got = {r.key: r.fused for r in R.fuse_rrf(s).collect()}
    assert got == {"a": round(0.4 / 61, 12), "b": round(0.4 / 62 + 0.3 / 61, 12)}


def test_texts(spark):
    df = spark.createDataFrame([("Hello wörld. Fine?", "hello there")], "a string, b string")
    r = df.select(T.word_jaccard(F.col("a"), F.col("b"), lower=True).alias("j"), T.split_sentences(F.col("a")).alias("s"), T.change_type(F.col("a"), F.concat("a", F.lit(" more"))).alias("c"), T.ngram_similarity(F.col("b"), F.col("b")).alias("n")).first()
    assert r.j == 1 / 4 and r.s == ["Hello wörld.", "Fine?"] and r.c == "append" and r.n == 1.0
    g = spark.createDataFrame([("user:1:name",), ("user:2",)], "k string")
    assert [r.k for r in g.filter(T.matches_glob(F.col("k"), "user:*:name")).collect()] == ["user:1:name"]
    assert g.filter(T.matches_glob(F.col("k"), "*")).count() == 2 and g.filter(T.matches_glob(F.col("k"), "ser:2")).count() == 1
    assert spark.createDataFrame([("{\\rtf1 \\b bold\\b0  text}",)], "r string").select(T.extract_rtf_text(F.col("r"))).first()[0] == "bold text"


def test_vectors_of_unequal_length_and_zeros(spark):
    r = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0], [1.0])], "a array<double>, z array<double>, s array<double>").select(
        V.cosine(F.col("a"), F.col("z")).alias("zero"), V.cosine(F.col("a"), F.col("s")).alias("short"), V.euclidean(F.col("a"), F.col("s")).alias("far"), V.normalize(F.col("z")).alias("n"), V.support_jaccard(F.col("z"), F.col("z")).alias("both")
    ).first()
    assert (r.zero, r.short, r.far, r.n, r.both) == (0.0, 0.0, math.inf, [0.0, 0.0], 1.0)


def test_string_similarities():
    assert Y.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert Y.jaro_winkler("", "a") == 0 and Y.jaro_winkler("", "") == 1
    assert Y.damerau_levenshtein("ca", "ac") == 1 and Y.damerau_levenshtein("kitten", "sitting") == 3
    assert Y.combined("same", "same") == pytest.approx(1.0)


def test_facts_and_times():
    assert N.extract_relations("Alice Smith works at Acme. Bob lives in Paris") == [("Alice Smith", "works_at", "Acme"), ("Bob", "lives_in", "Paris")]
    assert N.split_multi_part("Who came and what did they say? Why?") == ["Who came", "what did they say", "Why"]
    now = datetime(2025, 6, 4, 10)
    assert N.temporal_range("yesterday", now) == (datetime(2025, 6, 3), datetime(2025, 6, 4))
    assert N.temporal_range("last month", now) == (datetime(2025, 5, 1), datetime(2025, 6, 1))
    assert N.temporal_range("winter 2023", now) == (datetime(2023, 12, 1), datetime(2024, 3, 1))
    assert N.temporal_range("nothing", now) is None


def test_store(spark):
    t = S.MemoryTable(spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int"))
    new = spark.createDataFrame([("b", 3), ("c", 4)], "key string, v int")
    rows = lambda x: sorted(map(tuple, x.rows.collect()))
    assert rows(t.store(new)) == [("a", 1), ("b", 3), ("c", 4)] and rows(t.insert_absent(new)) == [("a", 1), ("b", 2), ("c", 4)]
    assert rows(t.delete(new)) == [("a", 1)] and t.get("a").count() == 1
    with pytest.raises(PySparkException, match="not found: c"):
        t.update(new).rows.collect()
    with pytest.raises(PySparkException, match="exists: b"):
        t.merge(new, "fail").rows.collect()


def test_backup_knows_when_it_was_changed(spark, tmp_path):
    t = S.MemoryTable(spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int"))
    t.backup(str(tmp_path / "x"))
    assert S.MemoryTable.restore(spark, str(tmp_path / "x"), t.rows.schema).rows.count() == 2
    spark.createDataFrame([("c", 1)], "key string, v int").write.mode("append").json(str(tmp_path / "x/entries"))
    with pytest.raises(ValueError, match="checksum"):
        S.MemoryTable.restore(spark, str(tmp_path / "x"), t.rows.schema)
    with pytest.raises(ValueError, match="unsupported"):
        S.write(t.rows, str(tmp_path / "y"), "yaml")


def test_formats():
    assert S.csv_delimiter(["a;b;c", "1;2;3,5"]) == ";" and S.csv_delimiter(["a\tb", "1\t2"]) == "\t"
    assert S.csv_has_header(["a,b", "1,2"], ",") and not S.csv_has_header(["1,2", "3,4"], ",")


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.id: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert connected_components(links.limit(0)).collect() == []


def test_graph_walks(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("x", "y")], "src string, dst string")
    e = e.selectExpr("src", "dst", "'causes' AS rel_type", "1.0D AS strength", "0.9D AS confidence")
    p = G.shortest_paths(e, [("a", "c"), ("a", "y")]).collect()
    assert [(r.hops, r.length, r.path) for r in p] == [(2, 3, "a>b>c")]
    assert {(r.src, r.dst, round(r.confidence, 3)) for r in G.infer_transitive(e, "causes").collect()} == {("a", "c", 0.648)}
    assert {r.node: r.score for r in G.expand_seeds(e, [("a", 1.0)]).collect()} == {"b": 0.8, "d": 0.8, "c": 0.64}


def test_similar_pairs_over_blocks(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 4))
    df = spark.createDataFrame([(f"k{i:02d}", [float(a) for a in v]) for i, v in enumerate(x)], "key string, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f"k{i:02d}", f"k{j:02d}") for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] >= 0.7}
    for block in (7, 100):
        got = [(r.a, r.b) for r in G.similar_pairs(df, 0.7, block).collect()]
        assert set(got) == want and len(got) == len(want)


def test_kept_versions(spark):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [("k", at(0), "Accessed"), ("k", at(3), "Accessed"), ("k", at(4), "ContentModified"), ("k", at(6), "Accessed"), ("k", at(10), "Accessed")]
    got = M.throttle_versions(spark.createDataFrame(rows, "key string, ts timestamp_ntz, change_type string")).collect()
    assert [(r.ts.minute, r.change_type) for r in got] == [(0, "Accessed"), (4, "ContentModified"), (10, "Accessed")]


def test_decisions_about_facts(spark):
    s = "subject string, predicate string, object string, content string"
    old = spark.createDataFrame([("p", "city", "Rome", "lives in Rome"), ("p", "pet", "cat", "has a cat")], s)
    new = spark.createDataFrame([("p", "city", "Oslo", "x"), ("p", "pet", "cat", "has a black cat"), ("p", "job", "cook", "y"), ("p", "pet", "cat", "has a cat")], s)
    assert sorted((r.predicate, r.decision) for r in M.resolve_facts(old, new).collect()) == [("city", "supersede"), ("job", "insert"), ("pet", "no_op"), ("pet", "update")]


def test_private_counts_are_near(spark):
    df = spark.range(1000)
    got = [A.private_count(df, 1.0, seed).first()[0] for seed in range(8)]
    assert all(abs(x - 1000) < 30 for x in got) and len(set(got)) == 8
    with pytest.raises(ValueError):
        A.private_count(df, 0)


def test_clusters_and_anomalies(spark):
    pts = [(f"a{i}", [1.0 + i / 100, 0.0]) for i in range(5)] + [(f"b{i}", [0.0, 1.0 + i / 100]) for i in range(5)] + [("lone", [-1.0, -1.0])]
    df = spark.createDataFrame(pts, "key string, embedding array<double>")
    got = {r.key: r.cluster for r in L.dbscan_cosine(df, 0.1, 2).collect()}
    assert got == {**{f"a{i}": "a0" for i in range(5)}, **{f"b{i}": "b0" for i in range(5)}}
    k = {r.key: r.cluster for r in L.kmeans_first_rows(df.filter("key <> 'lone'").withColumn("key", F.expr("reverse(key)")), 2).collect()}
    assert len({v for key, v in k.items() if key.endswith("a")}) == 1 and len(set(k.values())) == 2


def test_whole_cascade_drops_near_copies(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wizards mix potions"
    texts = [base, "THE  " + base[4:], "a much longer first text " * 9, "other words here at the start " * 8, base[4:], "zzzz 0123456789", base, "x" * 99, "x" * 100]
    m = spark.createDataFrame([(str(i), t, i / 10) for i, t in enumerate(texts)], "key string, value string, importance double")
    v = spark.createDataFrame([("2", [1.0, 0.0]), ("3", [0.99, 0.05]), ("5", [0.0, 1.0])], "key string, embedding array<double>")
    texts_left = {i: texts[i] for i in (0, 3, 4, 5, 7, 8)}  # after exact, normalized and semantic steps
    gone = set()
    for i, a in texts_left.items():
        for j, b in texts_left.items():
            step = len(b) // 100 - len(a) // 100
            if step == 1 or step == 0 and i < j:
                n, k = len(a), len(b)
                same = sum(c in b for c in a) / max(n, k) * (1 - 0.3 * abs(n - k) / max(n, k))
                if same > 0.95 and min(n, k) / max(n, k) >= 0.5:
                    gone.add(str(j if i >= j else i))
    assert gone == {"0", "7"}
    assert {r.key for r in M.byte_similar(m.filter(F.col("key").isin(*map(str, texts_left))), block=2).collect()} == gone
    assert {r.key for r in M.deduplicate_whole(m, v).collect()} == {"3", "4", "5", "8"}


def test_alike_names_meet_all_pairs(spark):
    names = ["red widget", "red wigdet", "rde widget", "blue widget", "red widget", "bleu widget", "a", "a", "b", "", None, "hot gear", "hott gear", "gear hot", "red widgets", "ab", "ba"]
    got = {(r.p_partkey, r.other): r.similarity for r in alike_names(spark.createDataFrame(list(enumerate(names)), "p_partkey long, p_name string")).collect()}
    want = {(i, j): round(Y.combined(a, b), 9) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and a is not None and b is not None}
    assert got == {k: s for k, s in want.items() if s >= 0.8} and (0, 2) in got


def test_classes_of_names_hold_all_alike_pairs_without_expanding_copies(spark):
    names = ["red widget", "red wigdet", "bleu widget", "hot gear", "gear hot", "", None, "a", "red widgets"]
    p = spark.createDataFrame([(k, names[k % 9]) for k in range(180)], "p_partkey long, p_name string")
    got = {(r.p_partkey, r.other): r.similarity for r in alike_classes(p).collect()}
    assert len(got) < 300  # all pairs of copies are 1,520 and more
    first = {n: i for i, n in enumerate(names)}
    of = {k: first[names[k % 9]] for k in range(180) if names[k % 9] is not None}
    whole = {(r.p_partkey, r.other): r.similarity for r in alike_names(p).collect()}
    near = {(a, b): s for (a, b), s in got.items() if a < 9 and b < 9} | {(a, a): s for (a, b), s in got.items() if of[a] == of[b]}
    assert whole == {(a, b): near[of[a], of[b]] for a in of for b in of if a < b and (of[a], of[b]) in near}



def test_hybrid_search_finds_what_holds_no_word_of_the_query(spark):
    old = datetime(2020, 1, 1)
    rows = [("word", "a lantern by the sea", old, old, 1, 0.5), ("dense", "something else entirely", old, old, 1, 0.5), ("linked", "nothing in common", old, old, 1, 0.5), ("far", "no relation", old, old, 1, 0.5)]
    rows += [(f"new{i:02}", "filler text", datetime(2024, 12, 1), old, 50, 0.1) for i in range(50)]  # more recent than any, a full temporal signal
    m = spark.createDataFrame(rows, "key string, value string, created_at timestamp_ntz, last_accessed timestamp_ntz, access_count long, importance double")
    v = spark.createDataFrame([("dense", [1.0, 0.1]), ("far", [0.0, 1.0]), ("ask", [1.0, 0.0])], "key string, embedding array<double>")
    links = spark.createDataFrame([("linked", "word", "causes")], "src string, dst string, rel_type string")
    got = [r.key for r in R.hybrid_search(m, v, links, [("q", "lantern")], {"q": "ask"}, datetime(2025, 1, 1), k=60).collect()]
    assert got[0] == "dense" and {"word", "linked"} <= set(got) and "far" not in got and "ask" not in got
    assert R.hybrid_search(m.limit(0), v.limit(0), links.limit(0), [("q", "lantern")], {"q": "ask"}, datetime(2025, 1, 1)).collect() == []


def test_cheapest_paths_around_and_over_nodes(spark):
    from recollect.operators import paths as P

    e = spark.createDataFrame([("a", "b", 1.0), ("b", "d", 1.0), ("a", "c", 2.0), ("c", "d", 1.0), ("a", "d", 9.0), ("d", "a", 0.5), ("b", "d", 0.9)], "src string, dst string, w double")
    got = lambda **k: {r.node: (r.cost, r.path) for r in P.cheapest_paths(e, ["a"], F.col("w"), **k).collect()}
    assert got() == {"a": (0.0, "a"), "b": (1.0, "a>b"), "c": (2.0, "a>c"), "d": (1.9, "a>b>d")}
    assert got(avoid=("b",)) == {"a": (0.0, "a"), "c": (2.0, "a>c"), "d": (3.0, "a>c>d")}
    assert got(through="c")["d"] == (3.0, "a>c>d") and got(rounds=1)["d"] == (9.0, "a>d") and got(through="c")["b"] == (4.5, "a>c>d>a>b")
    with pytest.raises(ValueError):
        P.graph_lines(e, "tape")
    odd = spark.createDataFrame([('x"<', "y&", "r", 1.0)], "src string, dst string, rel_type string, strength double")
    assert [r.line for r in P.graph_lines(odd, "gexf").filter("part = 2").collect()] == ['<edge source="x&quot;&lt;" target="y&amp;" label="r"/>']
    assert [r.line for r in P.graph_lines(odd, "dot").orderBy("part").collect()] == ["digraph memories {", '"x\\"<" -> "y&" [label="r"];', "}"]


@pytest.mark.parametrize("judges, block", [(1, 7), (3, 2048)])
def test_byte_similar_meets_every_pair(spark, judges, block):
    import random

    rng = random.Random(6)
    letters = ["abcdefgh", "abcdefghijklmnop", "qrstuvwxyz", "0123456789", "äöüß"]
    texts = ["".join(rng.choice(rng.choice(letters) if i % 3 else letters[i % 5]) for _ in range(rng.choice([0, 3, 90, 99, 100, 101, 150, 199, 205, 330]))) for i in range(160)]
    rows = [(f"k{i:03d}", t, rng.randint(0, 5) / 5) for i, t in enumerate(texts)]
    gone = set()
    for a, ta, ia in rows:
        for b, tb, ib in rows:
            x, y = ta.encode(), tb.encode()
            bx, by = len(x) // 100, len(y) // 100
            if (bx, a) < (by, b) and by - bx <= 1:
                longest = max(len(x), len(y), 1)
                score = sum(c in set(y) for c in x) / longest * (1 - abs(len(x) - len(y)) / longest * 0.3)
                if score > 0.95 and min(len(x), len(y)) / longest >= 0.5:
                    gone.add(a if ia < ib else b)
    m = spark.createDataFrame(rows, "key string, value string, importance double").repartition(3)
    got = [r.key for r in M.byte_similar(m, block=block, judges=judges).collect()]
    assert sorted(got) == sorted(gone) and 10 < len(gone) < 150
    assert M.byte_similar(m.limit(0)).collect() == []


def test_pages_of_a_search_with_words_filters_and_likeness(spark):
    rows = [("a", "Red fox jumps", 0.9), ("b", "red red fox", 0.5), ("c", "a foxx jumped", 0.8), ("d", "fox", 0.1), ("e", None, 0.9), ("f", "", 0.9), ("g", "fox red jumps", 0.9)]
    m = spark.createDataFrame(rows, "key string, value string, importance double")
    page = lambda offset, limit, **how: [(r.query_id, r["rank"], r.key, r.relevance) for r in R.search_pages(m, [("q", "red fox fox"), ("none", "  ")], F.col("importance") > 0.2, 0.3, [F.desc("relevance")], offset, limit, **how).orderBy("query_id", "rank").collect()]
    assert page(0, 10) == [("q", 1, "a", 1.0), ("q", 2, "b", 1.0), ("q", 3, "g", 1.0)]
    assert page(1, 1) == [("q", 2, "b", 1.0)] and page(5, 5) == []
    fuzzy = page(0, 10, alike=0.5)
    assert [k for _, _, k, _ in fuzzy] == ["a", "b", "g", "c"] and 0.3 <= fuzzy[-1][3] < 0.67
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "src string, dst string")
    assert {r.key: r.related for r in R.search_pages(m, [("q", "fox")], F.lit(True), 0.5, [F.asc("importance")], 0, 9, links).collect()} == {"a": 2, "b": 1, "d": 0, "g": 0}
    assert R.search_pages(m, [("q", " ")], F.lit(True), 0.5, [F.asc("importance")], 0, 9).collect() == []


def test_collaborators_in_blocks_meet_all_pairs(spark, monkeypatch):
    from recollect.operators import context as C

    for name, n in (("BLOCK", 7), ("STRIP", 3), ("WIDTH", 5)):
        monkeypatch.setattr(C, name, n)
    rng = np.random.default_rng(3)
    sets = {f"u{k:02}": {f"i{x}" for x in rng.choice(14, rng.integers(1, 12), replace=False)} for k in range(40)}
    rows = [(u, i) for u, s in sets.items() for i in s for _ in range(2)] + [("u01", None), (None, "i1")]
    got = [(r.a, r.b, r.score) for r in C.collaborators(spark.createDataFrame(rows, "user_id string, item string")).collect()]
    want = [(a, b, len(sets[a] & sets[b]) / max(len(sets[a]), len(sets[b]))) for a in sets for b in sets if a < b]
    assert sorted(got) == sorted(w for w in want if w[2] > 0.5)
    assert C.collaborators(spark.createDataFrame([], "user_id long, item string")).collect() == []
    # every two users share an item that all hold: no pair of candidates is exchanged
    plan = C.collaborators(spark.createDataFrame([(k, "hot") for k in range(30)], "user_id long, item string"))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInArrow" in plan


def test_many_highlights_of_a_long_text_are_soon_found(spark):
    text = "é The" * 6_000 + "x"
    began = time.time()
    rows = spark.createDataFrame([(text,), (None,), ("none",), ("",), ("tHe",)], "t string").select(C.highlights(F.col("t"), "the", 5).alias("h")).collect()
    assert time.time() - began < 15
    assert [tuple(x) for x in rows[0].h] == [(2 + 5 * i, text[max(2 + 5 * i - 5, 0) : 2 + 5 * i + 8]) for i in range(6_000)]
    assert [[tuple(x) for x in r.h] for r in rows[1:]] == [[], [], [], [(0, "tHe")]]
