"""Groups, counts and scores beside plain versions."""
import math
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.functions import scores as S
from recollect.functions.similarity import jaro_winkler
from recollect.operators import likeness as K
from recollect.operators import related as D

WORDS = [f"word{i}" for i in range(12)]


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, rng.integers(0, 9))) for _ in range(n)]


def likeness(a, b):
    x, y = ({w for w in t.lower().split() if len(w.encode()) > 2} for t in (a, b))
    return 1.0 if not x and not y else len(x & y) / len(x | y)


def plain_groups(keys, near):
    leader = {}
    for k in keys:
        if k not in leader:
            leader[k] = k
            leader |= {j: k for j in keys if j not in leader and near(k, j)}
    return leader


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_pairs_groups_and_shares_meet_brute_force(spark, threshold):
    rows = [(f"k{i:03}", t) for i, t in enumerate(texts(90, 3))]
    m = spark.createDataFrame(rows, "key string, value string")
    value = dict(rows)
    classes = D.text_classes(m)
    ids = {r.key: r.id for r in classes.collect()}
    got = {(r.a, r.b): round(r.similarity, 9) for r in D.similar_texts(classes, threshold).collect()}
    want = {(a, b): round(likeness(value[a], value[b]), 9) for a in set(ids.values()) for b in set(ids.values()) if a < b and likeness(value[a], value[b]) >= threshold}
    assert got == want and len(want) > (0 if threshold > 0.5 else 20)
    groups = {r.key: r.leader for r in D.similarity_groups(m, threshold).collect()}
    assert groups == plain_groups(sorted(value), lambda a, b: likeness(value[a], value[b]) >= threshold)
    share = D.duplicate_share(m, threshold).first()
    n = sum(likeness(a, b) > threshold for i, (_, a) in enumerate(rows) for _, b in rows[i + 1 :])
    assert (share.pairs, share.share) == (n, pytest.approx(n / (90 * 89 / 2)))
    assert D.similarity_groups(m.limit(0), threshold).collect() == [] and D.duplicate_share(m.limit(1)).first().share == 0.0


def test_candidates_are_important_tagged_alike_and_near(spark):
    t0, rng = datetime(2024, 1, 1), np.random.default_rng(4)
    rows = [(f"k{i:03}", t, t0 + timedelta(hours=int(rng.integers(0, 60))), float(rng.integers(0, 10)) / 10, [["a"], ["b"], ["a", "c"]][i % 3]) for i, t in enumerate(texts(80, 5))]
    m = spark.createDataFrame(rows, "key string, value string, created_at timestamp_ntz, importance double, tags array<string>")
    got = {r.key: r.leader for r in D.consolidation_candidates(m, 0.5, 24, 0.3, ["a"]).collect()}
    fit = {r[0]: r for r in rows if r[3] >= 0.3 and "a" in r[4]}
    plain = plain_groups(sorted(fit), lambda a, b: likeness(fit[a][1], fit[b][1]) >= 0.5 and abs(fit[a][2] - fit[b][2]) <= timedelta(hours=24))
    many = {v for v in plain.values() if list(plain.values()).count(v) > 1}
    assert got == {k: v for k, v in plain.items() if v in many} and len(many) > 2


def test_greedy_groups_of_a_chain(spark):
    pairs = spark.createDataFrame([(f"{i:02}", f"{i + 1:02}") for i in range(20)], "a string, b string")
    ids = spark.createDataFrame([(f"{i:02}",) for i in range(21)], "id string")
    got = {r.id: r.leader for r in D.greedy_groups(ids, pairs).collect()}
    assert got == {f"{i:02}": f"{i - i % 2:02}" for i in range(21)}


def test_scores_of_odd_input(spark):
    r = spark.createDataFrame([("aé", "", "abc", "abcdefgh", None)], "a string, e string, s string, l string, n string").select(
        S.character_entropy(F.col("a")).alias("h"), S.character_entropy(F.col("e")).alias("h0"), S.byte_similarity(F.col("a"), F.col("a")).alias("same"), S.byte_similarity(F.col("s"), F.col("l")).alias("short"),
        S.byte_similarity(F.col("e"), F.col("s")).alias("none"), S.graph_score(F.lit(0.4), F.lit(None).cast("long"), F.lit(None).cast("double")).alias("alone"), S.parameter_importance(F.lit(-1.0), F.lit(0.0)).alias("p"),
        S.byte_similarity(F.lit("é"), F.lit("è")).alias("bytes"),
    ).first()
    p = 1 / 3
    assert r.h == pytest.approx(-2 * p * math.log2(p) / 8) and r.h0 == 0.0 and r.same == 1.0 and r.short == 0.0 and r.none == 0.0 and r.alone == 0.4 and r.p == pytest.approx(10 / 11)
    assert r.bytes == 0.5  # the first of their two bytes is one


def test_entropy_of_many_kinds_of_characters_is_soon_told(spark):
    text = "".join(map(chr, range(0x4E00, 0x4E00 + 20_000))) * 2 + "\U0001f600" * 7
    t = spark.createDataFrame([(text,), (None,), ("aaaa",)], "t string")
    began = time.time()
    got = [r.h for r in t.select(S.character_entropy(F.col("t")).alias("h")).collect()]
    total = len(text.encode())
    assert time.time() - began < 10
    assert got[0] == pytest.approx(-(20_000 * 2 / total * math.log2(2 / total) + 7 / total * math.log2(7 / total)) / 8) and got[1:] == [None, 0.0]


def test_replay_stops_at_the_first_that_is_not_due(spark):
    q = spark.createDataFrame([("a", 0.9, 1.0), ("b", 0.8, 5.0), ("c", 0.7, 1.0)], "key string, priority double, due double")
    assert [r.key for r in D.replay_batch(q, F.lit(2.0)).collect()] == ["a"]
    assert [r.key for r in D.replay_batch(q, F.lit(9.0), most=2).collect()] == ["a", "b"]


def test_likeness_to_one_meets_brute_force(spark):
    rng, t0 = np.random.default_rng(6), datetime(2024, 1, 1)
    words = ["lantern", "lanterns", "harbour", "harbor", "sea", "seas", "größe", "grösse", "of", "keeper"]
    rows = [(f"k{i:02}", " ".join(rng.choice(words, rng.integers(0, 7))), [["red", "blue_sky"], ["reds"], [], ["blue-skies", "x"]][i % 4], float(rng.integers(0, 11)) / 10, int(rng.integers(0, 9)), t0 + timedelta(hours=int(rng.integers(0, 900))), t0 + timedelta(hours=int(rng.integers(0, 900)))) for i in range(60)]
    m = spark.createDataFrame(rows, "key string, value string, tags array<string>, importance double, access_count long, created_at timestamp_ntz, last_accessed timestamp_ntz")
    got = {r.key: r for r in K.like(m, "k05").collect()}
    sets = {r[0]: {w for w in r[1].lower().split() if len(w.encode()) > 2} for r in rows}
    ref = rows[5]
    near = lambda x, y: 1 - abs(x - y) / max(x, y) if max(x, y) else 1.0
    for r in rows:
        x, y, both = sets["k05"], sets[r[0]], len(sets["k05"] & sets[r[0]])
        fuzzy = sum(max((jaro_winkler(a, b) for b in y), default=0) > 0.8 for a in x)
        content = 0.3 * both / len(x | y) + 0.25 * both / math.sqrt(len(x) * len(y)) + 0.25 * fuzzy / max(len(x), len(y)) + 0.2 * both / min(len(x), len(y)) if x and y else 0.0
        a, b = set(ref[2]), set(r[2])
        tag = 0.7 * len(a & b) / max(len(a), len(b)) + 0.3 * sum(any(K.tags_alike(s, t) for t in b) for s in a) / max(len(a), len(b)) if a and b else 0.0
        d, h = abs(r[3] - ref[3]), int(abs((r[5] - ref[5]).total_seconds()) // 3600)
        weight = 0.4 * max(0, 1 - d) + 0.3 * math.exp(-2 * d) + 0.3 * math.exp(-d * d / 0.1)
        time = 0.3 * max(0, 1 - h / 168) + 0.4 * math.exp(-h / 72) + 0.3 * math.exp(-((h / 24) ** 2) / 2)
        use = 0.6 * near(r[4], ref[4]) + 0.4 / (1 + int(abs((r[6] - ref[6]).total_seconds()) // 3600) / 24)
        size, vocabulary = near(len(r[1].encode()), len(ref[1].encode())), near(len(y), len(x))
        form = 0.5 * size + 0.3 * vocabulary + 0.2 * near(len(b), len(a))
        assert got[r[0]].similarity == pytest.approx(0.3 * content + 0.25 * tag + 0.15 * weight + 0.15 * time + 0.1 * use + 0.05 * form, abs=1e-9), r
        tags = 0.0 if not a and not b else 3.0 if not a or not b else 3 * (1 - 0.6 * len(a & b) / len(a | b) - 0.4 * tag)
        far = 0.3 * 3 * (1 - content) + 0.25 * tags + 0.2 * sum(h >= k for k in (1, 24, 168, 720)) + 0.15 * sum(d >= k for k in (0.1, 0.3, 0.5)) + 0.1 * (2 * (1 - size) + 2 * (1 - vocabulary)) / 2
        assert got[r[0]].distance == 1 + sum(round(far, 9) >= k for k in (0.2, 0.4, 0.6, 0.8))
    assert any(r.distance < 5 for r in got.values()) and got["k05"].distance == 1
    some = m.select("key")
    assert K.filter_like(some, m, "nobody", least=0.9).count() == 60
    assert {r.key for r in K.filter_like(some, m, "k05", most_distant=3).collect()} == {k for k, r in got.items() if r.distance <= 3}


def test_fuzzy_words_lose_none(spark):
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcde"), rng.integers(1, 9))) for _ in range(300)]
    words = vocabulary[:15]
    got = {r.word: r.hits for r in K.fuzzy_matches(spark.createDataFrame([(w,) for w in set(vocabulary)], "word string"), words).collect()}
    want = {v: [i for i, w in enumerate(words) if jaro_winkler(w, v) > 0.8] for v in set(vocabulary)}
    assert got == {v: h for v, h in want.items() if h}


def test_letters_out_of_place_count_half_rounded_down():
    duckdb = pytest.importorskip("duckdb")
    for a, b in [("andonthorble", "ononatre."), ("andonthorble", "antionhe"), ("martha", "marhta"), ("dwayne", "duane")]:
        jaro = duckdb.sql(f"SELECT jaro_similarity('{a}', '{b}')").fetchall()[0][0]
        common = next((i for i in range(4) if a[i] != b[i]), 4)
        assert jaro_winkler(a, b) == pytest.approx(jaro + 0.1 * common * (1 - jaro), abs=1e-12)


def test_likeness_measures_a_distinct_word_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(a, b, measure=K.jaro_winkler):
        seen.add(1)
        return measure(a, b)

    m = spark.range(200).selectExpr("cast(id as string) AS key", "'lanterns harbour' AS value", "array('x') AS tags", "0.5D AS importance", "1L AS access_count", "timestamp_ntz'2024-01-01' AS created_at", "timestamp_ntz'2024-01-01' AS last_accessed")
    whole, K.jaro_winkler = K.jaro_winkler, counted
    try:
        assert K.like(m, "5").count() == 200 and {r.similarity for r in K.like(m, "5").collect()} != set()
    finally:
        K.jaro_winkler = whole
    assert 0 < seen.value < 60


def test_classes_carry_hashes_of_their_words_once(spark):
    m = spark.createDataFrame([("a", "one two three"), ("b", "three TWO one one"), ("c", "of"), ("d", None)], "key string, value string").fillna("")
    got = {r.key: r for r in D.text_classes(m).collect()}
    assert {k: r.id for k, r in got.items()} == {"a": "a", "b": "a", "c": "c", "d": "c"}
    assert {k: None if r.hs is None else len(set(r.hs)) for k, r in got.items()} == {"a": 3, "b": None, "c": 0, "d": None}
