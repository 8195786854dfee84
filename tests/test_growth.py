"""Steps whose work, memory or exchange must not outgrow the input."""
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recollect.functions import similarity as Y
from recollect.functions.themes import THEMES, themes
from recollect.operators import learning as L
from recollect.operators import profiles as P


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_text_is_lowered_once_however_many_words_are_looked_for(spark):
    rows = [(i, f"X{w.upper()}x") for i, w in enumerate(w for ws in THEMES.values() for w in ws)] + [(-1, ""), (-2, None), (-3, "zzz")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(2).select("id", "text", themes(F.col("text")).alias("themes"))
    assert plan(df).count("lower(") == 1
    for r in df.collect():
        assert r.themes == [name for name, words in THEMES.items() if any(w in (r.text or "").lower() for w in words)]


def test_compressed_texts_leave_in_small_batches(spark):
    rows = [(f"k{i}", None if i == 5 else f"{i} grün " * 30) for i in range(900)]
    c = P.compressed(spark.createDataFrame(rows, "key string, value string").coalesce(1))
    sizes = c.select("key").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs), "n long")
    assert sum(r.n for r in sizes.collect()) == 899
    assert "MapInArrow" in plan(c) and "ArrowEvalPython" not in plan(c)
    got = {r.key: r for r in c.collect()}
    assert all((r := got[k]).original_size == len(t.encode()) and bytes(r.data) == zlib.compress(t.encode(), 6) and r.compressed_size == len(r.data) for k, t in rows if t)


def test_models_of_labels_are_fitted_side_by_side(spark, monkeypatch):
    from pyspark.ml.classification import OneVsRest

    from recollect.plans import QUERIES

    asked, fit = [], OneVsRest.fit
    monkeypatch.setattr(OneVsRest, "fit", lambda self, *a: asked.append(self.getParallelism()) or fit(self, *a))
    assert QUERIES["svm_classifier"](spark, "/root/testdata/sf0.001").count() > 0
    assert asked and asked[0] > 1


def test_sentences_are_ranked_where_their_text_lies(spark, monkeypatch):
    texts = {"a": [["x", "y"], ["y", "z"], ["q"], []], "b": [], "c": [["x"], ["x"]]}
    r = L.textrank(spark.createDataFrame(list(texts.items()), "key string, sentences array<array<string>>"))
    assert "Exchange" not in plan(r)
    got = {(x.key, x.pos): round(x.rank_score, 9) for x in r.collect()}
    # a sentence alone keeps the base; two that only have each other keep 1
    assert got == {("a", 0): 1.0, ("a", 1): 1.0, ("a", 2): 0.15, ("a", 3): 0.15, ("c", 0): 1.0, ("c", 1): 1.0}


def test_many_sentences_share_the_same_words_as_few(monkeypatch):
    rng = np.random.default_rng(3)
    sentences = [rng.choice(40, rng.integers(0, 9), replace=False) for _ in range(60)]
    words, sizes = np.concatenate(sentences), np.array([len(s) for s in sentences])
    want = sorted((i, j, c) for i, a in enumerate(sentences) for j, b in enumerate(sentences) if i != j and (c := len({*a} & {*b})))
    for dense, width in ((100, 7), (100, 4096), (0, 1)):
        monkeypatch.setattr(L, "DENSE", dense)
        monkeypatch.setattr(L, "WIDTH", width)
        assert sorted(zip(*(x.tolist() for x in L._shared_words(words, sizes)), strict=True)) == want


def test_few_pairs_of_words_are_measured_in_full(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = ["", "a", "ab", "licence", "license", "tokens", "token", "pasword", "password", "two words", *("".join(rng.choice(list("abcdet "), rng.integers(1, 9))) for _ in range(150))]
    measured, full = [], Y.combined
    monkeypatch.setattr(Y, "combined", lambda a, b: measured.append(1) or full(a, b))
    for least in (0.3, 0.8, 1.0):
        measured.clear()
        for a in words:
            for b in words:
                s = full(a, b)
                assert Y._pairs_alike(a, b, least) == (s if s >= least else None)
    assert len(measured) < len(words) ** 2 / 10
    rows = spark.createDataFrame([("licence", "license"), ("licence", "zebra"), (None, "x")], "a string, b string")
    assert [r.s for r in rows.select(Y.similarity_from(F.col("a"), F.col("b"), 0.8).alias("s")).collect()] == [full("licence", "license"), None, None]
