"""The pipeline's stages one by one beside plain versions, and the whole of it, over nulls, empty and long texts, repeated rows, clashing columns and empty tables."""
import hashlib
import struct
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from recollect import session
from recollect.llm import bpe, quality
from tests.llm.test_operators import DOCS, ODD, SECRETS, WORDS, _plain_components, _plain_secrets, words

STAGES = dict(corpus_pipeline.STAGES)
#: Names that stages use within.
CLASH = "rank kept n component_id secrets size taken ids copies row words component _k id hash nth _nth _secret_spans _Secret_Spans_ _secret_run _secret_assign _secret_access _secret_hex _secret_text _mix_key _mix_words _mix_text _mix_size _mix_taken _row _id _n _copy".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents (some bad, copied, secret, odd) and labels."""
    path = tmp_path_factory.mktemp("sf")
    texts = [words(40 + i % 30, i) for i in range(240)]
    for i in range(0, 240, 6):
        texts[i] = " ".join(w + "$$$" for w in texts[i].split())
    for i in range(7, 240, 12):
        texts[i] = texts[i - 2] + " " + WORDS[i % 20]  # a near copy of a good one
    for i, t in zip(range(8, 240, 12), SECRETS):
        texts[i] = texts[i] + " " + (t or "")
    texts += ODD
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, words(50, 999), None, None, 0), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(k) for k, c in enumerate(CLASH)})
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 6 != 0), 0) for i in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def staged(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = STAGES[name](spark, docs, folder)
    if name != "tokens":
        assert out.columns == docs.columns
    assert STAGES[name](spark, docs.limit(0), folder).collect() == []
    return docs.collect(), out.collect()


def test_quality_keeps_what_is_kept_of_the_sample(spark, folder):
    rows, got = staged(spark, folder, "quality")
    sample = quality.quality_sample(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    n = Counter(r.doc_id for r in sample.filter("kept = 1").collect())
    assert Counter(r.doc_id for r in got) == n
    assert {r.doc_id for r in rows if r.doc_id is not None and r.doc_id < 240 and r.doc_id % 6} <= set(n)
    assert not set(n) & set(range(0, 240, 6))
    assert all(r in rows for r in got)


def test_duplicates_keep_the_least_of_each_component(spark, folder):
    rows, got = staged(spark, folder, "duplicates")
    named = {r.doc_id: r.text for r in rows if r.doc_id is not None}
    want = {c for _, _, c in _plain_components(list(named.items()), corpus_pipeline.SHINGLE, corpus_pipeline.SIMILAR)}
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(want) and len(want) < len(named) - 15
    assert sum(r.doc_id is None for r in got) == 2


def test_secrets_are_redacted_and_the_rest_stays(spark, folder):
    rows, got = staged(spark, folder, "secrets")
    assert len(rows) == len(got)
    before = {}
    for r in rows:
        before.setdefault(r.doc_id, []).append(r.text)
    for r in got:
        if any(not _plain_secrets(t or "") for t in before[r.doc_id]):
            assert r.text in before[r.doc_id]
        else:
            plain = before[r.doc_id][0]
            out, end = "", 0
            for a, b in _merged(_plain_secrets(plain)):
                out, end = out + plain[end:a] + "[SECRET]", b
            assert r.text == out + plain[end:] and r.n_chars == len(r.text)
    assert sum("[SECRET]" in (r.text or "") for r in got) > 8


def _merged(spans):
    out = []
    for a, _, _, b in spans:
        if out and a <= out[-1][1] and (a < out[-1][1] or a == 0):
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def test_the_mix_comes_near_its_targets(spark, folder):
    rows, got = staged(spark, folder, "mixture")
    size = lambda t: len((t or "").split())
    own, taken = Counter(), Counter()
    for r in rows:
        own[r.source] += size(r.text)
    for r in got:
        taken[r.source] += size(r.text)
    names = sorted(s for s in own if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        level = (sum(own.values()) - sum(3 * own[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and weight[s] * level > 3 * own[s]}
        if not more:
            break
        capped |= more
    assert all(abs(taken[s] - (3 * own[s] if s in capped else weight[s] * level)) <= 0.51 for s in names)


def test_tokens_are_the_library_s(spark, folder):
    rows, got = staged(spark, folder, "tokens")
    ranks = bpe.load_ranks(public_tokenizers.path(bpe.RANKS))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in rows:
        ids = enc.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_the_whole_is_its_stages_and_leaves_one_table(spark, folder):
    shared = Path(session.shared_folder(spark))
    before = set(shared.iterdir()) if shared.exists() else set()
    got = corpus_pipeline.run(spark, folder)
    left = [p.name for p in set(shared.iterdir()) - before if (p / "_SUCCESS").exists()]
    assert len(left) == 1 and left[0].startswith("pipeline-tokens-")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = session.materialize(stage(spark, docs, folder), "stage")
    rows = lambda df: sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_sha256) for r in df.collect())
    assert rows(got) == rows(docs) and len(rows(got)) > 100


def test_a_folder_of_this_machine_is_refused_on_a_cluster(spark, monkeypatch):
    class Away:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://there:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError):
        session.shared_folder(Away)


def test_count_vectors_reach_the_driver_as_bytes_and_not_as_rows(spark, monkeypatch):
    import numpy as np

    from recollect.llm import ngram_join, quality
    from recollect.llm.ngram_join import Powers, ngram_hashes

    texts = ["one two three four five six", "one two three four nine", None, "", "seven eight " * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(type(docs), "toPandas", lambda self: pytest.fail("rows of cells are collected"))
    monkeypatch.setattr(ngram_join, "sketch_log2", lambda d: (18, 1))
    cells = np.zeros(1 << 18, int)
    for t in texts:
        np.add.at(cells, (ngram_hashes(t, Powers()) >> np.uint64(46)).astype(int), 1)
    assert (ngram_join.sketch_counts(docs) == np.round(8 * np.log2(cells + 1))).all()
    want = sum(np.bincount(quality.features(t, Powers()), minlength=quality.CELLS) for t in texts)
    assert (quality.raw_counts(docs) == want).all()


def test_stages_hand_texts_to_python_in_small_batches(spark, folder):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(name, before)
            stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
            assert spark.conf.get(name) == corpus_pipeline.BATCH_BYTES
        spark.conf.set(name, "77m")
        corpus_pipeline.run(spark, folder)
        assert spark.conf.get(name) == "77m"
    finally:
        spark.conf.set(name, before)


def test_plan_of_the_mixture_stays_small(spark):
    from recollect.llm import mixing

    docs = spark.createDataFrame([(i, f"some words {i}", "en", f"s{i % 3}", 12) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 10
