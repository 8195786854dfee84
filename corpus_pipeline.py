"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

quality      keeps the documents that importance resampling keeps, learned from labels.quality
duplicates   keeps of each group of near copies (five-word shingles, Jaccard 0.8) the smallest doc_id
secrets      replaces secrets in the texts
mixture      takes documents from their sources by weight: a row for each pass over a document
tokens       encodes by byte-level BPE, and decodes again: doc_id, n_tokens, ids_sha256, decoded_sha256, ids

A stage takes (spark, docs, sf_dir) and returns the columns of documents; the last returns tokens.
"""
import functools

import public_tokenizers

from recollect.llm import bpe, mixing, ngram_join, quality, secrets
from recollect.session import materialize, scratch

#: Shingles of so many words, similar from so many per cent.
SHINGLE, SIMILAR = 5, 80
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of texts that go to a Python worker at once. Spark's own bound, 64 MB, has an executor hold several times as much outside its heap for each task.
BATCH_BYTES = "4m"


def small_batches(stage):
    """The stage with batches of BATCH_BYTES. The setting stays, for a stage's result is computed when it is written; run() puts back the caller's."""

    @functools.wraps(stage)
    def run_stage(spark, docs, sf_dir):
        spark.conf.set(_BYTES, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def keep_quality(spark, docs, sf_dir):
    """The documents that importance resampling keeps, with all columns. Texts without words go; repeated rows share their fate; without labels all texts with words stay."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@small_batches
def drop_duplicates(spark, docs, sf_dir):
    """The smallest doc_id of each group of near copies, with all columns. Rows without words, and those with a null doc_id, stay; of rows that share a doc_id one stays."""
    return ngram_join.keep_representatives(docs, SHINGLE, SIMILAR)


@small_batches
def redact_secrets(spark, docs, sf_dir):
    """Every row, secrets in its text replaced and n_chars made to fit. A null text stays null."""
    return secrets.redact(docs)


@small_batches
def mix_sources(spark, docs, sf_dir):
    """A row for each pass over a document that the mix takes (the last may be a part), with all columns. A null source is one of its own; texts without words are never taken."""
    return mixing.mixed_documents(docs)


@small_batches
def encode(spark, docs, sf_dir):
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every row. A null text is empty."""
    return bpe.round_trip(docs, public_tokenizers.path(bpe.RANKS), with_ids=True)


STAGES = [("quality", keep_quality), ("duplicates", drop_duplicates), ("secrets", redact_secrets), ("mixture", mix_sources), ("tokens", encode)]

#: Models fitted on samples and merges of bytes are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The tokens of the documents in sf_dir after all stages. A stage's own tables, and its input, go once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(_BYTES)
    try:
        with scratch(spark) as last:
            for name, stage in STAGES:
                with scratch(spark) as keep:
                    docs = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
            return last(docs)
    finally:
        spark.conf.set(_BYTES, before)
