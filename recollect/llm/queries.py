"""Queries of this subpackage by name, each over the whole of its table, and their SQL where SQL can say it."""
import public_tokenizers
from pyspark.sql import functions as F

from recollect.llm import alignment, ann, bpe, chat, exact_dedup, fingerprint, language, mixing, ngram_join, prefix_trie, quality, secrets, toxicity


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_mix_sources(spark, sf_dir):
    return mixing.taken_words(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark, sf_dir):
    return secrets.secret_report(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_chat_format(spark, sf_dir):
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op1_byte_bpe(spark, sf_dir):
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(bpe.RANKS))


def op4_nearest(spark, sf_dir):
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_quality_resampling(spark, sf_dir):
    return quality.quality_sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language_id(spark, sf_dir):
    return language.identify(_table(spark, sf_dir, "documents"))


def op9_ngram_join(spark, sf_dir):
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_fingerprint(spark, sf_dir):
    return fingerprint.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark, sf_dir):
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_classes(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_mix_sources, op3_secret_scan, op4_nearest, op5_toxicity, op6_chat_format, op7_quality_resampling, op8_language_id, op9_ngram_join, op10_fingerprint, op11_token_alignment, op12_prefix_trie, op13_exact_dedup)}
ORACLES = {"op9_ngram_join": ngram_join.ORACLE, "op4_nearest": ann.ORACLE, "op2_mix_sources": mixing.ORACLE, "op3_secret_scan": secrets.ORACLE, "op6_chat_format": chat.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE, "op13_exact_dedup": exact_dedup.ORACLE}
