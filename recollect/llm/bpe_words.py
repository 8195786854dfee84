"""Byte-level BPE within Spark: higher-order functions fold ranked merges over the bytes of distinct words, by a literal rank map.

Beside bpe.py, which does the same in Arrow batches without a shuffle and is what the query and the pipeline use: sending
the words of documents to a common dictionary and back costs several times the input in shuffles (README, with figures).
"""
import json

import public_tokenizers
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.bpe import load_ranks, split_pattern

#: The rank map is a literal array of so many small maps, found by hash: Spark searches a map from end to end.
BUCKETS = 1 << 16


def rank_map(ranks: dict[bytes, int]) -> Column:
    """array<map<string, int>>: bytes, as characters of Latin-1, to their rank. The size is the vocabulary's."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        s = piece.decode("latin-1")
        buckets[xxhash.xxh64_intdigest(s.encode(), 42) % BUCKETS][s] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def piece_list(ranks: dict[bytes, int]) -> Column:
    """array<string>: the bytes of each id, as characters of Latin-1."""
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    return F.from_json(F.lit(json.dumps(pieces)), "array<string>")


def fold_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word") -> DataFrame:
    """words with ids (array<int>): of the adjacent pairs the one of lowest rank, the leftmost of equals, merges until none has a rank.

    The state of the fold is the parts and the ranks of their neighbours; a merge looks up two new ranks. A word of n
    bytes takes n steps, each of which copies the parts. Null and empty words have no ids.
    """
    rank = lambda p: f"try_element_at(get(r, cast(xxhash64({p}) & {BUCKETS - 1} as int)), {p})"
    left, right = rank("concat(s.parts[i - 2], m)"), rank("concat(m, s.parts[i + 1])")
    none = "cast(array() as array<int>)"
    merged = (
        "named_struct('parts', concat(slice(s.parts, 1, i - 1), array(m), slice(s.parts, i + 2, size(s.parts))), 'ranks', concat("
        f"slice(s.ranks, 1, greatest(i - 2, 0)), if(i > 1, array({left}), {none}), if(i < size(s.ranks), array({right}), {none}), slice(s.ranks, i + 2, size(s.parts))))"
    )
    at = "cast(array_position(s.ranks, array_min(s.ranks)) as int)"
    step = f"if(array_min(s.ranks) is null, s, transform(array({at}), i -> transform(array(concat(s.parts[i - 1], s.parts[i])), m -> {merged})[0])[0])"
    start = f"named_struct('parts', b, 'ranks', transform(sequence(0, size(b) - 2), j -> {rank('concat(b[j], b[j + 1])')}))"
    fold = f"transform(array(split(w, '')), b -> aggregate(sequence(2, size(b)), {start}, (s, k) -> {step}, s -> transform(s.parts, p -> {rank('p')})))[0]"
    whole = rank("w")
    # one character a byte; a single byte has no pair to fold
    text = f"decode(encode(`{word}`, 'UTF-8'), 'ISO-8859-1')"
    ids = f"transform(array({text}), w -> CASE WHEN coalesce(w, '') = '' THEN {none} WHEN {whole} is not null THEN array({whole}) ELSE {fold} END)[0]"
    return words.withColumn("_ranks", rank_map(ranks)).withColumn("ids", F.expr(f"transform(array(_ranks), r -> {ids})[0]")).drop("_ranks")


def round_trip(documents: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of documents, as bpe.round_trip gives them, without Python.

    Null text is empty; repeated rows repeat their result; an empty table gives no rows. Each distinct word is folded once.
    """
    ranks = load_ranks(ranks_path)
    text = F.coalesce("text", F.lit(""))
    docs = documents.select(F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th")).alias("doc"), text.alias("text"))
    once = docs.groupBy("doc").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    words = once.select("doc", "copies", F.posexplode_outer(F.regexp_extract_all("text", F.lit(split_pattern(pattern)), F.lit(0))).alias("pos", "word"))
    ids = fold_words(words.select("word").filter("word is not null").distinct(), ranks)
    # ids of four bytes, the least first, as hexadecimal digits
    digits = F.transform("ids", lambda i: F.transform(F.array(F.lpad(F.hex(i), 8, "0")), lambda h: F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))))[0])
    ids = ids.select("word", "ids", F.array_join(digits, "").alias("packed"))
    found = words.join(ids, "word", "left").groupBy("doc", "copies").agg(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("pos", "ids", "packed")))).alias("parts"))
    packed = F.unhex(F.array_join("parts.packed", ""))
    decoded = F.expr("transform(array(_pieces), x -> encode(array_join(transform(flatten(parts.ids), i -> get(x, i)), ''), 'ISO-8859-1'))[0]")
    out = found.withColumn("_pieces", piece_list(ranks)).select(
        F.col("doc.id").alias("doc_id"), F.size(F.flatten("parts.ids")).cast("long").alias("n_tokens"), F.sha2(packed, 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256"), "copies"
    )
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
