"""How like every memory is to one reference: content, tags, importance, time, use and structure; and that as a distance of 1 to 5."""
from collections import Counter
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.similarity import jaro_winkler
from recollect.operators.related import jaccard, word_set
from recollect.session import materialize

#: From which likeness words, tags and parts of tags match; and what each part of likeness and of distance weighs.
WORD, TAG, TAG_PART = 0.8, 0.85, 0.9
CONTENT = (0.3, 0.25, 0.25, 0.2)
SIMILARITY = (0.3, 0.25, 0.15, 0.15, 0.1, 0.05)
DISTANCE = (0.3, 0.25, 0.2, 0.15, 0.1)


def fuzzy_matches(vocabulary: DataFrame, words: list[str], above: float = WORD) -> DataFrame:
    """word, hits: which of a few words each word of vocabulary(word) resembles, for those that resemble any.

    A bound from lengths, common letters and common beginnings leaves few pairs to measure. It is had for many words at once:
    what two words have in common is the product of their rows of "holds this letter so many times".
    """
    most = Counter()
    for w in words:
        most |= Counter(w)
    place = {c: i for i, c in enumerate((c, k) for c, n in sorted(most.items()) for k in range(1, n + 1))}

    def letters(ws: list[str]) -> np.ndarray:
        out = np.zeros((len(ws), len(place)), np.float32)
        for i, w in enumerate(ws):
            seen: dict[str, int] = {}
            for c in w:
                seen[c] = k = seen.get(c, 0) + 1
                if (at := place.get((c, k))) is not None:
                    out[i, at] = 1
        return out

    def heads(ws: list[str], end: int) -> np.ndarray:
        return np.array([[ord(c) for c in w[:4]] + [end] * (4 - len(w[:4])) for w in ws], np.int32).reshape(len(ws), 4)

    lengths = lambda ws: np.maximum(np.array([len(w) for w in ws], np.float32), 1)
    table, own, begin = letters(words).T.copy(), lengths(words), heads(words, -1)

    def bounded(ws: list[str]) -> np.ndarray:
        m = letters(ws) @ table
        jaro = np.where(m > 0, (m / own + m / lengths(ws)[:, None] + 1) / 3, 0)
        common, same, theirs = np.zeros(m.shape, np.float32), np.ones(m.shape, bool), heads(ws, -2)
        for k in range(4):
            same &= theirs[:, k, None] == begin[None, :, k]
            common += same
        return jaro + np.float32(0.1) * common * (1 - jaro) > above - 1e-5

    @F.pandas_udf("array<int>")
    def hits(s: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(s), 1024):
            ws = s.iloc[at : at + 1024].tolist()
            found: list[list[int]] = [[] for _ in ws]
            for i, j in np.argwhere(bounded(ws)).tolist():
                if jaro_winkler(words[j], ws[i]) > above:
                    found[i].append(j)
            out += found
        return pd.Series(out, index=s.index, dtype=object)

    hits = hits.asNondeterministic()  # or the filter has it run a second time

    return vocabulary.select("word", hits("word").alias("hits")).filter(F.size("hits") > 0)


@cache
def tags_alike(a: str, b: str) -> bool:
    """Equal, alike as a whole, or with parts of over three bytes that begin alike or are alike."""
    if a == b or jaro_winkler(a, b) > TAG:
        return True
    parts = [[p for p in t.replace("-", "_").replace(" ", "_").split("_") if len(p.encode()) > 3] for t in (a, b)]
    return any(x.encode()[:4] == y.encode()[:4] or jaro_winkler(x, y) > TAG_PART for x in parts[0] for y in parts[1])


def _tag_matches(tags: Column, reference: list[str]) -> Column:
    """How many of the reference's tags have one alike among tags."""

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda own: sum(any(tags_alike(r, t) for t in own) for r in reference) if own is not None else 0)

    return run(tags)


def like(memories: DataFrame, reference: str) -> DataFrame:
    """key, similarity, distance of every memory to the one of that key; no rows if there is none.

    The reference is one row and becomes literals of the plan; words meet its words by way of the store's distinct words.
    """
    found = memories.filter(F.col("key") == reference).select("*", word_set(F.col("value"), 2).alias("_w"), F.octet_length("value").alias("_n"), F.unix_seconds(F.col("created_at").cast("timestamp")).alias("_c"), F.unix_seconds(F.col("last_accessed").cast("timestamp")).alias("_a")).first()
    if found is None:
        return memories.select("key", F.lit(0.0).alias("similarity"), F.lit(5).alias("distance")).limit(0)
    words, tags = sorted(found["_w"]), sorted(set(found["tags"] or []))
    m = memories.select("key", word_set(F.col("value"), 2).alias("w"), F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags"), "importance", "access_count", F.octet_length("value").alias("n"),
                        F.unix_seconds(F.col("created_at").cast("timestamp")).alias("c"), F.unix_seconds(F.col("last_accessed").cast("timestamp")).alias("a"))
    m = materialize(m, "likeness-rows")
    own = m.select("key", F.explode("w").alias("word"))
    # both are written: the filter on a function of words would be moved before distinct(), and to the other side of the join, and measure every occurrence of a word
    hits = materialize(fuzzy_matches(materialize(own.select("word").distinct(), "likeness-words"), words), "likeness-hits")
    fuzzy = own.join(hits, "word").select("key", F.explode("hits").alias("i")).groupBy("key").agg(F.count_distinct("i").alias("fuzzy"))
    m = m.join(fuzzy, "key", "left").withColumn("alike", _tag_matches(F.col("tags"), tags))

    refw, reft = (F.array(*map(F.lit, x)).cast("array<string>") for x in (words, tags))
    both, n1, n2 = F.size(F.array_intersect("w", refw)), F.lit(len(words)), F.size("w")
    some = (n1 > 0) & (n2 > 0)
    share = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    parts = (share(both, n1 + n2 - both), share(both, F.sqrt(n1 * n2)), share(F.coalesce("fuzzy", F.lit(0)), F.greatest(n1, n2)), share(both, F.least(n1, n2)))
    mix = lambda ws, cs: sum((w * c for w, c in zip(ws, cs, strict=True)), F.lit(0.0))
    content = F.when(some, mix(CONTENT, parts)).otherwise(0.0)
    t1, t2 = F.lit(len(tags)), F.size("tags")
    most = F.greatest(t1, t2)
    tag = F.when((t1 > 0) & (t2 > 0), 0.7 * share(F.size(F.array_intersect("tags", reft)), most) + 0.3 * share(F.col("alike"), most)).otherwise(0.0)
    d = F.abs(F.col("importance") - found["importance"])
    weight = 0.4 * F.greatest(F.lit(0.0), 1 - d) + 0.3 * F.exp(-2 * d) + 0.3 * F.exp(-d * d / 0.1)
    h = F.floor(F.abs(F.col("c") - found["_c"]) / 3600)
    time = 0.3 * F.greatest(F.lit(0.0), 1 - h / 168) + 0.4 * F.exp(-h / 72) + 0.3 * F.exp(-F.pow(h / 24, F.lit(2.0)) / 2)
    near = lambda x, y: F.when(F.greatest(x, y) > 0, 1 - F.abs(x - y) / F.greatest(x, y)).otherwise(1.0)
    use = 0.6 * near(F.col("access_count"), F.lit(found["access_count"])) + 0.4 / (1 + F.floor(F.abs(F.col("a") - found["_a"]) / 3600) / 24)
    length, vocabulary = near(F.col("n"), F.lit(found["_n"])), near(n2, n1)
    form = 0.5 * length + 0.3 * vocabulary + 0.2 * near(t2, t1)
    similarity = mix(SIMILARITY, (content, tag, weight, time, use, form))

    far_tags = F.when((t1 == 0) & (t2 == 0), 0.0).when((t1 == 0) | (t2 == 0), 3.0).otherwise(3 * (1 - 0.6 * jaccard(F.col("tags"), reft) - 0.4 * tag))
    far_time = F.when(h < 1, 0.0).when(h < 24, 1.0).when(h < 168, 2.0).when(h < 720, 3.0).otherwise(4.0)
    far_weight = F.when(d < 0.1, 0.0).when(d < 0.3, 1.0).when(d < 0.5, 2.0).otherwise(3.0)
    far = F.round(mix(DISTANCE, (3 * (1 - content), far_tags, far_time, far_weight, (2 * (1 - length) + 2 * (1 - vocabulary)) / 2)), 9)
    step = F.when(far < 0.2, 1).when(far < 0.4, 2).when(far < 0.6, 3).when(far < 0.8, 4).otherwise(5)
    return m.select("key", similarity.alias("similarity"), step.alias("distance"))


def filter_like(found: DataFrame, memories: DataFrame, reference: str, least: float | None = None, most_distant: int | None = None) -> DataFrame:
    """Rows of found(key, ..) that are like enough (to nine places), or near enough, to a reference; all of them if the store does not hold it."""
    if memories.filter(F.col("key") == reference).isEmpty():
        return found
    near = like(memories, reference)
    if least is not None:
        near = near.filter(F.round("similarity", 9) >= least)
    if most_distant is not None:
        near = near.filter(F.col("distance") <= most_distant)
    return found.join(near.select("key"), "key", "left_semi")
