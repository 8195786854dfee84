"""Clusters, anomalies and rankings within groups."""
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.vectors import literal
from recollect.operators.components import connected_components
from recollect.operators.graph import similar_links
from recollect.session import materialize

#: Texts that are ranked at once; the most sentences of a text that meet in one product, and the words of a part of it.
TEXTS, DENSE, WIDTH = 256, 2048, 4096


def kmeans_first_rows(vectors: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """key, cluster of vectors(key, embedding): the first k rows by key are the centroids, ties go to the lower one, ten rounds.

    A round is one pass that assigns and sums with partial aggregation; the k centroids, whose number is a parameter, go to the tasks as literals.
    """
    v = vectors.select("key", F.col("embedding").cast("array<double>").alias("e")).persist()
    centers = [list(r.e) for r in v.orderBy("key").limit(k).collect()]
    try:
        for _ in range(rounds):
            a = _assign(v, centers)
            sums = a.select("cluster", F.posexplode("e").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m")).collect()
            new = [list(c) for c in centers]
            for r in sums:
                new[r.cluster][r.i] = r.m
            if new == centers:
                break
            centers = new
        return _assign(v, centers).select("key", "cluster")
    finally:
        v.unpersist()


def _assign(v: DataFrame, centers: list[list[float]]) -> DataFrame:
    cs = F.array(*(literal(c) for c in centers))
    d = F.transform(cs, lambda c: F.aggregate(F.zip_with("e", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return v.withColumn("d", d).select("key", "e", (F.array_position("d", F.array_min("d")) - 1).cast("int").alias("cluster"))


def dbscan_cosine(vectors: DataFrame, eps: float = 0.3, neighbours: int = 2) -> DataFrame:
    """key, cluster (its least core key): points with enough neighbours are cores, cores that are near join, others take a near core; noise is left out."""
    found = materialize(similar_links(vectors, 1 - eps, neighbours), "near-links")
    p = found.filter("v IS NOT NULL").select("u", "v")
    both = p.unionByName(p.select(F.col("v").alias("u"), F.col("u").alias("v")))
    cores = materialize(found.filter("v IS NULL").groupBy("u").agg(F.sum("n").alias("n")).filter(F.col("n") >= neighbours).select("u"), "cores")
    links = p.join(cores, "u").join(cores.select(F.col("u").alias("v")), "v").select("u", "v")
    of_core = cores.join(connected_components(links).withColumnRenamed("id", "u"), "u", "left").select("u", F.coalesce("component", "u").alias("cluster"))
    border = both.join(cores, "u", "left_anti").join(of_core.select(F.col("u").alias("v"), "cluster"), "v").groupBy("u").agg(F.min("cluster").alias("cluster"))
    return of_core.unionByName(border).withColumnRenamed("u", "key")


def _shared_words(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, count of a text's sentences that share words, whose words lie one after the other, `sizes` each: in one product, or sentence by sentence if they are many."""
    n, (names, col) = len(sizes), np.unique(words, return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    if n <= DENSE:
        common = np.zeros((n, n), np.float32)  # counts up to 2**24 are exact
        for lo in range(0, len(names), WIDTH):
            m, here = np.zeros((n, min(WIDTH, len(names) - lo)), np.float32), (col >= lo) & (col < lo + WIDTH)
            m[row[here], col[here] - lo] = 1
            common += m @ m.T
        np.fill_diagonal(common, 0)
        i, j = np.nonzero(common)
        return i, j, common[i, j].astype(float)
    holders = np.split(row[np.argsort(col, kind="stable")], np.cumsum(np.bincount(col, minlength=len(names)))[:-1])
    out = []
    for i, own in enumerate(np.split(col, np.cumsum(sizes)[:-1])):
        c = np.bincount(np.concatenate([holders[w] for w in own]), minlength=n) if len(own) else np.zeros(n, int)
        c[i] = 0
        j = np.flatnonzero(c)
        out.append((np.full(len(j), i), j, c[j].astype(float)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def textrank(texts: DataFrame, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """key, pos, rank_score of texts(key, sentences array<array<string>>, each of distinct words): PageRank over the word Jaccard of one text's sentences, from a base of 1 - damping. Texts are ranked where they lie."""
    kind = dict(texts.dtypes)["key"]

    def ranked(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n = len(sizes)
        score = np.ones(n)
        rows, cols, common = _shared_words(words, sizes) if len(words) else (np.empty(0, int), np.empty(0, int), np.empty(0))
        vals = common / (sizes[rows] + sizes[cols] - common)
        share = vals / np.bincount(cols, vals, n)[cols]
        for _ in range(rounds):
            score = (1 - damping) + damping * np.bincount(rows, share * score[cols], n)
        return score

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                b = batch.slice(at, TEXTS)
                each = b.column(1).flatten()
                words = each.flatten().dictionary_encode().indices.to_numpy()
                texts, sizes = (pc.fill_null(pc.list_value_length(c), 0).to_numpy().astype(int) for c in (b.column(1), each))
                if not len(sizes):
                    continue
                ends = np.cumsum(texts)
                begin = np.concatenate([[0], np.cumsum(sizes)])
                scores = [ranked(words[begin[e - n] : begin[e]], sizes[e - n : e]) for n, e in zip(texts, ends, strict=True) if n]
                pos = np.arange(len(sizes)) - np.repeat(ends - texts, texts)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(texts)), texts))), pa.array(pos.astype(np.int32)), pa.array(np.concatenate(scores))], ["key", "pos", "rank_score"])

    return texts.select("key", "sentences").mapInArrow(run, f"key {kind}, pos int, rank_score double")


def _race(i: int, weight: Column, seed: int) -> Column:
    """When a row arrives that waits for a time of exponential law with this rate: the first of all rows is a draw by weight. Null where the weight is 0."""
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{i}:"), F.col("key").cast("string"))), 1, 12), 16, 10).cast("double")
    return F.when(weight > 0, -F.log((digits + 0.5) / 2.0**48) / weight)


def spread_seeds(v: DataFrame, k: int, seed: int = 1) -> list[tuple[object, list[float]]]:
    """key, vector of k rows of v(key, e): the first drawn evenly, each next by its squared distance to the nearest drawn so far. Fewer if no other point is left.

    A draw is one pass that keeps one row a task; what is random follows from the key, so a rerun draws the same rows.
    """
    found: list[tuple[object, list[float]]] = []
    while len(found) < k:
        weight = F.lit(1.0)
        if found:
            centers = F.array(*(literal(c) for _, c in found))
            weight = F.array_min(F.transform(centers, lambda c: F.aggregate(F.zip_with("e", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)))
        first = v.select("key", "e", _race(len(found), weight, seed).alias("t")).agg(F.min_by(F.struct("key", "e"), "t").alias("row")).first()
        if first is None or first.row is None:
            break
        found.append((first.row.key, list(first.row.e)))
    return found


def kmeans_spread_start(vectors: DataFrame, k: int, rounds: int = 100, seed: int = 1, moved: float = 1e-6) -> DataFrame:
    """key, cluster of vectors(key, embedding) by Lloyd's rounds from spread_seeds, until no centroid moves by more than `moved`. Ties go to the lower one; a cluster that loses all rows keeps its centroid."""
    v = materialize(vectors.select("key", F.col("embedding").cast("array<double>").alias("e")), "kmeans-rows")
    centers = [c for _, c in spread_seeds(v, k, seed)]
    for _ in range(rounds if centers else 0):
        sums = _assign(v, centers).select("cluster", F.posexplode("e").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("m")).collect()  # k rows a dimension
        new = [list(c) for c in centers]
        for r in sums:
            new[r.cluster][r.i] = r.m
        far = max(np.linalg.norm(np.subtract(a, b)) for a, b in zip(new, centers, strict=True))
        centers = new
        if far <= moved:
            break
    return _assign(v, centers).select("key", "cluster") if centers else v.select("key", F.lit(0).alias("cluster")).limit(0)
