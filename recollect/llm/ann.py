"""Nearest neighbours by a block matrix join: int8 tiles bound the distances, the pairs left are measured in double."""
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block of candidates and of queries; a task holds one of each, and multiplies so many queries at a time.
BLOCK, STEP = 16384, 128


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not all zero (so not empty)."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(embedding.isNotNull() & ~odd & F.exists(embedding, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, the scale of each, and how far (Euclidean) each scaled row is from its original."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    q = np.rint(x / scale[:, None]).astype(np.int8)
    err = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))
    return q, scale, err


def tile(cand_ids, cands, query_ids, queries, k: int):
    """For each query, its k nearest of the candidates with another id: (query index, [(distance, id), ..]) by exact distance.

    With quantised rows a' and b', |d(a, b) - d(a', b')| is at most the two quantisation errors. Only candidates whose
    lower bound does not exceed the k-th smallest upper bound are measured on the original vectors.
    """
    q, qs, qe = quantise(queries)
    c, cs, ce = quantise(cands)
    # products of int8 in float are exact while dims * 127**2 fits the mantissa
    kind = np.float32 if queries.shape[1] * 127 * 127 < 2**24 else np.float64
    cf, qf = c.astype(kind), q.astype(kind)
    cn = (c.astype(np.float64) ** 2).sum(axis=1) * cs**2
    qn = (q.astype(np.float64) ** 2).sum(axis=1) * qs**2
    for at in range(0, len(queries), STEP):
        rows = slice(at, at + STEP)
        dot = (qf[rows] @ cf.T).astype(np.float64) * qs[rows, None] * cs[None, :]
        d = np.sqrt(np.maximum(qn[rows, None] + cn[None, :] - 2 * dot, 0))
        slack = (qe[rows, None] + ce[None, :]) * (1 + 1e-9) + 1e-6 * (1 + d)
        for i, (row, off) in enumerate(zip(d, slack, strict=True), start=at):
            other = cand_ids != query_ids[i]
            upper = (row + off)[other]
            if not len(upper):
                continue
            bound = np.partition(upper, k - 1)[k - 1] if len(upper) > k else upper.max()
            near = np.flatnonzero(other & (row - off <= bound))
            exact = np.sqrt(((cands[near] - queries[i]) ** 2).sum(axis=1))
            yield i, heapq.nsmallest(k, zip(exact.tolist(), cand_ids[near].tolist(), strict=True))


def nearest(embeddings: DataFrame, is_query: Column, k: int = 10, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows by Euclidean distance, ties to the smaller id.

    Queries are the rows where is_query holds. Rows that are not usable() or have a null id take no part; rows that
    repeat id and vector count once, and a query's own id is no candidate; vectors of different length are never
    neighbours. Fewer candidates than k give fewer rows; an empty table gives none. Queries and candidates are cut
    into blocks and each pair of blocks is one task, so a task's memory does not depend on the table. Exact: the
    bounds drop no neighbour.
    """
    rows = embeddings.filter(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).withColumn("_q", F.coalesce(is_query, F.lit(False)))
    # floats are shuffled as floats and measured in double, which holds them exactly
    single = embeddings.schema[vec_col].dataType.simpleString() == "array<float>"
    rows = rows.select(F.col(id_col).alias("id"), (F.col(vec_col) if single else F.col(vec_col).cast("array<double>")).alias("v"), "_q")
    rows = rows.groupBy("id", "v").agg(F.max("_q").alias("_q")).withColumn("dim", F.size("v")).withColumn("h", F.xxhash64("id", "v"))
    n, m = rows.agg(F.count(F.lit(1)), F.count_if("_q")).first()
    down, across = max(1, -(-n // block)), max(1, -(-m // block))
    spread = lambda parts, seed: F.pmod(F.xxhash64(F.lit(seed), "h"), F.lit(parts)).cast("int")
    own = F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c")
    left = rows.select("id", "v", "dim", spread(down, 1).alias("r"), own)
    own = F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("r2")
    right = rows.filter("_q").select(F.col("id").alias("query_id"), F.col("v").alias("query"), F.col("h").alias("key"), F.col("dim").alias("dim2"), spread(across, 2).alias("c2"), own)

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(b):
            ids, keys = b["query_id"].to_numpy(), b["key"].to_numpy()
            left, right = (np.stack(list(x)).astype(np.float64) for x in (a["v"], b["query"]))
            for i, best in tile(a["id"].to_numpy(), left, ids, right, k):
                out += [(int(keys[i]), int(ids[i]), int(x), float(d)) for d, x in best]
        return pd.DataFrame(out, columns=["h", "query_id", "vec_id", "score"])

    tiles = left.groupBy("dim", "r", "c").cogroup(right.groupBy("dim2", "r2", "c2")).applyInPandas(pair, "h long, query_id long, vec_id long, score double")

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        best = heapq.nsmallest(k, zip(g["score"].tolist(), g["vec_id"].tolist(), strict=True))
        return pd.DataFrame([(int(g["query_id"].iloc[0]), i, x, d) for i, (d, x) in enumerate(best, start=1)], columns=["query_id", "rank", "vec_id", "score"])

    return tiles.groupBy("query_id", "h").applyInPandas(merge, "query_id long, rank int, vec_id long, score double")


ORACLE = """
WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
