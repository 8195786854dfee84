"""Outliers by density (from a table of neighbours) and by isolation (from trees that each draw their own rows)."""
import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.vector_index import VectorIndex
from recollect.session import materialize


def neighbour_graph(index: VectorIndex, vectors: DataFrame, k: int) -> DataFrame:
    """key, other, distance, rank: the k nearest of all indexed rows to each of vectors(key, embedding), exactly."""
    found = index.search(vectors.withColumnRenamed("key", "query_id"), k=k, probes=4, exact=True)
    return found.select(F.col("query_id").alias("key"), F.col("key").alias("other"), "distance", "rank")


def local_outlier_factors(graph: DataFrame) -> DataFrame:
    """key, density, lof from a table of neighbours: how much denser its neighbours lie than a row itself.

    The reach from a row to a neighbour is their distance, or the neighbour's distance to the last of its own if that is
    greater; density is one over the mean reach (plus 1e-10, so that rows repeated more than k times have one). Rows
    that nothing is near to (fewer than two in all) have no factor and are left out.
    """
    g = materialize(graph.select("key", "other", "distance"), "neighbours")
    last = g.groupBy(F.col("key").alias("other")).agg(F.max("distance").alias("_last"))
    density = materialize(g.join(last, "other").groupBy("key").agg((1 / (F.avg(F.greatest("distance", "_last")) + 1e-10)).alias("density")), "densities")
    around = g.join(density.select(F.col("key").alias("other"), F.col("density").alias("_near")), "other").groupBy("key").agg(F.avg("_near").alias("_near"))
    return density.join(around, "key").select("key", "density", (F.col("_near") / F.col("density")).alias("lof"))


#: Trees end at this depth, and score nothing over fewer rows.
DEEPEST, FEWEST = 10, 10


def mean_depth(n: float) -> float:
    """The mean depth of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, depth: int = 0):
    """A tree: (feature, cut, below, above), or how many rows are left at its end."""
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else ()
    if depth >= DEEPEST or not len(spread):
        return len(x)
    f = int(rng.choice(spread))
    cut = rng.uniform(x[:, f].min(), x[:, f].max())
    return f, cut, grow(x[x[:, f] < cut], rng, depth + 1), grow(x[x[:, f] >= cut], rng, depth + 1)


def depths(tree, x: np.ndarray) -> np.ndarray:
    """At which depth each row ends, with what the rows left there would still take."""
    out = np.zeros(len(x))
    todo = [(tree, np.arange(len(x)), 0)]
    while todo:
        node, at, depth = todo.pop()
        if isinstance(node, int):
            out[at] = depth + mean_depth(node)
        else:
            f, cut, below, above = node
            low = x[at, f] < cut
            todo += [(below, at[low], depth + 1), (above, at[~low], depth + 1)]
    return out


def tree_samples(rows: DataFrame, key: str, trees: int, size: int, n: int, seed: int) -> DataFrame:
    """tree and the columns of rows: each tree's `size` rows of n, those whose hash with the tree's number is least.

    A row is dealt to the trees where its hash lies within twice the share that is needed, so that few are ranked; a
    tree draws from the whole table, and knows nothing of other trees' rows.
    """
    share = min(1.0, 2.0 * size / n + 20.0 / n)
    at = lambda t: F.xxhash64(F.lit(seed), t, key).cast("double") / 2.0**64 + 0.5
    dealt = rows.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: at(t) < share)))
    nth = F.row_number().over(Window.partitionBy("tree").orderBy(at(F.col("tree")), key))
    return dealt.withColumn("_nth", nth).filter(F.col("_nth") <= size).drop("_nth")


def isolation_forest(rows: DataFrame, key: str, columns: list[str], trees: int = 100, seed: int = 1) -> DataFrame:
    """key, isolation of every row: 2 ** (-mean depth / expected depth) over trees that each draw the root of n rows.

    Trees are grown side by side, a group each, and number like a parameter; none is deeper than DEEPEST, so all of
    them are small enough to travel with the tasks that score. Values that are null or not finite read as 0. Fewer than
    FEWEST rows score 0. The draw follows the key and the seed, so a rerun gives the same scores.
    """
    number = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")).otherwise(0.0).alias(c)
    data = materialize(rows.select(F.col(key), *(number(c) for c in columns)), "isolation-rows")
    n = data.count()
    size = math.isqrt(n)

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key)
        t = int(g["tree"].iloc[0])
        return pd.DataFrame({"tree": [t], "grown": [pickle.dumps(grow(g[columns].to_numpy(float), np.random.default_rng([seed, t])))]})

    forest = []
    if n >= FEWEST:
        grown = tree_samples(data, key, trees, size, n, seed).groupBy("tree").applyInPandas(one, "tree int, grown binary")
        forest = [pickle.loads(r.grown) for r in grown.orderBy("tree").collect()]  # `trees` rows of at most 2**DEEPEST nodes

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        x = np.stack([v.to_numpy(float) for v in values], axis=1)
        if not forest:
            return pd.Series(np.zeros(len(x)))
        return pd.Series(2 ** (-np.mean([depths(t, x) for t in forest], axis=0) / max(mean_depth(size), 1e-9)))

    return data.select(key, score(*columns).alias("isolation"))
