"""Connected components of a table of links, by alternating large and small stars."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.session import materialize


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours point to the least of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point to the least of them; u > v in e."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    others = e.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(others).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """id, component (the least id that links reach) of every id in links(u, v) but the least ones themselves.

    Links with a null end or from an id to itself say nothing. The rounds, each written to the shared folder, number
    about the logarithm of the longest path; aggregates combine before the shuffle, so a hub with many links is
    spread over tasks.
    """
    up = lambda e: e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = materialize(up(links.filter("u <> v")).distinct(), "links")
    seen = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = state
        e = materialize(_small_star(_large_star(e)), "stars")
