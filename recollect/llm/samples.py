"""Bounded samples of labelled rows, and ranks over a whole table."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import materialize


def bounded_ids(labelled: DataFrame, each: int) -> DataFrame:
    """doc_id, _label: at most `each` of labelled's distinct rows for each label, those with the smallest hash of doc_id.

    Hashes are even, so rows under 2 * each / n of their range hold those wanted (all but surely; else there are fewer);
    only these are ranked. Labels are few.
    """
    sizes = F.broadcast(labelled.groupBy("_label").agg(F.count(F.lit(1)).alias("_n")))
    at = F.xxhash64("doc_id").cast("double") / 2.0**64 + 0.5
    rows = labelled.join(sizes, "_label").filter(at * F.col("_n") <= 2.0 * each + 20).select("doc_id", "_label").distinct()
    nth = F.row_number().over(Window.partitionBy("_label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return rows.withColumn("_nth", nth).filter(F.col("_nth") <= each).select("doc_id", "_label")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, each: int) -> list[tuple[str, object]]:
    """(text, label) of at most `each` documents for each value of labels[label], on the driver; the same at every run.

    A null label or doc_id is no label, a null text reads as empty. Of rows that share a doc_id the least text counts, so
    that rows are bounded as ids are. The ids are sent to every task.
    """
    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_label"))
    ids = bounded_ids(ids, each)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "_label").agg(F.min("_text").alias("_text")).toPandas()
    rows = rows.sort_values(["doc_id"])
    return list(zip(rows["_text"].tolist(), rows["_label"].tolist(), strict=True))


def global_rank(df: DataFrame, *order: str, name: str = "ranks") -> DataFrame:
    """df with rank (from 1) in ascending order of columns: ranges are sorted side by side and shifted by those before. For narrow rows.

    df is written first: ranges are found by sampling it, which would compute it twice.
    """
    ranged = materialize(materialize(df, name).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("rank", inside).join(sizes, "_part").withColumn("rank", F.col("rank") + F.col("_before")).drop("_part", "_before")
