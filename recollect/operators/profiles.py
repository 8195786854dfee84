"""Profiles of tables and files, selection of features, compression, and private statistics of texts."""
import math
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import UnivariateFeatureSelector, VarianceThresholdSelector, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.analytics import laplace, running_counts

#: From which share of nulls values are missing, and below which share of distinct values they repeat.
MISSING_FROM, REPEATED_BELOW = 0.1, 0.1
#: Compression is worth its keep below this ratio.
WORTHWHILE = 0.85
#: Compressed texts that leave a task at once.
RESULTS = 256


def column_counts(df: DataFrame) -> DataFrame:
    """name, rows, nulls, distinct of every column, from one pass."""
    # empty strings are no values
    value = lambda c: F.when(F.col(f"`{c}`").cast("string") == "", None).otherwise(F.col(f"`{c}`"))
    one = df.agg(F.count(F.lit(1)).alias("rows"), *(F.struct(F.count(value(c)).alias("n"), F.count_distinct(value(c)).alias("d")).alias(f"c{i}") for i, c in enumerate(df.columns)))
    each = F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"c{i}.n").alias("n"), F.col(f"c{i}.d").alias("d")) for i, c in enumerate(df.columns)))
    return one.select("rows", F.explode(each).alias("e")).select("e.name", "rows", (F.col("rows") - F.col("e.n")).alias("nulls"), F.col("e.d").alias("distinct"))


def data_patterns(df: DataFrame) -> DataFrame:
    """name, pattern, share, confidence: columns with many missing values, and those whose values repeat much."""
    c = column_counts(df)
    missing, unique = F.try_divide("nulls", "rows"), F.try_divide("distinct", "rows")
    a = c.filter(missing > MISSING_FROM).select("name", F.lit("Missing").alias("pattern"), missing.alias("share"), F.lit(0.9).alias("confidence"))
    b = c.filter((unique < REPEATED_BELOW) & (F.col("distinct") > 1)).select("name", F.lit("Duplicate").alias("pattern"), unique.alias("share"), F.lit(0.8).alias("confidence"))
    return a.unionByName(b)


def columns_of(df: DataFrame) -> DataFrame:
    """position, name, type, nullable of a result's columns; nothing is read."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def csv_profile(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    """name, rows, nulls, distinct, type of a CSV file's columns; without a header they are called column_0 and on."""
    raw = spark.read.option("sep", delimiter).option("header", header).csv(path)
    typed = spark.read.option("sep", delimiter).option("header", header).option("inferSchema", True).csv(path)
    names = raw.columns if header else [f"column_{i}" for i in range(len(raw.columns))]
    kinds = {"int": "Integer", "bigint": "Integer", "double": "Float", "boolean": "Boolean", "date": "Date", "timestamp": "DateTime"}
    types = spark.createDataFrame([(n, kinds.get(f.dataType.simpleString(), "Text")) for n, f in zip(names, typed.schema, strict=True)], "name string, type string")
    return column_counts(raw.toDF(*names)).join(F.broadcast(types), "name")  # a row a column


def compressed(memories: DataFrame, level: int = 6) -> DataFrame:
    """key, original_size, compressed_size, ratio, data of the texts that zlib makes smaller than WORTHWHILE; others stay as they are and are left out."""

    kind = dict(memories.dtypes)["key"]

    def squeeze(batches):
        # texts are compressed where they lie, and few results are held at once
        for batch in batches:
            for at in range(0, batch.num_rows, RESULTS):
                b = batch.slice(at, RESULTS)
                data = [None if t is None else zlib.compress(t.as_buffer(), level) for t in (x if x.is_valid else None for x in b.column(2).cast(pa.binary()))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], ["key", "original_size", "data"])

    c = memories.select("key", F.octet_length("value").alias("original_size"), "value").mapInArrow(squeeze, f"key {kind}, original_size int, data binary")
    c = c.withColumn("compressed_size", F.octet_length("data")).withColumn("ratio", F.try_divide("compressed_size", "original_size"))
    return c.filter(F.col("ratio") < WORTHWHILE).select("key", "original_size", "compressed_size", "ratio", "data")


def decompressed(table: DataFrame) -> DataFrame:
    """key, value of what compressed() gave."""

    @F.pandas_udf("string")
    def restore(values: pd.Series) -> pd.Series:
        return values.map(lambda b: zlib.decompress(b).decode() if b is not None else None)

    return table.select("key", restore("data").alias("value"))


def select_features(rows: DataFrame, columns: list[str], least_variance: float | None = None, label: str | None = None, best: int | None = None) -> list[str]:
    """Names of the columns whose variance exceeds a threshold, or of the best k by their F-test with a label."""
    v = VectorAssembler(inputCols=columns, outputCol="_features", handleInvalid="skip").transform(rows)
    if least_variance is not None:
        model = VarianceThresholdSelector(featuresCol="_features", outputCol="_chosen", varianceThreshold=least_variance).fit(v)
    else:
        s = UnivariateFeatureSelector(featuresCol="_features", labelCol=label, outputCol="_chosen", selectionMode="numTopFeatures")
        model = s.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(best).fit(v)
    return [columns[i] for i in sorted(model.selectedFeatures)]


def _positive(epsilon: float) -> None:
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")


def private_histogram(memories: DataFrame, epsilon: float, bins: int = 10, seed: int | None = None) -> DataFrame:
    """bin, count: texts by length in bytes in bins of equal width up to the longest, each count with Laplace noise, 0 at least. The bins' sum is the noisy total."""
    _positive(epsilon)
    sizes = memories.select(F.octet_length("value").alias("n"))
    width = F.greatest(F.lit(1), F.ceil(F.coalesce(F.max("n"), F.lit(0)) / bins))
    by = sizes.join(F.broadcast(sizes.agg(width.alias("w")))).groupBy(F.least(F.floor(F.col("n") / F.col("w")), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("k"))
    every = memories.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(by, "bin", "left").select("bin", F.greatest(F.lit(0.0), F.coalesce("k", F.lit(0)) + laplace(1 / epsilon, seed)).alias("count"))


def private_quantile(memories: DataFrame, epsilon: float, quantile: float, seed: int | None = None) -> DataFrame:
    """quantile: the length at the rounded place quantile * (n - 1) of all lengths in order, with Laplace noise of scale 1000 / epsilon, 0 at least."""
    _positive(epsilon)
    run = running_counts(memories.select(F.octet_length("value").alias("size")), "size")
    found = F.min(F.when(F.col("upto") > F.floor(quantile * (F.col("n") - 1) + 0.5), F.col("x")))
    return run.agg(F.coalesce(found, F.lit(0)).alias("exact")).select(F.greatest(F.lit(0.0), F.col("exact") + laplace(1000 / epsilon, seed)).alias("quantile"))


def private_text(text: Column, epsilon: float, seed: int = 1) -> Column:
    """Randomized response: each character stays with probability e^epsilon / (e^epsilon + 1), else it is a letter drawn at random."""
    _positive(epsilon)
    letters = "abcdefghijklmnopqrstuvwxyz"
    # the draw follows from the seed, the text and the place, so that a task that is run again gives the same
    draw = lambda i, k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), text, i), F.lit(1 << 30)) / float(1 << 30)
    p = math.exp(epsilon) / (math.exp(epsilon) + 1)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(draw(i, 1) < p, c).otherwise(F.substring(F.lit(letters), (F.floor(draw(i, 2) * len(letters)) + 1).cast("int"), F.lit(1)))), "")
