"""The driver's tables as memories, links, versions and access events; and the same in DuckDB's SQL."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every score that depends on the time is computed as of this moment, never by the wall clock.
AS_OF = "2025-06-01 00:00:00"
#: A fixed query set; terms are matched as the reference's stores match them.
QUERIES = [("q1", "the license version"), ("q2", "token password secret"), ("q3", "ung keit der"), ("q4", "apache the the"), ("q5", "zzzz-nothing")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as memories: what the table lacks (times, counts, importance) follows from doc_id."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("key"),
        F.coalesce("text", F.lit("")).alias("value"),
        F.expr("if(doc_id % 3 = 0, 'LongTerm', 'ShortTerm')").alias("memory_type"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(doc_id % 365, doc_id % 24)").alias("created_at"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(doc_id % 365 + doc_id % 50, doc_id % 24)").alias("last_accessed"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(doc_id % 365 + doc_id % 20, doc_id % 24)").alias("last_modified"),
        F.expr("doc_id % 17").alias("access_count"),
        F.array("lang", "source").alias("tags"),
        F.expr("map('lang', lang, 'bucket', cast(doc_id % 7 as string))").alias("custom_fields"),
        F.expr("(doc_id % 101) / 100D").alias("importance"),
        F.expr("(doc_id % 11) / 10D").alias("confidence"),
    )


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores if it is so small that a file's row groups may give fewer; else as it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    each = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if size < cores * each else df


MEMORIES = """mem AS (SELECT doc_id::VARCHAR AS key, coalesce(text, '') AS value,
  CASE WHEN doc_id % 3 = 0 THEN 'LongTerm' ELSE 'ShortTerm' END AS memory_type,
  TIMESTAMP '2024-01-01' + to_days((doc_id % 365)::INT) + to_hours(doc_id % 24) AS created_at,
  TIMESTAMP '2024-01-01' + to_days((doc_id % 365 + doc_id % 50)::INT) + to_hours(doc_id % 24) AS last_accessed,
  TIMESTAMP '2024-01-01' + to_days((doc_id % 365 + doc_id % 20)::INT) + to_hours(doc_id % 24) AS last_modified,
  doc_id % 17 AS access_count, [lang, source] AS tags, lang, source, (doc_id % 7)::VARCHAR AS bucket,
  (doc_id % 101) / 100::DOUBLE AS importance, (doc_id % 11) / 10::DOUBLE AS confidence FROM documents)"""


def hours_since(column: str, as_of: str = AS_OF):
    """Hours, with fractions, from a timestamp without zone to as_of."""
    return F.expr(f"timestampdiff(SECOND, {column}, timestamp_ntz'{as_of}') / 3600D")


def hours_sql(column: str, as_of: str = AS_OF) -> str:
    return f"(date_diff('second', {column}, TIMESTAMP '{as_of}') / 3600::DOUBLE)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").cast("array<double>").alias("embedding"), "label")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of the relational tables: customers and suppliers are part_of nations, nations part_of regions, orders related_to customers.

    Validity of an edge: orders hold from their date on, every third for a year only; the others always.
    """
    t = lambda n: table(spark, sf_dir, n)
    part = [("nation", "n:", "n_nationkey", "r:", "n_regionkey"), ("customer", "c:", "c_custkey", "n:", "c_nationkey"), ("supplier", "s:", "s_suppkey", "n:", "s_nationkey")]
    open_ = F.lit(None).cast("timestamp_ntz")
    rows = None
    for name, a, ka, b, kb in part:
        e = t(name).select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("src"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("dst"), F.lit("part_of").alias("rel_type"),
                           F.expr(f"({ka} % 10 + 1) / 10D").alias("strength"), F.lit(1.0).alias("confidence"), open_.alias("valid_from"), open_.alias("valid_to"))
        rows = e if rows is None else rows.unionByName(e)
    o = t("orders").select(
        F.expr("concat('o:', cast(o_orderkey as string))").alias("src"), F.expr("concat('c:', cast(o_custkey as string))").alias("dst"), F.lit("related_to").alias("rel_type"),
        F.expr("(o_orderkey % 10 + 1) / 10D").alias("strength"), F.expr("(o_orderkey % 5 + 5) / 10D").alias("confidence"),
        F.expr("cast(o_orderdate as timestamp_ntz)").alias("valid_from"), F.expr("if(o_orderkey % 3 = 0, cast(o_orderdate as timestamp_ntz) + interval '365' day, null)").alias("valid_to"))
    return rows.unionByName(o)


def memory_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between memories, src, dst, rel_type, strength: what the tables lack follows from doc_id."""
    d = table(spark, sf_dir, "documents").select("doc_id").filter("doc_id >= 1")
    kinds = [("doc_id div 2", "part_of", "true"), ("doc_id - 7", "derives", "doc_id >= 7 and doc_id % 3 = 0"), ("doc_id - 10", "references", "doc_id >= 10 and doc_id % 5 = 0")]
    rows = F.array(*(F.when(F.expr(when), F.struct(F.expr(dst).alias("dst"), F.lit(kind).alias("rel_type"))) for dst, kind, when in kinds))
    e = d.select("doc_id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("e"))
    return e.select(F.col("doc_id").cast("string").alias("src"), F.col("e.dst").cast("string").alias("dst"), "e.rel_type", F.expr("(doc_id % 10 + 1) / 10D").alias("strength"))


MEMORY_LINKS = """links AS (SELECT doc_id::VARCHAR AS src, (doc_id // 2)::VARCHAR AS dst, 'part_of' AS rel_type, (doc_id % 10 + 1) / 10::DOUBLE AS strength FROM documents WHERE doc_id >= 1
  UNION ALL SELECT doc_id::VARCHAR, (doc_id - 7)::VARCHAR, 'derives', (doc_id % 10 + 1) / 10::DOUBLE FROM documents WHERE doc_id >= 7 AND doc_id % 3 = 0
  UNION ALL SELECT doc_id::VARCHAR, (doc_id - 10)::VARCHAR, 'references', (doc_id % 10 + 1) / 10::DOUBLE FROM documents WHERE doc_id >= 10 AND doc_id % 5 = 0)"""

EDGES = """edges AS (
  SELECT 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst, 'part_of' AS rel_type, (n_nationkey % 10 + 1) / 10::DOUBLE AS strength, 1.0::DOUBLE AS confidence, NULL::TIMESTAMP AS valid_from, NULL::TIMESTAMP AS valid_to FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'part_of', (c_custkey % 10 + 1) / 10::DOUBLE, 1.0, NULL, NULL FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'part_of', (s_suppkey % 10 + 1) / 10::DOUBLE, 1.0, NULL, NULL FROM supplier
  UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'related_to', (o_orderkey % 10 + 1) / 10::DOUBLE, (o_orderkey % 5 + 5) / 10::DOUBLE, o_orderdate::TIMESTAMP,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::TIMESTAMP + INTERVAL 365 DAY END FROM orders)"""
