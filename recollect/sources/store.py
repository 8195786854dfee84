"""A table of memories with the operations of a store; a table is a DataFrame, and a change is a new one."""
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats told by their first bytes.
MAGIC = (("PAR1", "parquet"), ("PK", "excel"), ("ARROW1", "arrow"))


class MemoryTable:
    """Rows by key; the last write of a key wins. Methods that change return a new table."""

    def __init__(self, rows: DataFrame, key: str = "key"):
        self.rows, self.key = rows, key

    def get(self, key) -> DataFrame:
        return self.rows.filter(F.col(self.key) == key)

    def get_batch(self, keys: list) -> DataFrame:
        """A row for each key in the order asked (ordinal), null where there is none."""
        spark = self.rows.sparkSession
        asked = spark.createDataFrame(list(enumerate(keys)), T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField(self.key, self.rows.schema[self.key].dataType)]))
        return asked.join(self.rows, self.key, "left")

    def store(self, new: DataFrame) -> "MemoryTable":
        """Upsert: rows of new replace those of their key; columns that new lacks are null."""
        rest = self.rows.join(new.select(self.key).distinct(), self.key, "left_anti")
        return MemoryTable(rest.unionByName(new, allowMissingColumns=True), self.key)

    def insert_absent(self, new: DataFrame) -> "MemoryTable":
        return MemoryTable(self.rows.unionByName(new.join(self.rows.select(self.key), self.key, "left_anti"), allowMissingColumns=True), self.key)

    def update(self, new: DataFrame) -> "MemoryTable":
        """Replace rows that are there; a key that is not raises when the rows are read."""
        known = self.rows.select(F.col(self.key).alias("_known")).distinct()
        checked = new.join(known, new[self.key] == known["_known"], "left").withColumn(
            self.key, F.when(F.col("_known").isNotNull(), F.col(self.key)).otherwise(F.raise_error(F.concat(F.lit("not found: "), F.col(self.key).cast("string"))))
        )
        rest = self.rows.join(new.select(self.key).distinct(), self.key, "left_anti")
        return MemoryTable(rest.unionByName(checked.drop("_known")), self.key)

    def delete(self, keys: DataFrame) -> "MemoryTable":
        return MemoryTable(self.rows.join(keys.select(self.key).distinct(), self.key, "left_anti"), self.key)

    def apply(self, operations: DataFrame) -> "MemoryTable":
        """operations: ordinal, op (store, update, delete), and the row's columns. The last operation of a key holds; an update stores."""
        last = operations.withColumn("_n", F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc("ordinal")))).filter("_n = 1")
        rest = self.rows.join(last.select(self.key), self.key, "left_anti")
        return MemoryTable(rest.unionByName(last.filter("op <> 'delete'").select(*self.rows.columns)), self.key)

    def search_ilike(self, column: str, query: str, limit: int) -> DataFrame:
        return self.rows.filter(F.col(column).ilike(f"%{query}%")).orderBy(self.key).limit(limit)

    def checksum(self) -> DataFrame:
        """One row: rows and an order-independent checksum."""
        h = F.xxhash64(*sorted(self.rows.columns)).cast("decimal(38,0)")
        return self.rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).alias("checksum"))

    def backup(self, path: str) -> None:
        """Compressed JSON and a manifest of version and checksum."""
        self.rows.write.mode("overwrite").json(f"{path}/entries", compression="gzip")
        self.checksum().withColumn("version", F.lit("1.1")).write.mode("overwrite").json(f"{path}/manifest")

    @classmethod
    def restore(cls, spark: SparkSession, path: str, schema, key: str = "key", verify: bool = True) -> "MemoryTable":
        """Raises for another version than 1.0 or 1.1, or if the rows don't meet their checksum."""
        table = cls(spark.read.schema(schema).json(f"{path}/entries"), key)
        manifest = spark.read.schema("rows long, checksum decimal(38,0), version string").json(f"{path}/manifest").first()
        if manifest["version"] not in ("1.0", "1.1"):
            raise ValueError(f"backup version {manifest['version']}")
        if verify and tuple(table.checksum().first()) != (manifest["rows"], manifest["checksum"]):
            raise ValueError("backup does not meet its checksum")
        return table

    def merge(self, other: DataFrame, how: str) -> "MemoryTable":
        """skip: keep what is there; overwrite: upsert; fail: raise for a key that is there; merge: union of tags and maps, the later modified wins."""
        if how == "skip":
            return self.insert_absent(other)
        if how == "overwrite":
            return self.store(other)
        if how == "fail":
            both = other.join(self.rows.select(F.col(self.key).alias("_known")), F.col(self.key) == F.col("_known"), "left")
            bad = F.when(F.col("_known").isNull(), F.col(self.key)).otherwise(F.raise_error(F.concat(F.lit("exists: "), F.col("_known").cast("string"))))
            return MemoryTable(self.rows.unionByName(both.withColumn(self.key, bad).drop("_known")), self.key)
        every = self.rows.withColumn("_side", F.lit(0)).unionByName(other.withColumn("_side", F.lit(1)), allowMissingColumns=True)
        newest = F.struct("last_modified", "_side")
        cols = [F.max_by(c, newest).alias(c) for c in self.rows.columns if c not in (self.key, "tags")]
        return MemoryTable(every.groupBy(self.key).agg(*cols, F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags")).select(*self.rows.columns), self.key)


def write(df: DataFrame, path: str, fmt: str) -> None:
    """csv (with header), json, parquet, orc or text."""
    if fmt not in ("csv", "json", "parquet", "orc", "text"):
        raise ValueError(f"unsupported format {fmt}")
    df.write.mode("overwrite").option("header", True).format(fmt).save(path)


def read(spark: SparkSession, path: str, fmt: str | None = None, schema=None) -> DataFrame:
    """By format, or by the path's ending."""
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1]
    reader = spark.read.option("header", True)
    if fmt == "csv" and schema is None:
        reader = reader.option("inferSchema", True)
    return (reader.schema(schema) if schema else reader).format(fmt).load(path)


def format_of(content: Column) -> Column:
    """Format of binary content by its first bytes: parquet, excel, arrow, json, tsv or csv."""
    head = F.decode(F.substring(content, 1, 6), "ISO-8859-1")
    line = F.substring_index(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), "\n", 1)
    out = F.when(F.startswith(head, F.lit(MAGIC[0][0])), MAGIC[0][1])
    for magic, name in MAGIC[1:]:
        out = out.when(F.startswith(head, F.lit(magic)), name)
    return out.when(F.ltrim(head).rlike(r"^[\[{]"), "json").when(F.contains(line, F.lit("\t")), "tsv").otherwise("csv")


def first_bytes(spark: SparkSession, path: str, n: int = 4096) -> bytes:
    """The first bytes of a file, or of the first file that is not empty in a folder; the driver reads no more than these."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(((s.getPath().getName(), s.getPath()) for s in files.listStatus(at) if s.getLen() > 0 and not s.getPath().getName().startswith(("_", "."))), key=lambda x: x[0])
    if not found:
        return b""
    stream = files.open(found[0][1])
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def csv_delimiter(lines: list[str]) -> str:
    """Of comma, semicolon, pipe and tab, the one whose count is most even over the first five lines."""
    def evenness(d):
        n = [x.count(d) for x in lines[:5] if x]
        return (bool(n) and min(n) > 0, -(max(n) - min(n)) if n else 0, sum(n))

    return max((",", ";", "|", "\t"), key=evenness)


def csv_has_header(lines: list[str], sep: str) -> bool:
    """Line 1 has letters and line 2 a number."""
    is_number = lambda x: x.strip().lstrip("+-").replace(".", "", 1).isdigit()
    return len(lines) > 1 and any(c.isalpha() for c in lines[0]) and any(map(is_number, lines[1].split(sep)))


def discover(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, bytes of files below root."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return f.select("path", F.col("length").alias("bytes"))


def open_store(spark: SparkSession, backend: str, where: str, **options) -> DataFrame:
    """The table behind a backend: memory (a view's name), file (a path, its format by its ending or `format`), sql (a JDBC url, with `table`)."""
    if backend == "memory":
        return spark.table(where)
    if backend == "file":
        return read(spark, where, options.get("format"))
    if backend == "sql":
        return spark.read.format("jdbc").option("url", where).options(**{("dbtable" if k == "table" else k): v for k, v in options.items()}).load()
    raise ValueError(f"unknown backend {backend}")


#: The tables of a store, and what they are partitioned by.
TABLES = {
    "memories": ("key string, value string, memory_type string, created_at timestamp, last_accessed timestamp, access_count bigint, tags array<string>, custom_fields map<string,string>, importance double, confidence double", "memory_type"),
    "analytics_events": ("event_id string, event_type string, memory_key string, ts timestamp, day date, payload string", "day"),
    "relationships": ("src string, dst string, rel_type string, strength double, confidence double, valid_from timestamp, valid_to timestamp", "rel_type"),
}


def create_tables(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """name, column, type of the store's tables, which are created below root where they are not there yet."""
    rows = []
    for name, (columns, by) in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({columns}) USING parquet PARTITIONED BY ({by}) LOCATION '{root}/{prefix}{name}'")
        rows += [(name, f.name, f.dataType.simpleString()) for f in spark.table(f"{prefix}{name}").schema]
    return spark.createDataFrame(rows, "name string, column string, type string")


def alive(table: DataFrame, stored_at: str, seconds: int, as_of: Column) -> DataFrame:
    """The rows that a cache of so many seconds to live still holds at as_of."""
    return table.filter(F.expr(f"{stored_at} + make_dt_interval(0, 0, 0, {seconds})") > as_of)


def restore_legacy(spark: SparkSession, path: str, schema, key: str = "key") -> "MemoryTable":
    """The older backup: one JSON document with `entries`, a map from key to row; columns that it lacks are null."""
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    doc = spark.read.schema(T.StructType([T.StructField("entries", T.MapType(T.StringType(), fields))])).json(path, multiLine=True)
    rows = doc.select(F.explode("entries").alias("_k", "_v")).select(F.col("_k").alias(key), *(F.col(f"_v.{f.name}") for f in fields if f.name != key))
    return MemoryTable(rows, key)


def gram_postings(memories: DataFrame, most: int = 3) -> DataFrame:
    """gram, key: the distinct runs of one to `most` characters of each lower-cased text."""
    v = F.lower(F.coalesce("value", F.lit("")))
    runs = lambda n: F.when(F.length("v") >= n, F.transform(F.sequence(F.lit(1), F.length("v") - n + 1), lambda i: F.substring(F.col("v"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return memories.select("key", v.alias("v")).select("key", F.explode(F.array_distinct(F.concat(*(runs(n) for n in range(1, most + 1))))).alias("gram"))


def gram_candidates(postings: DataFrame, term: str, most: int = 3) -> DataFrame:
    """key of the rows whose postings hold every run of `most` characters of a term (all of it, if it is shorter): those that may contain it."""
    t = term.lower()
    grams = sorted({t[i : i + most] for i in range(max(1, len(t) - most + 1))})
    hit = postings.filter(F.col("gram").isin(grams)).groupBy("key").agg(F.count_distinct("gram").alias("n"))
    return hit.filter(F.col("n") == len(grams)).select("key")


def ring_nodes(keys: DataFrame, nodes: list[str], replicas: int = 2) -> DataFrame:
    """key, place, node: the nodes that hold each key, those whose hash with the key is largest; a node that leaves moves only its own keys."""
    scored = F.array_sort(F.array(*(F.struct(F.md5(F.concat_ws("/", F.lit(n), F.col("key"))).alias("h"), F.lit(n).alias("node")) for n in nodes)))
    best = F.slice(F.reverse(scored), 1, replicas)
    return keys.select("key", F.posexplode(F.transform(best, lambda x: x["node"])).alias("place", "node"))
