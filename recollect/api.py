"""A store of memories as a client uses it: remember, recall, reflect, forget, and statements."""
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import decay as D
from recollect.operators import context as C
from recollect.operators import graph as G
from recollect.operators import retrieval as R
from recollect.operators.statements import Statements
from recollect.session import materialize
from recollect.sources.store import MemoryTable, create_tables

MEMORY = "key string, value string, memory_type string, created_at timestamp_ntz, last_accessed timestamp_ntz, access_count long, tags array<string>, custom_fields map<string,string>, importance double, confidence double"
LINK = "src string, dst string, rel_type string, strength double"
#: Fields that say a memory was replaced by a newer one, or that its facts stand beside it.
SUPERSEDED, RAW_SOURCE = "superseded", "raw_source"


class Memory:
    """Tables of memories, their vectors and their links; changes give new tables, and time is always an argument."""

    def __init__(self, spark: SparkSession, memories: DataFrame | None = None, vectors: DataFrame | None = None, links: DataFrame | None = None):
        empty = lambda schema: spark.createDataFrame([], schema)
        self.spark = spark
        self.memories = MemoryTable(empty(MEMORY) if memories is None else memories)
        self.vectors = empty("key string, embedding array<double>") if vectors is None else vectors
        self.links = empty(LINK) if links is None else links

    def remember(self, value: str, at: datetime, key: str | None = None, tags: list[str] | None = None, importance: float = 0.5) -> str:
        """Stores a text under a key, or under one that follows from the text; returns the key."""
        if not value:
            raise ValueError("nothing to remember")
        if not 0 <= importance <= 1:
            raise ValueError("importance lies between 0 and 1")
        row = self.spark.createDataFrame([(key, value, "ShortTerm", at, at, 0, tags or [], {}, importance, 1.0)], MEMORY)
        if key is None:
            row = row.withColumn("key", F.concat(F.lit("memory-"), F.substring(F.sha2("value", 256), 1, 16)))
            key = row.first().key
        self.memories = self.memories.store(row)
        return key

    def remember_all(self, texts: DataFrame, at: datetime, importance: float = 0.5) -> DataFrame:
        """Stores every text of texts(value, and key, tags, if it has them) as remember() does one; returns the keys. Null and empty texts are left out; of rows that share a key the least text counts."""
        if not 0 <= importance <= 1:
            raise ValueError("importance lies between 0 and 1")
        have = lambda c, other: F.coalesce(F.col(c), other) if c in texts.columns else other
        named = F.concat(F.lit("memory-"), F.substring(F.sha2("value", 256), 1, 16))
        rows = texts.filter("value <> ''").select(have("key", named).alias("key"), "value", have("tags", F.array().cast("array<string>")).alias("tags"))
        rows = rows.groupBy("key").agg(F.min(F.struct("value", "tags")).alias("r")).select(
            "key", "r.value", F.lit("ShortTerm").alias("memory_type"), *(F.lit(at).cast("timestamp_ntz").alias(c) for c in ("created_at", "last_accessed")), F.lit(0).cast("long").alias("access_count"),
            "r.tags", F.create_map().cast("map<string,string>").alias("custom_fields"), F.lit(float(importance)).alias("importance"), F.lit(1.0).alias("confidence"))
        self.memories = self.memories.store(rows)
        return rows.select("key")

    def recall(self, queries: list[tuple[str, str]], as_of: datetime, k: int = 10, query_vectors: dict[str, str] | None = None, exclude: tuple[str, ...] = (SUPERSEDED, RAW_SOURCE)) -> DataFrame:
        """The k best memories of each question, then without those marked: fewer may be left, as marks are looked at last."""
        if any(not q.strip() for _, q in queries) or not 1 <= k <= 10_000:
            raise ValueError("a question is not empty, and k lies between 1 and 10,000")
        found = R.hybrid_search(self.memories.rows, self.vectors, self.links, queries, query_vectors or {}, as_of, k)
        return without_marked(found, self.memories.rows, exclude)

    def reflect(self, threshold: float = 0.3, least: int = 2) -> DataFrame:
        """Clusters of memories with like vectors: cluster, members, coherence, representative."""
        return C.insights(self.vectors, materialize(G.similar_links(self.vectors, threshold), "near-links"), least)

    def forget(self, as_of: datetime, floor: float = 0.1) -> DataFrame:
        """Removes the memories whose retained strength is below a floor; returns their keys and strengths."""
        if not 0 <= floor <= 1:
            raise ValueError("a floor lies between 0 and 1")
        hours = F.expr(f"timestampdiff(SECOND, last_accessed, timestamp_ntz'{as_of}') / 3600D")
        kept = D.ebbinghaus(hours, F.col("importance"), F.lit(0.0), F.lit(0.0)) * D.recency_of_access(hours, F.col("access_count"))
        gone = self.memories.rows.select("key", kept.alias("strength")).filter(F.col("strength") < floor)
        self.memories = self.memories.delete(gone)
        return gone

    def statements(self) -> Statements:
        """The statement language over these tables."""
        return Statements(self.spark, {"memories": self.memories.rows, "edges": self.links, "vectors": self.vectors})

    def create_tables(self, root: str) -> DataFrame:
        return create_tables(self.spark, root)


def without_marked(found: DataFrame, memories: DataFrame, marks: tuple[str, ...]) -> DataFrame:
    """found without the keys whose memory carries one of the fields."""
    marked = memories.filter(F.arrays_overlap(F.map_keys("custom_fields"), F.array(*map(F.lit, marks)))).select("key") if marks else memories.select("key").limit(0)
    return found.join(marked, "key", "left_anti").select(*found.columns)
