"""Structured Streaming over events: sources, sessions, counters and stateful versions."""
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.session import shared_folder

#: How late events may come.
LATE = "1 hour"
#: Accesses of a key that its state remembers.
REMEMBERED = 100


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Files that appear below path, as events with a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", step: str | None = None, late: str = LATE) -> DataFrame:
    """event_type, start, n in tumbling or sliding windows; later events than the watermark are left out."""
    w = F.window("ts", width, step) if step else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


def burst_sessions(events: DataFrame, gap: str = "60 minutes", late: str = LATE) -> DataFrame:
    """user_id, start, end, n of sessions: a gap of over `gap` ends one."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def access_patterns(events: DataFrame) -> DataFrame:
    """user_id, n, mean_interval_ms, next_ms after each batch, from state that keeps the last REMEMBERED accesses of a key."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, seen = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        for b in batches:
            n += len(b)
            seen = sorted([*seen, *(int(t.value // 1_000_000) for t in pd.to_datetime(b["ts"]))])[-REMEMBERED:]
        state.update((n, seen))
        gap = (seen[-1] - seen[0]) // (len(seen) - 1) if len(seen) > 1 else None
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "mean_interval_ms": [gap], "next_ms": [None if gap is None else seen[-1] + gap]}, dtype="object")

    return events.select("user_id", "ts").groupBy("user_id").applyInPandasWithState(
        update, "user_id long, n long, mean_interval_ms long, next_ms long", "n long, seen array<long>", "update", GroupStateTimeout.NoTimeout
    )


def kept_versions(changes: DataFrame, minutes: float = 5.0) -> DataFrame:
    """key, ts, change_type of the changes a store keeps: an Accessed one closer than `minutes` to the last kept one goes. State is that one's time."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "change_type"])
        kept = []
        for r in rows.itertuples(index=False):
            at = r.ts.value // 1000
            if last is None or r.change_type != "Accessed" or at - last >= minutes * 60_000_000:
                kept.append((key[0], r.ts, r.change_type))
                last = at
        state.update((last,))
        yield pd.DataFrame(kept, columns=["key", "ts", "change_type"])

    return changes.groupBy("key").applyInPandasWithState(update, "key string, ts timestamp, change_type string", "last long", "append", GroupStateTimeout.NoTimeout)


def upsert_batches(path: str, key: str = "key", order: str = "ts"):
    """A foreachBatch sink: batches append to a log; latest() reads the last row of each key. A batch that comes again writes the same folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    def latest(spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(path)
        cols = [c for c in rows.columns if c not in (key, "batch")]
        newest = F.struct(F.col(order), F.col("batch"))
        return rows.groupBy(key).agg(*(F.max_by(c, newest).alias(c) for c in cols))

    return write, latest


def run_to_table(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Processes all that is there now and returns the result, written below the shared folder.

    In complete mode each batch replaces the table before; in append and update mode batches add up to a log.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"
    numbers: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        numbers.append(number)

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    if not numbers:
        return spark.createDataFrame([], df.schema)
    paths = [f"{path}/batch={n}" for n in ([max(numbers)] if mode == "complete" else sorted(set(numbers)))]
    return spark.read.schema(df.schema).parquet(*paths)


def subscribe(events: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str):
    """Gives each batch's events of a type to that type's handler, all that is there now; returns the finished query.

    A handler gets (events, batch number); a batch that comes again after a failure has its number, so a handler that
    writes by number does so once.
    """

    def hand_out(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for kind, handler in handlers.items():
                handler(batch.filter(F.col("event_type") == kind), number)
        finally:
            batch.unpersist()

    q = events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(hand_out).start()
    q.awaitTermination()
    return q


def enrich_batches(path: str, fact_column: Callable):
    """A foreachBatch sink for rows(key, value): the facts of each text, as rows `key::factN` beside their source, which is marked if any was found.

    Returns the sink and a reader of what it wrote: key, value, source, raw_source. A batch that comes again overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = batch.withColumn("_f", fact_column(F.coalesce(F.col("value"), F.lit(""))))
        raw = found.select("key", "value", F.lit(None).cast("string").alias("source"), (F.size("_f") > 0).alias("raw_source"))
        facts = found.select("key", F.posexplode("_f").alias("n", "f"))
        facts = facts.select(F.concat("key", F.lit("::fact"), F.col("n").cast("string")).alias("key"), F.concat_ws(" ", "f.subject", "f.predicate", "f.object").alias("value"), F.col("key").alias("source"), F.lit(False).alias("raw_source"))
        raw.unionByName(facts).write.mode("overwrite").parquet(f"{path}/batch={number}")

    def enriched(spark: SparkSession) -> DataFrame:
        return spark.read.parquet(path).select("key", "value", "source", "raw_source")

    return write, enriched


def sync_batches(path: str, valid: str):
    """A foreachBatch sink for queued operations: those that hold `valid` are written, the others counted as failed. Returns the sink and a reader of the counts by batch."""

    def write(batch: DataFrame, number: int) -> None:
        ok = F.coalesce(F.expr(valid), F.lit(False))
        batch.filter(ok).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        batch.agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed")).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    def counts(spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{path}/counts").groupBy("batch").agg(F.sum("succeeded").alias("succeeded"), F.sum("failed").alias("failed"))

    return write, counts


def run_sink(stream: DataFrame, write, checkpoint: str) -> None:
    """Processes all that is there now through a foreachBatch sink."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def last_snapshots(snapshots: DataFrame, keep: int = 1000) -> DataFrame:
    """metric, n, mean, slope after each batch: state keeps the last `keep` snapshots of a metric and gives their count, mean and slope by order."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(zip(*state.get, strict=True)) if state.exists else []
        for b in batches:
            seen += list(zip((int(t.value // 1000) for t in pd.to_datetime(b["ts"])), b["value"].astype(float), strict=True))
        seen = sorted(seen)[-keep:]
        state.update(([t for t, _ in seen], [v for _, v in seen]))
        n = len(seen)
        mean = sum(v for _, v in seen) / n
        spread = sum((i - (n - 1) / 2) ** 2 for i in range(n))
        slope = sum((i - (n - 1) / 2) * (v - mean) for i, (_, v) in enumerate(seen)) / spread if n > 1 else 0.0
        yield pd.DataFrame({"metric": [key[0]], "n": [n], "mean": [mean], "slope": [slope]})

    return snapshots.groupBy("metric").applyInPandasWithState(update, "metric string, n long, mean double, slope double", "at array<long>, value array<double>", "update", GroupStateTimeout.NoTimeout)
