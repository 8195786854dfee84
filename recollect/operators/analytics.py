"""Aggregates, windows, patterns, profiles and private counts over tables of memories and events."""
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import materialize


def basic_stats(memories: DataFrame, hours_idle: Column, hours_old: Column) -> DataFrame:
    """Totals, rows accessed within seven days, mean age in days."""
    return memories.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("memory_type") == "ShortTerm").alias("short_term"), F.count_if(F.col("memory_type") == "LongTerm").alias("long_term"),
        F.count_if(hours_idle <= 168).alias("active"), F.avg(hours_old / 24).alias("mean_age_days"), F.sum(F.octet_length("value")).alias("bytes"),
    )


def size_distribution(sizes: DataFrame, column: str) -> DataFrame:
    """min, max, median (the element at n / 2) and p95 (at n * 0.95) without sorting in one task, and six buckets."""
    edges = (100, 1000, 10_000, 100_000, 1_000_000)
    run = running_counts(sizes, column).withColumnRenamed("x", "size")
    return run.agg(
        F.min("size").alias("min"), F.max("size").alias("max"), F.min(F.when(F.col("upto") > F.expr("n div 2"), F.col("size"))).alias("median"),
        F.min(F.when(F.col("upto") > F.floor(F.col("n") * 0.95), F.col("size"))).alias("p95"),
        *(F.sum(F.when((F.col("size") >= lo) & (F.col("size") < hi), F.col("k")).otherwise(0)).alias(f"bucket_{i}") for i, (lo, hi) in enumerate(zip((0, *edges), (*edges, 1 << 62), strict=True))),
    )


def running_counts(df: DataFrame, column: str) -> DataFrame:
    """x, k, upto, n: the distinct values of a column, how many rows hold each, are up to each, and are there at all. Ranges are summed side by side."""
    by = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("k"))
    ranged = materialize(by.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "running-counts")
    sums = ranged.groupBy("part").agg(F.sum("k").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = ranged.withColumn("inside", F.sum("k").over(Window.partitionBy("part").orderBy("x"))).join(F.broadcast(sums.select("part", "before")), "part")
    n = F.broadcast(ranged.agg(F.sum("k").alias("n")))
    return run.join(n).select("x", "k", (F.col("inside") + F.col("before")).alias("upto"), "n")


def percentiles(df: DataFrame, column: str, points=(50, 95, 99)) -> DataFrame:
    """Elements at index n * p / 100 of the sorted column, and the largest."""
    run = running_counts(df, column)
    return run.agg(*(F.min(F.when(F.col("upto") > F.floor(F.col("n") * p / 100), F.col("x"))).alias(f"p{p}") for p in points), F.max("x").alias("max"))


def tag_statistics(tags: DataFrame) -> DataFrame:
    """tag, n, share, effectiveness of tags(key, tag): 50 times the share below 1 %, 1 - 2 (share - 0.5) above a half, else 1."""
    total = F.broadcast(tags.agg(F.count_distinct("key").alias("total")))
    t = tags.groupBy("tag").agg(F.count_distinct("key").alias("n")).join(total).withColumn("share", F.col("n") / F.col("total"))
    s = F.col("share")
    return t.select("tag", "n", "share", F.when(s < 0.01, s * 50).when(s > 0.5, 1 - 2 * (s - 0.5)).otherwise(1.0).alias("effectiveness"))


def tag_pairs(memories: DataFrame) -> DataFrame:
    """a, b, n: sorted pairs of tags of one row, counted over all rows; pairs are made inside the row."""
    t = F.array_sort(F.array_distinct("tags"))
    pairs = F.flatten(F.transform(t, lambda x, i: F.transform(F.filter(t, lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return memories.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def linear_trend(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """slope, intercept, r2, direction, volatility (population deviation / mean) of each group by least squares."""
    g = df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.coalesce(F.try_divide(F.stddev_pop(y), F.avg(y)), F.lit(0.0)).alias("volatility")
    )
    return g.withColumn("direction", F.when(F.col("slope") > 0.01, "increasing").when(F.col("slope") < -0.01, "decreasing").otherwise("stable"))


def z_outliers(df: DataFrame, column: str, *by: str, limit: float = 2.0) -> DataFrame:
    """Rows further than limit population deviations from their group's mean; statistics are joined back, so a hot group may be split."""
    s = df.groupBy(*by).agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    z = F.try_divide(F.col(column) - F.col("_m"), F.col("_s"))
    return df.join(s, list(by)).withColumn("z", z).filter(F.abs("z") > limit).drop("_m", "_s")


def access_intervals(events: DataFrame, key: str, ts: str) -> DataFrame:
    """key, n, mean_interval_ms (whole), confidence, next_ms: the next access as the last plus the mean interval."""
    w = Window.partitionBy(key).orderBy(ts)
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    e = events.withColumn("_ms", ms).withColumn("_gap", F.col("_ms") - F.lag("_ms").over(w))
    g = e.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("_ms").alias("last_ms"), F.floor(F.avg("_gap")).alias("mean_interval_ms"), F.try_divide(F.stddev_pop("_gap"), F.avg("_gap")).alias("cv"))
    conf = F.greatest(F.lit(0.0), 1 - F.least(F.col("cv"), F.lit(1.0)))
    return g.filter("n > 1").select(key, "n", "mean_interval_ms", conf.alias("confidence"), (F.col("last_ms") + F.col("mean_interval_ms")).alias("next_ms"))


def bursts(events: DataFrame, key: str, ts: str, gap: str = "60 minutes", least: int = 5) -> DataFrame:
    """key, start, end, n: runs of events with gaps of at most `gap`, of at least `least` events."""
    s = events.groupBy(key, F.session_window(F.col(ts).cast("timestamp"), gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return s.filter(F.col("n") >= least).select(key, "start", "end", "n")


def hourly_series(events: DataFrame, ts: str, *by: str) -> DataFrame:
    """by, hour (since the epoch), n: counts of each hour from the group's first to its last, empty hours included."""
    h = events.select(*by, F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / 3600).alias("hour")).groupBy(*by, "hour").agg(F.count(F.lit(1)).alias("n"))
    span = h.groupBy(*by).agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).select(*by, F.explode(F.sequence("lo", "hi")).alias("hour"))
    return span.join(h, [*by, "hour"], "left").select(*by, "hour", F.coalesce("n", F.lit(0)).alias("n"))


def autocorrelation(series: DataFrame, lags: list[int], *by: str) -> DataFrame:
    """by, lag, acf: Pearson correlation of a series with itself shifted, by an equi-join on the hour."""
    a = series.select(*by, F.col("hour"), F.col("n").alias("x"))
    b = series.select(*by, F.col("hour").alias("h2"), F.col("n").alias("y"))
    b = b.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), (F.col("h2") - k).alias("hour")) for k in lags))).alias("s"), "y").select(*by, "s.lag", "s.hour", "y")
    return a.join(b, [*by, "hour"]).groupBy(*by, "lag").agg(F.corr("x", "y").alias("acf"))


def change_points(series: DataFrame, order: str, value: str, *by: str, width: int = 12, limit: float = 0.5) -> DataFrame:
    """Points whose mean of the `width` rows from it on differs from that of the rows before by over `limit`, relatively."""
    w = Window.partitionBy(*by).orderBy(order)
    before, after = w.rowsBetween(-width, -1), w.rowsBetween(0, width - 1)
    s = series.withColumn("before", F.avg(value).over(before)).withColumn("after", F.avg(value).over(after)).withColumn("_k", F.count(value).over(before)).withColumn("_l", F.count(value).over(after))
    change = F.try_divide(F.abs(F.col("after") - F.col("before")), F.abs("before"))
    return s.filter((F.col("_k") == width) & (F.col("_l") == width)).withColumn("change", change).filter(F.col("change") > limit).drop("_k", "_l")


def peaks(series: DataFrame, order: str, value: str, *by: str) -> DataFrame:
    """Local maxima above 1.2 times the mean of the five points around."""
    w = Window.partitionBy(*by).orderBy(order)
    s = series.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w)).withColumn("local_mean", F.avg(value).over(w.rowsBetween(-2, 2)))
    return s.filter((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b")) & (F.col(value) > 1.2 * F.col("local_mean"))).drop("_a", "_b")


def consecutive_triples(events: DataFrame, key: str, kind: str, *order: str) -> DataFrame:
    """a, b, c, n: kinds of three consecutive events of a key, those that occur more than once."""
    w = Window.partitionBy(key).orderBy(*order)
    t = events.select(F.col(kind).alias("a"), F.lead(kind, 1).over(w).alias("b"), F.lead(kind, 2).over(w).alias("c")).filter("c IS NOT NULL")
    return t.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def forecast(series: DataFrame, order: str, value: str, *by: str) -> DataFrame:
    """by, forecast, confidence: mean of the last clamp(n / 3, 3, 7) points, 1 / (1 + variance / max(mean, 1))."""
    last = Window.partitionBy(*by).orderBy(F.desc(order))
    n = series.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    s = series.withColumn("_r", F.row_number().over(last)).filter("_r <= 7").join(n, list(by)).filter(F.col("_r") <= F.greatest(F.lit(3), F.least(F.lit(7), F.expr("_n div 3"))))
    g = s.groupBy(*by).agg(F.avg(value).alias("forecast"), F.var_pop(value).alias("_v"))
    return g.select(*by, "forecast", (1 / (1 + F.col("_v") / F.greatest("forecast", F.lit(1.0)))).alias("confidence"))


def profile_column(df: DataFrame, column: str) -> DataFrame:
    """One row: name, inferred type (over 80 % of the first values parse), counts, completeness, uniqueness, quality."""
    v = F.col(column).cast("string")
    filled = F.when(v == "", None).otherwise(v)
    share = lambda t: F.avg((F.expr(f"try_cast(`{column}` as string)").try_cast(t).isNotNull()).cast("double"))
    s = df.agg(
        F.lit(column).alias("name"), F.count(F.lit(1)).alias("rows"), F.count(filled).alias("filled"), F.count_distinct(filled).alias("distinct"),
        share("bigint").alias("as_int"), share("double").alias("as_float"), share("boolean").alias("as_bool"), share("date").alias("as_date"),
    )
    kind = F.when(F.col("as_int") > 0.8, "Integer").when(F.col("as_float") > 0.8, "Float").when(F.col("as_bool") > 0.8, "Boolean").when(F.col("as_date") > 0.8, "Date").otherwise("String")
    complete, unique = F.coalesce(F.try_divide("filled", "rows"), F.lit(0.0)), F.coalesce(F.try_divide("distinct", "filled"), F.lit(0.0))
    return s.select("name", kind.alias("type"), "rows", "filled", "distinct", complete.alias("completeness"), unique.alias("uniqueness"), (0.7 * complete + 0.3 * unique).alias("quality"))


def laplace(scale: Column | float, seed: int | None = None) -> Column:
    """Laplace noise of a scale from a uniform draw in [-0.5, 0.5)."""
    u = F.rand(seed) - 0.5
    return -F.lit(scale) * F.sign(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300)))


def private_count(df: DataFrame, epsilon: float, seed: int | None = None) -> DataFrame:
    """A count with Laplace noise of scale 1 / epsilon, 0 at least, and the half width of its 95 % interval."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    return df.agg(F.count(F.lit(1)).alias("_n")).select(F.greatest(F.lit(0.0), F.col("_n") + laplace(1 / epsilon, seed)).alias("count"), F.lit(math.log(20) / epsilon).alias("half_width"))


def private_sum(df: DataFrame, value: Column, epsilon: float, sensitivity: float = 1000.0, seed: int | None = None) -> DataFrame:
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    return df.agg(F.sum(value).alias("_s")).select((F.coalesce("_s", F.lit(0)) + laplace(sensitivity / epsilon, seed)).alias("sum"))


def private_average(df: DataFrame, value: Column, epsilon: float, seed: int | None = None) -> DataFrame:
    """Half of epsilon each for the sum and the count."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    s = df.agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    seeds = (seed, None if seed is None else seed + 1)
    return s.select(((F.col("_s") + laplace(2000 / epsilon, seeds[0])) / F.greatest(F.lit(1.0), F.col("_n") + laplace(2 / epsilon, seeds[1]))).alias("average"))
