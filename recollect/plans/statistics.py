"""Queries of aggregates, windows and profiles."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.operators import analytics as A
from recollect.plans.registry import query
from recollect.sources.tables import MEMORIES, hours_since, hours_sql, memories, table


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"""WITH {MEMORIES} SELECT count(*) AS total, count(*) FILTER (memory_type = 'ShortTerm') AS short_term, count(*) FILTER (memory_type = 'LongTerm') AS long_term,
 count(*) FILTER ({hours_sql("last_accessed")} <= 168) AS active, round(avg({hours_sql("created_at")} / 24), 6) AS mean_age_days, sum(strlen(value))::BIGINT AS bytes FROM mem""")
def basic_stats(spark, sf_dir):
    s = A.basic_stats(memories(spark, sf_dir), hours_since("last_accessed"), hours_since("created_at"))
    return s.withColumn("mean_age_days", F.round("mean_age_days", 6))


@query(f"""WITH {MEMORIES}, s AS (SELECT strlen(value) AS size, row_number() OVER (ORDER BY strlen(value)) - 1 AS i, count(*) OVER () AS n FROM mem)
SELECT min(size) AS min, max(size) AS max, min(size) FILTER (i = n // 2) AS median, min(size) FILTER (i = floor(n * 0.95)) AS p95, count(*) FILTER (size < 100) AS bucket_0, count(*) FILTER (size >= 100 AND size < 1000) AS bucket_1,
 count(*) FILTER (size >= 1000 AND size < 10000) AS bucket_2, count(*) FILTER (size >= 10000 AND size < 100000) AS bucket_3, count(*) FILTER (size >= 100000 AND size < 1000000) AS bucket_4, count(*) FILTER (size >= 1000000) AS bucket_5 FROM s""")
def size_distribution(spark, sf_dir):
    return A.size_distribution(memories(spark, sf_dir).select(F.octet_length("value").alias("size")), "size")


@query("""WITH s AS (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem)
SELECT min(x) FILTER (i = floor(n * 50 / 100e0)) AS p50, min(x) FILTER (i = floor(n * 95 / 100e0)) AS p95, min(x) FILTER (i = floor(n * 99 / 100e0)) AS p99, max(x) AS max FROM s""")
def price_percentiles(spark, sf_dir):
    return A.percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query(f"WITH {MEMORIES} SELECT hour(created_at) AS hour, isodow(created_at) - 1 AS weekday, month(created_at) AS month, count(*) AS n FROM mem GROUP BY ALL")
def temporal_distribution(spark, sf_dir):
    c = F.col("created_at").cast("timestamp")
    return memories(spark, sf_dir).groupBy(F.hour(c).alias("hour"), F.weekday(c).alias("weekday"), F.month(c).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {MEMORIES}, t AS (SELECT key, unnest(tags) AS tag FROM mem), n AS (SELECT tag, count(DISTINCT key) AS n FROM t GROUP BY 1), s AS (SELECT tag, n, n / (SELECT count(*) FROM mem)::DOUBLE AS share FROM n)
SELECT tag, n, share, CASE WHEN share < 0.01 THEN share * 50 WHEN share > 0.5 THEN 1 - 2 * (share - 0.5) ELSE 1 END AS effectiveness FROM s""")
def tag_statistics(spark, sf_dir):
    return A.tag_statistics(memories(spark, sf_dir).select("key", F.explode("tags").alias("tag")))


@query(f"WITH {MEMORIES} SELECT least(lang, source) AS a, greatest(lang, source) AS b, count(*) AS n FROM mem WHERE lang <> source GROUP BY 1, 2")
def tag_cooccurrence(spark, sf_dir):
    return A.tag_pairs(memories(spark, sf_dir))


@query(f"""WITH {MEMORIES}, g AS (SELECT count(*) AS n FROM mem GROUP BY source), h AS (SELECT count(*) AS n FROM mem GROUP BY lang), b AS (SELECT count(*) AS n FROM mem GROUP BY source, lang)
SELECT ((SELECT sum(n * (n - 1)) FROM b))::BIGINT AS moderate, ((SELECT sum(n * (n - 1)) FROM g) + (SELECT sum(n * (n - 1)) FROM h) - 2 * (SELECT sum(n * (n - 1)) FROM b))::BIGINT AS weak""")
def shared_tag_relationships(spark, sf_dir):
    """Ordered pairs of rows that share one tag (weak) or two (moderate), counted from group sizes: no pair is formed."""
    m = memories(spark, sf_dir).select(F.get("tags", F.lit(0)).alias("lang"), F.get("tags", F.lit(1)).alias("source"))
    pairs = lambda *by: m.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("p"))
    g, h, b = pairs("source").withColumnRenamed("p", "g"), pairs("lang").withColumnRenamed("p", "h"), pairs("source", "lang").withColumnRenamed("p", "b")
    return g.join(F.broadcast(h)).join(F.broadcast(b)).select(F.col("b").alias("moderate"), (F.col("g") + F.col("h") - 2 * F.col("b")).alias("weak"))


@query(f"""WITH {MEMORIES}, w AS (SELECT unnest(list_filter(list_transform(regexp_split_to_array(lower(value), '\\s+'), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda w: strlen(w) > 2)) AS w FROM mem)
SELECT count(DISTINCT w) AS distinct_words, count(*) AS words, round(count(DISTINCT w) / count(*), 9) AS diversity FROM w""")
def semantic_diversity(spark, sf_dir):
    w = F.transform(F.split(F.lower("value"), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    x = memories(spark, sf_dir).select(F.explode(F.filter(w, lambda w: F.octet_length(w) > 2)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return x.agg(F.count(F.lit(1)).alias("distinct_words"), F.sum("n").alias("words")).withColumn("diversity", F.round(F.try_divide("distinct_words", "words"), 9))


@query("""WITH d AS (SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
g AS (SELECT event_type, regr_slope(n, day) AS s, regr_intercept(n, day) AS i, regr_r2(n, day) AS r, stddev_pop(n) / avg(n) AS v FROM d GROUP BY 1)
SELECT event_type, round(s, 6) AS slope, round(i, 6) AS intercept, round(r, 6) AS r2, round(v, 6) AS volatility, CASE WHEN s > 0.01 THEN 'increasing' WHEN s < -0.01 THEN 'decreasing' ELSE 'stable' END AS direction FROM g""")
def linear_trend(spark, sf_dir):
    d = _events(spark, sf_dir).groupBy("event_type", F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    t = A.linear_trend(d, "day", "n", "event_type")
    return t.select("event_type", *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2", "volatility")), "direction")


@query("""WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) SELECT event_id, event_type, round((value - m) / s, 6) AS z FROM events JOIN s USING (event_type) WHERE abs((value - m) / s) > 2""")
def z_score_outliers(spark, sf_dir):
    return A.z_outliers(_events(spark, sf_dir), "value", "event_type").select("event_id", "event_type", F.round("z", 6).alias("z"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
q AS (SELECT event_type, min(value) FILTER (i = n // 4) AS q1, min(value) FILTER (i = 3 * n // 4) AS q3 FROM r GROUP BY 1)
SELECT event_id, event_type, value FROM events JOIN q USING (event_type) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def iqr_outliers(spark, sf_dir):
    """Index quartiles from counts of distinct values, which combine before the shuffle."""
    e = _events(spark, sf_dir).filter("value IS NOT NULL")
    by = e.groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("k"))
    own = Window.partitionBy("event_type")
    run = by.withColumn("upto", F.sum("k").over(own.orderBy("value"))).withColumn("n", F.sum("k").over(own))
    q = run.groupBy("event_type").agg(F.min(F.when(F.col("upto") > F.expr("n div 4"), F.col("value"))).alias("q1"), F.min(F.when(F.col("upto") > F.expr("3 * n div 4"), F.col("value"))).alias("q3"))
    wide = (F.col("q3") - F.col("q1")) * 1.5
    return e.join(q, "event_type").filter((F.col("value") < F.col("q1") - wide) | (F.col("value") > F.col("q3") + wide)).select("event_id", "event_type", "value")


@query("""WITH g AS (SELECT user_id, ts, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
SELECT user_id, count(*) AS n, floor(avg(gap))::BIGINT AS mean_interval_ms, round(greatest(0, 1 - least(stddev_pop(gap) / avg(gap), 1)), 6) AS confidence, max(epoch_us(ts) // 1000) + floor(avg(gap))::BIGINT AS next_ms FROM g GROUP BY 1 HAVING count(*) > 1""")
def access_prediction(spark, sf_dir):
    return A.access_intervals(_events(spark, sf_dir), "user_id", "ts").withColumn("confidence", F.round("confidence", 6))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 60 MINUTE THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM s GROUP BY user_id, s HAVING count(*) >= 2""")
def burst_sessions(spark, sf_dir):
    b = A.bursts(_events(spark, sf_dir), "user_id", "ts", least=2)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c}_us")
    return b.select("user_id", us("start"), us("end"), "n")


_HOURS = """h AS (SELECT event_type, epoch(ts)::BIGINT // 3600 AS hour, count(*) AS n FROM events GROUP BY 1, 2), sp AS (SELECT event_type, unnest(range(min(hour), max(hour) + 1)) AS hour FROM h GROUP BY 1),
ser AS (SELECT event_type, hour, coalesce(n, 0) AS n FROM sp LEFT JOIN h USING (event_type, hour))"""


def _hours(spark, sf_dir):
    return A.hourly_series(_events(spark, sf_dir), "ts", "event_type")


@query(f"WITH {_HOURS.replace('epoch(ts)::BIGINT // 3600', 'epoch_us(ts) // 3600000000')} SELECT event_type, hour, n FROM ser")
def hourly_series(spark, sf_dir):
    return _hours(spark, sf_dir)


_HOURS = _HOURS.replace("epoch(ts)::BIGINT // 3600", "epoch_us(ts) // 3600000000")


@query(f"WITH {_HOURS}, l(lag) AS (VALUES (1), (2), (24)) SELECT a.event_type, lag, round(corr(a.n, b.n), 6) AS acf FROM ser a, l JOIN ser b ON a.event_type = b.event_type AND b.hour = a.hour + lag GROUP BY 1, 2")
def autocorrelation(spark, sf_dir):
    return A.autocorrelation(_hours(spark, sf_dir), [1, 2, 24], "event_type").withColumn("acf", F.round("acf", 6))


@query(f"""WITH {_HOURS}, w AS (SELECT *, avg(n) OVER b AS before, avg(n) OVER a AS after, count(*) OVER b AS k, count(*) OVER a AS m FROM ser WINDOW b AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING))
SELECT event_type, hour, round(abs(after - before) / abs(before), 6) AS change FROM w WHERE k = 12 AND m = 12 AND before <> 0 AND abs(after - before) / abs(before) > 0.5""")
def change_points(spark, sf_dir):
    return A.change_points(_hours(spark, sf_dir), "hour", "n", "event_type").select("event_type", "hour", F.round("change", 6).alias("change"))


@query(f"""WITH {_HOURS}, w AS (SELECT *, lag(n) OVER o AS a, lead(n) OVER o AS b, avg(n) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM ser WINDOW o AS (PARTITION BY event_type ORDER BY hour))
SELECT event_type, hour, n FROM w WHERE n > a AND n > b AND n > 1.2e0 * m""")
def series_peaks(spark, sf_dir):
    return A.peaks(_hours(spark, sf_dir), "hour", "n", "event_type").select("event_type", "hour", "n")


@query("""WITH t AS (SELECT event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT a, b, c, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def content_sequences(spark, sf_dir):
    return A.consecutive_triples(_events(spark, sf_dir), "user_id", "event_type", "ts", "event_id")


@query("""WITH d AS (SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS r, count(*) OVER (PARTITION BY event_type) AS k FROM d)
SELECT event_type, round(avg(n), 6) AS forecast, round(1 / (1 + var_pop(n) / greatest(avg(n), 1)), 6) AS confidence FROM r WHERE r <= greatest(3, least(7, k // 3)) GROUP BY 1""")
def moving_average_forecast(spark, sf_dir):
    d = _events(spark, sf_dir).groupBy("event_type", F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return A.forecast(d, "day", "n", "event_type").select("event_type", F.round("forecast", 6).alias("forecast"), F.round("confidence", 6).alias("confidence"))


@query("""WITH d AS (SELECT user_id, epoch_us(ts) // 86400000000 AS day, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT user_id, day, CASE WHEN n > 10 THEN 'high' WHEN n > 5 THEN 'medium' ELSE 'low' END AS st FROM d),
t AS (SELECT st, lead(st) OVER (PARTITION BY user_id ORDER BY day) AS nx FROM s) SELECT st AS from_state, nx AS to_state, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM t WHERE nx IS NOT NULL GROUP BY 1, 2 QUALIFY count(*) / sum(count(*)) OVER () > 0.1""")
def markov_transitions(spark, sf_dir):
    d = _events(spark, sf_dir).groupBy("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    d = d.withColumn("from_state", F.when(F.col("n") > 10, "high").when(F.col("n") > 5, "medium").otherwise("low"))
    t = d.withColumn("to_state", F.lead("from_state").over(Window.partitionBy("user_id").orderBy("day"))).filter("to_state IS NOT NULL").groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(t.agg(F.sum("n").alias("total")))
    return t.join(total).withColumn("share", F.col("n") / F.col("total")).filter("share > 0.1").select("from_state", "to_state", F.round("share", 9).alias("share"))


@query("""SELECT count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, max(l_quantity) AS max, median(l_quantity) AS median,
 round(corr(l_quantity, l_extendedprice), 9) AS corr_price, round(corr(l_quantity, l_discount), 9) AS corr_discount, count(*) - count(l_quantity) AS nulls FROM lineitem""")
def describe_lineitem(spark, sf_dir):
    r = lambda c, n, k=6: F.round(c, k).alias(n)
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(q), "mean"), r(F.stddev_samp(q), "std"), F.min(q).alias("min"), F.max(q).alias("max"), F.median(q).alias("median"),
        r(F.corr("l_quantity", "l_extendedprice"), "corr_price", 9), r(F.corr("l_quantity", "l_discount"), "corr_discount", 9), (F.count(F.lit(1)) - F.count(q)).alias("nulls"),
    )


@query("WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1), r AS (SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS rank FROM c) SELECT * FROM r WHERE rank <= 10")
def top_values(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(10)
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "value")))


_COLS = ("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")


@query("WITH u AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS name, '{k}' AS type, count(*) AS rows, count(nullif({c}::VARCHAR, '')) AS filled, count(DISTINCT nullif({c}::VARCHAR, '')) AS d FROM part"
    for c, k in zip(_COLS, ("Integer", "String", "String", "Integer", "Float"), strict=True)
) + ") SELECT name, type, rows, filled, d AS \"distinct\", filled / rows::DOUBLE AS completeness, round(d / filled::DOUBLE, 9) AS uniqueness, round(0.7e0 * filled / rows + 0.3e0 * d / filled, 9) AS quality FROM u")
def column_profile(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    out = None
    for c in _COLS:
        x = A.profile_column(p, c)
        out = x if out is None else out.unionByName(x)
    return out.withColumn("uniqueness", F.round("uniqueness", 9)).withColumn("quality", F.round("quality", 9))


@query()
def private_aggregates(spark, sf_dir):
    m = memories(spark, sf_dir)
    return A.private_count(m, 0.5, 1).join(F.broadcast(A.private_sum(m, F.octet_length("value"), 0.5, seed=2))).join(F.broadcast(A.private_average(m, F.octet_length("value"), 0.5, seed=3)))


@query("""WITH r AS (SELECT d.doc_id, l.quality, row_number() OVER (ORDER BY length(text) DESC, d.doc_id) AS rn, d.lang FROM documents d LEFT JOIN labels l USING (doc_id)), k AS (SELECT lang, doc_id, quality, row_number() OVER (PARTITION BY lang ORDER BY rn) AS p FROM r),
t AS (SELECT lang, count(*) FILTER (quality = 1) AS rel, count(*) FILTER (quality = 1 AND p <= 10) AS hits, min(p) FILTER (quality = 1) AS first FROM k GROUP BY 1)
SELECT lang, hits / 10e0 AS precision_at_10, coalesce(hits / nullif(rel, 0)::DOUBLE, 0) AS recall_at_10, coalesce(1e0 / first, 0) AS mrr FROM t""")
def retrieval_metrics(spark, sf_dir):
    """Judgments are labels.quality; each language is a query, ranked by length of text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    r = d.withColumn("p", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "doc_id")))
    good = F.col("quality") == 1
    t = r.groupBy("lang").agg(F.count_if(good).alias("rel"), F.count_if(good & (F.col("p") <= 10)).alias("hits"), F.min(F.when(good, F.col("p"))).alias("first"))
    z = F.lit(0.0)
    return t.select("lang", (F.col("hits") / 10.0).alias("precision_at_10"), F.coalesce(F.try_divide("hits", "rel"), z).alias("recall_at_10"), F.coalesce(1.0 / F.col("first"), z).alias("mrr"))
