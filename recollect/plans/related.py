"""Queries of alike and related memories, of scores, strategies and replay."""
from pyspark.sql import functions as F

from recollect.functions import scores as S
from recollect.functions import text as T
from recollect.functions.decay import ebbinghaus, replay_priority, spaced_repetition_hours
from recollect.operators import adaptation as A
from recollect.operators import likeness as K
from recollect.operators import related as D
from recollect.plans.registry import query
from recollect.session import materialize
from recollect.sources.tables import MEMORIES, MEMORY_LINKS, hours_since, hours_sql, memories, memory_links, spread, table, vectors

_SET = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: strlen(w) > {1}))"
_PAIRS = f"""{MEMORIES}, ws AS MATERIALIZED (SELECT key, {_SET.format("value", 2)} AS w FROM mem), u AS (SELECT key, unnest(w) AS t FROM ws), c AS (SELECT a.key AS a, b.key AS b, count(*) AS n FROM u a JOIN u b ON a.t = b.t AND a.key < b.key GROUP BY 1, 2),
p AS MATERIALIZED (SELECT a, b, n / (len(x.w) + len(y.w) - n)::DOUBLE AS s FROM c JOIN ws x ON x.key = a JOIN ws y ON y.key = b),
e AS (SELECT count(*) AS z FROM ws WHERE len(w) = 0)"""


@query(f"WITH {_PAIRS} SELECT a, b, round(s, 9) AS similarity FROM p WHERE s >= 0.6 UNION ALL SELECT x.key, y.key, 1 FROM ws x JOIN ws y ON x.key < y.key WHERE len(x.w) = 0 AND len(y.w) = 0")
def similar_texts(spark, sf_dir):
    """Pairs of memories by the similarity of their words: pairs of classes, and the members of each class among themselves and across."""
    c = materialize(D.text_classes(spread(memories(spark, sf_dir))), "text-classes")
    pairs = D.similar_texts(c, 0.6)
    member = c.select("id", "key")
    across = pairs.join(member.withColumnRenamed("key", "ka"), F.col("a") == F.col("id")).drop("id").join(member.withColumnRenamed("key", "kb"), F.col("b") == F.col("id"))
    across = across.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), F.round("similarity", 9).alias("similarity"))
    within = member.join(member.withColumnRenamed("key", "b"), "id").filter("key < b").select(F.col("key").alias("a"), "b", F.lit(1.0).alias("similarity"))
    return across.unionByName(within)


@query(f"WITH {_PAIRS}, n AS (SELECT count(*) AS n FROM mem) SELECT (count(*) FILTER (s > 0.8) + any_value(z * (z - 1) // 2))::BIGINT AS pairs, round((count(*) FILTER (s > 0.8) + any_value(z * (z - 1) // 2)) / any_value(n * (n - 1) / 2::DOUBLE), 12) AS share FROM p, e, n")
def duplicate_content_share(spark, sf_dir):
    return D.duplicate_share(spread(memories(spark, sf_dir))).select("pairs", F.round("share", 12).alias("share"))


@query()
def similarity_groups(spark, sf_dir):
    return D.similarity_groups(spread(memories(spark, sf_dir)), 0.6)


@query()
def consolidation_candidates(spark, sf_dir):
    """The two rules of the reference's kind: near copies a day apart, related rows a week apart, here by language tags."""
    m, out = spread(memories(spark, sf_dir)), None
    for rule, threshold, hours, least, tags in (("similar_content", 0.8, 24, 0.3, ["en", "de"]), ("related_tasks", 0.6, 168, 0.5, ["fr", "es", "en"])):
        g = D.consolidation_candidates(m, threshold, hours, least, tags).select(F.lit(rule).alias("rule"), "key", "leader")
        out = g if out is None else out.unionByName(g)
    return out


#: Memories whose relations are counted.
ASKED = ("50", "100", "150", "199")
_ASK = ", ".join(f"('{k}')" for k in ASKED)
_FROM = "CASE {0} WHEN 'related_to' THEN 0.3 WHEN 'part_of' THEN 0.4 ELSE 0.5 END::DOUBLE"


@query(f"""WITH {MEMORIES}, {MEMORY_LINKS}, b AS (SELECT src AS node, dst AS other, rel_type, strength FROM links UNION ALL SELECT dst, src, rel_type, strength FROM links),
l0 AS (SELECT k AS asked, k AS node FROM (VALUES {_ASK}) v(k) JOIN mem ON key = k),
l1 AS (SELECT asked, other AS node, max(strength >= {_FROM.format('rel_type')}) AS ok FROM l0 JOIN b USING (node) WHERE (asked, other) NOT IN (SELECT (asked, node) FROM l0) GROUP BY 1, 2),
l2 AS (SELECT asked, other AS node, max(strength >= {_FROM.format('rel_type')}) AS ok FROM l1 JOIN b USING (node) WHERE (asked, other) NOT IN (SELECT (asked, node) FROM l0 UNION ALL SELECT (asked, node) FROM l1) GROUP BY 1, 2),
l3 AS (SELECT asked, other AS node, max(strength >= {_FROM.format('rel_type')}) AS ok FROM l2 JOIN b USING (node) WHERE (asked, other) NOT IN (SELECT (asked, node) FROM l0 UNION ALL SELECT (asked, node) FROM l1 UNION ALL SELECT (asked, node) FROM l2) GROUP BY 1, 2),
lk AS (SELECT asked, node AS key FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) WHERE ok AND node IN (SELECT key FROM mem)),
vec AS (SELECT vec_id::VARCHAR AS key, embedding::DOUBLE[] AS e FROM embeddings),
x AS (SELECT mem.*, e, {_SET.format("value", 2)} AS w, {_SET.format("value", 3)} AS w3 FROM mem LEFT JOIN vec USING (key)),
q AS (SELECT a.key AS asked, m.key, lk.key IS NOT NULL AS linked, coalesce(list_cosine_similarity(m.e, a.e) >= 0.7, false) AS v,
  len(list_intersect(m.tags, a.tags)) / len(list_distinct(list_concat(m.tags, a.tags)))::DOUBLE >= 0.3 AS t, abs(date_diff('second', m.created_at, a.created_at)) / 3600::DOUBLE AS gap,
  len(list_intersect(m.w, a.w)) / nullif(len(list_distinct(list_concat(m.w, a.w))), 0)::DOUBLE AS j, len(list_intersect(m.w3, a.w3)) / nullif(len(list_distinct(list_concat(m.w3, a.w3))), 0)::DOUBLE AS j3, list_has_any(m.tags, a.tags) AS any_tag
  FROM x m JOIN x a ON m.key <> a.key AND a.key IN ({_ASK.replace("(", "").replace(")", "")}) LEFT JOIN lk ON lk.asked = a.key AND lk.key = m.key),
g AS (SELECT asked AS key, count(*) FILTER (linked) AS by_link, count(*) FILTER (v AND NOT linked) AS by_vector, count(*) FILTER (t AND NOT linked) AS by_tag, count(*) FILTER (gap <= 1 AND coalesce(j, 1) >= 0.1 AND NOT linked) AS by_time,
  count(*) FILTER (coalesce(j, 1) >= 0.4 AND NOT linked) AS by_text, count(*) FILTER (coalesce(j3 > 0.3, false) OR any_tag OR gap < 24) AS "distinct" FROM q GROUP BY 1)
SELECT *, by_link + by_vector + by_tag + by_time + by_text AS total FROM g""")
def related_counts(spark, sf_dir):
    return D.related_counts(spread(memories(spark, sf_dir)), vectors(spark, sf_dir), memory_links(spark, sf_dir), list(ASKED))


_LOW = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"


@query(f"""WITH {MEMORIES}, {MEMORY_LINKS}, x AS (SELECT key, tags, {_LOW.format("value")} AS w FROM mem)
SELECT src, dst, rel_type, round(CASE WHEN a.key IS NULL OR b.key IS NULL THEN 0 ELSE (0.5 + 0.3 * coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0)::DOUBLE, 0)
  + 0.2 * len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags)))::DOUBLE) * CASE rel_type WHEN 'part_of' THEN 0.8 ELSE 0.5 END END, 9) AS strength FROM links LEFT JOIN x a ON a.key = src LEFT JOIN x b ON b.key = dst""")
def edge_strengths(spark, sf_dir):
    return D.edge_strengths(memory_links(spark, sf_dir), spread(memories(spark, sf_dir))).select("src", "dst", "rel_type", F.round("strength", 9).alias("strength"))


@query("""WITH n AS (SELECT s_suppkey AS k, ['nation:' || s_nationkey, 'tier:' || (s_suppkey % 7)] AS t, s_nationkey AS d FROM supplier),
s AS (SELECT a.k AS a, b.d, max((len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE + 1) / 2) AS s FROM n a JOIN n b ON a.k <> b.k GROUP BY 1, 2)
SELECT 's:' || a AS src, 'n:' || d AS dst, round(round(s, 12) * 0.9e0 , 9) AS confidence FROM s WHERE round(s, 12) >= 0.6 AND round(s, 12) * 0.9e0 >= 0.6""")
def infer_by_similarity(spark, sf_dir):
    """A supplier serves the nation of one alike: of the same nation or tier."""
    s = table(spark, sf_dir, "supplier")
    key, nation = F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")), F.col("s_nationkey").cast("string")
    nodes = s.select(key.alias("key"), F.lit("supplier").alias("node_type"), F.array(F.concat(F.lit("nation:"), nation), F.concat(F.lit("tier:"), (F.col("s_suppkey") % 7).cast("string"))).alias("tags"))
    e = s.select(key.alias("src"), F.concat(F.lit("n:"), nation).alias("dst"), F.lit("part_of").alias("rel_type"), F.lit(1.0).alias("confidence"))
    return D.similarity_rule(nodes, e, "part_of", "serves").select("src", "dst", F.round("confidence", 9).alias("confidence"))


@query(f"WITH {MEMORIES}, {MEMORY_LINKS} SELECT src AS key, dst AS source, value FROM links JOIN mem ON key = dst WHERE rel_type = 'derives'")
def derived_sources(spark, sf_dir):
    """The memories that each is derived from."""
    d = memory_links(spark, sf_dir).filter("rel_type = 'derives'").select(F.col("src").alias("key"), F.col("dst").alias("source"))
    return d.join(memories(spark, sf_dir).select(F.col("key").alias("source"), "value"), "source").select("key", "source", "value")


@query(f"WITH {MEMORIES} SELECT vec_id::VARCHAR AS key, created_at <= TIMESTAMP '2024-07-01' AND TIMESTAMP '2024-07-01' < last_accessed AS valid FROM embeddings LEFT JOIN mem ON key = vec_id::VARCHAR")
def node_valid_at(spark, sf_dir):
    """Whether the node of a key holds at a time: null where there is none."""
    m = memories(spark, sf_dir).select("key", F.expr("created_at <= timestamp_ntz'2024-07-01' AND timestamp_ntz'2024-07-01' < last_accessed").alias("valid"))
    return vectors(spark, sf_dir).select("key").join(m, "key", "left")


@query(f"WITH {MEMORIES} SELECT bucket AS concept, count(*) AS n, min(key) AS first FROM mem WHERE bucket IN ('2', '5') GROUP BY 1")
def memories_by_concept(spark, sf_dir):
    """Memories whose property names a concept."""
    m = memories(spark, sf_dir).withColumn("concept", F.try_element_at("custom_fields", F.lit("bucket"))).filter(F.col("concept").isin("2", "5"))
    return m.groupBy("concept").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first"))


@query("""WITH g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) // 1000000 AS gap, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT user_id, count(*) AS n, coalesce(CASE WHEN avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) END, 1) AS v FROM g GROUP BY 1)
SELECT user_id, n, round(v, 6) AS variation, n >= 3 AND v < 0.5 AS regular FROM r""")
def regular_intervals(spark, sf_dir):
    return D.regular_intervals(table(spark, sf_dir, "events"), "user_id", "ts").select("user_id", "n", F.round("variation", 6).alias("variation"), "regular")


@query("""WITH g AS (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) // 1000000 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT user_id, count(*) AS n, coalesce(CASE WHEN avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) END, 1) AS v FROM g GROUP BY 1),
h AS (SELECT user_id, hour(ts) AS h, count(*) AS k FROM events GROUP BY 1, 2), p AS (SELECT user_id, k / sum(k) OVER (PARTITION BY user_id) AS p FROM h), e AS (SELECT user_id, -sum(p * log2(p)) AS e FROM p GROUP BY 1)
SELECT user_id, round(CASE WHEN n < 2 THEN 0.5 ELSE (greatest(0, 1 - least(v, 1)) + greatest(0, 1 - e / 4.58)) / 2 END, 6) AS consistency FROM r JOIN e USING (user_id)""")
def temporal_consistency(spark, sf_dir):
    return D.temporal_consistency(table(spark, sf_dir, "events"), "user_id", "ts").select("user_id", F.round("consistency", 6).alias("consistency"))


_IDLE, _AGE = hours_sql("last_accessed"), hours_sql("created_at")


@query(f"""WITH {MEMORIES}, x AS (SELECT *, greatest(0.001, least(0.999, exp(-ln(2) * {_AGE} / (24 * (1 + 2 * importance))))) AS r FROM mem)
SELECT key, round(least(0.999, greatest(0.001, r * CASE WHEN confidence > 0.7 THEN 1 + (confidence - 0.7) * 0.5 ELSE 1 END * CASE WHEN access_count > 1 THEN 1 + ln(access_count - 1) * 0.2 ELSE 1 END
  * CASE WHEN {_IDLE} < 6 THEN 1 + (6 - {_IDLE}) / 6 * 0.3 ELSE 1 END * CASE WHEN importance > 0.5 THEN 1 + (importance - 0.5) ELSE 1 END * CASE WHEN importance > 0.6 THEN 1 + (importance - 0.6) * 0.8 ELSE 1 END)), 9) AS retention FROM x""")
def adaptive_retention(spark, sf_dir):
    """Confidence stands for engagement, importance for emotion as well."""
    m = memories(spark, sf_dir)
    kept = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.exp(-F.log(F.lit(2.0)) * hours_since("created_at") / (24 * (1 + 2 * F.col("importance"))))))
    r = S.adaptive_retention(kept, F.col("confidence"), F.col("access_count"), hours_since("last_accessed"), F.col("importance"), F.col("importance"))
    return m.select("key", F.round(r, 9).alias("retention"))


_W4 = ("0.2 * e + 0.6 * p + 0.2 * g", "0.4 * e + 0.4 * p + 0.2 * g", "0.5 * e + 0.2 * p + 0.3 * g", "0.6 * e + 0.3 * p + 0.1 * g")


@query(f"""WITH {MEMORIES}, x AS (SELECT *, floor({_IDLE} / 50) AS i, greatest(1, floor({_AGE})) AS a FROM mem),
y AS (SELECT *, exp(-ln(2) * i / (24 * (1 + 2 * importance) * CASE WHEN access_count > 10 THEN 2 WHEN access_count > 5 THEN 1.5 ELSE 1 END * CASE WHEN strlen(value) > 1000 THEN 1.5 WHEN strlen(value) > 100 THEN 1.2 ELSE 1 END)) AS e,
  pow(1 + i / 24, CASE WHEN importance > 0.7 THEN -0.5 ELSE -0.8 END) AS p, CASE WHEN i < 1 THEN 1 ELSE 1 - least(1, ln(i) / ln(168)) END AS g FROM x)
SELECT key, round(least(1, greatest(0, CASE WHEN access_count > 20 AND importance > 0.8 THEN {_W4[0]} WHEN access_count > 10 THEN {_W4[1]} WHEN importance > 0.7 THEN {_W4[2]} ELSE {_W4[3]} END
  * CASE WHEN access_count / (a / 24) > 1 THEN 1.2 WHEN access_count / (a / 24) > 0.1 THEN 1 ELSE 0.8 END)), 9) AS score FROM y""")
def importance_recency(spark, sf_dir):
    m = memories(spark, sf_dir)
    s = S.importance_recency(hours_since("last_accessed") / 50, hours_since("created_at"), F.col("importance"), F.col("access_count"), F.octet_length("value"))
    return m.select("key", F.round(s, 9).alias("score"))


@query(f"""WITH {MEMORIES}, x AS (SELECT key, {_AGE} / 40 AS h FROM mem), y AS (SELECT key, h, greatest(0, 1 - h / 168) AS l, exp(-h / 72) AS e, exp(-pow(h / 24, 2) / 8) AS b, greatest(0, 1 / (1 + ln(h / 24))) AS s FROM x)
SELECT key, round(CASE WHEN h < 24 THEN 0.6 * e + 0.4 * b WHEN h < 168 THEN 0.4 * l + 0.3 * e + 0.3 * s ELSE 0.7 * s + 0.3 * l END, 9) AS score FROM y""")
def three_regime_recency(spark, sf_dir):
    return memories(spark, sf_dir).select("key", F.round(S.three_regime_recency(hours_since("created_at") / 40), 9).alias("score"))


@query(f"""WITH {MEMORIES}, c AS (SELECT key, strlen(value) AS t, unnest(string_split(value, '')) AS c FROM mem WHERE value <> ''), n AS (SELECT key, t, c, count(*) / t::DOUBLE AS p FROM c GROUP BY 1, 2, 3), e AS (SELECT key, -sum(p * log2(p)) / 8 AS e FROM n GROUP BY 1)
SELECT key, round(coalesce(e, 0), 9) AS entropy FROM mem LEFT JOIN e USING (key)""")
def character_entropy(spark, sf_dir):
    return spread(memories(spark, sf_dir)).select("key", F.round(S.character_entropy(F.col("value")), 9).alias("entropy"))


@query("""WITH p AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (ORDER BY p_partkey) AS b FROM part), x AS (SELECT p_partkey, a, coalesce(b, '') AS b FROM p),
y AS (SELECT *, len(list_filter(string_split(a, ''), lambda c: contains(b, c))) AS c, strlen(a) AS m, strlen(b) AS n FROM x)
SELECT p_partkey, round(CASE WHEN a = b THEN 1 WHEN m = 0 OR n = 0 OR least(m, n) * 2 < greatest(m, n) THEN 0 ELSE greatest(0, c / greatest(m, n)::DOUBLE * (1 - 0.3 * abs(m - n) / greatest(m, n))) END, 9) AS similarity FROM y""")
def byte_similarity(spark, sf_dir):
    """Each part's name beside the next one's."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return p.join(after, "p_partkey", "left").select("p_partkey", F.round(S.byte_similarity(F.col("p_name"), F.coalesce("b", F.lit(""))), 9).alias("similarity"))


@query(f"""WITH {MEMORIES}, x AS (SELECT key, CASE WHEN memory_type = 'ShortTerm' THEN least(1, access_count / 5::DOUBLE) ELSE 0 END AS f, CASE WHEN memory_type = 'ShortTerm' THEN least(1, {_AGE} / 10000) ELSE 0 END AS a, CASE WHEN memory_type = 'ShortTerm' THEN least(1, importance / 0.8) ELSE 0 END AS i FROM mem)
SELECT key, round(f, 9) AS frequency, round(a, 9) AS age, round(i, 9) AS importance, round(0.4 * f + 0.3 * a + 0.3 * i, 9) AS score, round(0.4 * f + 0.3 * a + 0.3 * i, 12) >= 0.6 AS promote FROM x""")
def promotion_scores(spark, sf_dir):
    m = memories(spark, sf_dir)
    p = S.promotion(F.col("memory_type"), F.col("access_count"), hours_since("created_at"), F.col("importance"), from_hours=10_000)
    return m.select("key", *(F.round(p[k], 9).alias(k) for k in ("frequency", "age", "importance", "score")), (F.round(p["score"], 12) >= S.PROMOTED_FROM).alias("promote"))


@query("""WITH c AS (SELECT l_suppkey AS parameter, l_shipdate AS d0, l_orderkey, l_linenumber, l_extendedprice / 100000 AS x FROM lineitem), d AS (SELECT parameter, x - coalesce(lag(x) OVER (PARTITION BY parameter ORDER BY d0, l_orderkey, l_linenumber), x) AS dx FROM c),
g AS (SELECT parameter, sum(dx * dx) AS o, sum(dx) AS t FROM d GROUP BY 1) SELECT parameter, round(o / (0.1 + t * t) / (1 + o / (0.1 + t * t)), 9) AS importance FROM g""")
def parameter_importance(spark, sf_dir):
    """A supplier's price is a parameter: the path integral is the sum of squared steps, the change is that from first to last."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("parameter"), "l_shipdate", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 100_000).alias("x"))
    w = Window.partitionBy("parameter").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    d = c.select("parameter", (F.col("x") - F.coalesce(F.lag("x").over(w), F.col("x"))).alias("dx"))
    g = d.groupBy("parameter").agg(F.sum(F.col("dx") * F.col("dx")).alias("o"), F.sum("dx").alias("t"))
    return g.select("parameter", F.round(S.parameter_importance(F.col("o"), F.col("t")), 9).alias("importance"))


@query("""WITH k AS (SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1), h AS (SELECT hour(ts) AS h, count(*) AS n FROM events GROUP BY 1), c AS (SELECT * FROM events WHERE event_type = 'signup')
SELECT (SELECT count(*) FROM c) AS created, (SELECT count(*) FROM events WHERE event_type = 'purchase') AS updated, (SELECT count(*) FROM events WHERE event_type = 'error') AS deleted,
 round((SELECT avg(strlen(user_id::VARCHAR) * 10 + strlen(props) + 100) FROM c), 6) AS mean_size, (SELECT string_agg(user_id, ',' ORDER BY n DESC, user_id) FROM (SELECT * FROM k ORDER BY n DESC, user_id LIMIT 5)) AS most_active,
 (SELECT string_agg(user_id, ',' ORDER BY n, user_id) FROM (SELECT * FROM k ORDER BY n, user_id LIMIT 5)) AS least_active, (SELECT string_agg(h, ',' ORDER BY h) FROM h WHERE n > (SELECT sum(n) / 24 FROM h)) AS peak_hours,
 round((SELECT count(*) / greatest(1, epoch_us(max(ts) - min(ts)) // 86400000000)::DOUBLE FROM c), 6) AS per_day""")
def usage_statistics(spark, sf_dir):
    """Signups create, purchases update, errors delete, clicks and views are accesses."""
    e = table(spark, sf_dir, "events")
    one = F.count_if(F.col("event_type") == "signup").alias("created"), F.count_if(F.col("event_type") == "purchase").alias("updated"), F.count_if(F.col("event_type") == "error").alias("deleted")
    made = F.col("event_type") == "signup"
    size = F.avg(F.when(made, F.octet_length(F.col("user_id").cast("string")) * 10 + F.octet_length("props") + 100))
    span = F.expr("timestampdiff(DAY, min(if(event_type = 'signup', ts, null)), max(if(event_type = 'signup', ts, null)))")
    s = e.agg(*one, F.round(size, 6).alias("mean_size"), F.round(F.count_if(made) / F.greatest(span, F.lit(1)), 6).alias("per_day"))
    k = e.filter("event_type IN ('click', 'view')").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    # five rows of each end, and 24 hours
    first = lambda order, name: k.orderBy(*order).limit(5).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n") if name == "most_active" else F.col("n")).alias("o"), "user_id"))), lambda x: x["user_id"].cast("string")), ",").alias(name))
    h = e.groupBy(F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    h = h.join(F.broadcast(h.agg((F.sum("n") / 24).alias("mean")))).filter("n > mean").agg(F.array_join(F.transform(F.array_sort(F.collect_list("h")), lambda x: x.cast("string")), ",").alias("peak_hours"))
    out = s
    for part in (first([F.desc("n"), F.asc("user_id")], "most_active"), first([F.asc("n"), F.asc("user_id")], "least_active"), h):
        out = out.join(F.broadcast(part))
    return out


_DRAW = "conv(substring(md5(key), 1, 8), 16, 10) / 4294967296D"


@query(f"""WITH {MEMORIES}, x AS (SELECT *, (1 - exp(-ln(2) * {_IDLE} / 168)) * (1 - importance) AS p, ('0x' || substr(md5(key), 1, 8))::BIGINT / 4294967296::DOUBLE AS u FROM mem)
SELECT 'gradual_forgetting' AS strategy, round(count(*) FILTER (NOT p > u) / count(*)::DOUBLE, 9) AS success, round(count(*) FILTER (p > u) / count(*)::DOUBLE, 9) AS compression, round(avg(importance) FILTER (NOT p > u), 9) AS quality FROM x
UNION ALL SELECT 'importance_weighted', round(count(*) FILTER (importance > 0.3) / count(*)::DOUBLE, 9), 0, round(avg(importance * confidence) FILTER (importance > 0.3), 9) FROM mem""")
def strategy_outcomes(spark, sf_dir):
    """What two strategies would keep: gradual forgetting by a draw that the key fixes, and importance over 0.3."""
    m = memories(spark, sf_dir)
    p = (1 - F.exp(-F.log(F.lit(2.0)) * hours_since("last_accessed") / 168)) * (1 - F.col("importance"))
    m = m.select("importance", "confidence", (p > F.expr(_DRAW)).alias("gone"), (F.col("importance") > 0.3).alias("kept"))
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 9)
    one = m.agg(share(~F.col("gone")).alias("success"), share(F.col("gone")).alias("compression"), F.round(F.avg(F.when(~F.col("gone"), F.col("importance"))), 9).alias("quality")).select(F.lit("gradual_forgetting").alias("strategy"), "*")
    two = m.agg(share(F.col("kept")).alias("success"), F.lit(0.0).alias("compression"), F.round(F.avg(F.when(F.col("kept"), F.col("importance") * F.col("confidence"))), 9).alias("quality")).select(F.lit("importance_weighted").alias("strategy"), "*")
    return one.unionByName(two)


_PRIO = "0.3 * importance + 0.2 * (1 - confidence) + 0.2 * (1 - greatest(0.001, least(0.999, exp(-ln(2) * {idle} / (24 * (1 + 2 * importance)))))) + 0.15 * (access_count / 17e0) + 0.15 * confidence"


@query(f"""WITH {MEMORIES}, x AS (SELECT key, round({_PRIO.format(idle=_IDLE)}, 12) AS priority, created_at + to_seconds(3600 * ([1, 6, 24, 72, 168][least(access_count, 4) + 1] * (2 - importance))) AS due FROM mem),
r AS (SELECT *, row_number() OVER (ORDER BY priority DESC, key) AS rank FROM x QUALIFY rank <= 100), s AS (SELECT *, min(CASE WHEN due > TIMESTAMP '2025-06-01' THEN rank END) OVER () AS stop FROM r)
SELECT key, rank, round(priority, 9) AS priority FROM s WHERE stop IS NULL OR rank < stop""")
def selective_replay(spark, sf_dir):
    """The hundred of highest priority, up to the first that is not due yet."""
    m = memories(spark, sf_dir)
    kept = ebbinghaus(hours_since("last_accessed"), F.col("importance"), F.lit(0.0), F.lit(0.0))
    p = replay_priority(F.col("importance"), 1 - F.col("confidence"), 1 - kept, F.col("access_count") / 17, F.col("confidence"))
    due = F.expr("cast(created_at as timestamp)").cast("double") + 3600 * spaced_repetition_hours(F.col("access_count"), F.col("importance"))
    m = m.select("key", F.round(p, 12).alias("priority"), due.alias("due"))
    return D.replay_batch(m, F.lit("2025-06-01 00:00:00").cast("timestamp").cast("double")).select("key", "rank", F.round("priority", 9).alias("priority"))


@query(f"""WITH {MEMORIES}, g AS (SELECT key, value, CASE WHEN length(value) < 3 THEN [value] ELSE list_distinct(list_transform(range(1, length(value) - 1), lambda i: substr(value, i::INT, 3))) END AS g FROM (SELECT key, lower(value) AS value FROM mem)),
p AS (SELECT a.key, a.g, b.g AS h FROM g a JOIN g b ON b.key::BIGINT = a.key::BIGINT + 1) SELECT key, round(len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h)))::DOUBLE, 9) AS similarity FROM p""")
def ngram_similarity(spark, sf_dir):
    """Trigrams of each whole text and the next."""
    m = memories(spark, sf_dir).select("key", F.lower("value").alias("a"))
    b = m.select((F.col("key").cast("long") - 1).cast("string").alias("key"), F.col("a").alias("b"))
    return m.join(b, "key").select("key", F.round(T.ngram_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


_JW = "(jaro_similarity({a}, {b}) + 0.1e0 * (CASE WHEN {a}[1] <> {b}[1] THEN 0 WHEN {a}[1:2] <> {b}[1:2] OR least(length({a}), length({b})) < 2 THEN 1 WHEN {a}[1:3] <> {b}[1:3] OR least(length({a}), length({b})) < 3 THEN 2 WHEN {a}[1:4] <> {b}[1:4] OR least(length({a}), length({b})) < 4 THEN 3 ELSE 4 END) * (1 - jaro_similarity({a}, {b})))"
#: DuckDB compares bytes: letters of more than one become one each.
_ONE_BYTE = "translate({0}, 'áâäçèéêëíîïñóôöùúûüßàæœ', '" + "".join(map(chr, (*range(1, 9), *range(14, 29)))) + "')"
_NEAR = "CASE WHEN greatest({a}, {b}) > 0 THEN 1 - abs({a} - {b}) / greatest({a}, {b})::DOUBLE ELSE 1 END"
_LIKE = f"""{MEMORIES}, m AS MATERIALIZED (SELECT *, {_SET.format("value", 2)} AS w, strlen(value) AS n, floor(epoch(created_at)) AS c, floor(epoch(last_accessed)) AS a FROM mem), r AS (SELECT * FROM m WHERE key = '100'), rw AS (SELECT x, {_ONE_BYTE.format("x")} AS x1 FROM (SELECT unnest(w) AS x FROM r)),
vo AS (SELECT y, {_ONE_BYTE.format("y")} AS y1 FROM (SELECT DISTINCT unnest(w) AS y FROM m)), fm AS MATERIALIZED (SELECT x, y FROM rw, vo WHERE x = y OR {_JW.format(a="x1", b="y1")} > 0.8), fz AS (SELECT key, count(DISTINCT x) AS fuzzy FROM (SELECT key, unnest(w) AS y FROM m) JOIN fm USING (y) GROUP BY 1),
ta AS (SELECT DISTINCT unnest(tags) AS t FROM m), tm AS (SELECT t, u FROM (SELECT unnest(tags) AS u FROM r), ta WHERE t = u OR {_JW.format(a="u", b="t")} > 0.85 OR (strlen(t) > 3 AND strlen(u) > 3 AND (left(t, 4) = left(u, 4) OR {_JW.format(a="u", b="t")} > 0.9))),
al AS (SELECT key, count(DISTINCT u) AS alike FROM (SELECT key, unnest(tags) AS t FROM m) JOIN tm USING (t) GROUP BY 1),
b AS (SELECT m.key, len(list_intersect(m.w, r.w))::DOUBLE AS i, len(m.w) AS n2, len(r.w) AS n1, len(list_intersect(m.tags, r.tags))::DOUBLE AS ti, len(m.tags) AS t2, len(r.tags) AS t1, abs(m.importance - r.importance) AS d, floor(abs(m.c - r.c) / 3600) AS h, floor(abs(m.a - r.a) / 3600) AS ha,
  {_NEAR.format(a="m.access_count", b="r.access_count")} AS acc, {_NEAR.format(a="m.n", b="r.n")} AS ln, {_NEAR.format(a="len(m.w)", b="len(r.w)")} AS vl, {_NEAR.format(a="len(m.tags)", b="len(r.tags)")} AS tl FROM m, r),
b2 AS (SELECT b.*, coalesce(fz.fuzzy, 0) AS fuzzy, coalesce(al.alike, 0) AS alike FROM b LEFT JOIN fz USING (key) LEFT JOIN al USING (key)),
p AS (SELECT *, CASE WHEN n1 > 0 AND n2 > 0 THEN 0.3 * coalesce(i / nullif(n1 + n2 - i, 0), 0) + 0.25 * i / sqrt(n1 * n2) + 0.25 * fuzzy / greatest(n1, n2) + 0.2 * i / least(n1, n2) ELSE 0 END AS content, 0.7 * ti / greatest(t1, t2) + 0.3 * alike / greatest(t1, t2) AS tag FROM b2),
lk AS (SELECT key, 0.3 * content + 0.25 * tag + 0.15 * (0.4 * greatest(0, 1 - d) + 0.3 * exp(-2 * d) + 0.3 * exp(-d * d / 0.1)) + 0.15 * (0.3 * greatest(0, 1 - h / 168) + 0.4 * exp(-h / 72) + 0.3 * exp(-pow(h / 24, 2) / 2)) + 0.1 * (0.6 * acc + 0.4 / (1 + ha / 24)) + 0.05 * (0.5 * ln + 0.3 * vl + 0.2 * tl) AS similarity,
  round(0.3 * 3 * (1 - content) + 0.25 * 3 * (1 - 0.6 * ti / (t1 + t2 - ti) - 0.4 * tag) + 0.2 * CASE WHEN h < 1 THEN 0 WHEN h < 24 THEN 1 WHEN h < 168 THEN 2 WHEN h < 720 THEN 3 ELSE 4 END + 0.15 * CASE WHEN d < 0.1 THEN 0 WHEN d < 0.3 THEN 1 WHEN d < 0.5 THEN 2 ELSE 3 END
    + 0.1 * (2 * (1 - ln) + 2 * (1 - vl)) / 2, 9) AS far FROM p)"""


@query()
def likeness_to_one(spark, sf_dir):
    """Likeness of every memory to one of them, and its distance from 1 to 5."""
    return K.like(spread(memories(spark, sf_dir)), "100").select("key", F.round("similarity", 7).alias("similarity"), "distance")


@query(f"WITH {_LIKE} SELECT key, importance FROM mem JOIN lk USING (key) WHERE round(similarity, 9) >= 0.4 AND access_count >= 5")
def similarity_filter(spark, sf_dir):
    """Results that are like enough to a reference."""
    m = spread(memories(spark, sf_dir))
    return K.filter_like(m.filter("access_count >= 5").select("key", "importance"), m, "100", least=0.4)


_CONTEXT = A.Context(activity=0.8, load=0.3, time_of_day=0.6, trends=(0.4, 0.5, 0.7), variance=0.05, feedback=12, history=(("performance_driven", (0.9, 0.8)), ("multi_objective", (0.6,) * 40), ("context_aware", (0.95, 0.9, 1.0))))


@query(f"""WITH {MEMORIES}, x AS (SELECT key, importance AS s, access_count / 17e0 AS u FROM mem), f AS (SELECT *, unnest([{{'n': 'context_aware', 'p': 0.95e0, 'k': 3, 'c': 0.5e0}}, {{'n': 'multi_objective', 'p': 0.6e0, 'k': 40, 'c': CASE WHEN s > 0.6 THEN 0.85e0 ELSE 0.7e0 END}},
  {{'n': 'performance_driven', 'p': 0.85e0, 'k': 2, 'c': CASE WHEN s > 0.7 THEN 0.9e0 ELSE 0.6e0 END}}, {{'n': 'reinforcement_learning', 'p': 0.5e0, 'k': 0, 'c': 0.8e0}}]) AS t FROM x),
g AS (SELECT key, s, t.n AS n, t.p AS p, t.k AS k, round(0.3 * t.p + 0.25 * t.c + 0.2 * (s + u) / 2 + 0.15 * 0.7 + 0.1 * 0.6, 12) AS f FROM f), b AS (SELECT *, count(*) FILTER (f > 0.7) OVER (PARTITION BY key) AS many FROM g QUALIFY row_number() OVER (PARTITION BY key ORDER BY f DESC, n) = 1),
d AS (SELECT *, CASE WHEN many >= 2 THEN 'hybrid' ELSE n END AS strategy FROM b)
SELECT key, strategy, round(f, 9) AS fitness, round(least(1, 0.3 * s + 0.2 * 0.8 + 0.2 * 0.7 + 0.15 * 0.6 + 0.15 * CASE strategy WHEN 'performance_driven' THEN CASE WHEN s > 0.7 THEN 1.2 ELSE 0.8 END WHEN 'context_aware' THEN 0.7 ELSE 1 END), 9) AS priority,
 floor(24 * CASE strategy WHEN 'performance_driven' THEN 2 - s WHEN 'context_aware' THEN 0.5 ELSE 1 END)::DOUBLE AS delay_hours, round(0.7 * CASE WHEN many >= 2 THEN 0.5 ELSE p END + 0.3 * (0.8 + s) / 2, 9) AS effectiveness, round(CASE WHEN many >= 2 THEN 0 ELSE k / 100e0 END, 9) AS confidence FROM d""")
def replay_decisions(spark, sf_dir):
    m = memories(spark, sf_dir).select("key", F.col("importance").alias("score"), (F.col("access_count") / 17).alias("use"))
    d = A.replay_decisions(m, _CONTEXT)
    return d.select("key", "strategy", *(F.round(c, 9).alias(c) for c in ("fitness", "priority")), "delay_hours", *(F.round(c, 9).alias(c) for c in ("effectiveness", "confidence")))


@query("""WITH e AS (SELECT vec_id, label, i, (embedding::DOUBLE[])[i] AS x FROM embeddings, range(1, 65) r(i)), a AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM e WHERE label < 5 GROUP BY i), b AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM e WHERE label >= 5 GROUP BY i),
z AS (SELECT vec_id, sum(b.m + CASE WHEN a.s > 0 THEN (x - a.m) / a.s * b.s ELSE 0 END) AS total FROM e JOIN a USING (i) JOIN b USING (i) WHERE label < 5 GROUP BY 1), d AS (SELECT avg(abs(a.m - b.m)) AS d FROM a JOIN b USING (i))
SELECT vec_id::VARCHAR AS key, round(total, 6) AS total, round(d, 9) AS discrepancy FROM z, d""")
def domain_alignment(spark, sf_dir):
    """Vectors of five classes moved to where those of the others lie, and how far apart they were."""
    v = vectors(spark, sf_dir)
    a, b = v.filter("label < 5").select("key", "embedding"), v.filter("label >= 5").select("key", "embedding")
    moved = A.align_domains(a, b)
    return moved.join(F.broadcast(A.discrepancy(a, b))).select("key", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round("discrepancy", 9).alias("discrepancy"))
