"""Further queries: contexts, importance, consolidation, relations, event logs, machine learning by Spark's library."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import context as C
from recollect.operators import graph as G
from recollect.operators import related as D
from recollect.plans.registry import query
from recollect.session import materialize
from recollect.sources import datasets as S
from recollect.sources.tables import EDGES, MEMORIES, MEMORY_LINKS, edges, hours_since, hours_sql, memories, memory_links, spread, table, vectors

#: Labels whose models are fitted at one time; it changes no model.
FITS = 10


@query(f"""WITH {MEMORIES}, p AS (SELECT key, value, string_split(lower(value), 'the') AS s FROM mem), u AS (SELECT key, value, s, unnest(range(1, len(s))) AS i FROM p),
h AS (SELECT key, value, (list_sum(list_transform(s[1:i], lambda x: length(x))) + (i - 1) * 3)::INT AS start FROM u) SELECT key, start, substring(value, greatest(start + 1 - 50, 1), least(start, 50) + 53) AS text FROM h""")
def search_highlights(spark, sf_dir):
    m = memories(spark, sf_dir).select("key", F.explode(C.highlights(F.col("value"), "the")).alias("h"))
    return m.select("key", "h.start", "h.text")


@query(f"WITH {MEMORIES}, t AS (SELECT lang, key, sum(ceil(strlen(value) / 4::DOUBLE)::BIGINT) OVER (PARTITION BY lang ORDER BY importance DESC, key ROWS UNBOUNDED PRECEDING)::BIGINT AS tokens FROM mem) SELECT lang, key, tokens FROM t WHERE tokens <= 5000")
def context_budget(spark, sf_dir):
    m = memories(spark, sf_dir).select("key", F.col("value").alias("text"), F.get("tags", F.lit(0)).alias("lang"), "importance")
    return C.within_budget(m, 5000, F.desc("importance"), F.asc("key"), by=("lang",)).select("lang", "key", "tokens")


for _style, _sql in (
    ("plain", "key || ': ' || value"), ("markdown", "'- **' || key || '**: ' || value"), ("xml", "'<memory key=\"' || key || '\">' || replace(replace(value, '&', '&amp;'), '<', '&lt;') || '</memory>'"),
):

    def _context(spark, sf_dir, style=_style):
        return C.format_context(memories(spark, sf_dir), style)

    _context.__name__ = f"context_{_style}"
    query(f"WITH {MEMORIES} SELECT key, {_sql} AS line FROM mem")(_context)


_IDLE, _AGE = hours_sql("last_accessed"), hours_sql("created_at")
_MIX = lambda rows, names: "CASE WHEN importance > 0.8 AND access_count > 20 THEN {} WHEN access_count > {} THEN {} WHEN importance > 0.7 THEN {} ELSE {} END".format(*[" + ".join(f"{w}e0 * {n}" for w, n in zip(r, names, strict=True)) if isinstance(r, tuple) else r for r in rows])
_IMPORTANCE = f"""{MEMORIES}, {MEMORY_LINKS}, wd AS (SELECT key, list_filter(regexp_split_to_array(value, '\\s+'), lambda w: w <> '') AS ws FROM mem), ch AS (SELECT key, strlen(value)::DOUBLE AS t, unnest(string_split(value, '')) AS c FROM mem WHERE value <> ''),
en AS (SELECT key, -sum(p * log2(p)) / 8 AS e FROM (SELECT key, t, c, count(*) / t AS p FROM ch GROUP BY 1, 2, 3) GROUP BY 1),
lo AS (SELECT src AS key, count(*) AS outs, sum(strength) AS so FROM links GROUP BY 1), li AS (SELECT dst AS key, count(*) AS ins, sum(strength) AS si FROM links GROUP BY 1),
x AS (SELECT mem.key, importance, access_count, strlen(value) AS size, coalesce(len(list_distinct(ws)) / nullif(len(ws), 0)::DOUBLE, 0) AS rich, coalesce(len(list_filter(ws, lambda w: strlen(w) > 3)) / nullif(len(ws), 0)::DOUBLE, 0) AS dense, coalesce(e, 0) AS e,
  regexp_matches(value, 'and|between|connects|relates') AS bridges, access_count / greatest(1, floor({_AGE} / 24)) AS daily, floor({_IDLE}) AS idle, greatest(1, floor({_AGE})) AS age, coalesce(outs, 0) AS outs, coalesce(ins, 0) AS ins, least(10, coalesce(so, 0) + coalesce(si, 0)) AS tie
  FROM mem JOIN wd USING (key) LEFT JOIN en USING (key) LEFT JOIN lo USING (key) LEFT JOIN li USING (key)),
y AS (SELECT *, least(1, (ins + outs) / 80::DOUBLE) AS v1, tie / 10 AS v2, least(1, least(1, ins * outs / 1500::DOUBLE) + CASE WHEN bridges THEN 0.2 ELSE 0 END) AS v3, least(1, tie / 10 + 0.3 * importance + CASE WHEN access_count > 15 THEN 0.2 WHEN access_count > 5 THEN 0.1 ELSE 0 END) AS v4,
  least(1, 0.0015 + 0.85 * ins / 50 + 0.1 * access_count / 100) AS v5, least(1, 0.6 * CASE WHEN size > 500 THEN 0.8 WHEN size > 100 THEN 0.6 ELSE 0.3 END + 0.4 * rich) AS v6,
  exp(-ln(2) * idle / (24 * (1 + 2 * importance) * CASE WHEN access_count > 10 THEN 2 WHEN access_count > 5 THEN 1.5 ELSE 1 END * CASE WHEN size > 1000 THEN 1.5 WHEN size > 100 THEN 1.2 ELSE 1 END)) AS r1,
  pow(1 + idle / 24, CASE WHEN importance > 0.7 THEN -0.5 ELSE -0.8 END) AS r2, CASE WHEN idle < 1 THEN 1 ELSE 1 - least(1, ln(idle) / ln(168)) END AS r3 FROM x),
z AS (SELECT key, 1 / (1 + exp(-(daily - avg(daily) OVER ()) / stddev_pop(daily) OVER ())) AS frequency, least(1, greatest(0, ({_MIX(((0.2, 0.6, 0.2), 10, (0.4, 0.4, 0.2), (0.5, 0.2, 0.3), (0.6, 0.3, 0.1)), ("r1", "r2", "r3"))}) * CASE WHEN access_count / (age / 24) > 1 THEN 1.2 WHEN access_count / (age / 24) > 0.1 THEN 1 ELSE 0.8 END)) AS recency,
  least(1, {_MIX((C.CENTRAL[0], 15, *C.CENTRAL[1:]), ("v1", "v2", "v3", "v4", "v5", "v6"))}) AS centrality, least(1, 0.2 * CASE WHEN size BETWEEN 50 AND 2000 THEN 0.4 ELSE 0.8 END + 0.3 * rich + 0.3 * e + 0.2 * dense) AS uniqueness,
  CASE WHEN access_count < 2 THEN 0.1 ELSE least(1, 1 / (1 + exp(-2 * (1 - abs(idle - 24 / daily) / (24 / daily)))) + CASE WHEN access_count > 10 THEN 0.2 WHEN access_count > 5 THEN 0.1 ELSE 0 END) END AS consistency FROM y),
sc AS (SELECT *, least(1, greatest(0, 0.25e0 * frequency + 0.2e0 * recency + 0.2e0 * centrality + 0.2e0 * uniqueness + 0.15e0 * consistency)) AS score FROM z)"""


def _importance(spark, sf_dir):
    return C.importance(spread(memories(spark, sf_dir)), memory_links(spark, sf_dir), hours_since("last_accessed"), hours_since("created_at"))


@query(f"WITH {_IMPORTANCE} SELECT key, " + ", ".join(f"round({c}, 7) AS {c}" for c in ("frequency", "recency", "centrality", "uniqueness", "consistency", "score")) + " FROM sc")
def importance_scores(spark, sf_dir):
    s = _importance(spark, sf_dir)
    return s.select("key", *(F.round(c, 7).alias(c) for c in s.columns[1:]))


@query(f"WITH {_IMPORTANCE} SELECT key, round(score, 7) AS score, CASE WHEN round(score, 7) >= 0.45 THEN 'replay' ELSE 'forget' END AS outcome FROM sc")
def consolidation(spark, sf_dir):
    s = _importance(spark, sf_dir).select("key", F.round("score", 7).alias("score"))
    return C.consolidate(memories(spark, sf_dir), s, 0.45)


@query("""WITH RECURSIVE v AS (SELECT vec_id::VARCHAR AS k, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.k AS a, b.k AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.k < b.k WHERE list_cosine_similarity(a.e, b.e) >= 0.3),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(a, b) AS (SELECT a, a FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), c AS (SELECT a AS key, min(b) AS cluster FROM r GROUP BY a),
st AS (SELECT key, round(sum(s), 9) AS s FROM (SELECT a AS key, s FROM p UNION ALL SELECT b, s FROM p) GROUP BY 1), rep AS (SELECT cluster, count(*) AS members, min(key) FILTER (true) AS x FROM c GROUP BY 1),
q AS (SELECT cluster, key AS representative FROM c JOIN st USING (key) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY s DESC, key) = 1) SELECT rep.cluster, members, representative, coherence FROM rep JOIN q USING (cluster) JOIN (SELECT cluster, round(avg(s), 9) AS coherence FROM p JOIN c ON c.key = p.a GROUP BY 1) USING (cluster) WHERE members >= 2""")
def reflection_insights(spark, sf_dir):
    v = vectors(spark, sf_dir).select("key", "embedding")
    return C.insights(v, materialize(G.similar_links(v, 0.3), "near-links")).select("cluster", "members", "representative", "coherence")


@query("""WITH u AS (SELECT DISTINCT user_id, event_type || '/' || (epoch_us(ts) // 3600000000 % 24) AS item FROM events), n AS (SELECT user_id, count(*) AS n FROM u GROUP BY 1), p AS (SELECT a.user_id AS a, b.user_id AS b, count(*) AS c FROM u a JOIN u b ON a.item = b.item AND a.user_id < b.user_id GROUP BY 1, 2)
SELECT a, b, round(c / greatest(x.n, y.n)::DOUBLE, 9) AS score FROM p JOIN n x ON x.user_id = a JOIN n y ON y.user_id = b WHERE c / greatest(x.n, y.n)::DOUBLE > 0.5""")
def potential_collaborators(spark, sf_dir):
    hour = (F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) % 24).cast("string")
    u = table(spark, sf_dir, "events").select("user_id", F.concat_ws("/", "event_type", hour).alias("item"))
    return C.collaborators(u).withColumn("score", F.round("score", 9))


@query("SELECT row_number() OVER (ORDER BY ts, event_id) AS sequence, event_id, user_id FROM events")
def event_log_sequence(spark, sf_dir):
    return S.sequence_events(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "ts", "event_id").select("sequence", "event_id", "user_id")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS offset_ FROM events")
def partition_events(spark, sf_dir):
    """The offset of every event in its partition."""
    e = table(spark, sf_dir, "events")
    return e.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("offset_"))


@query(f"WITH {MEMORIES} SELECT key, len(regexp_extract_all(value, '[^\\n]*(?:https?://|doi[:.]|\\[[^\\]\\n]+\\])[^\\n]*')) AS refs FROM mem")
def text_references(spark, sf_dir):
    return memories(spark, sf_dir).select("key", F.size(T.references(F.col("value"))).alias("refs"))


@query(f"""WITH {EDGES}, {MEMORIES}, nb AS (SELECT DISTINCT CASE WHEN src = 'c:1' THEN dst ELSE src END AS k FROM edges WHERE 'c:1' IN (src, dst)) SELECT k AS node FROM nb UNION SELECT 'c:1'""")
def graph_distance_filter(spark, sf_dir):
    """Nodes within one hop of a reference, itself included."""
    return G.bfs(edges(spark, sf_dir), ["c:1"], 1).select("node")


@query(f"WITH {MEMORIES} SELECT key, importance, access_count FROM mem WHERE created_at BETWEEN TIMESTAMP '2024-03-01' AND TIMESTAMP '2024-03-31' AND last_accessed >= TIMESTAMP '2024-03-10'")
def temporal_slice(spark, sf_dir):
    return memories(spark, sf_dir).filter("created_at between timestamp_ntz'2024-03-01' and timestamp_ntz'2024-03-31' and last_accessed >= timestamp_ntz'2024-03-10'").select("key", "importance", "access_count")


for _rank, _expr, _dsql in (
    ("recency", lambda m: 1 / (1 + hours_since("last_accessed") / 24), f"1 / (1 + {hours_sql('last_accessed')} / 24)"),
    ("frequency", lambda m: F.least(F.col("access_count") / 100, F.lit(1.0)), "least(access_count / 100e0, 1)"),
    ("recent_and_important", lambda m: 0.5 / (1 + hours_since("last_accessed") / 24) + 0.5 * F.col("importance"), f"0.5e0 / (1 + {hours_sql('last_accessed')} / 24) + 0.5e0 * importance"),
):

    def _ranked(spark, sf_dir, f=_expr):
        m = memories(spark, sf_dir)
        return m.select("key", F.round(f(m), 9).alias("score")).orderBy(F.desc("score"), "key").limit(50)

    _ranked.__name__ = f"ranking_{_rank}"
    query(f"WITH {MEMORIES} SELECT key, round({_dsql}, 9) AS score FROM mem ORDER BY score DESC, key LIMIT 50")(_ranked)


@query(f"""WITH {MEMORIES}, a AS (SELECT key, 0.4e0 * importance AS s FROM mem WHERE access_count > 12), b AS (SELECT key, 0.9e0 * confidence AS s FROM mem WHERE access_count < 14 AND confidence > 0.5), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT key, round(max(s), 9) AS score FROM u GROUP BY key""")
def union_of_retrievals(spark, sf_dir):
    """Results of two retrievals, the best score of each key."""
    m = memories(spark, sf_dir)
    a = m.filter("access_count > 12").select("key", (0.4 * F.col("importance")).alias("s"))
    b = m.filter("access_count < 14 AND confidence > 0.5").select("key", (0.9 * F.col("confidence")).alias("s"))
    return a.unionByName(b).groupBy("key").agg(F.round(F.max("s"), 9).alias("score"))


@query("""WITH w AS (SELECT user_id, ts, lead(ts, 2) OVER (PARTITION BY user_id ORDER BY ts) AS third FROM events) SELECT DISTINCT user_id FROM w WHERE third - ts <= INTERVAL 2 HOUR""")
def two_hour_bursts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    third = F.lead("ts", 2).over(Window.partitionBy("user_id").orderBy("ts"))
    return e.withColumn("third", third).filter(F.unix_micros("third") - F.unix_micros("ts") <= 7_200_000_000).select("user_id").distinct()


@query("""WITH x AS (SELECT unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT i, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, min(v) AS min, max(v) AS max, round(median(v), 9) AS median FROM x GROUP BY i""")
def array_statistics(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select(F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    r = lambda c, n: F.round(c, 9).alias(n)
    return x.groupBy("i").agg(r(F.avg("v"), "mean"), r(F.stddev_pop("v"), "std"), F.min("v").alias("min"), F.max("v").alias("max"), r(F.median("v"), "median"))


@query("""WITH x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), s AS (SELECT i, min(v) AS lo, max(v) AS hi FROM x GROUP BY 1) SELECT vec_id, i, round((v - lo) / (hi - lo), 9) AS scaled FROM x JOIN s USING (i)""")
def normalize_minmax(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    s = x.groupBy("i").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return x.join(s, "i").select("vec_id", "i", F.round(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), 9).alias("scaled"))


@query()
def principal_components(spark, sf_dir):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("x"))
    p = PCA(k=2, inputCol="x", outputCol="p").fit(v).transform(v).select("vec_id", vector_to_array("p").alias("p"))
    return p.select("vec_id", F.round(F.abs(F.get("p", F.lit(0))), 6).alias("first"), F.round(F.abs(F.get("p", F.lit(1))), 6).alias("second"))


@query()
def forest_classifier(spark, sf_dir):
    """Labels of vectors by a random forest that has seen four rows in five; held_out says which it has not."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    v = table(spark, sf_dir, "embeddings").filter("label IS NOT NULL").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    held_out = F.crc32(F.col("vec_id").cast("string")) % 5 == 0
    p = RandomForestClassifier(numTrees=10, maxDepth=5, seed=1).fit(v.filter(~held_out)).transform(v)
    return p.select("vec_id", held_out.alias("held_out"), F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))


@query()
def svm_classifier(spark, sf_dir):
    """Labels of vectors by linear support vector machines, one against the rest, that have seen four rows in five."""
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.functions import array_to_vector

    v = table(spark, sf_dir, "embeddings").filter("label IS NOT NULL").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    held_out = F.crc32(F.col("vec_id").cast("string")) % 5 == 0
    # a fit is many short jobs, each after the last: those of several labels run side by side
    p = OneVsRest(classifier=LinearSVC(maxIter=10, regParam=0.1), parallelism=FITS).fit(v.filter(~held_out)).transform(v)
    return p.select("vec_id", held_out.alias("held_out"), F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))


@query(f"""WITH {MEMORIES}, t AS (SELECT key, unnest(list_filter(regexp_split_to_array(lower(value), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS t FROM mem), d AS (SELECT t, count(DISTINCT key) AS df FROM t GROUP BY 1) SELECT t AS term, df, round(ln((SELECT count(*) FROM mem) / (df + 1)::DOUBLE), 9) AS idf FROM d""")
def inverse_document_frequency(spark, sf_dir):
    m = memories(spark, sf_dir)
    t = m.select("key", F.explode(T.scan_tokens(F.col("value"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = F.broadcast(m.agg(F.count(F.lit(1)).alias("n")))
    return t.join(n).select("term", "df", F.round(F.log(F.col("n") / (F.col("df") + 1)), 9).alias("idf"))


@query(f"""WITH {MEMORIES}, t AS (SELECT key, t, count(*) AS tf FROM (SELECT key, unnest(list_filter(regexp_split_to_array(lower(value), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS t FROM mem) GROUP BY 1, 2),
d AS (SELECT t, count(*) AS df, (('0x' || substr(md5(t), 1, 8))::BIGINT % 384)::INT AS dim FROM t GROUP BY 1), w AS (SELECT key, dim, sum(tf * ln((SELECT count(*) FROM mem) / (df + 1)::DOUBLE)) AS w FROM t JOIN d USING (t) GROUP BY 1, 2)
SELECT key, dim, round(coalesce(w / nullif(sqrt(sum(w * w) OVER (PARTITION BY key)), 0), 0), 7) AS weight FROM w""")
def hashed_embeddings(spark, sf_dir):
    return C.hashed_tfidf(spread(memories(spark, sf_dir))).select("key", "dim", F.round("weight", 7).alias("weight"))


@query(f"""WITH {MEMORIES} SELECT key, substring(value, 1, 40) AS head FROM mem WHERE value ILIKE '%the%' ORDER BY key LIMIT 30""")
def ilike_search(spark, sf_dir):
    return memories(spark, sf_dir).filter(F.col("value").ilike("%the%")).orderBy("key").limit(30).select("key", F.substring("value", 1, 40).alias("head"))


@query()
def distillation(spark, sf_dir):
    """Groups of memories with like words, and what is kept of each."""
    groups = D.similarity_groups(spread(memories(spark, sf_dir)), 0.6)
    d = C.distill(groups, _importance(spark, sf_dir).select("key", "score"))
    return d.select("leader", "members", F.round("compression", 9).alias("compression"), "quality")


@query("""WITH c AS (SELECT l_suppkey AS p, l_extendedprice / 100000 AS x, row_number() OVER w AS r, count(*) OVER (PARTITION BY l_suppkey) AS n, lag(l_extendedprice / 100000) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber)),
g AS (SELECT p, avg(pow(x - b, 2)) AS f, max(x) FILTER (r = n) - max(x) FILTER (r = 1) AS d FROM c GROUP BY 1) SELECT count(*) AS parameters, round(sum(0.5 * 0.4 * coalesce(f, 0) * d * d), 9) AS penalty FROM g""")
def regularization_penalty(spark, sf_dir):
    """Half of lambda times Fisher information times the squared change: a supplier's price is a parameter, its steps are gradients."""
    w = Window.partitionBy("p").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber")
    c = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("p"), "l_shipdate", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 100_000).alias("x"))
    c = c.withColumn("b", F.lag("x").over(w)).withColumn("o", order)
    g = c.groupBy("p").agg(F.avg(F.pow(F.col("x") - F.col("b"), F.lit(2.0))).alias("fisher"), (F.max_by("x", "o") - F.min_by("x", "o")).alias("change"))
    return g.agg(F.count(F.lit(1)).alias("parameters"), F.round(F.sum(C.regularization(F.coalesce("fisher", F.lit(0.0)), F.col("change"), 0.4)), 9).alias("penalty"))
