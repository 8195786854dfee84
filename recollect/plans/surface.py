"""Queries of the statement language, profiles, stores, streams, learning and facts."""
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from recollect.api import Memory, without_marked
from recollect.functions import decay as D
from recollect.functions import facts as N
from recollect.functions import text as T
from recollect.functions.themes import THEMES, themes
from recollect.operators import retrieval as R
from recollect.operators import learning as L
from recollect.operators import profiles as P
from recollect.operators.statements import Statements
from recollect.plans.registry import query
from recollect.session import shared_folder
from recollect.sources import store as K
from recollect.sources.tables import AS_OF, EDGES, MEMORIES, edges, hours_since, hours_sql, memories, spread, table, vectors
from recollect.streaming import events as E


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# the statement language


def _statements(spark, sf_dir, *names):
    tables = {n: table(spark, sf_dir, n) for n in names}
    return Statements(spark, {**tables, "edges": edges(spark, sf_dir), "memories": memories(spark, sf_dir)})


@query(f"WITH {EDGES} SELECT a.src AS o, a.dst AS c, round(a.strength, 9) AS strength FROM edges a JOIN edges b ON a.dst = b.src WHERE a.rel_type = 'related_to' AND b.rel_type = 'part_of' AND b.dst = 'n:3' AND a.strength >= 0.5 AND a.dst <> 'it''s r.strength'")
def statement_match(spark, sf_dir):
    """A path of two typed edges to a named node."""
    return _statements(spark, sf_dir).execute("MATCH (o)-[r:related_to]->(c)-[:part_of]->(n {key: 'n:3'}) WHERE r.strength >= 0.5 AND c.key <> 'it''s r.strength' RETURN o.key AS o, c.key AS c, round(r.strength, 9) AS strength")


@query(f"WITH {EDGES}, p AS (SELECT DISTINCT src, dst FROM edges WHERE rel_type = 'part_of'), u AS (SELECT src, dst FROM p UNION SELECT a.src, b.dst FROM p a JOIN p b ON a.dst = b.src UNION SELECT a.src, c.dst FROM p a JOIN p b ON a.dst = b.src JOIN p c ON b.dst = c.src) SELECT dst AS place, count(*) AS n FROM u GROUP BY 1")
def statement_paths(spark, sf_dir):
    """Ends of paths of one to three steps."""
    s = _statements(spark, sf_dir)
    return s.execute("MATCH (a)-[:part_of*1..3]->(b) RETURN a.key AS a, b.key AS place").groupBy("place").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EDGES}, b AS (SELECT src AS f, dst AS t FROM edges WHERE rel_type = 'part_of' UNION ALL SELECT dst, src FROM edges WHERE rel_type = 'part_of') SELECT x.t AS near, count(*) AS n FROM b x JOIN (SELECT dst AS f, src AS t FROM edges WHERE rel_type = 'part_of') y ON y.f = x.t WHERE x.f = 'r:1' GROUP BY 1")
def statement_directions(spark, sf_dir):
    """An edge of either direction, then one backwards."""
    return _statements(spark, sf_dir).execute("MATCH (r {key: 'r:1'})-[:part_of]-(n)<-[:part_of]-(c) RETURN n.key AS near").groupBy("near").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {MEMORIES}, a AS (SELECT key, value, importance FROM mem WHERE key <> 'new' UNION ALL SELECT 'new', 'it''s here', NULL), b AS (SELECT key, CASE WHEN importance > 0.9 THEN 'top, ' || key ELSE value END AS value, CASE WHEN importance > 0.9 THEN 1 ELSE importance END AS importance FROM a)
SELECT key, md5(value) AS value, round(importance, 9) AS importance FROM b WHERE NOT coalesce(importance < 0.2, false)""")
def statement_changes(spark, sf_dir):
    """CREATE, UPDATE and DELETE, one after the other."""
    s = _statements(spark, sf_dir)
    for text in ("CREATE MEMORY 'new' VALUE 'it''s here'", "UPDATE MEMORIES SET value = concat('top, ', key), importance = 1.0 WHERE importance > 0.9", "DELETE FROM MEMORIES WHERE importance < 0.2;"):
        s.execute(text)
    return s.execute("SELECT key, md5(value) AS value, round(importance, 9) AS importance FROM memories")


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def statement_select(spark, sf_dir):
    return _statements(spark, sf_dir, "customer").execute("SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")


@query("SELECT * FROM (VALUES ('explain', true), ('malformed', false), ('match', true), ('select', true), ('unknown', false)) v(name, valid)")
def statement_validation(spark, sf_dir):
    s = _statements(spark, sf_dir)
    texts = {"select": "SELECT key FROM memories", "match": "MATCH (a)-[:x]->(b) RETURN a.key", "explain": "EXPLAIN SELECT 1", "malformed": "SELECT (key FROM memories", "unknown": "FETCH all"}
    return spark.createDataFrame([(n, s.validate(t)[0]) for n, t in texts.items()], "name string, valid boolean")


@query()
def statement_plan(spark, sf_dir):
    return _statements(spark, sf_dir).execute("EXPLAIN MATCH (a)-[:part_of]->(b) WHERE a.key = 'c:1' RETURN b.key AS key")


@query("SELECT position - 1 AS position, name, type, nullable FROM (VALUES (1, 'n_nationkey', 'int', true), (2, 'n_name', 'string', true), (3, 'n_regionkey', 'int', true)) v(position, name, type, nullable)")
def result_columns(spark, sf_dir):
    return P.columns_of(table(spark, sf_dir, "nation"))


# profiles


def _column_sql(t, columns):
    return " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, count(nullif({c}::VARCHAR, '')) AS f, count(DISTINCT nullif({c}::VARCHAR, '')) AS d FROM {t}" for c in columns)


_EVENTS = "event_id, ts, user_id, event_type, value, props".split(", ")


@query(f"""WITH x AS (SELECT event_id, ts, user_id, event_type, CASE WHEN user_id % 4 = 0 THEN NULL ELSE value END AS value, props FROM events), c AS ({_column_sql('x', _EVENTS)}), p AS (SELECT *, (n - f) / n::DOUBLE AS m, d / n::DOUBLE AS u FROM c)
SELECT name, 'Missing' AS pattern, round(m, 9) AS share, 0.9::DOUBLE AS confidence FROM p WHERE m > 0.1 UNION ALL SELECT name, 'Duplicate', round(u, 9), 0.8 FROM p WHERE u < 0.1 AND d > 1""")
def data_patterns(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("user_id") % 4 != 0, F.col("value")))
    return P.data_patterns(e).select("name", "pattern", F.round("share", 9).alias("share"), "confidence")


_PART = {"p_partkey": "Integer", "p_name": "Text", "p_brand": "Text", "p_type": "Text", "p_size": "Integer", "p_retailprice": "Float"}


@query(f"WITH c AS ({_column_sql('part', _PART)}) SELECT name, n AS rows, n - f AS nulls, d AS distinct_, CASE name {' '.join(f'WHEN {c!r} THEN {t!r}' for c, t in _PART.items())} END AS type FROM c")
def csv_profile(spark, sf_dir):
    path = _place(spark, "csv")
    K.write(table(spark, sf_dir, "part"), path, "csv")
    return P.csv_profile(spark, path).withColumnRenamed("distinct", "distinct_")


@query("""SELECT 'semicolon' AS file, ';' AS delimiter, true AS header UNION ALL SELECT 'tab', chr(9), false UNION ALL SELECT 'comma', ',', true""")
def csv_rules(spark, sf_dir):
    """What the first lines of files tell about them."""
    files = {"semicolon": ["id;name", "1;a,b", "2;c,d"], "tab": ["1\t2", "3\t4"], "comma": ["x,y", "1,2"]}
    return spark.createDataFrame([(n, K.csv_delimiter(x), K.csv_has_header(x, K.csv_delimiter(x))) for n, x in files.items()], "file string, delimiter string, header boolean")


@query()
def compressed_memories(spark, sf_dir):
    return P.compressed(spread(memories(spark, sf_dir))).select("key", "original_size", "compressed_size", F.round("ratio", 9).alias("ratio"))


@query("SELECT unnest(['l_extendedprice', 'l_quantity']) AS feature")
def selected_features(spark, sf_dir):
    """Of four columns, those whose variance exceeds 1."""
    names = P.select_features(table(spark, sf_dir, "lineitem"), ["l_discount", "l_extendedprice", "l_quantity", "l_tax"], least_variance=1.0)
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query()
def private_histogram(spark, sf_dir):
    return P.private_histogram(memories(spark, sf_dir), 0.5)


@query()
def private_quantile(spark, sf_dir):
    return P.private_quantile(memories(spark, sf_dir), 0.5, 0.75)


@query()
def private_text(spark, sf_dir):
    return spread(memories(spark, sf_dir)).select("key", P.private_text(F.col("value"), 2.0).alias("value"))


# stores


@query("""WITH v AS (SELECT p_partkey::VARCHAR AS key, lower(p_name) AS v FROM part), g AS (SELECT key, n, unnest(list_distinct(list_transform(range(1, length(v) - n + 2), lambda i: substr(v, i::INT, n::INT)))) AS gram FROM v, range(1, 4) r(n))
SELECT gram, count(*) AS n FROM g GROUP BY 1""")
def gram_postings(spark, sf_dir):
    """How many part names hold each run of one to three characters."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("value"))
    return K.gram_postings(p).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey::VARCHAR AS key FROM part WHERE contains(lower(p_name), 'l gi')")
def gram_search(spark, sf_dir):
    """Rows that hold a string, found by its runs and then checked."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("value"))
    found = K.gram_candidates(K.gram_postings(p), "L Gi")
    return p.join(found, "key", "left_semi").filter(F.contains(F.lower("value"), F.lit("l gi"))).select("key")


@query(f"""WITH h AS (SELECT c_custkey AS k, n, md5(n || '/' || c_custkey) AS h FROM customer, (VALUES ('a'), ('b'), ('c'), ('d'), ('e')) v(n)) SELECT k::VARCHAR AS key, (row_number() OVER (PARTITION BY k ORDER BY h DESC, n DESC) - 1)::INT AS place, n AS node FROM h QUALIFY place < 2""")
def ring_nodes(spark, sf_dir):
    """Two of five nodes for each customer."""
    return K.ring_nodes(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key")), ["a", "b", "c", "d", "e"])


@query("SELECT n_nationkey::VARCHAR AS key, n_name AS value, n_regionkey / 10::DOUBLE AS importance FROM nation")
def legacy_restore(spark, sf_dir):
    """The older backup, one document, read back; of a table of fixed size, since one task writes it."""
    path = _place(spark, "legacy")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.struct(F.col("n_name").alias("value"), (F.col("n_regionkey") / 10).alias("importance")).alias("row"))
    doc = rows.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("key", "row"))).alias("entries"))).alias("value"))
    doc.coalesce(1).write.text(path)
    return K.restore_legacy(spark, path, "value string, importance double").rows.select("key", "value", "importance")


@query("SELECT * FROM (VALUES ('analytics_events', 6), ('memories', 10), ('relationships', 7)) v(name, columns)")
def store_tables(spark, sf_dir):
    """The tables of a store, created where they are not there."""
    prefix = f"t{uuid.uuid4().hex[:8]}_"
    t = K.create_tables(spark, _place(spark, "store"), prefix).groupBy("name").agg(F.count(F.lit(1)).cast("int").alias("columns"))
    for n in K.TABLES:
        spark.sql(f"DROP TABLE {prefix}{n}")
    return t


@query(f"WITH {MEMORIES} SELECT key FROM mem WHERE last_accessed + INTERVAL 90 DAY > TIMESTAMP '2024-12-01'")
def cache_alive(spark, sf_dir):
    return K.alive(memories(spark, sf_dir), "last_accessed", 90 * 86400, F.lit("2024-12-01").cast("timestamp_ntz")).select("key")


@query("SELECT 'memory' AS backend, count(*) AS n FROM nation UNION ALL SELECT 'file', count(*) FROM nation")
def store_backends(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation_store")
    path = _place(spark, "nation") + ".json"
    K.write(table(spark, sf_dir, "nation"), path, "json")
    n = lambda b, w: K.open_store(spark, b, w).agg(F.count(F.lit(1)).alias("n")).select(F.lit(b).alias("backend"), "n")
    return n("memory", "nation_store").unionByName(n("file", path))


@query("SELECT count(*) AS files, 5::BIGINT AS csv FROM range(14)")
def discovered_files(spark, sf_dir):
    """Files below a folder, and those of a pattern."""
    path = _place(spark, "found")
    spark.range(5).withColumn("x", F.col("id")).write.partitionBy("id").csv(f"{path}/a")
    spark.range(9).withColumn("x", F.col("id")).write.partitionBy("id").json(f"{path}/b")
    f = K.discover(spark, path)
    kind = T.matches_glob(F.col("path"), "*.csv")
    data = f.filter(F.col("bytes") > 0)
    return data.agg(F.count(F.lit(1)).alias("files"), F.count_if(kind).alias("csv"))


# streams and facts


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def stream_subscriptions(spark, sf_dir):
    """Two handlers, each with its kind of events."""
    path = _place(spark, "subscribe")

    def keep(batch, number):
        batch.write.mode("append").partitionBy("event_type").parquet(f"{path}/rows/batch={number}")

    stream = E.read_events(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)
    E.subscribe(stream, {"click": keep, "purchase": keep}, f"{path}/state")
    return spark.read.parquet(f"{path}/rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS r FROM events WHERE value IS NOT NULL), k AS (SELECT event_type, value, -r AS x FROM r WHERE r <= 1000)
SELECT event_type AS metric, count(*) AS n, round(avg(value), 6) AS mean, round(regr_slope(value, x), 6) AS slope FROM k GROUP BY 1""")
def stream_snapshots(spark, sf_dir):
    """The last thousand values of each kind of event, their mean and slope."""
    stream = E.read_events(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema).filter("value IS NOT NULL").select(F.col("event_type").alias("metric"), "ts", "value")
    t = E.run_to_table(E.last_snapshots(stream), "snapshots", "update")
    return t.groupBy("metric").agg(F.max_by(F.struct("n", "mean", "slope"), "n").alias("s")).select("metric", "s.n", F.round("s.mean", 6).alias("mean"), F.round("s.slope", 6).alias("slope"))


@query("SELECT count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed FROM events")
def stream_sync(spark, sf_dir):
    path = _place(spark, "sync")
    write, counts = E.sync_batches(path, "event_type <> 'error'")
    E.run_sink(E.read_events(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema), write, f"{path}-state")
    return counts(spark).agg(F.sum("succeeded").alias("succeeded"), F.sum("failed").alias("failed"))


_WHO = ("Alice", "Bob Stone", "Carol", "Dave", "Erin Moss")
_VERB = ("moved to", "was born in", "visited", "has recently relocated to", "works for")
_PRED = ("lives_in", "born_in", "visited", "lives_in", "works_at")
_SAID_SQL = "WITH s AS (SELECT c_custkey AS k, [{}][c_custkey % 5 + 1] AS w, [{}][c_custkey // 5 % 5 + 1] AS v, [{}][c_custkey // 5 % 5 + 1] AS p, 'Place' || chr((97 + c_nationkey)::INT) AS o FROM customer)".format(*(", ".join(f"'{x}'" for x in xs) for xs in (_WHO, _VERB, _PRED)))


def _said(spark, sf_dir):
    """A sentence for each customer; every seventh says nothing."""
    c = table(spark, sf_dir, "customer")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i % 5 + 1).cast("int"))
    k = F.col("c_custkey")
    place = F.concat(F.lit("Place"), F.char(97 + F.col("c_nationkey")))
    text = F.concat_ws(" ", pick(_WHO, k), pick(_VERB, F.floor(k / 5)), place)
    return c.select(k.cast("string").alias("key"), F.when(k % 7 == 0, "nothing to say").otherwise(F.concat(text, F.lit("."))).alias("value"))


@query(f"{_SAID_SQL} SELECT k::VARCHAR AS key, w AS subject, p AS predicate, o AS object FROM s WHERE k % 7 <> 0")
def extracted_facts(spark, sf_dir):
    """Subject, predicate and object of sentences by rule."""
    f = spread(_said(spark, sf_dir)).select("key", F.explode(N.facts(F.col("value"))).alias("f"))
    return f.select("key", "f.subject", "f.predicate", "f.object")


@query(f"{_SAID_SQL} SELECT k::VARCHAR AS key, k % 7 <> 0 AS raw_source, NULL::VARCHAR AS source FROM s UNION ALL SELECT k || '::fact0', false, k::VARCHAR FROM s WHERE k % 7 <> 0")
def stream_enrichment(spark, sf_dir):
    """Memories come in files; their facts are stored beside them, and they are marked as their source."""
    path = _place(spark, "enrich")
    _said(spark, sf_dir).repartition(3).write.parquet(f"{path}-in")
    write, enriched = E.enrich_batches(path, N.facts)
    E.run_sink(spark.readStream.schema("key string, value string").option("maxFilesPerTrigger", 1).parquet(f"{path}-in"), write, f"{path}-state")
    return enriched(spark).select("key", "raw_source", "source")


@query("WITH {}, t(o, name, words) AS (VALUES {}) SELECT name AS theme, count(*) AS n FROM mem JOIN t ON len(list_filter(words, lambda w: contains(lower(value), w))) > 0 GROUP BY 1".format(MEMORIES, ", ".join(f"({i}, '{n}', [{', '.join(repr(w) for w in ws)}])" for i, (n, ws) in enumerate(THEMES.items()))))
def key_themes(spark, sf_dir):
    """How many memories speak of each theme."""
    m = spread(memories(spark, sf_dir)).select(F.explode(themes(F.col("value"))).alias("theme"))
    return m.groupBy("theme").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {MEMORIES} SELECT key, [1, 6, 24, 72, 168][least(access_count, 4) + 1] * (2 - importance) AS hours, round({hours_sql('last_accessed')}, 6) AS idle FROM mem""")
def spaced_repetition(spark, sf_dir):
    m = memories(spark, sf_dir)
    return m.select("key", D.spaced_repetition_hours(F.col("access_count"), F.col("importance")).alias("hours"), F.round(hours_since("last_accessed"), 6).alias("idle"))


@query("""WITH m AS (SELECT (epoch_us(min(ts)) + epoch_us(max(ts))) / 2 AS m FROM events), h AS (SELECT user_id, count(*) FILTER (epoch_us(ts) < m) AS a, count(*) FILTER (epoch_us(ts) >= m) AS b FROM events, m GROUP BY 1)
SELECT user_id, CASE WHEN a = 0 THEN 'irregular' WHEN b / a::DOUBLE > 1.2 THEN 'increasing' WHEN b / a::DOUBLE < 0.8 THEN 'decreasing' WHEN b / a::DOUBLE BETWEEN 0.9 AND 1.1 THEN 'stable' ELSE 'irregular' END AS trend FROM h""")
def access_trends(spark, sf_dir):
    """Whether a user's events grow from the first half of the time to the second."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    mid = F.broadcast(e.agg(((F.min("t") + F.max("t")) / 2).alias("m")))
    h = e.join(mid).groupBy("user_id").agg(F.count_if(F.col("t") < F.col("m")).alias("a"), F.count_if(F.col("t") >= F.col("m")).alias("b"))
    return h.select("user_id", D.access_trend(F.col("a"), F.col("b")).alias("trend"))


# a client's view, and array arithmetic


@query(f"WITH {MEMORIES}, r AS (SELECT key, importance, row_number() OVER (ORDER BY importance DESC, key) AS rank, bucket FROM mem QUALIFY rank <= 60) SELECT key, rank FROM r WHERE bucket NOT IN ('2', '5')")
def marked_left_out(spark, sf_dir):
    """The first sixty by importance, and of these those that carry no mark: fewer may be left."""
    m = memories(spark, sf_dir).withColumn("custom_fields", F.when(F.col("custom_fields")["bucket"].isin("2", "5"), F.create_map(F.lit("superseded"), F.lit("true"))).otherwise(F.col("custom_fields")))
    return without_marked(R.top(m.select("key", "importance", F.lit("q").alias("query_id")), 60, F.desc("importance"), F.asc("key")).select("key", "rank"), m, ("superseded", "raw_source"))


@query(f"WITH {MEMORIES} SELECT key FROM mem WHERE created_at > (SELECT max(created_at) FROM mem) - INTERVAL 24 HOUR")
def made_within_a_day(spark, sf_dir):
    """Memories of the day before the newest."""
    m = memories(spark, sf_dir).select("key", "created_at")
    newest = F.broadcast(m.agg(F.max("created_at").alias("newest")))  # one row
    return m.join(newest).filter(F.expr("created_at > newest - interval '24' hour")).select("key")


@query(f"WITH {MEMORIES} SELECT key, importance FROM mem WHERE access_count >= 3 ORDER BY importance DESC, key LIMIT 20 OFFSET 40")
def third_page(spark, sf_dir):
    """Rows 41 to 60 in order: the offset comes before the limit."""
    return memories(spark, sf_dir).filter("access_count >= 3").select("key", "importance").orderBy(F.desc("importance"), "key").offset(40).limit(20)


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT label, i, (embedding::DOUBLE[])[i] AS x FROM embeddings, range(1, 65) r(i))
SELECT 'row ' || vec_id AS name, round(list_sum(v), 6) AS sum, round(list_avg(v), 6) AS mean, round(list_dot_product(v, v), 6) AS dot FROM e UNION ALL SELECT 'column ' || (i - 1), round(sum(x), 6), round(avg(x), 6), round(sum(x * x), 6) FROM u GROUP BY i""")
def array_math(spark, sf_dir):
    """Sum, mean and product with itself of each row and each column of a matrix."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    r = lambda c, n: F.round(c, 6).alias(n)
    rows = e.select(F.concat(F.lit("row "), F.col("vec_id").cast("string")).alias("name"), r(add("v"), "sum"), r(add("v") / F.size("v"), "mean"), r(add(F.transform("v", lambda x: x * x)), "dot"))
    columns = e.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(r(F.sum("x"), "sum"), r(F.avg("x"), "mean"), r(F.sum(F.col("x") * F.col("x")), "dot"))
    return rows.unionByName(columns.select(F.concat(F.lit("column "), F.col("i").cast("string")).alias("name"), "sum", "mean", "dot"))


@query("SELECT i, count(*) AS n, round(min(x), 9) AS least, round(max(x), 9) AS most FROM (SELECT vec_id, i - 1 AS i, (embedding::DOUBLE[])[i] AS x FROM embeddings, range(1, 65) r(i)) GROUP BY i")
def transposed(spark, sf_dir):
    """The matrix on its side, cell by cell; each of its rows summed up."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    return cells.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("x"), 9).alias("least"), F.round(F.max("x"), 9).alias("most"))


# a client


def _client(spark, sf_dir):
    return Memory(spark, memories(spark, sf_dir), vectors(spark, sf_dir).select("key", "embedding"))


@query(f"""WITH {MEMORIES}, n AS (SELECT 'memory-' || substr(sha256(text), 1, 16) AS key, min(text) AS value FROM benchmark WHERE text <> '' GROUP BY 1)
SELECT key, strlen(value) AS bytes, memory_type, importance FROM mem WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT key, strlen(value), 'ShortTerm', 0.5 FROM n""")
def remembered(spark, sf_dir):
    """The store after the passages of another table are remembered in it, each under a key that follows from its text."""
    m = _client(spark, sf_dir)
    m.remember_all(table(spark, sf_dir, "benchmark").select(F.col("text").alias("value")), datetime.fromisoformat(AS_OF))
    return m.memories.rows.select("key", F.octet_length("value").cast("long").alias("bytes"), "memory_type", "importance")


_HOURS_IDLE = f"(date_diff('second', last_accessed, TIMESTAMP '2024-12-20') / 3600::DOUBLE)"


@query(f"""WITH {MEMORIES}, s AS (SELECT key, greatest(0.001, least(0.999, exp(-ln(2) * {_HOURS_IDLE} / (24 * (1 + 2 * importance))))) * (0.5 + 0.5 * exp(-{_HOURS_IDLE} / 24)) * least(1 + 0.25 * ln(1 + access_count), 2) AS strength FROM mem)
SELECT key, strength < 0.1 AS forgotten, round(strength, 9) AS strength FROM s WHERE strength < 0.1 UNION ALL SELECT key, false, NULL FROM s WHERE strength >= 0.1""")
def forgotten(spark, sf_dir):
    """What a client forgets by the end of a year for want of strength, and what is left in its store."""
    m = _client(spark, sf_dir)
    gone = m.forget(datetime(2024, 12, 20))
    return gone.select("key", F.lit(True).alias("forgotten"), F.round("strength", 9).alias("strength")).unionByName(m.memories.rows.select("key", F.lit(False).alias("forgotten"), F.lit(None).cast("double").alias("strength")))
