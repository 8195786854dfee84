"""Queries that say the rest of what others say in part: paths, exports, retention, periods, profiles, summaries, sequences."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions import decay as D
from recollect.functions import text as T
from recollect.functions import vectors as V
from recollect.operators import analytics as A
from recollect.operators import graph as G
from recollect.operators import paths as P
from recollect.operators.retrieval import top
from recollect.plans.registry import query
from recollect.sources.tables import AS_OF, EDGES, MEMORIES, edges, hours_since, hours_sql, memories, spread, table, vectors

_IDLE, _AGE = hours_sql("last_accessed"), hours_sql("created_at")


# graphs


@query(f"""WITH RECURSIVE {EDGES}, e AS (SELECT src, dst, min(1.1 - strength) AS w FROM (SELECT src, dst, strength FROM edges WHERE rel_type = 'part_of' UNION ALL SELECT dst, src, strength FROM edges WHERE rel_type = 'part_of') WHERE src <> 'n:7' AND dst <> 'n:7' GROUP BY 1, 2),
p(node, cost, hops, path) AS (SELECT 'r:1', 0::DOUBLE, 0, 'r:1' UNION ALL SELECT e.dst, round(cost + w, 9), hops + 1, path || '>' || e.dst FROM p JOIN e ON e.src = p.node WHERE hops < 2)
SELECT 'r:1' AS source, node, cost, hops, path FROM p QUALIFY row_number() OVER (PARTITION BY node ORDER BY cost, hops, path) = 1""")
def cheapest_paths(spark, sf_dir):
    """From one region over the strongest edges, two steps far, around one nation."""
    e = edges(spark, sf_dir).filter("rel_type = 'part_of'")
    both = e.select("src", "dst", "strength").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "strength"))
    return P.cheapest_paths(both, ["r:1"], 1.1 - F.col("strength"), rounds=2, avoid=("n:7",))


@query(f"""WITH RECURSIVE {EDGES}, e AS (SELECT src, dst, min(1.1 - strength) AS w FROM edges WHERE rel_type = 'part_of' GROUP BY 1, 2), p(source, node, cost, hops, path, met) AS (SELECT 'c:' || k, 'c:' || k, 0::DOUBLE, 0, 'c:' || k, false FROM (VALUES (1), (2), (3)) v(k)
 UNION ALL SELECT source, e.dst, round(cost + w, 9), hops + 1, path || '>' || e.dst, met OR e.dst LIKE 'n:%' FROM p JOIN e ON e.src = p.node WHERE hops < 3)
SELECT source, node, cost, hops, path FROM p WHERE met QUALIFY row_number() OVER (PARTITION BY source, node ORDER BY cost, hops, path) = 1""")
def paths_of_customers(spark, sf_dir):
    """Where three customers lead, by nations: a path counts from its nation on."""
    p = P.cheapest_paths(edges(spark, sf_dir).filter("rel_type = 'part_of'"), ["c:1", "c:2", "c:3"], 1.1 - F.col("strength"), rounds=3)
    return p.filter("hops > 0")


@query(f"""WITH {EDGES}, t AS (SELECT a.src, b.dst, 'part_of' AS rel_type, max(a.confidence * b.confidence * 0.8) AS confidence, 'transitive' AS rule FROM edges a JOIN edges b ON a.dst = b.src AND a.rel_type = 'part_of' AND b.rel_type = 'part_of' AND a.src <> b.dst WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.src = a.src AND x.dst = b.dst AND x.rel_type = 'part_of') GROUP BY 1, 2),
i AS (SELECT dst AS src, src AS dst, 'contains' AS rel_type, max(confidence) AS confidence, 'inverse' AS rule FROM edges WHERE rel_type = 'part_of' GROUP BY 1, 2), s AS (SELECT dst AS src, src AS dst, 'related_to' AS rel_type, max(confidence * 0.9) AS confidence, 'symmetric' AS rule FROM edges WHERE rel_type = 'related_to' GROUP BY 1, 2)
SELECT src, dst, rel_type, round(confidence, 9) AS confidence, rule FROM (SELECT * FROM t UNION ALL SELECT * FROM i UNION ALL SELECT * FROM s) WHERE confidence >= 0.6""")
def infer_all_rules(spark, sf_dir):
    """Three rules over the same graph."""
    f = P.infer_all(edges(spark, sf_dir), [("transitive", "part_of", "part_of", 0.8), ("inverse", "part_of", "contains", 1.0), ("symmetric", "related_to", "related_to", 0.9)])
    return f.withColumn("confidence", F.round("confidence", 9))


#: The first and last lines of each format.
_FRAMES = {
    "csv": [(0, "src,dst,rel_type,strength")], "dot": [(0, "digraph memories {"), (3, "}")], "json": [],
    "graphml": [(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (3, "</graph></graphml>")],
    "gexf": [(0, '<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed">'), (3, "</graph></gexf>")],
}

for _fmt, _line in (
    ("csv", "src || ',' || dst || ',' || rel_type || ',' || strength"), ("dot", "'\"' || src || '\" -> \"' || dst || '\" [label=\"' || rel_type || '\"];'"),
    ("graphml", "'<edge source=\"' || src || '\" target=\"' || dst || '\"/>'"), ("gexf", "'<edge source=\"' || src || '\" target=\"' || dst || '\" label=\"' || rel_type || '\"/>'"),
    ("json", "'{\"src\":\"' || src || '\",\"dst\":\"' || dst || '\",\"rel_type\":\"' || rel_type || '\",\"strength\":' || strength || '}'"),
):

    def _export(spark, sf_dir, fmt=_fmt):
        return P.graph_lines(edges(spark, sf_dir), fmt)

    _export.__name__ = f"graph_export_{_fmt}"
    _nodes = " UNION ALL SELECT DISTINCT 1, '<node id=\"' || n || '\"/>' FROM (SELECT src AS n FROM edges UNION SELECT dst FROM edges)" if _fmt in ("graphml", "gexf") else ""
    _ends = "".join(f" UNION ALL SELECT {k}, '{line}'" for k, line in _FRAMES[_fmt])
    query(f"WITH {EDGES} SELECT 2 AS part, {_line} AS line FROM edges{_nodes}{_ends}")(_export)


@query(f"WITH {EDGES} SELECT src AS node, dst AS other, rel_type, round(strength, 9) AS strength FROM edges WHERE src IN ('n:1', 'c:5') UNION ALL SELECT dst, src, rel_type, round(strength, 9) FROM edges WHERE dst IN ('n:1', 'c:5')")
def connected_with_types(spark, sf_dir):
    """Both ends' neighbours with type and strength, each edge a row."""
    return G.undirected(edges(spark, sf_dir).select("src", "dst", "rel_type", "strength")).filter(F.col("node").isin("n:1", "c:5")).withColumn("strength", F.round("strength", 9))


@query("SELECT 'c:' || c_custkey AS key, c_name AS label FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def graph_nodes(spark, sf_dir):
    """Nodes by type and property, in order, and no more than asked for."""
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING' AND c_acctbal > 0").orderBy(F.desc("c_acctbal"), "c_custkey").limit(25)
    return c.select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("label"))


# vectors


for _metric, _sql in (("euclidean", "list_distance(e, q)"), ("manhattan", "list_sum(list_transform(list_zip(e, q), lambda z: abs(z[1] - z[2])))"), ("dot", "-list_dot_product(e, q)")):

    def _nearest(spark, sf_dir, metric=_metric):
        v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
        first = F.broadcast(v.agg(F.min_by("e", "vec_id").alias("q"), F.min("vec_id").alias("own")))  # one row
        d = v.join(first).filter("vec_id <> own").select("vec_id", F.round(V.distance(metric, F.col("e"), F.col("q")), 9).alias("distance"))
        return d.orderBy("distance", "vec_id").limit(20)

    _nearest.__name__ = f"nearest_{_metric}"
    query(f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), o AS (SELECT e AS q, vec_id AS own FROM v WHERE vec_id = (SELECT min(vec_id) FROM v)) SELECT vec_id, round({_sql}, 9) AS distance FROM v, o WHERE vec_id <> own ORDER BY 2, 1 LIMIT 20")(_nearest)


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), o AS (SELECT e AS q FROM v WHERE vec_id = (SELECT min(vec_id) FROM v)), k AS (SELECT vec_id, round(list_distance(e, q), 9) AS d FROM v, o ORDER BY d, vec_id LIMIT 30) SELECT vec_id, d AS distance FROM k WHERE d <= (SELECT avg(d) FROM k)")
def nearest_within(spark, sf_dir):
    """The thirty nearest first, then those within their mean distance: fewer may be left."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    first = F.broadcast(v.agg(F.min_by("e", "vec_id").alias("q")))  # one row
    k = v.join(first).select("vec_id", F.round(V.distance("euclidean", F.col("e"), F.col("q")), 9).alias("distance")).orderBy("distance", "vec_id").limit(30)
    return k.join(F.broadcast(k.agg(F.avg("distance").alias("mean")))).filter("distance <= mean").select("vec_id", "distance")


for _how, _one in (("l2", "x / sqrt(sum(x * x) OVER ())"), ("standard", "(x - avg(x) OVER ()) / stddev_pop(x) OVER ()")):

    def _scaled(spark, sf_dir, how=_how):
        p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("x"))
        s = F.broadcast(p.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s")))  # one row
        y = F.col("x") / F.col("n") if how == "l2" else (F.col("x") - F.col("m")) / F.col("s")
        return p.join(s).select("p_partkey", F.round(y, 9).alias("y"))

    _scaled.__name__ = f"normalize_{_how}"
    query(f"SELECT p_partkey, round({_one}, 9) AS y FROM (SELECT p_partkey, p_retailprice AS x FROM part)")(_scaled)


# time


@query("""WITH e AS (SELECT event_type, hour(ts) AS h, (dayofweek(ts) + 1)::INT AS d FROM events), h AS (SELECT event_type, 'hour' AS unit, h AS pl, count(*) AS n FROM e GROUP BY 1, 3 UNION ALL SELECT event_type, 'weekday', d, count(*) FROM e GROUP BY 1, 3)
SELECT event_type, unit, pl::INT AS place, n FROM h QUALIFY n > max(n) OVER (PARTITION BY event_type, unit) // 2""")
def busy_times(spark, sf_dir):
    """Hours and weekdays with over half the events of the busiest."""
    e = table(spark, sf_dir, "events").select("event_type", F.explode(F.array(F.struct(F.lit("hour").alias("unit"), F.hour("ts").alias("place")), F.struct(F.lit("weekday").alias("unit"), F.dayofweek("ts").alias("place")))).alias("u"))
    n = e.groupBy("event_type", "u.unit", "u.place").agg(F.count(F.lit(1)).alias("n"))
    most = F.max("n").over(Window.partitionBy("event_type", "unit"))
    return n.withColumn("most", most).filter("n > most div 2").drop("most")


@query("""WITH c AS (SELECT event_type, epoch_us(ts) // 3600000000 AS hour, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT event_type, min(hour) AS lo, max(hour) AS hi FROM c GROUP BY 1), ser AS (SELECT b.event_type, h.hour, coalesce(n, 0) AS n FROM b, LATERAL (SELECT unnest(range(lo, hi + 1)) AS hour) h LEFT JOIN c ON c.event_type = b.event_type AND c.hour = h.hour),
ac AS (SELECT a.event_type, lag, corr(a.n, b.n) AS acf FROM ser a, range(1, 49) l(lag) JOIN ser b ON a.event_type = b.event_type AND b.hour = a.hour + lag GROUP BY 1, 2), p AS (SELECT *, lag(acf) OVER w AS x, lead(acf) OVER w AS y FROM ac WINDOW w AS (PARTITION BY event_type ORDER BY lag))
SELECT event_type, lag AS period, round(acf, 6) AS acf FROM p WHERE acf > x AND acf > y AND acf > 0.02""")
def periods(spark, sf_dir):
    """Lags at which the hourly counts resemble themselves most, of two days. The bound is low, for these events have no strong period."""
    s = A.hourly_series(table(spark, sf_dir, "events"), "ts", "event_type")
    a = A.autocorrelation(s, list(range(1, 49)), "event_type").withColumn("acf", F.col("acf"))
    w = Window.partitionBy("event_type").orderBy("lag")
    a = a.withColumn("x", F.lag("acf").over(w)).withColumn("y", F.lead("acf").over(w)).filter("acf > x AND acf > y AND acf > 0.02")
    return a.select("event_type", F.col("lag").cast("long").alias("period"), F.round("acf", 6).alias("acf"))


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 2")
def previous_versions(spark, sf_dir):
    """The last but one of each key."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return top(e, 2, F.desc("ts"), F.desc("event_id"), by=("user_id",)).filter("rank = 2").drop("rank")


@query("WITH v AS (SELECT user_id, event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15') SELECT user_id, count(*) AS versions, min(ts) AS first, max(ts) AS last FROM v GROUP BY 1")
def versions_since(spark, sf_dir):
    """Versions before a date go; what is left of each key."""
    v = table(spark, sf_dir, "events").filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz"))
    return v.groupBy("user_id").agg(F.count(F.lit(1)).alias("versions"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events QUALIFY sequence >= 20")
def replay_from(spark, sf_dir):
    """Each partition's events in order, from a sequence number on."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(order).alias("sequence")).filter("sequence >= 20")


_TIER = "CASE WHEN n = 0 THEN 'inactive' WHEN n <= 5 THEN 'low' WHEN n <= 20 THEN 'moderate' WHEN n <= 50 THEN 'high' ELSE 'very_high' END"


@query(f"""WITH d AS (SELECT max(ts) - INTERVAL 240 HOUR AS since FROM events), u AS (SELECT user_id, count(*) AS events, count(DISTINCT hour(ts)) AS hours, count(*) FILTER (ts >= since) AS n, count(DISTINCT event_type) AS kinds FROM events, d GROUP BY 1) SELECT user_id, events, hours, kinds, {_TIER} AS tier FROM u""")
def user_profiles(spark, sf_dir):
    """How much, when and in how many ways a user acts, and the tier of the last ten days."""
    e = table(spark, sf_dir, "events")
    since = F.broadcast(e.agg((F.max("ts") - F.expr("interval '240' hour")).alias("since")))  # one row
    u = e.join(since).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.count_distinct(F.hour("ts")).alias("hours"), F.count_if(F.col("ts") >= F.col("since")).alias("n"), F.count_distinct("event_type").alias("kinds"))
    return u.select("user_id", "events", "hours", "kinds", F.expr(_TIER).alias("tier"))


# profiles


@query("SELECT " + ", ".join(f"round(corr({a}, {b}), 9) AS {a}__{b}" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_tax"))) + " FROM lineitem")
def correlations(spark, sf_dir):
    pairs = (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_tax"))
    return table(spark, sf_dir, "lineitem").agg(*(F.round(F.corr(a, b), 9).alias(f"{a}__{b}") for a, b in pairs))


@query(" UNION ALL ".join(f"(SELECT '{c}' AS name, {c}::VARCHAR AS value, count(*) AS n FROM orders GROUP BY 2 ORDER BY n DESC, value LIMIT 10)" for c in ("o_orderstatus", "o_orderpriority")))
def top_values_by_column(spark, sf_dir):
    """The ten commonest values of each column that is no number, counted in one pass."""
    o = table(spark, sf_dir, "orders").select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("o_orderstatus", "o_orderpriority")))).alias("v")).select("v.*")
    return top(o.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")), 10, F.desc("n"), F.asc("value"), by=("name",)).drop("rank")


@query("""WITH m AS (SELECT p_size AS x, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, x LIMIT 1) SELECT min(p_size) AS least, max(p_size) AS most, round(avg(p_size), 9) AS mean, round(stddev_pop(p_size), 9) AS deviation, median(p_size)::DOUBLE AS median, (SELECT x FROM m) AS mode FROM part""")
def column_statistics(spark, sf_dir):
    """Least, most, mean, deviation, median and the commonest value of a column of numbers."""
    p = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n"))  # one row a value
    s = table(spark, sf_dir, "part").agg(F.min("p_size").alias("least"), F.max("p_size").alias("most"), F.round(F.avg("p_size"), 9).alias("mean"), F.round(F.stddev_pop("p_size"), 9).alias("deviation"), F.percentile("p_size", 0.5).alias("median"))
    return s.join(F.broadcast(p.agg(F.min_by("p_size", F.struct(-F.col("n"), F.col("p_size"))).alias("mode"))))


@query("WITH s AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r, count(*) OVER () AS n FROM orders) SELECT " + ", ".join(f"max(x) FILTER (r = ceil({p} / 100.0::DOUBLE * n)) AS p{str(p).replace('.', '_')}" for p in (50, 95, 99, 99.9)) + " FROM s")
def nearest_rank_percentiles(spark, sf_dir):
    """The element at the place p / 100 * n, rounded up."""
    run = A.running_counts(table(spark, sf_dir, "orders"), "o_totalprice")
    return run.agg(*(F.min(F.when(F.col("upto") >= F.ceil(p / 100 * F.col("n")), F.col("x"))).alias(f"p{str(p).replace('.', '_')}") for p in (50, 95, 99, 99.9)))


@query("WITH t AS (SELECT o_custkey AS k, o_totalprice AS x FROM orders WHERE o_orderstatus = 'O') SELECT k, count(*) AS n, round(sum(coalesce(x, 0)), 4) AS total FROM t WHERE x IS NOT NULL GROUP BY 1 ORDER BY total DESC, k LIMIT 50")
def dataframe_operations(spark, sf_dir):
    """Filter, drop and fill of nulls, group and sort, as a list of operations."""
    df = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("x"), "o_orderstatus")
    for name, arg in (("filter", "o_orderstatus = 'O'"), ("drop_na", ["x"]), ("fill_na", {"x": 0.0}), ("group_by", "k"), ("sort", [F.desc("total"), F.asc("k")])):
        df = {"filter": lambda d, a: d.filter(a), "drop_na": lambda d, a: d.dropna(subset=a), "fill_na": lambda d, a: d.fillna(a), "sort": lambda d, a: d.orderBy(*a),
              "group_by": lambda d, a: d.groupBy(a).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("total"))}[name](df, arg)
    return df.limit(50)


# texts and summaries


@query(f"""WITH {MEMORIES}, l AS (SELECT key, list_distinct(list_concat(list_filter(list_transform(regexp_split_to_array(value, '[.!?]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: strlen(s) > 10), list_filter(list_transform(string_split(value, chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: strlen(s) > 15))) AS s FROM mem)
SELECT key, len(s) AS sentences, coalesce(list_sum(list_transform(s, lambda x: strlen(x)))::BIGINT, 0) AS bytes FROM l""")
def sentences_and_lines(spark, sf_dir):
    """Pieces between full stops, and lines of over fifteen bytes."""
    trim = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    lines = F.filter(F.transform(F.split("value", "\n"), trim), lambda s: F.octet_length(s) > 15)
    s = spread(memories(spark, sf_dir)).select("key", F.array_distinct(F.concat(T.long_sentences(F.col("value")), lines)).alias("s"))
    return s.select("key", F.size("s").alias("sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x)).alias("bytes"))


@query("SELECT page_id, len(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1)) AS headings, coalesce(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1)[1], '') AS first FROM pages")
def page_headings(spark, sf_dir):
    """Headings of web pages."""
    h = F.regexp_extract_all("html", F.lit("<h[1-6][^>]*>([^<]*)</h[1-6]>"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(h).alias("headings"), F.coalesce(F.get(h, F.lit(0)), F.lit("")).alias("first"))


for _way, _order, _sqlo in (("chronological", lambda: [F.asc("created_at"), F.asc("key")], "created_at, key"), ("by_importance", lambda: [F.desc("importance"), F.asc("key")], "importance DESC, key")):

    def _summary(spark, sf_dir, order=_order):
        m = memories(spark, sf_dir).select("key", F.get("tags", F.lit(0)).alias("lang"), "created_at", "importance", F.left("value", F.lit(60)).alias("head"))
        return top(m, 5, *order(), by=("lang",)).select("lang", "rank", "key", "head")

    _summary.__name__ = f"summary_{_way}"
    query(f"WITH {MEMORIES} SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY {_sqlo}) AS rank, key, left(value, 60) AS head FROM mem QUALIFY rank <= 5")(_summary)


@query(f"""WITH {MEMORIES}, x AS (SELECT CASE WHEN contains(value, '```') OR contains(value, 'function') OR contains(value, 'class ') THEN 'code' WHEN contains(value, 'http') OR contains(value, 'www.') THEN 'web_content' WHEN len(string_split(value, chr(10))) > 10 AND strlen(value) > 1000 THEN 'document'
 WHEN len(list_filter(regexp_split_to_array(value, '\\s+'), lambda w: w <> '')) < 10 THEN 'note' ELSE 'text' END AS kind, created_at FROM mem) SELECT kind, count(*) AS n, count(*) FILTER (created_at >= TIMESTAMP '2024-11-01' AND created_at < TIMESTAMP '2024-12-01') AS last, count(*) FILTER (created_at >= TIMESTAMP '2024-10-02' AND created_at < TIMESTAMP '2024-11-01') AS before FROM x GROUP BY 1""")
def content_type_growth(spark, sf_dir):
    """How many of each kind, in the last thirty days and in those before."""
    t = lambda d: F.lit(d).cast("timestamp_ntz")
    m = spread(memories(spark, sf_dir)).select(T.content_type(F.col("value")).alias("kind"), "created_at")
    within = lambda a, b: F.count_if((F.col("created_at") >= t(a)) & (F.col("created_at") < t(b)))
    return m.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), within("2024-11-01", "2024-12-01").alias("last"), within("2024-10-02", "2024-11-01").alias("before"))


# retention


@query(f"""WITH {MEMORIES}, x AS (SELECT key, row_number() OVER (ORDER BY created_at DESC, key) AS newest, row_number() OVER (ORDER BY importance DESC, key) AS weightiest, created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 300 DAY AS young FROM mem) SELECT 'recent' AS policy, count(*) FILTER (newest <= 100) AS kept FROM x UNION ALL SELECT 'age', count(*) FILTER (young) FROM x UNION ALL SELECT 'importance', count(*) FILTER (weightiest <= 100) FROM x""")
def retention_policies(spark, sf_dir):
    """What three policies keep: the newest hundred, those under an age, the weightiest hundred."""
    m = memories(spark, sf_dir)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(name).alias("policy"), "kept")
    young = F.col("created_at") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval '300' day")
    return n(m.orderBy(F.desc("created_at"), "key").limit(100), "recent").unionByName(n(m.filter(young), "age")).unionByName(n(m.orderBy(F.desc("importance"), "key").limit(100), "importance"))


@query(f"""WITH {MEMORIES}, x AS (SELECT key, memory_type, greatest(0.001, least(0.999, exp(-ln(2) * {_IDLE} / (24 * (1 + 2 * importance))))) AS s FROM mem) SELECT key, CASE WHEN s >= 0.05 THEN 'keep' WHEN memory_type = 'LongTerm' THEN 'demote' ELSE 'evict' END AS decision FROM x""")
def forgetting_pass(spark, sf_dir):
    """What falls under the floor: long-term memories become short-term, short-term ones go."""
    m = memories(spark, sf_dir)
    s = D.ebbinghaus(hours_since("last_accessed"), F.col("importance"), F.lit(0.0), F.lit(0.0))
    return m.select("key", F.when(s >= 0.05, "keep").when(F.col("memory_type") == "LongTerm", "demote").otherwise("evict").alias("decision"))


@query(f"WITH {MEMORIES} SELECT key, CASE WHEN memory_type = 'ShortTerm' AND (access_count >= 12 OR importance >= 0.8) THEN 'LongTerm' ELSE memory_type END AS memory_type FROM mem")
def promoted_memories(spark, sf_dir):
    """The table after promotion."""
    up = (F.col("memory_type") == "ShortTerm") & ((F.col("access_count") >= 12) | (F.col("importance") >= 0.8))
    return memories(spark, sf_dir).select("key", F.when(up, "LongTerm").otherwise(F.col("memory_type")).alias("memory_type"))


@query(f"WITH {MEMORIES}, r AS (SELECT key, importance, row_number() OVER (ORDER BY importance DESC, key) AS i FROM mem QUALIFY i <= 40) SELECT key, round(1 - (i - 1) / 40e0, 9) AS ranking_score FROM r")
def ranking_scores(spark, sf_dir):
    """A place in the order as a score: 1 for the first, and a fortieth less for each after."""
    m = memories(spark, sf_dir).select("key", "importance", F.lit(0).alias("q"))
    r = top(m, 40, F.desc("importance"), F.asc("key"), by=("q",))
    return r.select("key", F.round(1 - (F.col("rank") - 1) / 40, 9).alias("ranking_score"))


@query(f"""WITH {MEMORIES}, {EDGES}, r AS (SELECT key FROM mem WHERE importance > 0.7) SELECT r.key FROM r JOIN mem USING (key) WHERE created_at <= TIMESTAMP '2024-06-01' AND TIMESTAMP '2024-06-01' < last_modified + INTERVAL 60 DAY""")
def recall_as_of(spark, sf_dir):
    """Results as they stood at a time: made by then, and not replaced before."""
    t = F.lit("2024-06-01").cast("timestamp_ntz")
    m = memories(spark, sf_dir).filter("importance > 0.7")
    return m.filter((F.col("created_at") <= t) & (t < F.col("last_modified") + F.expr("interval '60' day"))).select("key")


@query(f"""WITH {MEMORIES}, t AS (SELECT key, lang, CASE WHEN importance >= 0.6 THEN 0 WHEN importance >= 0.3 THEN 1 ELSE 2 END AS part, ceil(strlen(value) / 4::DOUBLE)::BIGINT AS n, created_at FROM mem), r AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY part, created_at DESC, key ROWS UNBOUNDED PRECEDING) AS upto FROM t)
SELECT lang, part, count(*) AS kept, sum(n)::BIGINT AS tokens FROM r WHERE upto <= 20000 GROUP BY 1, 2""")
def context_parts(spark, sf_dir):
    """Core, related and temporal rows within a budget: the last of the last part go first."""
    m = memories(spark, sf_dir).select("key", F.get("tags", F.lit(0)).alias("lang"), F.when(F.col("importance") >= 0.6, 0).when(F.col("importance") >= 0.3, 1).otherwise(2).alias("part"), F.ceil(F.octet_length("value") / 4).alias("n"), "created_at")
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("part", F.desc("created_at"), "key").rowsBetween(Window.unboundedPreceding, 0))
    return m.withColumn("upto", upto).filter("upto <= 20000").groupBy("lang", "part").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("tokens"))


@query(f"WITH {MEMORIES} SELECT count(*) AS entries, sum(strlen(key) + strlen(value))::BIGINT AS bytes, round(avg(strlen(value)), 6) AS mean_bytes, bool_or(key = '7') AS has_seven, count(DISTINCT key) AS keys FROM mem")
def store_summary(spark, sf_dir):
    """What a store says of itself."""
    size = F.octet_length("value")
    return memories(spark, sf_dir).agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("key") + size).alias("bytes"), F.round(F.avg(size), 6).alias("mean_bytes"), F.bool_or(F.col("key") == "7").alias("has_seven"), F.count_distinct("key").alias("keys"))


@query("SELECT n_nationkey AS k, '- n_nationkey: ' || n_nationkey || chr(10) || '  n_name: \"' || n_name || '\"' AS yaml FROM nation")
def yaml_rows(spark, sf_dir):
    """Rows as YAML: texts are quoted."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("- n_nationkey: "), F.col("n_nationkey").cast("string"), F.lit("\n  n_name: "), F.to_json(F.array("n_name")).substr(F.lit(2), F.length(F.to_json(F.array("n_name"))) - 2)).alias("yaml"))


_sql_words = "SELECT c_custkey, c_custkey % 7 AS m, power(c_custkey % 5, 2) AS p, c_name LIKE '%1' AS l, {} AS r, contains(c_name, '00') AS c, +c_custkey AS pos, c_custkey BETWEEN 5 AND 50 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AS b, EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 2) AS e FROM customer"


@query(_sql_words.format("regexp_matches(c_name, '#0+[1-5]')"))
def sql_more_operators(spark, sf_dir):
    """Powers, patterns, membership and subqueries in statements."""
    for t in ("customer", "nation"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(_sql_words.format("c_name RLIKE '#0+[1-5]'"))
