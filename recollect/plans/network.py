"""Queries of graphs."""
from pyspark.sql import functions as F

from recollect.operators import graph as G
from recollect.operators.components import connected_components
from recollect.plans.registry import query
from recollect.sources.tables import EDGES, MEMORIES, edges, memories, table, vectors

_BOTH = "both_ AS (SELECT src AS node, dst AS other, * FROM edges UNION ALL SELECT dst, src, * FROM edges)"


@query(f"WITH {EDGES}, {_BOTH} SELECT DISTINCT node, other FROM both_ WHERE node IN ('n:1', 'c:1', 'r:0')")
def graph_neighbors(spark, sf_dir):
    return G.neighbors(edges(spark, sf_dir), ["n:1", "c:1", "r:0"])


@query(f"WITH {EDGES} SELECT DISTINCT src AS node, dst AS other FROM edges WHERE rel_type = 'related_to' AND strength >= 0.5 AND confidence >= 0.7")
def graph_neighbors_filtered(spark, sf_dir):
    return G.neighbors(edges(spark, sf_dir), None, "out", "related_to", 0.5, 0.7)


@query(f"WITH {EDGES}, {_BOTH} SELECT node, other, rel_type, strength FROM both_ WHERE node IN ('c:1', 'c:2', 'c:3', 'n:1') AND (valid_from IS NULL OR valid_from <= TIMESTAMP '1997-01-01') AND (valid_to IS NULL OR TIMESTAMP '1997-01-01' < valid_to)")
def neighbors_as_of(spark, sf_dir):
    return G.neighbors_as_of(edges(spark, sf_dir), ["c:1", "c:2", "c:3", "n:1"], F.lit("1997-01-01").cast("timestamp_ntz"))


_BFS = f"""WITH RECURSIVE {EDGES}, l AS (SELECT DISTINCT src AS node, dst AS other FROM edges UNION SELECT dst, src FROM edges),
w(seed, node, hops, path) AS (SELECT s, s, 0, s FROM (VALUES ('c:1'), ('s:2')) v(s) UNION SELECT seed, l.other, hops + 1, path || '>' || l.other FROM w JOIN l ON l.node = w.node
  WHERE hops < 3 AND NOT list_contains(string_split(path, '>'), l.other)),
b AS (SELECT seed, node, min(hops) AS hops FROM w GROUP BY 1, 2), f AS (SELECT seed, node, hops, min(path) AS path FROM w JOIN b USING (seed, node, hops) GROUP BY 1, 2, 3)"""


@query(f"{_BFS} SELECT seed, node, hops, path FROM f")
def graph_bfs(spark, sf_dir):
    return G.bfs(edges(spark, sf_dir), ["c:1", "s:2"], 3)


@query(f"{_BFS} SELECT seed AS source, node AS target, hops, hops + 1 AS length, path FROM f WHERE (seed, node) IN (('c:1', 'r:0'), ('c:1', 'r:1'), ('c:1', 'r:2'), ('c:1', 'r:3'), ('c:1', 'r:4'), ('s:2', 'c:7'), ('s:2', 'r:2'))")
def graph_shortest_path(spark, sf_dir):
    return G.shortest_paths(edges(spark, sf_dir), [*(("c:1", f"r:{i}") for i in range(5)), ("s:2", "c:7"), ("s:2", "r:2")], 3)


@query(f"""WITH {EDGES}, {_BOTH}, d AS (SELECT node, count(*) AS d FROM both_ GROUP BY 1), s AS (SELECT count(*) AS nodes, (sum(d) / 2)::BIGINT AS edges, max(d) AS max_degree FROM d)
SELECT nodes, edges, 2 * edges / nodes::DOUBLE AS avg_degree, edges / (nodes * (nodes - 1) / 2::DOUBLE) AS density, max_degree, (SELECT node FROM d ORDER BY d DESC, node LIMIT 1) AS hub FROM s""")
def graph_statistics(spark, sf_dir):
    return G.graph_stats(edges(spark, sf_dir))


@query(f"""WITH {EDGES}, e AS (SELECT * FROM edges WHERE rel_type = 'part_of') SELECT a.src, b.dst, max(a.confidence * b.confidence * 0.8e0) AS confidence FROM e a JOIN e b ON a.dst = b.src
WHERE a.src <> b.dst AND a.confidence * b.confidence * 0.8 >= 0.6 AND (a.src, b.dst) NOT IN (SELECT (src, dst) FROM e) GROUP BY 1, 2""")
def infer_transitive(spark, sf_dir):
    return G.infer_transitive(edges(spark, sf_dir), "part_of")


@query(f"""WITH {EDGES}, e AS (SELECT * FROM edges WHERE rel_type = 'related_to') SELECT dst AS src, src AS dst, max(confidence * 0.9e0) AS confidence FROM e WHERE confidence * 0.9e0 >= 0.6 AND (dst, src) NOT IN (SELECT (src, dst) FROM e) GROUP BY 1, 2""")
def infer_symmetric(spark, sf_dir):
    return G.infer_symmetric(edges(spark, sf_dir), "related_to")


@query(f"WITH {EDGES} SELECT dst AS src, src AS dst, max(confidence) AS confidence FROM edges WHERE rel_type = 'part_of' AND confidence >= 0.6 GROUP BY 1, 2")
def infer_inverse(spark, sf_dir):
    return G.infer_inverse(edges(spark, sf_dir), "part_of", "contains")


@query(f"""WITH {MEMORIES}, n AS (SELECT key, epoch(created_at)::BIGINT AS s FROM mem) SELECT a.key AS a, b.key AS b, round((1 - floor(abs(a.s - b.s) / 60) / 60e0) * 0.7e0, 9) AS confidence FROM n a JOIN n b ON a.key < b.key AND abs(a.s - b.s) <= 3600""")
def infer_temporal(spark, sf_dir):
    return G.near_in_time(memories(spark, sf_dir).select("key", F.col("created_at").alias("at")), 1.0)


_PAIRS = "p AS (SELECT least(a.k, b.k) AS a, greatest(a.k, b.k) AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.k < b.k)"
_V = "v AS (SELECT vec_id::VARCHAR AS k, embedding::DOUBLE[] AS e, label FROM embeddings)"


@query(f"WITH {_V}, {_PAIRS} SELECT a, b, round(s, 9) AS similarity FROM p WHERE s >= 0.4")
def similarity_edges(spark, sf_dir):
    p = G.similar_pairs(vectors(spark, sf_dir).select("key", "embedding"), 0.4)
    return p.select("a", "b", F.round("similarity", 9).alias("similarity"))


@query(f"""WITH RECURSIVE {_V}, {_PAIRS}, l AS (SELECT a, b FROM p WHERE s >= 0.4 UNION SELECT b, a FROM p WHERE s >= 0.4), r(a, b) AS (SELECT k, k FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT a AS key, min(b) AS component FROM r GROUP BY a""")
def similarity_components(spark, sf_dir):
    v = vectors(spark, sf_dir).select("key", "embedding")
    c = connected_components(G.similar_links(v, 0.4).filter("v IS NOT NULL").select("u", "v"))
    return v.select("key").join(c.withColumnRenamed("id", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("component"))


@query(f"""WITH {EDGES}, {_BOTH}, s1 AS (SELECT other AS node, max(round(1.0e0 * strength * 0.8e0, 12)) AS score FROM both_ WHERE node = 'n:3' GROUP BY 1), t1 AS (SELECT * FROM s1 WHERE node <> 'n:3' ORDER BY score DESC, node LIMIT 16),
s2 AS (SELECT other AS node, max(round(score * strength * 0.8e0, 12)) AS score FROM t1 JOIN both_ USING (node) WHERE other <> 'n:3' GROUP BY 1), u AS (SELECT node, score, 1 AS hops FROM s1 WHERE node <> 'n:3' UNION ALL SELECT node, score, 2 FROM s2)
SELECT node, max(score) AS score, arg_max(hops, score * 10 - hops / 1e6) AS hops FROM u GROUP BY node ORDER BY score DESC, node LIMIT 32""")
def multihop_expansion(spark, sf_dir):
    return G.expand_seeds(edges(spark, sf_dir), [("n:3", 1.0)])


@query(f"""WITH {EDGES}, {_BOTH} SELECT node, count(*) AS degree, round(avg(strength), 9) AS avg_strength, count(DISTINCT rel_type) AS type_diversity, round(count(*) / max(count(*)) OVER (), 9) AS degree_centrality FROM both_ GROUP BY node""")
def graph_centrality(spark, sf_dir):
    d = G.undirected(edges(spark, sf_dir)).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.round(F.avg("strength"), 9).alias("avg_strength"), F.count_distinct("rel_type").alias("type_diversity"))
    most = d.agg(F.max("degree").alias("most"))
    return d.join(F.broadcast(most)).select("node", "degree", "avg_strength", "type_diversity", F.round(F.col("degree") / F.col("most"), 9).alias("degree_centrality"))


@query("""SELECT o_custkey, o_orderkey, round(pow(0.8e0, 2) * 0.7e0 * 0.9e0, 9) AS strength FROM orders""")
def relationship_strength(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_custkey", "o_orderkey", F.round(G.relationship_strength(F.array(F.lit("related_to"), F.lit("part_of")), F.lit(2)), 9).alias("strength"))


@query(f"""WITH {EDGES} SELECT src, rel_type, dst, NOT ((valid_from IS NULL OR valid_from <= TIMESTAMP '1997-01-01') AND (valid_to IS NULL OR TIMESTAMP '1997-01-01' < valid_to)) AS superseded FROM edges""")
def relations_for_entity(spark, sf_dir):
    t = F.lit("1997-01-01").cast("timestamp_ntz")
    return edges(spark, sf_dir).select("src", "rel_type", "dst", (~G.valid_at(t)).alias("superseded"))


@query(f"WITH {EDGES} SELECT '  \"' || src || '\" -> \"' || dst || '\" [label=\"' || rel_type || '\"];' AS line FROM edges")
def graph_dot_lines(spark, sf_dir):
    return edges(spark, sf_dir).select(F.format_string('  "%s" -> "%s" [label="%s"];', "src", "dst", "rel_type").alias("line"))


@query(f"""WITH {EDGES} SELECT '<edge source="' || src || '" target="' || dst || '"><data key="type">' || rel_type || '</data></edge>' AS line FROM edges""")
def graph_xml_lines(spark, sf_dir):
    return edges(spark, sf_dir).select(F.format_string('<edge source="%s" target="%s"><data key="type">%s</data></edge>', "src", "dst", "rel_type").alias("line"))
