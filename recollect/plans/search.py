"""Queries of retrieval and of column functions over texts, vectors and ages."""
from datetime import datetime

from pyspark.sql import functions as F

from recollect.functions import decay as D
from recollect.functions import text as T
from recollect.functions import vectors as V
from recollect.functions.facts import split_multi_part
from recollect.operators import retrieval as R
from recollect.plans.registry import query
from recollect.sources.tables import AS_OF, MEMORIES, MEMORY_LINKS, QUERIES, hours_since, hours_sql, memories, memory_links, spread, table, vectors

_QS = "qs(query_id, query) AS (VALUES " + ", ".join(f"('{i}', '{q}')" for i, q in QUERIES) + ")"
_OCC = "CASE WHEN length(t) = 0 THEN 0 ELSE (length(v) - length(replace(v, t, ''))) // length(t) END"
_MATCH = f"""{_QS}, {MEMORIES},
hit AS (SELECT query_id, key, value, lower(value) AS v, list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda t: t <> '') AS ts FROM mem, qs),
fr AS (SELECT query_id, key, value, v, list_transform(ts, lambda t: {_OCC}) AS f FROM hit),
m AS (SELECT query_id, key, value, len(list_filter(f, lambda x: x > 0)) AS distinct_terms, list_sum(f)::BIGINT AS total_freq, list_sum(f) / strlen(v)::DOUBLE AS score FROM fr WHERE len(list_filter(f, lambda x: x > 0)) > 0),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distinct_terms DESC, total_freq DESC, key) AS rank FROM m)"""


@query(f"WITH {_MATCH} SELECT query_id, key, distinct_terms, total_freq, score, rank FROM top WHERE rank <= 20")
def keyword_match(spark, sf_dir):
    return R.match_any_term(spread(memories(spark, sf_dir)), QUERIES, 20).select("query_id", "key", "distinct_terms", "total_freq", "score", "rank")


#: Phrases that some texts hold as they stand.
_PHRASES = [("p1", "Apache License"), ("p2", "licensed under"), ("p3", "of the"), ("p4", "keit der"), ("p5", "zzzz nothing")]


@query(f"""WITH ph(query_id, query) AS (VALUES {", ".join(f"('{i}', '{q}')" for i, q in _PHRASES)}), {MEMORIES}, h AS (SELECT query_id, key, lower(value) AS v, list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda t: t <> '') AS ts FROM mem, ph WHERE contains(lower(value), lower(query))),
m AS (SELECT query_id, key, v, list_sum(list_transform(ts, lambda t: {_OCC}))::BIGINT AS total_freq FROM h), r AS (SELECT query_id, key, total_freq, total_freq / strlen(v)::DOUBLE AS score FROM m)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM r QUALIFY rank <= 20""")
def phrase_match(spark, sf_dir):
    return R.match_phrase(spread(memories(spark, sf_dir)), _PHRASES, 20).select("query_id", "key", "total_freq", "score", "rank")


_BM25 = f"""{_MATCH}, c AS (SELECT query_id, key, list_filter(regexp_split_to_array(lower(value), '\\s+'), lambda t: t <> '') AS w FROM top WHERE rank <= 100),
st AS (SELECT query_id, count(*) AS n, avg(len(w)) AS a FROM c GROUP BY query_id),
tm AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda t: t <> ''))) AS t FROM qs),
tf AS (SELECT c.query_id, key, t, len(w) AS l, len(list_filter(w, lambda x: x = t)) AS tf FROM c JOIN tm USING (query_id)),
df AS (SELECT query_id, t, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY 1, 2),
s AS (SELECT query_id, key, sum(ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * l / a)))) AS s FROM tf JOIN df USING (query_id, t) JOIN st USING (query_id) GROUP BY 1, 2),
bm AS (SELECT query_id, key, s / (s + 1) AS bm25 FROM s)"""


@query(f"WITH {_BM25} SELECT query_id, key, round(bm25, 9) AS bm25 FROM bm")
def bm25_signal(spark, sf_dir):
    c = R.match_any_term(spread(memories(spark, sf_dir)), QUERIES, 100).select("query_id", "key", "value")
    return R.bm25(c, QUERIES).select("query_id", "key", F.round("bm25", 9).alias("bm25"))


@query(f"""WITH {_QS}, {MEMORIES}, w AS (SELECT key, list_filter(regexp_split_to_array(lower(value), '\\s+'), lambda t: t <> '') AS w FROM mem), st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w),
tm AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda t: t <> '')) AS t FROM qs), tf AS (SELECT key, t, len(w) AS l, len(list_filter(w, lambda x: x = t)) AS tf FROM w, (SELECT DISTINCT t FROM tm)),
df AS (SELECT t, count(*) AS df FROM tf WHERE tf > 0 GROUP BY 1), s AS (SELECT query_id, key, round(sum(ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * l / a))), 9) AS score FROM tf JOIN df USING (t) JOIN tm USING (t), st WHERE tf > 0 GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM s QUALIFY rank <= 50""")
def bm25_store(spark, sf_dir):
    """The fifty best of the whole store for each question."""
    return R.bm25_store(spread(memories(spark, sf_dir)), QUERIES, 50)


_PAGED = [("s1", "Apache license the"), ("s2", "the token the"), ("s3", "der die und"), ("s4", "zzzz nothing")]


@query(f"""WITH {MEMORIES}, {MEMORY_LINKS}, qs(query_id, query) AS (VALUES {", ".join(f"('{i}', '{q}')" for i, q in _PAGED)}), a AS (SELECT query_id, unnest(string_split(lower(query), ' ')) AS word FROM qs),
w AS (SELECT DISTINCT key, importance, unnest(list_filter(regexp_split_to_array(lower(value), '\\s+'), lambda t: t <> '')) AS word FROM mem WHERE importance >= 0.2 AND memory_type = 'ShortTerm'),
s AS (SELECT query_id, key, any_value(importance) AS importance, round(count(*) / (SELECT count(*) FROM a x WHERE x.query_id = a.query_id)::DOUBLE, 9) AS relevance FROM w JOIN a USING (word) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, importance DESC, key) AS rank FROM s WHERE relevance >= 0.5),
n AS (SELECT node AS key, count(DISTINCT other) AS related FROM (SELECT src AS node, dst AS other FROM links UNION ALL SELECT dst, src FROM links) GROUP BY 1)
SELECT query_id, rank, key, relevance, coalesce(related, 0) AS related FROM r LEFT JOIN n USING (key) WHERE rank BETWEEN 6 AND 25""")
def search_pages(spark, sf_dir):
    """Words, filters, a least relevance, an order and a page in one call, for several queries at once."""
    where = (F.col("importance") >= 0.2) & (F.col("memory_type") == "ShortTerm")
    return R.search_pages(spread(memories(spark, sf_dir)), _PAGED, where, 0.5, [F.desc("relevance"), F.desc("importance")], 5, 20, memory_links(spark, sf_dir))


@query()
def search_pages_fuzzy(spark, sf_dir):
    """The same with words that are merely alike, from a similarity of 0.8."""
    return R.search_pages(spread(memories(spark, sf_dir)), [("s1", "Apache licence"), ("s2", "tokens pasword")], F.lit(True), 0.3, [F.desc("relevance"), F.desc("importance")], 0, 20, alike=0.8)


#: Questions of several parts, and of a time, besides the plain queries; and the rows whose vectors stand for theirs.
_QUESTIONS = [*QUERIES, ("q6", "which license and what version"), ("q7", "spring 2024 token")]
_QV = {"q1": "1", "q2": "2", "q3": "3", "q4": "4", "q6": "6", "q7": "7"}
_PARTS = [(f"{i}/{n}", part) for i, q in _QUESTIONS for n, part in enumerate(split_multi_part(q))]
_TOK = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_AGE = hours_sql("created_at")
_TYPE = "CASE {0} WHEN 'part_of' THEN 0.9e0 WHEN 'references' THEN 0.6e0 ELSE 0.5e0 END"
_STORE = f"""{MEMORIES}, {MEMORY_LINKS}, vec AS (SELECT vec_id::VARCHAR AS key, embedding::DOUBLE[] AS e FROM embeddings),
both_ AS (SELECT src AS node, dst AS other, rel_type FROM links UNION ALL SELECT dst, src, rel_type FROM links),
qv AS (SELECT q AS qid, e FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _QV.items())}) v(q, k) JOIN vec ON key = k)"""


def _signals_sql(p: str, qs: str) -> str:
    """CTEs {p}sig (query_id, signal, key, score) for the questions in qs(query_id, query); the part of an id before '/' names its vector."""
    return f"""{p}hit AS (SELECT query_id, key, value, lower(value) AS v, list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda t: t <> '') AS ts FROM mem, {qs}),
{p}fr AS (SELECT query_id, key, value, v, list_transform(ts, lambda t: {_OCC}) AS f FROM {p}hit),
{p}m AS (SELECT query_id, key, value, len(list_filter(f, lambda x: x > 0)) AS distinct_terms, list_sum(f)::BIGINT AS total_freq, list_sum(f) / strlen(v)::DOUBLE AS score FROM {p}fr WHERE len(list_filter(f, lambda x: x > 0)) > 0),
{p}c AS MATERIALIZED (SELECT query_id, key, score, list_filter(regexp_split_to_array(lower(value), '\\s+'), lambda t: t <> '') AS w FROM {p}m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distinct_terms DESC, total_freq DESC, key) <= 100),
{p}st AS (SELECT query_id, count(*) AS n, avg(len(w)) AS a FROM {p}c GROUP BY query_id),
{p}tm AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda t: t <> ''))) AS t FROM {qs}),
{p}tf AS (SELECT c.query_id, key, t, len(w) AS l, len(list_filter(w, lambda x: x = t)) AS tf FROM {p}c c JOIN {p}tm USING (query_id)),
{p}df AS (SELECT query_id, t, count(*) FILTER (tf > 0) AS df FROM {p}tf GROUP BY 1, 2),
{p}s AS (SELECT query_id, key, sum(ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * (tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * l / a)))) AS s FROM {p}tf JOIN {p}df USING (query_id, t) JOIN {p}st USING (query_id) GROUP BY 1, 2),
{p}one AS (SELECT DISTINCT c.key, other, {_TYPE.format("rel_type")} AS w FROM {p}c c JOIN both_ ON node = c.key),
{p}two AS (SELECT key, other, 1 AS hops, 0.8e0 * w AS x FROM {p}one UNION ALL SELECT key, b.other, 2, 0.8e0 * 0.8e0 * w * {_TYPE.format("b.rel_type")} FROM {p}one o JOIN both_ b ON b.node = o.other WHERE b.other <> key),
{p}near AS (SELECT key, other, round(max(x) FILTER (hops = h), 12) AS strength FROM (SELECT *, min(hops) OVER (PARTITION BY key, other) AS h FROM {p}two WHERE key <> other) GROUP BY 1, 2),
{p}g AS (SELECT query_id, c.key, round(coalesce(least(1, score + least(n / 10::DOUBLE, 0.5e0) + 0.3e0 * a), score), 12) AS score FROM {p}c c LEFT JOIN (SELECT key, count(*) AS n, avg(strength) AS a FROM {p}near GROUP BY key) USING (key)),
{p}seed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS nth FROM {p}g QUALIFY nth <= 5),
{p}led AS (SELECT query_id, other AS key, arg_min(round(score * least(1, strength), 12), nth) AS score FROM {p}seed JOIN {p}near USING (key) WHERE (query_id, other) NOT IN (SELECT (query_id, key) FROM {p}c) GROUP BY 1, 2),
{p}old AS (SELECT key, round(0.6e0 * exp(-floor({_AGE} / 24) / 30) + 0.4e0 * (access_count / (access_count + 10e0)), 12) AS score FROM mem ORDER BY score DESC, key LIMIT 50),
{p}every AS (SELECT query_id, 'keyword' AS signal, key, round(s / (s + 1), 12) AS score FROM {p}s UNION ALL SELECT query_id, 'graph', key, score FROM {p}g UNION ALL SELECT query_id, 'graph', key, score FROM {p}led
  UNION ALL SELECT query_id, 'temporal', key, score FROM {p}old, {qs}
  UNION ALL SELECT * FROM (SELECT q.query_id, 'dense', vec.key, round(list_cosine_similarity(vec.e, qv.e), 12) AS score FROM {qs} q JOIN qv ON qv.qid = split_part(q.query_id, '/', 1), vec) WHERE score >= 0.3),
{p}sig AS MATERIALIZED (SELECT query_id, signal, key, score FROM {p}every QUALIFY row_number() OVER (PARTITION BY query_id, signal ORDER BY score DESC, key) <= 50)"""


_WEIGHT = "CASE signal WHEN 'keyword' THEN 0.3 WHEN 'temporal' THEN 0.1 WHEN 'graph' THEN 0.2 ELSE 0.4 END::DOUBLE"


def _fused_sql(p: str, qs: str) -> str:
    """As _signals_sql, and {p}fz (query_id, key, fused, weighted)."""
    return f"""{_signals_sql(p, qs)},
{p}rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, signal ORDER BY score DESC, key) AS r FROM {p}sig WHERE score >= 0.1),
{p}fz AS (SELECT query_id, key, round(sum(w / (60 + r)), 12) AS fused, round(sum(w * score), 12) AS weighted FROM (SELECT *, {_WEIGHT} AS w FROM {p}rk) GROUP BY 1, 2)"""


def _signals(spark, sf_dir):
    v = vectors(spark, sf_dir)
    e = R.query_embeddings(v, {i: k for i, k in _QV.items() if i in dict(QUERIES)})
    m = memories(spark, sf_dir)
    return R.signals(m, v, memory_links(spark, sf_dir), QUERIES, e, R.recent_memories(m, hours_since("created_at")))


@query(f"WITH {_QS}, {_STORE}, {_fused_sql('', 'qs')} SELECT query_id, key, round(fused, 9) AS fused, round(weighted, 9) AS weighted FROM fz")
def rank_fusion(spark, sf_dir):
    return R.fuse_rrf(_signals(spark, sf_dir)).select("query_id", "key", F.round("fused", 9).alias("fused"), F.round("weighted", 9).alias("weighted"))


for _how, _sql in (("average", "sum(w * score) / sum(w)"), ("max", "max(score)"), ("borda", "sum(score) * count(*)")):

    def _fusion(spark, sf_dir, how=_how):
        return R.fuse_scores(_signals(spark, sf_dir), how).select("query_id", "key", F.round("fused", 9).alias("fused"))

    _fusion.__name__ = f"fusion_{_how}"
    query(f"WITH {_QS}, {_STORE}, {_signals_sql('', 'qs')}, z AS (SELECT query_id, key, {_sql} AS f FROM (SELECT *, {_WEIGHT} AS w FROM sig) GROUP BY 1, 2) SELECT query_id, key, round(f, 9) AS fused FROM z WHERE f >= 0.1")(_fusion)

_VALUES = lambda rows: "VALUES " + ", ".join(f"('{i}', '{q}')" for i, q in rows)
_FLAG = f"""ask(query_id, query) AS ({_VALUES(_QUESTIONS)}), part(query_id, query) AS ({_VALUES(_PARTS)}), {_STORE}, {_fused_sql('a_', 'part')},
best AS (SELECT split_part(query_id, '/', 1) AS query_id, key, max(fused) AS fused FROM (SELECT * FROM a_fz QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, weighted DESC, key) <= 50) GROUP BY 1, 2),
boosted AS (SELECT query_id, key, round(fused * CASE WHEN query_id = 'q7' AND (created_at >= TIMESTAMP '2024-03-01' AND created_at < TIMESTAMP '2024-06-01' OR regexp_matches(value, '(^|[^0-9])2024([^0-9]|$)')) THEN 1.3e0 ELSE 1 END, 12) AS fused FROM best JOIN mem USING (key)),
pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, key) AS p FROM boosted QUALIFY p <= 50),
fw AS (SELECT query_id, query, unnest({_TOK.format("value")}) AS term FROM pool JOIN mem USING (key) JOIN ask USING (query_id) WHERE p <= 5),
fc AS (SELECT query_id, term, count(*) AS n FROM fw WHERE strlen(term) >= 3 AND NOT regexp_full_match(term, '[0-9]+') AND NOT list_contains({_TOK.format("query")}, term) GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) <= 10),
wider AS (SELECT query_id, query || ' ' || t AS query FROM ask JOIN (SELECT query_id, string_agg(term, ' ' ORDER BY n DESC, term) AS t FROM fc GROUP BY 1) USING (query_id)), {_fused_sql('b_', 'wider')},
joined AS (SELECT query_id, key, max(fused) AS fused FROM (SELECT query_id, key, fused FROM pool UNION ALL SELECT query_id, key, fused FROM (SELECT * FROM b_fz QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, weighted DESC, key) <= 50) JOIN mem USING (key)) GROUP BY 1, 2),
last AS (SELECT * FROM joined QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, key) <= 50),
cs AS (SELECT last.query_id, key, fused, value, created_at, 0.6e0 * CASE WHEN max(fused) OVER o = min(fused) OVER o THEN 1 ELSE (fused - min(fused) OVER o) / (max(fused) OVER o - min(fused) OVER o) END
  + 0.2e0 * greatest(0.001e0, least(0.999e0, exp(-ln(2) * {_AGE} / 24))) + 0.2e0 * importance AS composite FROM last JOIN mem USING (key) WINDOW o AS (PARTITION BY query_id)),
ft AS (SELECT cs.*, len(list_intersect(list_distinct({_TOK.format("query")}), list_distinct({_TOK.format("value")}))) / len(list_distinct({_TOK.format("query")}))::DOUBLE AS terms, pow(0.5, {_AGE} / 168) AS recent,
  qv.e IS NOT NULL AS has, coalesce(list_cosine_similarity(vec.e, qv.e), 0) AS agree FROM cs JOIN ask USING (query_id) LEFT JOIN qv ON qv.qid = query_id LEFT JOIN vec USING (key)),
rr AS (SELECT *, CASE WHEN has THEN 0.25e0 * terms + 0.15e0 * recent + 0.6e0 * greatest(0, least(1, agree)) ELSE (0.25e0 * terms + 0.15e0 * recent) / 0.4e0 END AS rerank_score FROM ft),
fin AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 12) DESC, key) AS rank FROM rr)"""


@query(f"WITH {_FLAG} SELECT query_id, rank, key, fused, round(composite, 9) AS composite, round(rerank_score, 9) AS rerank_score FROM fin WHERE rank <= 10")
def hybrid_search(spark, sf_dir):
    return R.hybrid_search(memories(spark, sf_dir), vectors(spark, sf_dir), memory_links(spark, sf_dir), _QUESTIONS, _QV, datetime.fromisoformat(AS_OF))


@query(f"""WITH {_MATCH}, w AS (SELECT query_id, unnest({_TOK.format("value")}) AS term FROM top WHERE rank <= 5),
c AS (SELECT query_id, term, count(*) AS n FROM w JOIN qs USING (query_id) WHERE strlen(term) >= 3 AND NOT regexp_full_match(term, '[0-9]+') AND NOT list_contains({_TOK.format("query")}, term) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) AS rank FROM c) SELECT * FROM r WHERE rank <= 10""")
def prf_expansion_terms(spark, sf_dir):
    return R.feedback_terms(R.match_any_term(spread(memories(spark, sf_dir)), QUERIES, 5), QUERIES).select("query_id", "term", "n", "rank")


_EBB = "greatest(0.001, least(0.999, exp(-ln(2) * {h} / (24 * (1 + 2 * importance)))))"


# column functions over texts, a row for each document
_W = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"
_J = "coalesce(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0)::DOUBLE, {e})"


@query(f"""WITH {MEMORIES}, p AS (SELECT key, value, coalesce(lead(value) OVER (ORDER BY key::BIGINT), '') AS other FROM mem),
s AS (SELECT key, list_distinct({_W.format("value")}) AS a, list_distinct({_W.format("other")}) AS b, list_distinct({_W.format("lower(value)")}) AS la, list_distinct({_W.format("lower(other)")}) AS lb FROM p)
SELECT key, round({_J.format(a="a", b="b", e="0")}, 9) AS word_jaccard, round({_J.format(a="la", b="lb", e="0")}, 9) AS lower_jaccard FROM s""")
def text_similarity(spark, sf_dir):
    m = memories(spark, sf_dir).select("key", "value", F.col("key").cast("long").alias("n"))
    after = m.select((F.col("n") - 1).alias("n"), F.col("value").alias("other"))
    p = m.join(after, "n", "left").withColumn("other", F.coalesce("other", F.lit("")))
    return p.select("key", F.round(T.word_jaccard(F.col("value"), F.col("other")), 9).alias("word_jaccard"), F.round(T.word_jaccard(F.col("value"), F.col("other"), lower=True), 9).alias("lower_jaccard"))


@query(f"""WITH {MEMORIES}, x AS (SELECT key, value, {_W.format("value")} AS w, {_W.format("lower(value)")} AS lw, len(list_filter(regexp_split_to_array(value, '[.!?]'), lambda s: trim(s) <> '')) AS s FROM mem)
SELECT key, trim(regexp_replace(lower(value), '\\s+', ' ', 'g')) AS normalized, sha256(value) AS content_hash,
 array_to_string([(floor(strlen(value) / 50) * 50)::BIGINT::VARCHAR, len(w)::VARCHAR, array_to_string(w[1:3], '_')], '_') AS cluster_key,
 CASE WHEN length(value) = 0 THEN 'unknown' WHEN length(regexp_replace(value, '[^\\x00-\\x7F]', '', 'g')) / length(value)::DOUBLE > 0.95 THEN 'en' WHEN length(regexp_replace(value, '[^\\x00-\\x7F]', '', 'g')) / length(value)::DOUBLE > 0.8 THEN 'mixed' ELSE 'non_latin' END AS language,
 round(greatest(0, 1 - (least(coalesce(len(w) / nullif(s, 0)::DOUBLE, 0) / 20, 1) * 0.5 + least(coalesce(strlen(value) / nullif(len(w), 0)::DOUBLE, 0) / 8, 1) * 0.5)), 9) AS readability,
 round(least(1, 0.7 * coalesce(len(list_distinct(lw)) / nullif(len(lw), 0)::DOUBLE, 0) + 0.3 * least(strlen(value) / 1000::DOUBLE, 1)), 9) AS density,
 CASE WHEN contains(value, '```') OR contains(value, 'function') OR contains(value, 'class ') THEN 'code' WHEN contains(value, 'http') OR contains(value, 'www.') THEN 'web_content'
  WHEN len(string_split(value, chr(10))) > 10 AND strlen(value) > 1000 THEN 'document' WHEN len(w) < 10 THEN 'note' ELSE 'text' END AS content_type FROM x""")
def text_profile(spark, sf_dir):
    v = F.col("value")
    return spread(memories(spark, sf_dir)).select(
        "key", T.normalize_content(v).alias("normalized"), F.sha2(v, 256).alias("content_hash"), T.cluster_key(v).alias("cluster_key"), T.ascii_language(v).alias("language"),
        F.round(T.readability(v), 9).alias("readability"), F.round(T.information_density(v), 9).alias("density"), T.content_type(v).alias("content_type"),
    )


@query(f"""WITH {MEMORIES}, b AS (SELECT key, value, regexp_extract_all(hex(encode(value)), '..') AS h FROM mem), g AS (SELECT key, value, h, string_split(value, '') AS c FROM b)
SELECT key, round(CASE WHEN len(h) = 0 THEN 0 ELSE list_aggregate(h, 'entropy') END, 9) AS byte_entropy, round(coalesce(1 - len(list_distinct(h)) / nullif(len(h), 0)::DOUBLE, 0), 9) AS repetition FROM g""")
def text_entropy(spark, sf_dir):
    """Entropy over counts of bytes that are made by one aggregation, not by comparing all bytes of a text with each other."""
    m = memories(spark, sf_dir).select("key", T.byte_pairs(F.col("value")).alias("b"))
    n = m.select("key", F.explode_outer("b").alias("c")).groupBy("key", "c").agg(F.count("c").alias("n"))
    s = n.groupBy("key").agg(F.sum("n").alias("t"), F.sum(F.when(F.col("n") > 0, F.col("n") * F.log2("n"))).alias("s"), F.count("c").alias("d"))
    e = F.coalesce(F.log2(F.expr("nullif(t, 0)")) - F.try_divide("s", "t"), F.lit(0.0))
    return s.select("key", F.round(e, 9).alias("byte_entropy"), F.round(F.coalesce(1 - F.try_divide("d", "t"), F.lit(0.0)), 9).alias("repetition"))


@query(f"""WITH {MEMORIES}, s AS (SELECT key, list_filter(list_transform(regexp_split_to_array(regexp_replace(value, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS s,
 list_filter(list_transform(regexp_split_to_array(value, '[.!?]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: strlen(s) > 10) AS l FROM mem)
SELECT key, len(s) AS sentences, len(l) AS long_sentences, coalesce(l[1], '') AS first_long FROM s""")
def sentence_split(spark, sf_dir):
    m = memories(spark, sf_dir).select("key", T.split_sentences(F.col("value")).alias("s"), T.long_sentences(F.col("value")).alias("l"))
    return m.select("key", F.size("s").alias("sentences"), F.size("l").alias("long_sentences"), F.coalesce(F.get("l", F.lit(0)), F.lit("")).alias("first_long"))


@query(f"""WITH {MEMORIES}, w AS (SELECT key, unnest(list_filter(list_transform({_W.format("lower(value)")}, lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda w: strlen(w) > 3)) AS word FROM mem),
c AS (SELECT key, word, count(*) AS n FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, word) AS rank FROM c) SELECT * FROM r WHERE rank <= 10""")
def extract_keywords(spark, sf_dir):
    w = memories(spark, sf_dir).select("key", F.explode(T.keywords(F.col("value"))).alias("word")).groupBy("key", "word").agg(F.count(F.lit(1)).alias("n"))
    return R.top(w, 10, F.desc("n"), F.asc("word"), by=("key",))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<br\\s*/?>|</?p(\\s[^>]*)?>', chr(10), 'gi'), '<[^>]*>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM pages""")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.extract_html_text(F.col("html")).alias("text"))


# vectors
_ONE = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


@query(f"""SELECT vec_id, round(list_cosine_similarity(e, q), 9) AS cosine, round(list_distance(e, q), 9) AS euclidean, round(list_sum(list_transform(list_zip(e, q), lambda z: abs(z[1] - z[2]))), 9) AS manhattan,
 round(list_dot_product(e, q), 9) AS dot, round(acos(greatest(-1, least(1, list_cosine_similarity(e, q) - 1e-15))), 6) AS angular, len(list_filter(list_zip(e, q), lambda z: z[1] <> 0 AND z[2] <> 0)) / len(list_filter(list_zip(e, q), lambda z: z[1] <> 0 OR z[2] <> 0))::DOUBLE AS support FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), {_ONE}""")
def vector_metrics(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    q = v.agg(F.min_by("e", "vec_id").alias("q"))
    v = v.join(F.broadcast(q))  # one row
    a, b = F.col("e"), F.col("q")
    r = lambda c, n: F.round(c, 9).alias(n)
    return v.select("vec_id", r(V.cosine(a, b), "cosine"), r(V.euclidean(a, b), "euclidean"), r(V.manhattan(a, b), "manhattan"), r(V.dot(a, b), "dot"), F.round(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.cosine(a, b) - 1e-15))), 6).alias("angular"), V.support_jaccard(a, b).alias("support"))


@query(f"""WITH d AS (SELECT vec_id, list_cosine_similarity(e, q) AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), {_ONE}), r AS (SELECT vec_id, round(s, 9) AS similarity, row_number() OVER (ORDER BY round(s, 12) DESC, vec_id) AS rank FROM d)
SELECT * FROM r WHERE rank <= 10""")
def vector_top_k(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    s = v.join(F.broadcast(v.agg(F.min_by("e", "vec_id").alias("q")))).select("vec_id", V.cosine(F.col("e"), F.col("q")).alias("s"), F.lit(0).alias("g"))
    return R.top(s, 10, F.desc(F.round("s", 12)), F.asc("vec_id"), by=("g",)).select("vec_id", F.round("s", 9).alias("similarity"), "rank")


@query(f"""SELECT vec_id, round(s, 9) AS similarity FROM (SELECT vec_id, list_cosine_similarity(e, q) AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), {_ONE}) WHERE s >= 0.7""")
def vector_threshold_search(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    s = v.join(F.broadcast(v.agg(F.min_by("e", "vec_id").alias("q")))).select("vec_id", V.cosine(F.col("e"), F.col("q")).alias("s"))
    return s.filter("s >= 0.7").select("vec_id", F.round("s", 9).alias("similarity"))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2), d AS (SELECT vec_id, x.label, c.label AS proto, sqrt(sum((v - m) * (v - m))) AS d FROM x JOIN c USING (i) GROUP BY 1, 2, 3),
p AS (SELECT vec_id, label, proto, d, exp(-d) / sum(exp(-d)) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), proto) AS r FROM d)
SELECT vec_id, label, proto AS predicted, round(d, 6) AS distance, round(p, 6) AS probability FROM p WHERE r = 1""")
def prototype_predict(spark, sf_dir):
    """Class means, then each vector's nearest: the means are as many as the classes, kept as one row of arrays."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    m = v.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    protos = m.agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("ps"))
    d = v.join(F.broadcast(protos)).withColumn("d", F.transform("ps", lambda p: F.struct(F.round(V.euclidean(F.col("e"), p["c"]), 9).alias("k"), p["label"].alias("l"), V.euclidean(F.col("e"), p["c"]).alias("d"))))
    best = F.array_min("d")
    total = F.aggregate("d", F.lit(0.0), lambda a, x: a + F.exp(-x["d"]))
    return d.select("vec_id", "label", best["l"].alias("predicted"), F.round(best["d"], 6).alias("distance"), F.round(F.exp(-best["d"]) / total, 6).alias("probability"))


# ages
@query(f"""WITH {MEMORIES}, x AS (SELECT *, {hours_sql("created_at")} AS t, {hours_sql("last_accessed")} AS a FROM mem)
SELECT key, round({_EBB.format(h="t")}, 9) AS ebbinghaus, round(pow(1 + t / 24, -(0.5 * (1 + 0.5 * importance))), 9) AS power_law,
 round(greatest(0, 1 - ln(1 + t / (24 * (1 + 0.5 * confidence))) / ln(101)), 9) AS logarithmic, round(exp(-pow(t / 168, 2) / 2), 9) AS gaussian, round(1 / (1 + t / 24), 9) AS hyperbolic,
 round(exp(-pow(t / 168, 0.8)), 9) AS weibull, round(exp(-pow((t + 1) / 72, 0.7)), 9) AS custom, round(pow(0.5, a / 168), 9) AS recency,
 round((0.5 + 0.5 * exp(-a / 24)) * least(1 + 0.25 * ln(1 + access_count), 2), 9) AS access_recency,
 round({_EBB.format(h="t")} * importance * (0.5 + 0.5 * exp(-a / 24)) * least(1 + 0.25 * ln(1 + access_count), 2), 9) AS retained FROM x""")
def decay_models(spark, sf_dir):
    m = memories(spark, sf_dir).withColumn("t", hours_since("created_at")).withColumn("a", hours_since("last_accessed"))
    t, a, i, n = F.col("t"), F.col("a"), F.col("importance"), F.col("access_count")
    zero = F.lit(0.0)
    cols = {
        "ebbinghaus": D.ebbinghaus(t, i, zero, zero), "power_law": D.power_law(t, i), "logarithmic": D.logarithmic(t, F.col("confidence")), "gaussian": D.gaussian(t),
        "hyperbolic": D.hyperbolic(t), "weibull": D.weibull(t), "custom": D.custom(t), "recency": R.recency_half_life(a), "access_recency": D.recency_of_access(a, n),
        "retained": D.ebbinghaus(t, i, zero, zero) * i * D.recency_of_access(a, n),
    }
    return m.select("key", *(F.round(c, 9).alias(k) for k, c in cols.items()))


@query(f"""WITH {MEMORIES}, x AS (SELECT *, {hours_sql("created_at")} AS t FROM mem), y AS (SELECT *, {_EBB.format(h="t")} AS e, pow(1 + t / 24, -(0.5 * (1 + 0.5 * importance))) AS p FROM x)
SELECT key, round((0.6 * e + 0.4 * p) / 1.0, 9) AS hybrid, round(0.3 * importance + 0.2 * (1 - confidence) + 0.2 * (1 - e) + 0.15 * (access_count / 17.0) + 0.15 * confidence, 9) AS replay_priority,
 ([1, 6, 24, 72, 168]::DOUBLE[])[(least(access_count, 4) + 1)::INT] * (2 - importance) AS replay_after_hours, round((1 - e) * (1 - confidence) * 0.1, 9) AS forget_probability,
 (round(0.4 * (access_count >= 5)::INT + 0.3 * (t / 24 >= 7)::INT + 0.3 * (importance >= 0.8)::INT, 9) >= 0.6) AS promoted, e * importance < 0.05 AS under_floor,
 CASE WHEN e * importance >= 0.05 THEN 'keep' WHEN memory_type = 'LongTerm' THEN 'demote' ELSE 'evict' END AS forgetting FROM y""")
def retention_decisions(spark, sf_dir):
    m = memories(spark, sf_dir).withColumn("t", hours_since("created_at"))
    i, c, n, zero = F.col("importance"), F.col("confidence"), F.col("access_count"), F.lit(0.0)
    m = m.withColumn("e", D.ebbinghaus(F.col("t"), i, zero, zero))
    e = F.col("e")
    promote = F.round(0.4 * (n >= 5).cast("int") + 0.3 * (F.col("t") / 24 >= 7).cast("int") + 0.3 * (i >= 0.8).cast("int"), 9) >= 0.6
    return m.select(
        "key", F.round(D.hybrid([(0.6, e), (0.4, D.power_law(F.col("t"), i))]), 9).alias("hybrid"), F.round(D.replay_priority(i, 1 - c, 1 - e, n / 17.0, c), 9).alias("replay_priority"),
        D.spaced_repetition_hours(n, i).alias("replay_after_hours"), F.round(D.forgetting_probability(1 - e, c), 9).alias("forget_probability"), promote.alias("promoted"), (e * i < 0.05).alias("under_floor"),
        F.when(e * i >= 0.05, "keep").when(F.col("memory_type") == "LongTerm", "demote").otherwise("evict").alias("forgetting"),
    )


