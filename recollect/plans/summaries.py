"""Queries of summaries over many memories."""
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators import summaries as S
from recollect.plans.registry import query
from recollect.sources.tables import MEMORIES, memories, spread

_LEVELS = [("memory", "key"), ("month", "memory_type || ' ' || strftime(created_at, '%Y-%m')"), ("year", "memory_type || ' ' || strftime(created_at, '%Y')"), ("type", "memory_type"), ("all", "'all'")]
_TOK = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''))"


def _tree_sql() -> str:
    cols = ", ".join(f"{c} AS l{i}" for i, (_, c) in enumerate(_LEVELS))
    ctes = [f"""{MEMORIES}, p AS (SELECT value, {cols} FROM mem),
s0 AS MATERIALIZED (SELECT DISTINCT l0 AS node, sentence FROM (SELECT l0, unnest(list_filter(list_transform(regexp_split_to_array(value, '[.!?]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: strlen(s) > 10)) AS sentence FROM p) WHERE strlen(sentence) BETWEEN 21 AND 199)"""]
    for i in range(len(_LEVELS)):
        if i:
            ctes.append(f"s{i} AS MATERIALIZED (SELECT DISTINCT u.up AS node, sentence FROM k{i - 1} JOIN (SELECT DISTINCT l{i - 1} AS node, l{i} AS up FROM p) u USING (node))")
        ctes.append(f"""w{i} AS (SELECT node, sentence, unnest({_TOK.format('sentence')}) AS w FROM s{i}), d{i} AS (SELECT w, count(*) AS df FROM w{i} GROUP BY 1),
k{i} AS MATERIALIZED (SELECT node, sentence, score, row_number() OVER (PARTITION BY node ORDER BY score DESC, sentence) AS rank FROM (SELECT node, sentence, round(avg(ln((SELECT count(*) FROM s{i}) / df::DOUBLE)), 9) AS score FROM w{i} JOIN d{i} USING (w) GROUP BY 1, 2) QUALIFY rank <= 3)""")
    parts = [f"SELECT '{n}' AS level, node, " + (f"u.up AS parent" if i + 1 < len(_LEVELS) else "NULL AS parent") + f", rank, sentence, score FROM k{i}" + (f" JOIN (SELECT DISTINCT l{i} AS node, l{i + 1} AS up FROM p) u USING (node)" if i + 1 < len(_LEVELS) else "") for i, (n, _) in enumerate(_LEVELS)]
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(parts)}"


@query(_tree_sql())
def summary_tree(spark, sf_dir):
    """The three most telling sentences of each memory, of each month of a type of memory from these, of its years, of types, and of all."""
    m = spread(memories(spark, sf_dir))
    at = lambda f: F.concat_ws(" ", "memory_type", F.date_format("created_at", f))
    return S.summary_tree(m, [("memory", F.col("key")), ("month", at("yyyy-MM")), ("year", at("yyyy")), ("type", F.col("memory_type")), ("all", F.lit("all"))])


_KEY_TERMS = f"""{MEMORIES}, tf AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(list_filter(regexp_split_to_array(lower(value), '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) >= 4)) AS term FROM mem) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING df > 1),
k AS MATERIALIZED (SELECT key, term FROM tf JOIN dfs USING (term) QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(tf * ln((SELECT count(*) FROM mem) / df::DOUBLE), 9) DESC, term) <= 5)"""
_CONCEPTS = f"""{_KEY_TERMS}, n AS (SELECT term, count(*) AS n FROM k GROUP BY 1),
l AS MATERIALIZED (SELECT a.term AS u, b.term AS v FROM k a JOIN k b ON a.key = b.key AND a.term < b.term JOIN n x ON x.term = a.term JOIN n y ON y.term = b.term GROUP BY 1, 2, x.n, y.n HAVING count(*) >= 2 AND count(*) >= 0.3 * (x.n + y.n - count(*))),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l), r(a, b) AS (SELECT term, term FROM n UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b), c AS MATERIALIZED (SELECT a AS term, min(b) AS concept FROM r GROUP BY 1)"""


@query(f"WITH RECURSIVE {_CONCEPTS} SELECT * FROM c")
def concept_terms(spark, sf_dir):
    """Key terms and the concept that each belongs to."""
    return S.concepts(spread(memories(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_CONCEPTS}, h AS (SELECT key, concept, count(*) AS n FROM k JOIN c USING (term) GROUP BY 1, 2), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, concept) = 1),
g AS (SELECT concept, count(*) AS n_memories, arg_min(key, {{'n': -n, 'k': key}}) AS key FROM b GROUP BY 1)
SELECT concept, (SELECT count(*) FROM c WHERE c.concept = g.concept) AS n_terms, n_memories, array_to_string(list_filter(regexp_split_to_array(value, '\\s+'), lambda w: w <> '')[1:5], ' ') || '...' AS lead FROM g JOIN mem USING (key)""")
def summary_by_concept(spark, sf_dir):
    """Memories grouped by their concept, each group with the first words of its most telling one."""
    return S.concept_summary(spread(memories(spark, sf_dir)))


@query(f"WITH {MEMORIES} SELECT memory_type AS section, row_number() OVER (PARTITION BY memory_type ORDER BY created_at, key) AS pos, array_to_string(list_filter(regexp_split_to_array(value, '\\s+'), lambda w: w <> '')[1:5], ' ') || '...' AS line FROM mem")
def summary_outline(spark, sf_dir):
    """A line for each memory, its first five words, in sections by type and in order of time."""
    m = spread(memories(spark, sf_dir)).select("memory_type", "created_at", "key", F.concat(F.array_join(F.slice(T.words(F.col("value")), 1, 5), " "), F.lit("...")).alias("line"))
    return S.sections(m, "memory_type", "created_at", "key").select("section", "pos", "line")
