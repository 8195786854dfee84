"""Retrieval: matches of query terms, signals, rank fusion, feedback, composite scores and reordering, for a set of queries at once."""
import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.functions import vectors as V
from recollect.functions.decay import ebbinghaus
from recollect.functions.facts import split_multi_part, temporal_range
from recollect.functions.scores import graph_score
from recollect.functions.similarity import similarity_from
from recollect.operators.graph import relationship_strength, undirected
from recollect.session import materialize
from recollect.sources.tables import spread

#: Fixed values of the fusion, the signals, the composite and the reordering.
RRF_K, MIN_SCORE = 60, 0.1
WEIGHTS = {"dense": 0.4, "keyword": 0.3, "graph": 0.2, "temporal": 0.1}
PRESETS = {
    "semantic": {"dense": 0.6, "keyword": 0.2, "graph": 0.15, "temporal": 0.05},
    "keyword": {"dense": 0.2, "keyword": 0.6, "graph": 0.15, "temporal": 0.05},
    "graph": {"dense": 0.25, "keyword": 0.25, "graph": 0.4, "temporal": 0.1},
    "temporal": {"dense": 0.3, "keyword": 0.2, "graph": 0.1, "temporal": 0.4},
}
PER_SIGNAL = 50
K1, B = 1.2, 0.75
COMPOSITE = (0.6, 0.2, 0.2)
RERANK = {"term": 0.25, "embed": 0.60, "recency": 0.15}
RECENCY_HALF_LIFE = 168.0
DENSE_FLOOR, SEEDS, BOOST = 0.3, 5, 1.3
FEEDBACK_ROWS, FEEDBACK_TERMS = 5, 10


def with_queries(df: DataFrame, queries: list[tuple[str, str]]) -> DataFrame:
    """Each row beside each query of a small literal set: query_id, query. No join: the set is part of the plan."""
    return df.withColumn("_q", F.explode(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(q).alias("text")) for i, q in queries)))).select("*", F.col("_q.id").alias("query_id"), F.col("_q.text").alias("query")).drop("_q")


def _terms(query: Column) -> Column:
    """Lower-cased words of a query; a word that repeats counts each time, as it does for the reference."""
    return F.filter(F.split(F.lower(query), r"\s+"), lambda t: t != "")


def top(df: DataFrame, k: int, *order: Column, by=("query_id",), name: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank from 1; Spark prunes each partition to k before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def quoted(text: str) -> str:
    """A string as a literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def match_any_term(memories: DataFrame, queries: list[tuple[str, str]], k: int) -> DataFrame:
    """query_id, key, distinct_terms, total_freq, score, rank: texts that contain any term, by distinct terms, then frequency, then key."""
    split = {i: q.lower().split() for i, q in queries}
    terms = sorted({t for ts in split.values() for t in ts})
    # each distinct term is counted once in a text, by generated code; queries only add up counts. Said in SQL, which is built at once
    count = lambda t: f"if(contains(_v, {t}), cast(try_divide(octet_length(_v) - octet_length(replace(_v, {t}, '')), octet_length({t})) as bigint), 0L)"
    m = memories.withColumn("_v", F.lower("value")).selectExpr("*", *(f"{count(quoted(t))} AS _f{n}" for n, t in enumerate(terms)))
    own = {i: [f"_f{terms.index(t)}" for t in ts] for i, ts in split.items() if ts}
    total = lambda cols, each: " + ".join(each.format(c) for c in cols)
    rows = ", ".join(f"named_struct('query_id', {quoted(i)}, 'distinct_terms', {total(cols, 'cast({} > 0 as int)')}, 'total_freq', {total(cols, '{}')})" for i, cols in own.items())
    rows = f"array({rows})" if own else "cast(array() as array<struct<query_id: string, distinct_terms: int, total_freq: bigint>>)"
    m = m.selectExpr(*(f"`{c}`" for c in memories.columns), "_v", f"explode(filter({rows}, r -> r.distinct_terms > 0)) AS _q").select(*memories.columns, "_v", "_q.*")
    m = m.withColumn("score", F.col("total_freq") / F.octet_length("_v")).drop("_v")
    return top(m, k, F.desc("distinct_terms"), F.desc("total_freq"), F.asc("key"))


def match_phrase(memories: DataFrame, queries: list[tuple[str, str]], k: int) -> DataFrame:
    """query_id, key, total_freq, score, rank: texts that contain the whole query as one substring, best first over all matches."""
    m = with_queries(memories, queries).withColumn("_v", F.lower("value")).filter(F.contains("_v", F.lower("query")))
    freq = F.aggregate(F.transform(_terms(F.col("query")), lambda t: T.occurrences(F.col("_v"), t)), F.lit(0).cast("long"), lambda a, x: a + x)
    m = m.withColumn("total_freq", freq).withColumn("score", F.col("total_freq") / F.octet_length("_v"))
    return top(m.drop("_v", "query"), k, F.desc("score"), F.asc("key"))


def of_query(texts: dict[str, str], query: str = "query_id") -> Column:
    """What a small literal table has for the row's question: no join."""
    return F.expr(f"try_element_at(map({', '.join(f'{quoted(i)}, {x}' for i, x in texts.items())}), {query})") if texts else F.lit(None)


def term_counts(candidates: DataFrame, queries: list[tuple[str, str]]) -> DataFrame:
    """candidates with _n, the number of words of their values, and _terms, how often each of the question's occurs. Words are bound once."""
    terms = of_query({i: f"array({', '.join(map(quoted, dict.fromkeys(q.lower().split())))})" for i, q in queries if q.split()})
    words = F.array(F.filter(F.split(F.lower("value"), r"\s+"), lambda t: t != ""))
    counts = lambda w: F.struct(F.size(w).alias("n"), F.transform("_asked", lambda t: F.struct(t.alias("t"), F.size(F.filter(w, lambda x: x == t)).alias("tf"))).alias("terms"))
    c = candidates.withColumn("_asked", terms).withColumn("_c", F.transform(words, counts)[0])
    return c.select(*candidates.columns, F.col("_c.n").alias("_n"), F.col("_c.terms").alias("_terms"))


def bm25_of_counts(counted: DataFrame) -> DataFrame:
    """query_id, key, bm25 of rows with term_counts' columns."""
    own = Window.partitionBy("query_id")
    c = counted.select("query_id", "key", "_n", "_terms", F.count(F.lit(1)).over(own).alias("_all"), F.avg("_n").over(own).alias("_avg"))
    c = c.select("query_id", "key", "_n", "_all", "_avg", F.explode_outer("_terms").alias("_e")).select("*", F.col("_e.t").alias("_t"), F.coalesce("_e.tf", F.lit(0)).alias("_tf"))
    c = c.withColumn("_df", F.count_if(F.col("_tf") > 0).over(Window.partitionBy("query_id", "_t")))
    idf = F.log((F.col("_all") - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1)
    part = idf * F.try_divide(F.col("_tf") * (K1 + 1), F.col("_tf") + K1 * (1 - B + B * F.try_divide(F.col("_n"), F.col("_avg"))))
    s = c.groupBy("query_id", "key").agg(F.sum(F.coalesce(part, F.lit(0.0))).alias("_s"))
    return s.select("query_id", "key", (F.col("_s") / (F.col("_s") + 1)).alias("bm25"))


def bm25(candidates: DataFrame, queries: list[tuple[str, str]]) -> DataFrame:
    """candidates (query_id, key, value) with bm25 in 0..1: N, df and the mean length are those of each query's candidates. Counts replace texts before any exchange."""
    return bm25_of_counts(term_counts(candidates.select("query_id", "key", "value"), queries).drop("value"))


def bm25_store(memories: DataFrame, queries: list[tuple[str, str]], k: int) -> DataFrame:
    """query_id, key, score, rank: BM25 of every memory that holds a word of the question, the k best; N, df and the mean length are the whole store's.

    Words are counted once where a text is read, and only those that some question has go on.
    """
    asked = [(i, t) for i, q in queries for t in dict.fromkeys(q.lower().split())]
    if not asked:
        return memories.select(F.lit("").alias("query_id"), "key", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    wanted = F.array(*(F.lit(t) for t in sorted({t for _, t in asked})))
    words = F.array(F.filter(F.split(F.lower("value"), r"\s+"), lambda t: t != ""))
    counts = lambda w: F.struct(F.size(w).alias("n"), F.filter(F.transform(wanted, lambda t: F.struct(t.alias("t"), F.size(F.filter(w, lambda x: x == t)).alias("tf"))), lambda e: e["tf"] > 0).alias("e"))
    m = materialize(memories.select("key", F.transform(words, counts)[0].alias("c")).select("key", "c.n", "c.e"), "term-counts")
    store = F.broadcast(m.agg(F.count(F.lit(1)).alias("_all"), F.avg("n").alias("_avg")))  # one row
    held = m.select("key", "n", F.explode("e").alias("e")).select("key", "n", "e.t", "e.tf")
    df = held.groupBy("t").agg(F.count(F.lit(1)).alias("df"))  # a row a word asked for
    terms = memories.sparkSession.createDataFrame(asked, "query_id string, t string")
    s = held.join(F.broadcast(df), "t").join(F.broadcast(terms), "t").join(store)
    part = F.log((F.col("_all") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("_avg")))
    return top(s.groupBy("query_id", "key").agg(F.round(F.sum(part), 9).alias("score")), k, F.desc("score"), F.asc("key"))


def search_pages(memories: DataFrame, queries: list[tuple[str, str]], where: Column, least: float, order: list[Column], offset: int, limit: int, links: DataFrame | None = None, alike: float | None = None) -> DataFrame:
    """query_id, rank, key, relevance (and related): a page of each query's results, in one call.

    relevance is how many of the query's words (repeats counting) a memory has among its own, of all of them; with `alike`,
    a word of the store whose string similarity to the query's is that or more counts by it, too. Then `where` filters, as does
    `least` relevance; `order` (ties by key) ranks what is left, and the page is its rows offset + 1 to offset + limit. links
    adds how many memories each result is linked with. Words are measured once each, not once a memory.
    """
    words = F.array_distinct(T.words(F.lower("value")))
    asked = {i: q.lower().split() for i, q in queries if q.split()}
    known = memories.sparkSession.range(1).select(F.expr("explode(array(" + ", ".join(f"named_struct('query_id', {quoted(i)}, 'word', {quoted(w)}, 'n', {ws.count(w)}, 'of', {len(ws)})" for i, ws in asked.items() for w in dict.fromkeys(ws)) + "))").alias("a")).select("a.*") if asked else None
    if known is None:
        return memories.select(F.lit("").alias("query_id"), F.lit(0).alias("rank"), "key", F.lit(0.0).alias("relevance")).limit(0)
    held = memories.filter(where).select("key", F.explode(words).alias("word"))
    hits = held.join(F.broadcast(known), "word").select("query_id", "key", "of", F.col("n").cast("double").alias("score"))
    if alike is not None:
        store = held.select("word").distinct()
        near = store.join(F.broadcast(known.withColumnRenamed("word", "asked")), F.col("word") != F.col("asked"))  # as many rows a word as are asked for
        # written, so that the few words that are alike go to the store's, not all of these to them
        near = materialize(near.withColumn("s", similarity_from(F.col("asked"), F.col("word"), alike)).filter("s IS NOT NULL"), "words-alike")
        hits = hits.unionByName(held.join(near, "word").select("query_id", "key", "of", (F.col("n") * F.col("s")).alias("score")))
    scored = hits.groupBy("query_id", "key").agg(F.round(F.sum("score") / F.first("of"), 9).alias("relevance")).filter(F.col("relevance") >= least)
    rest = memories.drop("value")
    page = top(scored.join(rest, "key"), offset + limit, *order, F.asc("key")).filter(F.col("rank") > offset)
    out = page.select("query_id", "rank", "key", "relevance")
    if links is None:
        return out
    n = undirected(links.select("src", "dst")).distinct().groupBy(F.col("node").alias("key")).agg(F.count(F.lit(1)).alias("related"))
    return out.join(n, "key", "left").select("query_id", "rank", "key", "relevance", F.coalesce("related", F.lit(0)).alias("related"))


def temporal_score(days: Column, accesses: Column) -> Column:
    return 0.6 * F.exp(-days / 30.0) + 0.4 * (accesses / (accesses + 10.0))


def recency_half_life(hours: Column, half_life: float = RECENCY_HALF_LIFE) -> Column:
    return F.pow(F.lit(0.5), hours / half_life)


def fuse_rrf(signals: DataFrame, weights: dict[str, float] = WEIGHTS, min_score: float = MIN_SCORE) -> DataFrame:
    """query_id, key, fused, weighted: reciprocal ranks over signals(query_id, signal, key, score); scores under min_score don't vote."""
    w = F.element_at(F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v)))), F.col("signal"))
    r = F.row_number().over(Window.partitionBy("query_id", "signal").orderBy(F.desc("score"), F.asc("key")))
    s = signals.filter(F.col("score") >= min_score).withColumn("_r", r)
    return s.groupBy("query_id", "key").agg(F.round(F.sum(w / (RRF_K + F.col("_r"))), 12).alias("fused"), F.round(F.sum(w * F.col("score")), 12).alias("weighted"))


def fuse_scores(signals: DataFrame, how: str, weights: dict[str, float] = WEIGHTS, min_score: float = MIN_SCORE) -> DataFrame:
    """query_id, key, fused by weighted average of the signals present, maximum, or Borda count (sum times their number); the fused score is thresholded."""
    w = F.element_at(F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(v)))), F.col("signal"))
    fused = {"average": F.sum(w * F.col("score")) / F.sum(w), "max": F.max("score"), "borda": F.sum("score") * F.count(F.lit(1))}[how]
    return signals.groupBy("query_id", "key").agg(fused.alias("fused")).filter(F.col("fused") >= min_score)


def composite(pool: DataFrame, as_of_hours: Column) -> DataFrame:
    """pool (query_id, fused, importance) with composite: 0.6 relevance (min-max over the query's pool, 1 where all are equal), 0.2 retention by age alone, 0.2 importance."""
    own = Window.partitionBy("query_id")
    low, high = F.min("fused").over(own), F.max("fused").over(own)
    rel = F.when(high == low, 1.0).otherwise(F.try_divide(F.col("fused") - low, high - low))
    keep = ebbinghaus(as_of_hours, F.lit(0.0), F.lit(0.0), F.lit(0.0))
    a, b, c = COMPOSITE
    return pool.withColumn("composite", a * rel + b * keep + c * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("importance"))))


def rerank_score(overlap: Column, hours: Column, agreement: Column) -> Column:
    """From the share of the question's terms, agreement of vectors and recency; a null agreement shares its weight among the others."""
    wt, we, wr = RERANK["term"], RERANK["embed"], RERANK["recency"]
    plain = wt * overlap + wr * recency_half_life(hours)
    return F.when(agreement.isNull(), plain / (wt + wr)).otherwise(plain + we * agreement)


def feedback_terms(pool: DataFrame, queries: list[tuple[str, str]], rows: int = 5, terms: int = 10) -> DataFrame:
    """query_id, term, n, rank: terms of the best rows that may widen the query (three bytes or more, no number, not in the query)."""
    p = pool.filter(F.col("rank") <= rows).withColumn("query", of_query({i: quoted(q) for i, q in queries}).cast("string"))
    p = p.select("query_id", "query", F.explode(T.tokenize(F.col("value"))).alias("term"))
    p = p.filter((F.octet_length("term") >= 3) & ~F.col("term").rlike("^[0-9]+$") & ~F.array_contains(T.tokenize(F.col("query")), F.col("term")))
    return top(p.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n")), terms, F.desc("n"), F.asc("term"))


def query_embeddings(vectors: DataFrame, query_vectors: dict[str, str]) -> dict[str, list[float]]:
    """The vectors of the rows that stand for the queries; as many as queries, so they are literals of the plan."""
    named = {r.key: list(r.embedding) for r in vectors.filter(F.col("key").isin(sorted(set(query_vectors.values())))).select("key", "embedding").collect()}
    return {q: named[k] for q, k in query_vectors.items() if k in named}


def related(links: DataFrame, keys: DataFrame) -> DataFrame:
    """key, other, strength: the nodes within two hops of each of keys, by the fewest hops and, of those, the strongest path."""
    both = undirected(links.select("src", "dst", "rel_type"))
    one = keys.join(both, keys["key"] == both["node"]).select("key", "other", F.array("rel_type").alias("types"))
    next_ = both.select(F.col("node").alias("other"), F.col("other").alias("far"), "rel_type")
    two = one.join(next_, "other").filter("far <> key").select("key", F.col("far").alias("other"), F.array_append("types", F.col("rel_type")).alias("types"))
    paths = one.unionByName(two).filter("other <> key").withColumn("strength", F.round(relationship_strength(F.col("types"), F.size("types")), 12))
    return paths.groupBy("key", "other").agg(F.max(F.struct(-F.size("types"), F.col("strength"))).alias("best")).select("key", "other", "best.strength")


def graph_signal(candidates: DataFrame, links: DataFrame) -> DataFrame:
    """query_id, key, score: candidates (query_id, key, match) raised by how many and how strong their relations are, and what the best five lead to.

    A candidate gains a tenth for each related node, half at most, and 0.3 of their mean strength; 1 is the most. What only
    a seed leads to gets the seed's score times the strength, of the first seed that does.
    """
    near = materialize(related(links, F.broadcast(candidates.select("key").distinct())), "related")  # as many keys as candidates
    stats = near.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.avg("strength").alias("_s"))
    lifted = graph_score(F.col("match"), F.col("_n"), F.col("_s"))
    own = candidates.join(stats, "key", "left").select("query_id", "key", F.round(lifted, 12).alias("score"))
    seeds = top(own, SEEDS, F.desc("score"), F.asc("key"), name="_seed")
    led = seeds.join(near, "key").select("query_id", F.col("other").alias("key"), "_seed", F.round(F.col("score") * F.least(F.lit(1.0), F.col("strength")), 12).alias("score"))
    led = led.join(own.select("query_id", "key"), ["query_id", "key"], "left_anti").groupBy("query_id", "key").agg(F.min_by("score", "_seed").alias("score"))
    return own.unionByName(led)


def recent_memories(memories: DataFrame, age_hours: Column) -> DataFrame:
    """key, score of the 50 memories of best temporal score: the same for all queries, so ranked once."""
    scored = memories.select("key", F.round(temporal_score(F.floor(age_hours / 24.0), F.col("access_count")), 12).alias("score"))
    return materialize(scored.orderBy(F.desc("score"), "key").limit(PER_SIGNAL), "recent")


def signals(memories: DataFrame, vectors: DataFrame, links: DataFrame, queries: list[tuple[str, str]], embeddings: dict[str, list[float]], recent: DataFrame) -> DataFrame:
    """query_id, signal, key, score: what each retriever finds for itself, its 50 best a query.

    keyword: BM25 over the 100 best substring matches; graph: these and what they lead to; dense: cosine of every vector to
    the query's, 0.3 at least; temporal: recency and use of every memory, as recent_memories() ranks them. A memory need not hold a word of the query.
    """
    keep = lambda df: top(df, PER_SIGNAL, F.desc("score"), F.asc("key"), name="_r", by=("query_id", "signal")).select("query_id", "signal", "key", "score")
    named = lambda df, n: df.select("query_id", F.lit(n).alias("signal"), "key", F.round("score", 12).alias("score"))
    best = match_any_term(spread(memories), queries, 2 * PER_SIGNAL).select("query_id", "key", "value", F.col("score").alias("match"))
    # a hundred narrow rows a question: one task has them all, so that ranks and sums over them take no exchange
    cand = materialize(term_counts(best, queries).drop("value"), "candidates").coalesce(1)
    keyword = named(bm25_of_counts(cand).withColumnRenamed("bm25", "score"), "keyword")
    graph = named(graph_signal(cand.select("query_id", "key", "match"), links), "graph")
    temporal = named(recent.withColumn("query_id", F.explode(F.array(*(F.lit(q) for q, _ in queries)))), "temporal")
    found = keep(keyword.unionByName(graph).coalesce(1)).unionByName(temporal)
    if embeddings:
        e = F.explode(F.array(*(F.struct(F.lit(q).alias("query_id"), V.literal(v).alias("qe")) for q, v in embeddings.items())))
        dense = vectors.select("key", "embedding", e.alias("_q")).select("_q.query_id", "key", F.round(V.cosine(F.col("embedding"), F.col("_q.qe")), 12).alias("score"))
        found = found.unionByName(keep(named(dense.filter(F.col("score") >= DENSE_FLOOR), "dense")))
    return found


def _bounded(df: DataFrame, schema: str) -> DataFrame:
    """df's rows, whose number a parameter bounds, as literals of the plan."""
    say = lambda x: quoted(x) if isinstance(x, str) else f"{x!r}D"
    rows = [f"named_struct({', '.join(f'{quoted(c)}, {say(x)}' for c, x in r.asDict().items())})" for r in df.collect()]
    return df.sparkSession.range(1).select(F.expr(f"inline(cast(array({', '.join(rows)}) as array<struct<{schema}>>))"))


def hybrid_search(memories: DataFrame, vectors: DataFrame, links: DataFrame, queries: list[tuple[str, str]], query_vectors: dict[str, str], as_of: datetime, k: int = 10, weights=WEIGHTS, feedback: bool = True) -> DataFrame:
    """The flagship: query_id, rank, key, fused, composite, rerank_score.

    A question is split into its parts, and the time it speaks of becomes a boost. Each part's signals vote by reciprocal
    rank; parts are joined by the best fused score. Frequent terms of the best five rows widen the question for a second
    retrieval, joined in the same way. The pool of 50 gets composite scores, is put in order by the reranker (terms,
    vectors, recency) and cut to k. All questions go through one plan. Texts are read where memories are, which leaves
    narrow rows, fifty a part: these are ranked in one task, and what the driver sees of them is bounded as well.
    """
    hours = F.expr(f"timestampdiff(SECOND, created_at, timestamp_ntz'{as_of}') / 3600D")
    embeddings = query_embeddings(vectors, query_vectors)
    recent = recent_memories(memories, hours)
    asked = of_query({i: quoted(q) for i, q in queries})
    boost = F.lit(1.0)
    for i, q in queries:
        if span := temporal_range(q, as_of):
            lo, hi = (F.lit(f"{x.year:04d}-{x:%m-%d} 00:00:00").cast("timestamp_ntz") for x in span)
            hit = (F.col("created_at") >= lo) & (F.col("created_at") < hi)
            if years := re.findall(r"\b(?:19|20)[0-9]{2}\b", q):
                hit |= F.col("value").rlike(f"(^|[^0-9])({'|'.join(years)})([^0-9]|$)")
            boost = F.when((F.col("query_id") == i) & hit, BOOST).otherwise(boost)

    def retrieve(qs: list[tuple[str, str]], raised: Column, *also: str) -> DataFrame:
        """query_id, key, fused, hours, importance, overlap (and more of memories' columns) of the best fifty a part."""
        own = {i: embeddings[i.split("/")[0]] for i, _ in qs if i.split("/")[0] in embeddings}
        fused = fuse_rrf(signals(memories, vectors, links, qs, own, recent).coalesce(1), weights)
        pool = top(fused, PER_SIGNAL, F.desc("fused"), F.desc("weighted"), F.asc("key"), name="_p")
        best = pool.withColumn("query_id", F.split("query_id", "/")[0]).groupBy("query_id", "key").agg(F.max("fused").alias("fused"))
        rows = memories.join(F.broadcast(_bounded(best, "query_id: string, key: string, fused: double")), "key")
        overlap = T.term_overlap(F.col("_asked"), F.col("value"))
        return materialize(rows.withColumn("_asked", asked.cast("string")).select("query_id", "key", F.round(F.col("fused") * raised, 12).alias("fused"), hours.alias("hours"), "importance", overlap.alias("overlap"), *also), "pool")

    narrow = ["query_id", "key", "fused", "hours", "importance", "overlap"]
    cut = lambda df: top(df.coalesce(1), PER_SIGNAL, F.desc("fused"), F.asc("key"), name="rank")
    parts = [(f"{i}/{n}", part) for i, q in queries for n, part in enumerate(split_multi_part(q))]
    found = retrieve(parts, boost, *["value"] * feedback)
    pool = cut(found.select(*narrow))
    if feedback:
        first = F.broadcast(pool.filter(F.col("rank") <= FEEDBACK_ROWS).select("query_id", "key", "rank"))  # five rows a question
        terms = feedback_terms(found.join(first, ["query_id", "key"]), queries, FEEDBACK_ROWS, FEEDBACK_TERMS).select("query_id", "term", "rank").collect()  # ten a question
        more = {i: " ".join(t.term for t in sorted(terms, key=lambda t: t.rank) if t.query_id == i) for i, _ in queries}
        if wider := [(i, f"{q} {more[i]}") for i, q in queries if more[i]]:
            both = pool.select(*narrow).unionByName(retrieve(wider, F.lit(1.0))).coalesce(1)
            pool = cut(both.groupBy("query_id", "key", "hours", "importance", "overlap").agg(F.max("fused").alias("fused")))
    agreement = F.lit(None).cast("double")
    pool = composite(pool, F.col("hours"))
    if embeddings:
        near = vectors.join(F.broadcast(pool.select("key").distinct()), "key", "left_semi").select("key", "embedding")
        pool = pool.join(F.broadcast(near), "key", "left")  # a vector for each row of the pool at most
        for i, v in embeddings.items():
            own = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(V.cosine(F.col("embedding"), V.literal(v)), F.lit(0.0))))
            agreement = F.when(F.col("query_id") == i, own).otherwise(agreement)
    scored = pool.withColumn("rerank_score", rerank_score(F.col("overlap"), F.col("hours"), agreement)).drop("rank")
    ordered = top(scored, k, F.desc(F.round("rerank_score", 12)), F.asc("key"))
    return ordered.select("query_id", "rank", "key", "fused", F.round("composite", 9).alias("composite"), F.round("rerank_score", 9).alias("rerank_score"))
