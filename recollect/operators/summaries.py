"""Summaries of many memories: a tree whose levels summarise the level below, concepts of terms that occur together, and plain listings."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import text as T
from recollect.operators.components import connected_components
from recollect.operators.terms import terms_of, with_texts
from recollect.session import materialize

#: Bytes of a sentence that may stand in a summary.
SHORTEST, LONGEST = 21, 199


def telling_sentences(sentences: DataFrame, keep: int) -> DataFrame:
    """node, rank, sentence, score: of sentences(node, sentence) each node's `keep` whose distinct words are rarest among all sentences of the level.

    score is the mean over a sentence's words of ln(sentences / sentences that hold the word). A sentence that repeats in
    a node counts once there; ties go to the lesser sentence.
    """
    s = sentences.filter(F.octet_length("sentence").between(SHORTEST, LONGEST)).distinct()
    # a sentence's words carry 128 bits of it, not its text
    s = materialize(s.withColumn("id", F.unhex(F.md5(F.concat_ws("\0", "node", "sentence")))), "sentences")
    words = s.select("id", F.explode(T.scan_tokens(F.col("sentence"))).alias("w"))
    df = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    total = F.broadcast(s.agg(F.count(F.lit(1)).alias("all")))  # one row
    scored = words.join(df, "w").join(total).groupBy("id").agg(F.round(F.avg(F.log(F.col("all") / F.col("df"))), 9).alias("score"))
    scored = scored.join(s, "id")
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "sentence"))
    return scored.withColumn("rank", nth).filter(F.col("rank") <= keep).select("node", "rank", "sentence", "score")


def summary_tree(memories: DataFrame, levels: list[tuple[str, Column]], keep: int = 3) -> DataFrame:
    """level, node, parent, rank, sentence, score: summaries of memories(key, value, ..), then of the nodes above, level by level.

    levels: name and column of memories that names a node, from the narrowest up; each node must lie in one of the next
    level. The sentences that a level keeps are all that the next one reads, `keep` a node, so levels shrink. Words are
    weighed anew among a level's sentences. Texts without a sentence of fitting length have no node; a null in a
    level's column is a node of that name, 'none'.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    first, *above = levels
    rows = memories.select(name(first[1]).alias("node"), *(name(c).alias(f"up{i}") for i, (_, c) in enumerate(above)), F.explode(T.long_sentences(F.col("value"))).alias("sentence"))
    paths = [f"up{i}" for i in range(len(above))]
    # nodes and those above them; a node's path is one
    tree = materialize(memories.select(name(first[1]).alias("node"), *(name(c).alias(f"up{i}") for i, (_, c) in enumerate(above))).groupBy("node").agg(*(F.min(p).alias(p) for p in paths)), "summary-paths")
    out, at = None, rows.select("node", "sentence")
    for i, (level, _) in enumerate(levels):
        kept = materialize(telling_sentences(at, keep), f"summary-{level}")
        up = paths[i] if i < len(paths) else None
        with_parent = kept.join(tree.select("node", F.col(up).alias("parent")), "node") if up else kept.withColumn("parent", F.lit(None).cast("string"))
        part = with_parent.select(F.lit(level).alias("level"), "node", "parent", "rank", "sentence", "score")
        out = part if out is None else out.unionByName(part)
        if up:
            at = with_parent.select(F.col("parent").alias("node"), "sentence")
            tree = tree.groupBy(F.col(up).alias("node")).agg(*(F.min(p).alias(p) for p in paths[i + 1 :])) if paths[i + 1 :] else tree.select(F.col(up).alias("node")).distinct()
            tree = materialize(tree, "summary-paths")
    return out


def key_terms(memories: DataFrame, terms: int = 5, least: int = 4) -> DataFrame:
    """key, term, rank: each memory's terms of highest tf * ln(memories / memories that hold it), of `least` bytes or more and held by two memories at least."""
    total = F.broadcast(memories.agg(F.count(F.lit(1)).alias("all")))  # one row
    w = with_texts(terms_of(memories, least), 2).withColumnRenamed("t", "term")
    scored = w.join(total).withColumn("score", F.round(F.col("tf") * F.log(F.col("all") / F.col("df")), 9))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", nth).filter(F.col("rank") <= terms).select("key", "term", "rank")


def concepts(memories: DataFrame, terms: int = 5, together: int = 2, jaccard: float = 0.3, of: DataFrame | None = None) -> DataFrame:
    """term, concept (its least term): key terms that occur together in `together` memories and in a share `jaccard` of those that either is a key term of.

    A memory has `terms` key terms, so it gives few pairs however long it is; a term that none goes with is a concept of its own.
    `of` has the key terms, if they are known.
    """
    k = materialize(key_terms(memories, terms).select("key", "term"), "key-terms") if of is None else of
    n = k.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    own = k.groupBy("key").agg(F.sort_array(F.collect_list("term")).alias("ts"))  # `terms` a key
    pairs = own.select(F.explode("ts").alias("u"), "ts").select("u", F.explode("ts").alias("v")).filter("u < v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= together)
    pairs = pairs.join(n.select(F.col("term").alias("u"), F.col("n").alias("nu")), "u").join(n.select(F.col("term").alias("v"), F.col("n").alias("nv")), "v")
    links = pairs.filter(F.col("c") >= jaccard * (F.col("nu") + F.col("nv") - F.col("c"))).select("u", "v")
    found = connected_components(links).withColumnRenamed("id", "term")
    return n.join(found, "term", "left").select("term", F.coalesce("component", "term").alias("concept"))


def concept_summary(memories: DataFrame, terms: int = 5, together: int = 2, jaccard: float = 0.3) -> DataFrame:
    """concept, n_terms, n_memories, lead (the first five words of its most telling memory): memories by the concept that most of their key terms belong to.

    Ties go to the lesser concept; memories without key terms belong to none. The most telling memory has most terms of
    the concept, then the least key.
    """
    k = materialize(key_terms(memories, terms).select("key", "term"), "key-terms")
    of = materialize(concepts(memories, terms, together, jaccard, k), "concepts")
    held = k.join(of, "term").groupBy("key", "concept").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "concept"))
    best = held.withColumn("_nth", nth).filter("_nth = 1")
    groups = best.groupBy("concept").agg(F.count(F.lit(1)).alias("n_memories"), F.min(F.struct((-F.col("n")).alias("n"), "key"))["key"].alias("key"))
    lead = F.concat(F.array_join(F.slice(T.words(F.col("value")), 1, 5), " "), F.lit("..."))
    sizes = of.groupBy("concept").agg(F.count(F.lit(1)).alias("n_terms"))
    return groups.join(sizes, "concept").join(memories.select("key", lead.alias("lead")), "key").select("concept", "n_terms", "n_memories", "lead")


def sections(lines: DataFrame, section: str, *order: str) -> DataFrame:
    """lines with section and pos, their place in it from 1. Ranges of the order are sorted side by side, so a section may hold all rows; only counts of ranges meet."""
    ranged = materialize(lines.withColumnRenamed(section, "section").repartitionByRange("section", *order).withColumn("_part", F.spark_partition_id()), "sections")
    sizes = ranged.groupBy("section", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("section").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("section", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part", "section").orderBy(*order))
    return ranged.withColumn("_nth", inside).join(sizes, ["section", "_part"]).withColumn("pos", F.col("_nth") + F.col("_before")).drop("_part", "_nth", "_before")
