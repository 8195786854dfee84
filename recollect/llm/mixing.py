"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import materialize

#: White space by the contract, the weights in turn, how often a document may be taken.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
#: Words in a block of the schedule, about.
BLOCK = 4096
#: Fractional part of the golden ratio; steps by it visit (0, 1) evenly.
GOLDEN = 0.6180339887498949
#: Slots are ranked in chunks of so many, and cumulative weights are looked up in so many cells.
CHUNK, CELLS = 65536, 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sid, source, source_size, target of each source; one row a source, so its windows may stand in one task.

    Sources in code-point order, null last, weigh `weights` in turn. The targets share all words by weight, none
    above `most` times its source's size: with sources ordered by most * size / weight, those before the level
    where the rest can be shared evenly by weight are full.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = s.select(F.row_number().over(order).alias("sid"), "source", "source_size", w.cast("long").alias("w"), (F.col("source_size") * most).alias("full"))
    fill = Window.orderBy(F.col("full") / F.col("w"), "sid")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("level", level).withColumn("nth", F.row_number().over(fill))
    fits = F.when(F.col("full") >= F.col("level") * F.col("w"), F.struct("nth", "level"))
    s = s.withColumn("level", F.min(fits).over(everything)["level"])
    return s.select("sid", "source", "source_size", F.least(F.col("full").cast("double"), F.col("level") * F.col("w")).alias("target"), F.sum("source_size").over(everything).alias("all_size"))


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """sid, rank, slot, n_slots: which source each slot of the mix reads from, and its how-manieth slot that is.

    Slot i stands at the fraction of i times the golden ratio and belongs to the source whose stretch of the
    cumulative targets holds that point. Each source with words to take has one slot before all others, so that
    the smallest is not missed.
    """
    t = targets.filter("target >= 0.5")
    run = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("sid", F.sum("target").over(run).alias("hi"), "target", F.sum("target").over(Window.partitionBy()).alias("every"))
    t = t.select("sid", ((F.col("hi") - F.col("target")) / F.col("every")).alias("lo"), (F.col("hi") / F.col("every")).alias("hi"), F.ceil(F.col("every") / block).alias("n"))
    cell = lambda c: F.least(F.floor(c * CELLS), F.lit(CELLS - 1)).cast("int")
    stretches = t.select("sid", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    # chunks of slots, then slots: one row becomes many in two steps, on many tasks
    chunks = t.groupBy().agg(F.max("n").alias("n")).filter("n > 0").select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk"))
    slots = chunks.repartition("chunk").select("chunk", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least((F.col("chunk") + 1) * CHUNK, F.col("n")) - 1)).alias("slot"))
    point = F.col("slot") * GOLDEN - F.floor(F.col("slot") * GOLDEN)
    slots = slots.withColumn("at", point).withColumn("cell", cell(F.col("at")))
    found = slots.join(stretches, "cell").filter("at >= lo AND at < hi").select("sid", "chunk", "slot")
    found = found.unionByName(t.select("sid", F.lit(-1).cast("long").alias("chunk"), F.lit(-1).cast("long").alias("slot")))
    ranked = found.withColumn("nth", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")))
    counts = found.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("sid")
    before = own.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(own).alias("n_slots"))
    return ranked.join(counts, ["sid", "chunk"]).select("sid", (F.col("nth") + F.col("before") - 1).alias("rank"), "slot", "n_slots")


def shuffled(documents: DataFrame, seed: str) -> DataFrame:
    """doc_id, source, size, bucket, key of each document: its place in its source's shuffled order, from a hash of doc_id."""
    key = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")).withColumn("bucket", F.left("key", F.lit(3)))


def mix(documents: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK, seed: str = "mix-1") -> tuple[DataFrame, DataFrame]:
    """The mix, and the documents it drew on.

    segments: slot, source, doc_id, row (which document), pass (0, 1, ..), word_from, words: what each slot reads.
    placed: row, doc_id, source, size, source_size, target for every document.

    A source's shuffled documents, read up to `most` times over, are cut at its rounded target into as many blocks
    of equal words as it has slots; the slot of rank k reads block k. So taken words meet the target to the word and
    no document is taken over `most` times. Null texts and sizes of 0 are in placed and in no segment; null sources
    are one source; repeated rows are documents of their own; an empty table gives two empty tables. Offsets in a
    source are sums by bucket of the hash, then within the bucket: no source stands in one task.
    """
    sized = materialize(shuffled(documents, seed), "mix-sizes")
    targets = materialize(source_targets(sized, weights, most), "mix-targets")
    names = targets.select("sid", F.col("source").alias("_s"), "source_size", "target")
    docs = sized.join(names, sized["source"].eqNullSafe(names["_s"])).drop("_s")
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size")
    to_here = inside.rowsBetween(Window.unboundedPreceding, 0)
    docs = docs.withColumn("nth", F.row_number().over(inside)).withColumn("to", F.sum("size").over(to_here))
    buckets = sized.join(names, sized["source"].eqNullSafe(names["_s"])).groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("sid", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = docs.join(buckets, ["sid", "bucket"]).select(
        F.struct("sid", "bucket", "nth").alias("row"), "sid", "doc_id", "source", "size", "source_size", "target", (F.col("before") + F.col("to") - F.col("size")).alias("at")
    )
    # narrow tables, written so that no plan grows large: the driver keeps a plan as often as its stages end
    placed, slots = materialize(placed, "mix-placed"), materialize(schedule(targets, block), "mix-slots")
    lengths = slots.groupBy("sid").agg(F.max("n_slots").alias("n"))
    lengths = targets.join(lengths, "sid").select("sid", "n", F.floor(F.col("target") + 0.5).alias("len"))
    lengths = lengths.select("sid", "n", "len", F.expr("len div n").alias("base"), (F.col("len") % F.col("n")).alias("extra"))
    reads = placed.join(lengths, "sid").filter("size > 0").select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass")
    ).withColumn("lo", F.col("at") + F.col("pass") * F.col("source_size")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("len"))).filter("lo < hi")
    wide = "extra * (base + 1)"
    block_of = lambda p: F.expr(f"CASE WHEN {p} < {wide} THEN ({p}) div (base + 1) ELSE extra + (({p}) - {wide}) div greatest(base, 1) END")
    reads = reads.withColumn("rank", F.explode(F.sequence(block_of("lo"), block_of("(hi - 1)"))))
    start = F.col("rank") * F.col("base") + F.least("rank", "extra")
    end = start + F.col("base") + (F.col("rank") < F.col("extra")).cast("long")
    reads = reads.withColumn("from", F.greatest("lo", start)).withColumn("till", F.least("hi", end))
    segments = reads.join(slots.select("sid", "rank", "slot"), ["sid", "rank"]).select(
        "slot", "source", "doc_id", "row", "pass", (F.col("from") - F.col("lo")).alias("word_from"), (F.col("till") - F.col("from")).alias("words")
    )
    return segments, placed.select("row", "doc_id", "source", "size", "source_size", "target")


def taken_words(documents: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken and source of every document, from the mix's segments."""
    segments, placed = mix(documents, **how)
    none = placed.withColumn("words", F.lit(0).cast("long"))
    # each document's own row carries what describes it; its segments carry words
    lines = none.unionByName(segments.select("row", "words"), allowMissingColumns=True)
    whole = lines.groupBy("row").agg(*(F.max(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")), F.sum("words").alias("taken"))
    return whole.select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed_documents(documents: DataFrame, **how) -> DataFrame:
    """The mixed corpus with the columns of documents: a row for each pass over a document, the last one cut to the words it gives.

    Equal rows are told apart by their share alone. A whole pass keeps the text as it is; a cut one keeps its first words,
    joined by spaces, and n_chars is its length. Documents that the mix does not take are not in it.
    """
    own = [F.col(f"`{c}`") for c in documents.columns]
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("/"), F.md5(F.to_json(F.struct(*own))))
    # a row stands in one column, so that no name of its own can clash
    keyed = documents.select(key.alias("_mix_key"), F.struct(*own).alias("_row"))
    taken = taken_words(keyed.select(F.col("_mix_key").alias("doc_id"), "_row.text", "_row.source"), **how).groupBy(F.col("doc_id").alias("_mix_key")).agg(F.max("size").alias("_mix_size"), F.sum("taken").alias("_mix_taken"))
    taken = materialize(taken, "mix-taken")
    rows = keyed.dropDuplicates(["_mix_key"]).join(taken.filter("_mix_taken > 0"), "_mix_key")
    size, all_words = F.col("_mix_size"), F.col("_mix_taken")
    rows = rows.withColumn("_mix_words", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.ceil(all_words / size)), lambda k: F.least(size, all_words - (k - 1) * size))))
    cut = F.array_join(F.slice(F.regexp_extract_all("_row.text", F.lit(f"({WORD})"), F.lit(0)), 1, F.col("_mix_words").cast("int")), " ")
    whole = F.col("_mix_words") == size
    rows = rows.withColumn("_mix_text", F.when(whole, F.col("_row.text")).otherwise(cut))
    changed = {"text": F.col("_mix_text"), "n_chars": F.when(whole, F.col("_row.n_chars")).otherwise(F.length("_mix_text").cast("long"))}
    return rows.select(*(changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in documents.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  md5('mix-1/' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM s),
w AS (SELECT *, [5, 2, 1][((sid - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 3 AS cap FROM r),
f AS (SELECT *, row_number() OVER o AS nth, ((sum(source_size) OVER ())::BIGINT - coalesce((sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))::DOUBLE
  / ((sum(w) OVER ())::BIGINT - coalesce((sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))::DOUBLE AS lev FROM w WINDOW o AS (ORDER BY cap / w, sid)),
l AS (SELECT arg_min(lev, nth) AS lev FROM f WHERE cap >= lev * w),
t AS (SELECT source, source_size, least(cap::DOUBLE, l.lev * w) AS target FROM f, l),
o AS (SELECT d.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS len,
  coalesce((sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS lo
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, source,
  (greatest(0, least(lo + size, len) - lo) + greatest(0, least(lo + source_size + size, len) - lo - source_size)
   + greatest(0, least(lo + 2 * source_size + size, len) - lo - 2 * source_size))::BIGINT AS taken
FROM o
"""
