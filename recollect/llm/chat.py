"""Chat formatting: collapse logged snapshots of conversations, keep the maximal ones, render their turns."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one conversation are ranked in chunks of so many turn numbers, so that no conversation must fit one task.
CHUNK = 256
LANES = ("k0", "k1", "k2", "k3")
_LOW = 0xFFFFFFFF


def _lanes(*cols: Column) -> list[Column]:
    """Two 64-bit hashes as four 32-bit lanes, whose sums don't overflow below two thousand million turns."""
    one, two = F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit(2), *cols)
    return [h.alias(k) for k, h in zip(LANES, (one.bitwiseAND(_LOW), F.shiftrightunsigned(one, 32), two.bitwiseAND(_LOW), F.shiftrightunsigned(two, 32)), strict=True)]


def ranked_turns(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """_k, turn, role, text, _rank: turns numbered from 1 within _k, struct<id struct<conv_id>, c, role, start>.

    Turns stand in order of turn (nulls first), then role, then text; rows that repeat one exactly count once. _k is a
    conversation's chunk of turn numbers, or, of turns without a number, those of one role that begin alike; chunks
    ascend as their turns do, so a conversation with a third of all rows is spread over many tasks. A chunk is one
    task's: turn numbers that repeat with different texts are expected to be few. Structs hold nulls but are none, so
    that a null conv_id is an id like any other. This is the one exchange that texts go through.
    """
    unnumbered = lambda c: F.when(F.col("turn").isNull(), c)
    key = F.struct(F.struct("conv_id").alias("id"), F.floor(F.col("turn") / chunk).alias("c"), unnumbered(F.col("role")).alias("role"), unnumbered(F.left("text", F.lit(2))).alias("start"))
    t = conversations.select(key.alias("_k"), "turn", "role", "text")
    w = Window.partitionBy("_k").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    this = F.struct("turn", "role", "text")
    before = F.lag(this).over(w)
    t = t.withColumn("_again", before.isNotNull() & before.eqNullSafe(this)).filter(~F.col("_again")).drop("_again")
    return t.withColumn("_rank", F.row_number().over(w))


def chunk_totals(ranked: DataFrame) -> DataFrame:
    """_k, _before, n_turns: of each chunk, the turns before it, and its conversation's turns."""
    sizes = ranked.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_k.id")
    run = whole.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_k", F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("n_turns"))


def prefix_hashes(ranked: DataFrame, totals: DataFrame) -> DataFrame:
    """_id, pos, n_turns, k0, k1 (two longs): the rolling hash of turns 1..pos, sums modulo 2**32 of hashes keyed by position."""
    h = ranked.join(totals, "_k").withColumn("pos", F.col("_rank") + F.col("_before")).select("_k", "pos", "n_turns", *_lanes(F.col("pos"), F.col("role"), F.col("text")))
    inside = Window.partitionBy("_k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    h = h.select("_k", "pos", "n_turns", *(F.sum(k).over(inside).alias(k) for k in LANES))
    by_chunk = h.groupBy("_k").agg(*(F.max(k).alias(f"_{k}") for k in LANES))
    run = Window.partitionBy("_k.id").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    by_chunk = by_chunk.select("_k", *(F.coalesce(F.sum(f"_{k}").over(run), F.lit(0)).alias(f"_{k}") for k in LANES))
    lane = lambda k: (F.col(k) + F.col(f"_{k}")).bitwiseAND(_LOW)
    two = [F.shiftleft(lane(a), 32).bitwiseOR(lane(b)).alias(c) for a, b, c in (("k0", "k1", "k0"), ("k2", "k3", "k1"))]
    return h.join(by_chunk, "_k").select(F.col("_k.id").alias("_id"), "pos", "n_turns", *two)


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """_id, n_copies of the conversations that are no proper prefix of another; of equal ones the smallest id stays, null last."""
    p = prefixes
    whole = p.filter("pos = n_turns").groupBy("pos", "k0", "k1").agg(F.min("_id.conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = p.filter("pos < n_turns").select("pos", "k0", "k1").distinct()
    return whole.join(inner, ["pos", "k0", "k1"], "left_anti").select(F.struct("conv_id").alias("_id"), "n_copies")


def render(role: Column, text: Column) -> Column:
    """One turn in the chat template. A marker inside a text is broken up, so that a text can't open a turn."""
    inert = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), inert, F.lit("<|end|>\n"))


def format_chats(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rendered turns of maximal conversations: conv_id, pos, n_turns, n_copies, role, rendered.

    Needs columns conv_id, turn, role, text; others are ignored. A snapshot that is a prefix of a longer
    conversation, or equal to one with a smaller id, goes. Null role reads "unknown", null text is empty; a turn
    with a null text differs from one with an empty text. An empty table gives no rows. One row a turn: no
    conversation is gathered into one task. Texts are shuffled once, by chunk; all else carries hashes and counts.
    """
    ranked = ranked_turns(conversations, chunk)
    totals = chunk_totals(ranked)
    kept = maximal_conversations(prefix_hashes(ranked, totals))
    chunks = totals.withColumn("_id", F.col("_k.id")).join(kept, "_id").select("_k", "_before", "n_turns", "n_copies")
    rows = ranked.join(chunks, "_k").withColumn("pos", F.col("_rank") + F.col("_before"))
    return rows.select(F.col("_k.id.conv_id").alias("conv_id"), "pos", "n_turns", "n_copies", "role", render(F.col("role"), F.col("text")).alias("rendered"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
  count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
x AS (SELECT conv_id, pos, n_turns, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY pos) AS pre FROM p),
w AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, pre FROM x WHERE pos = n_turns GROUP BY pre),
m AS (SELECT conv_id, n_copies FROM w WHERE pre NOT IN (SELECT pre FROM x WHERE pos < n_turns))
SELECT p.conv_id, p.pos, p.n_turns, m.n_copies, p.role,
  '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS rendered
FROM p JOIN m ON p.conv_id IS NOT DISTINCT FROM m.conv_id
"""
