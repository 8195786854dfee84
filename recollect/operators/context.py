"""Highlights, contexts, budgets, importance, consolidation and reflection over memories; relations between users."""
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import scores as S
from recollect.functions import text as T
from recollect.operators.components import connected_components
from recollect.operators.terms import terms_of, with_texts
from recollect.session import materialize


#: Fixed weights of the six views of centrality: much used and important, much used, important, others.
CENTRAL = ((0.15, 0.15, 0.15, 0.25, 0.25, 0.05), (0.25, 0.20, 0.15, 0.15, 0.20, 0.05), (0.15, 0.25, 0.15, 0.25, 0.15, 0.05), (0.25, 0.20, 0.20, 0.15, 0.15, 0.05))

#: Users of a block; rows and items of a product of what two blocks hold.
BLOCK, STRIP, WIDTH = 4096, 512, 1024


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string())]))


def highlights(text: Column, query: str, around: int = 50) -> Column:
    """array<struct<start, text>>: matches of query in any case, with up to `around` characters on both sides; none of a null text.

    Pieces between matches give the places; their lengths are summed up once, and a text is cut as characters that
    are reached without counting, so the work grows with the text and its matches.
    """
    pieces = F.split(F.lower(text), F.lit(_literal(query.lower())), -1)
    step = len(query)

    @F.arrow_udf("array<struct<start:int,text:string>>")
    def cut(texts: pa.Array, lengths: pa.Array) -> pa.Array:
        out = []
        for t, n in zip(texts, lengths, strict=True):
            t, n, start, spans = t.as_py() or "", n.as_py() or [], 0, []
            for piece in n[:-1]:
                start += piece
                spans.append({"start": start, "text": t[max(start - around, 0) : max(start - around, 0) + min(start, around) + step + around]})
                start += step
            out.append(spans)
        return pa.array(out, _SPANS)

    return cut(text, F.transform(pieces, F.length))


def _literal(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in s)


def within_budget(rows: DataFrame, budget: int, *order: Column, by=("query_id",)) -> DataFrame:
    """rows(text) in order while the sum of tokens (bytes / 4, rounded up) stays in the budget: the first that doesn't fit ends it."""
    cost = F.ceil(F.octet_length("text") / 4)
    run = F.sum(cost).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("tokens", run).filter(F.col("tokens") <= budget)


def format_context(rows: DataFrame, style: str = "plain") -> DataFrame:
    """A line for each row(key, value): plain, markdown, xml, or a chat message as JSON."""
    line = {
        "plain": F.format_string("%s: %s", "key", "value"),
        "markdown": F.format_string("- **%s**: %s", "key", "value"),
        "xml": F.format_string('<memory key="%s">%s</memory>', "key", F.replace(F.replace("value", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))),
        "openai": F.to_json(F.struct(F.lit("system").alias("role"), F.col("value").alias("content"))),
    }[style]
    return rows.select("key", line.alias("line"))


def importance(memories: DataFrame, links: DataFrame, idle_hours: Column, age_hours: Column) -> DataFrame:
    """key, frequency, recency, centrality, uniqueness, consistency, score: 0.25, 0.2, 0.2, 0.2 and 0.15 of five parts.

    frequency: logistic of the z-score of accesses a day over the store. centrality: six views of a memory's place among
    links(src, dst, strength), weighed by its use and importance. uniqueness: length, distinct words, entropy and words
    of over three bytes. consistency: how near the time since the last access is to that between accesses.
    """
    days = F.greatest(F.floor(age_hours / 24), F.lit(1))
    n, i, v = F.col("access_count"), F.col("importance"), F.col("value")
    words = F.array(T.words(v))
    counts = lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"), F.size(F.filter(w, lambda x: F.octet_length(x) > 3)).alias("m"))
    m = memories.select("key", n, i, F.octet_length(v).alias("size"), F.transform(words, counts)[0].alias("w"), S.character_entropy(v).alias("entropy"), v.rlike("and|between|connects|relates").alias("bridges"),
                        (n / days).alias("daily"), S.importance_recency(idle_hours, age_hours, i, n, F.octet_length(v)).alias("recency"), F.floor(idle_hours).alias("idle"))
    s = F.broadcast(m.agg(F.avg("daily").alias("_m"), F.stddev_pop("daily").alias("_s")))  # one row
    out = links.groupBy(F.col("src").alias("key")).agg(F.count(F.lit(1)).alias("outs"), F.sum("strength").alias("so"))
    into = links.groupBy(F.col("dst").alias("key")).agg(F.count(F.lit(1)).alias("ins"), F.sum("strength").alias("si"))
    m = m.join(s).join(out, "key", "left").join(into, "key", "left").fillna(0, ["outs", "ins", "so", "si"])
    one = lambda c: F.least(F.lit(1.0), c)
    rich, dense = (F.coalesce(F.try_divide(f"w.{k}", "w.n"), F.lit(0.0)) for k in "dm")
    tie = F.least(F.lit(10.0), F.col("so") + F.col("si"))
    views = (
        one((F.col("ins") + F.col("outs")) / 80), tie / 10, one(one(F.col("ins") * F.col("outs") / 1500) + F.when(F.col("bridges"), 0.2).otherwise(0.0)),
        one(tie / 10 + 0.3 * i + F.when(n > 15, 0.2).when(n > 5, 0.1).otherwise(0.0)), one(0.0015 + 0.85 * F.col("ins") / 50 + 0.1 * n / 100),
        one(0.6 * F.when(F.col("size") > 500, 0.8).when(F.col("size") > 100, 0.6).otherwise(0.3) + 0.4 * rich),
    )
    mix = lambda ws: sum((w * c for w, c in zip(ws, views, strict=True)), F.lit(0.0))
    central = F.when((i > 0.8) & (n > 20), mix(CENTRAL[0])).when(n > 15, mix(CENTRAL[1])).when(i > 0.7, mix(CENTRAL[2])).otherwise(mix(CENTRAL[3]))
    unique = 0.2 * F.when(F.col("size").between(50, 2000), 0.4).otherwise(0.8) + 0.3 * rich + 0.3 * F.col("entropy") + 0.2 * dense
    gap = 24 / F.col("daily")
    steady = 1 / (1 + F.exp(-2 * (1 - F.abs(F.col("idle") - gap) / gap))) + F.when(n > 10, 0.2).when(n > 5, 0.1).otherwise(0.0)
    z = F.when(F.col("_s") > 0, (F.col("daily") - F.col("_m")) / F.col("_s")).otherwise(0.0)
    parts = {"frequency": 1 / (1 + F.exp(-z)), "recency": F.col("recency"), "centrality": one(central), "uniqueness": one(unique), "consistency": F.when(n < 2, 0.1).otherwise(one(steady))}
    m = m.select("key", *(c.alias(k) for k, c in parts.items()))
    return m.withColumn("score", S.unit(sum((w * F.col(k) for w, k in zip((0.25, 0.2, 0.2, 0.2, 0.15), parts, strict=True)), F.lit(0.0))))


def distill(groups: DataFrame, scores: DataFrame) -> DataFrame:
    """leader, members, compression, quality of groups(key, leader): one row stays of each, 1 - 1 / members; quality by the mean score, 0.9 from 0.7, 0.8 from 0.5, else 0.6."""
    g = groups.join(scores, "key").groupBy("leader").agg(F.count(F.lit(1)).alias("members"), F.avg("score").alias("mean"))
    return g.select("leader", "members", (1 - 1.0 / F.col("members")).alias("compression"), F.when(F.col("mean") >= 0.7, 0.9).when(F.col("mean") >= 0.5, 0.8).otherwise(0.6).alias("quality"))


def consolidate(memories: DataFrame, scores: DataFrame, floor: float = 0.3) -> DataFrame:
    """key, score, outcome: rows at or over the floor are replayed, others forgotten."""
    return memories.select("key").join(scores, "key").select("key", "score", F.when(F.col("score") >= floor, "replay").otherwise("forget").alias("outcome"))


def reflect(vectors: DataFrame, pairs: DataFrame, least: int = 2) -> DataFrame:
    """cluster, members, coherence, representative: components of similar pairs(a, b, similarity), their mean similarity, and the member with most of it."""
    none = F.lit(None)
    ends = [pairs.select(F.col(x).alias("u"), none.cast(dict(pairs.dtypes)["b"]).alias("v"), F.lit(1).cast("long").alias("n"), F.col("similarity").alias("s")) for x in ("a", "b")]
    return insights(vectors, pairs.select(F.col("a").alias("u"), F.col("b").alias("v"), none.cast("long").alias("n"), none.cast("double").alias("s")).unionByName(ends[0]).unionByName(ends[1]), least)


def insights(vectors: DataFrame, links: DataFrame, least: int = 2) -> DataFrame:
    """The same from what graph.similar_links gives, which holds no pairs: links that join what pairs join, and each member's number of pairs and summed similarity."""
    c = connected_components(links.filter("v IS NOT NULL").select("u", "v"))
    label = vectors.select("key").join(c.withColumnRenamed("id", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("cluster"))
    strength = links.filter("v IS NULL").groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("n"), F.sum("s").alias("sum"))
    own = label.join(strength, "key").withColumn("s", F.round("sum", 9))
    rep = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.min_by("key", F.struct(-F.col("s"), "key")).alias("representative"), F.round(F.sum("sum") / F.sum("n"), 9).alias("coherence"))
    return rep.filter(F.col("members") >= least)


def shared_items(left: pa.Table, right: pa.Table | None, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of left and right (None: left with itself, each pair once) whose items share more than limit of the larger set, and how much, by products of 0/1 matrices."""
    tables = [left] if right is None else [left, right]
    lists = [t.column("items").combine_chunks() for t in tables]
    n = [pc.list_value_length(c).to_numpy() for c in lists]
    names, place = np.unique(np.concatenate([c.flatten().to_numpy() for c in lists]), return_inverse=True)
    flat = np.split(place, [int(n[0].sum())])[: len(tables)]
    rows = [np.repeat(np.arange(len(k)), k) for k in n]
    m, flat, rows = (x if right is not None else x * 2 for x in (n, flat, rows))
    out = []
    for at in range(0, len(m[0]), STRIP):
        size = m[0][at : at + STRIP]
        common = np.zeros((len(size), len(m[1])), np.float32)  # counts up to 2**24 are exact
        for lo in range(0, len(names), WIDTH):
            here = []
            for k, first, count in ((0, at, len(size)), (1, 0, len(m[1]))):
                ok = (flat[k] >= lo) & (flat[k] < lo + WIDTH) & (rows[k] >= first) & (rows[k] < first + count)
                x = np.zeros((count, min(WIDTH, len(names) - lo)), np.float32)
                x[rows[k][ok] - first, flat[k][ok] - lo] = 1
                here.append(x)
            common += here[0] @ here[1].T
        score = common.astype(float) / np.maximum(size[:, None], m[1][None])
        i, j = np.nonzero(score > limit)
        if right is None:
            i, j = i[j > i + at], j[j > i + at]
        out.append((i + at, j, score[i, j]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))


def collaborators(usage: DataFrame, limit: float = 0.5) -> DataFrame:
    """a, b, score of users that share items in usage(user_id, item): shared over the larger set, above a limit.

    Where few items are held by many users nearly all pairs of users share some, so pairs are not made by joining items:
    users lie in blocks, and every two blocks meet in one task, which counts what all their users share. A user is sent
    once to every block, so the exchange is the sets times the number of blocks; no candidate pair is exchanged.
    """
    kind = usage.schema["user_id"].dataType.simpleString()
    u = usage.select("user_id", "item").filter("user_id IS NOT NULL AND item IS NOT NULL").distinct()
    numbers = materialize(u.select("item").distinct().select("item", F.monotonically_increasing_id().alias("i")), "item-numbers")
    sets = materialize(u.join(numbers, "item").groupBy("user_id").agg(F.collect_list("i").alias("items")), "item-sets")
    blocks = max(1, -(-sets.count() // BLOCK))
    block = F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int")
    dealt = sets.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("user_id", "items", "block", F.least("block", "other").alias("g"), F.greatest("block", "other").alias("h"))

    def run(group: pa.Table) -> pa.Table:
        g, h = group.column("g")[0], group.column("h")[0]
        left = group.filter(pc.equal(group.column("block"), g))
        right = None if g == h else group.filter(pc.equal(group.column("block"), h))
        x, y, score = shared_items(left, right, limit) if right is None or len(left) and len(right) else ([], [], [])
        return pa.table({"a": left.column("user_id").take(pa.array(x, pa.int64())), "b": (left if right is None else right).column("user_id").take(pa.array(y, pa.int64())), "score": pa.array(score, pa.float64())})

    found = dealt.groupBy("g", "h").applyInArrow(run, f"a {kind}, b {kind}, score double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


def hashed_tfidf(memories: DataFrame, dims: int = 384) -> DataFrame:
    """key, dim, weight: tf * ln(N / (df + 1)) of tokens hashed into dims, scaled to length 1, as sparse rows. A token's place is hashed once, where it is counted."""
    place = (F.conv(F.substring(F.md5("t"), 1, 8), 16, 10).cast("long") % dims).cast("int")
    n = F.broadcast(memories.agg(F.count(F.lit(1)).alias("every")))
    each = with_texts(terms_of(memories), dim=place).join(n).select("key", "dim", (F.col("tf") * F.log(F.col("every") / (F.col("df") + 1))).alias("w"))
    # dealt by key once, for the sums of a key's places and for its length
    w = each.repartition("key").groupBy("key", "dim").agg(F.sum("w").alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key")))
    return w.withColumn("norm", norm).select("key", "dim", F.coalesce(F.try_divide("w", "norm"), F.lit(0.0)).alias("weight"))


def topological(steps: dict[str, list[str]]) -> list[str]:
    """Steps after all they depend on; a cycle or an unknown step raises."""
    done: list[str] = []
    left = dict(steps)
    while left:
        ready = sorted(k for k, needs in left.items() if all(n in done for n in needs))
        if not ready:
            raise ValueError(f"cycle or unknown step among {sorted(left)}")
        done += ready
        for k in ready:
            del left[k]
    return done


def run_workflow(steps: dict, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """steps: name -> (function of its inputs, names of inputs); inputs are tables or other steps."""
    out = dict(tables)
    for name in topological({k: [n for n in needs if n not in tables] for k, (_, needs) in steps.items()}):
        f, needs = steps[name]
        out[name] = f(*(out[n] for n in needs))
    return out


def regularization(fisher: Column, change: Column, strength: float) -> Column:
    """What holds a parameter near its value: half the strength times its Fisher information times the squared change."""
    return 0.5 * strength * fisher * change * change
