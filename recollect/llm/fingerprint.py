"""Document fingerprints: homomorphic hashes of multisets of paragraphs, wide vectors summed lane by lane modulo 2**32."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import materialize

#: Lanes that tell multisets of paragraphs apart, and lanes that carry likeness. All are sums modulo 2**32.
EQUAL, NEAR = 8, 128
LANES = EQUAL + NEAR
_LOW = 0xFFFFFFFF
#: Rows that repeat are written so many to a step.
_STEP = 4096


def _vectors(text: Column, base: int) -> Column:
    """array<long>: the paragraphs' vectors, entry by entry, as base and a code that _entry() reads.

    A paragraph (a line that is not empty) adds 32 bits of its hashes to each EQUAL lane; and, for each of its words with
    the word that follows (the last word: alone), +1 or -1 to the NEAR lane that their hash names. What a lambda uses
    twice is bound to a variable, or it would be computed twice.
    """

    def vector(p: Column) -> Column:
        whole = [F.xxhash64(F.lit(k), p) for k in range(1, EQUAL // 2 + 1)]
        equal = F.array(*((F.shiftleft(F.shiftrightunsigned(h, 32) if j else h.bitwiseAND(_LOW), 4) + (base + 2 * NEAR + 2 * k + j)) for k, h in enumerate(whole) for j in (0, 1)))
        words = F.array(F.split(F.btrim(p, F.lit(" \t\x0b\x0c\r")), r"[\x20\x09-\x0D]+"))
        near = F.transform(words, lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.xxhash64(a, b).bitwiseAND(2 * NEAR - 1) + F.lit(base)))
        return F.concat(equal, near[0])

    return F.flatten(F.transform(F.filter(F.split(text, r"\n"), lambda p: p != ""), vector))


def _entry(code: Column) -> tuple[Column, Column]:
    """The lane of a code, and what it adds there: below 2 * NEAR the lane and sign of words, else an EQUAL lane in 4 bits and 32 bits of a hash."""
    near, equal = code < 2 * NEAR, code - 2 * NEAR
    lane = F.when(near, EQUAL + code.bitwiseAND(NEAR - 1)).otherwise(equal.bitwiseAND(15))
    return lane.cast("int"), F.when(near, 1 - 2 * F.shiftright(code, NEAR.bit_length() - 1)).otherwise(F.shiftright(equal, 4))


def multiset_lanes(df: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """keys, and for each of texts the LANES sums over its paragraphs as {text}_lanes, array<long>; one row for each distinct keys, which may repeat no texts.

    Sums don't depend on order, and combine() adds or removes paragraphs. Texts without a paragraph sum to 0.
    """
    place = 40  # bits of a code; above them stands which of texts it is of
    codes = F.concat(*(_vectors(F.col(t), k << place) for k, t in enumerate(texts)))
    rows = df.select(*keys, F.explode_outer(codes).alias("_c"))
    lane, s = _entry(F.col("_c").bitwiseAND((1 << place) - 1))
    rows = rows.select(*keys, (lane + LANES * F.shiftright("_c", place)).cast("int").alias("lane"), s.alias("s"))
    sums = rows.groupBy(*keys, "lane").agg(F.sum("s").bitwiseAND(_LOW).alias("s"))
    found = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("lane").isNotNull(), F.struct("lane", "s")))).alias("_m"))
    lanes = lambda k: F.expr(f"transform(array(_m), m -> transform(sequence({LANES * k}, {LANES * (k + 1) - 1}), i -> coalesce(try_element_at(m, i), 0L)))[0]")
    return found.select(*keys, *(lanes(k).alias(f"{t}_lanes") for k, t in enumerate(texts)))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes of the union of two multisets (sign 1), or of a without b (sign -1)."""
    return F.zip_with(a, b, lambda x, y: (x + y * sign).bitwiseAND(_LOW))


def packed(lanes: Column) -> Column:
    """Lanes as array<int>, the same 32 bits in half the room for tables and shuffles."""
    return F.transform(lanes, lambda x: F.when(x > 0x7FFFFFFF, x - (_LOW + 1)).otherwise(x).cast("int"))


def unpacked(lanes: Column) -> Column:
    return F.transform(lanes, lambda x: x.cast("long").bitwiseAND(_LOW))


def as_text(lanes: Column) -> Column:
    """8 hex digits for each lane."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """1 where all lanes are equal; else the cosine of the NEAR lanes, 0 at least, read as signed numbers.

    It estimates the cosine of the counts of word pairs, off by about 1 / sqrt(NEAR), 0.09.
    """
    signed = lambda v: F.transform(F.slice(v, EQUAL + 1, NEAR), lambda x: F.when(x > 0x7FFFFFFF, x - (_LOW + 1)).otherwise(x).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(signed(x), signed(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(a == b, 1.0).when(norm == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def next_keys(keys: DataFrame) -> DataFrame:
    """id, th, n, copies and next_id, next_th of distinct (id, th) in ascending order, the last followed by the first.

    Ranges of ids are sorted side by side; only the first row of each range crosses to the range before.
    """
    ranged = materialize(keys.repartitionByRange("id", "th").select("id", "th", "n", "copies", F.spark_partition_id().alias("part")), "fingerprint-order")
    here = F.struct("id", "th")
    firsts = ranged.groupBy("part").agg(F.min(here).alias("first"))
    across = Window.orderBy("part")
    every = Window.partitionBy()
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(across), F.min("first").over(every)).alias("after"))
    follow = ranged.withColumn("next", F.lead(here).over(Window.partitionBy("part").orderBy("id", "th")))
    follow = follow.join(firsts, "part").withColumn("next", F.coalesce("next", "after"))
    return follow.select("id", "th", "n", "copies", F.col("next.id").alias("next_id"), F.col("next.th").alias("next_th"))


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of documents.

    The edited text is the first n - floor(n/2) code points followed by the first floor(n/2) of the next document's.
    Null texts are empty. Documents stand by doc_id, null first; of rows with one doc_id, different texts are different
    documents in an order fixed by a hash, and repeated rows are one document whose result repeats. A lone document is
    its own next. Two empty texts have likeness 1, an empty and another 0. An empty table gives no rows. Other columns
    are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # the last bit of th says that there is no id
    th = F.xxhash64(text).bitwiseAND(-2).bitwiseOR(F.col("doc_id").isNull().cast("long"))
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), th.alias("th"), text.alias("text"))
    keys = docs.groupBy("id", "th", F.length("text").alias("n")).agg(F.count(F.lit(1)).alias("copies"))
    order = materialize(next_keys(keys), "fingerprint-next")
    # rows that repeat meet before they are shuffled; both joins below share that one exchange of texts
    once = docs.groupBy("id", "th").agg(F.first("text").alias("text"))
    heads = order.select(F.col("next_id").alias("id"), F.col("next_th").alias("th"), F.col("id").alias("to_id"), F.col("th").alias("to_th"), "n", "copies")
    heads = once.join(heads, ["id", "th"]).select(F.col("to_id").alias("id"), F.col("to_th").alias("th"), "n", "copies", F.expr("left(text, n div 2)").alias("head"))
    both = once.join(heads, ["id", "th"]).withColumn("stays", F.expr("left(text, n - n div 2)")).withColumn("sha", F.unhex(F.sha2(F.concat("stays", "head"), 256)))
    # the paragraphs that stay whole are summed once for both versions
    both = both.withColumn("cut", F.length("stays") + 1 - F.locate("\n", F.reverse("stays"))).withColumn("cut", F.when(F.contains("stays", F.lit("\n")), F.col("cut")).otherwise(0))
    both = both.select(
        "id", "th", "n", "copies", "sha", F.expr("left(text, cut)").alias("same"), F.expr("substring(text, cut + 1)").alias("old"), F.expr("concat(substring(stays, cut + 1), head)").alias("new")
    )
    whole = multiset_lanes(both, ["id", "th", "n", "copies", "sha"], ["same", "old", "new"])
    whole = whole.select("id", "th", "n", "copies", "sha", packed(combine(F.col("same_lanes"), F.col("old_lanes"))).alias("text_lanes"), packed(combine(F.col("same_lanes"), F.col("new_lanes"))).alias("edited_lanes"))
    whole = materialize(whole, "fingerprint-lanes")
    after = order.select("id", "th", "next_id", "next_th").join(whole.select(F.col("id").alias("next_id"), F.col("th").alias("next_th"), F.col("text_lanes").alias("next_lanes")), ["next_id", "next_th"])
    whole = whole.join(after.select("id", "th", "next_lanes"), ["id", "th"]).withColumns({c: unpacked(F.col(c)) for c in ("text_lanes", "edited_lanes", "next_lanes")})
    whole = whole.select(
        F.when(F.col("th").bitwiseAND(1) == 0, F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"),
        as_text(F.col("text_lanes")).alias("fingerprint"), as_text(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("text_lanes"), F.col("edited_lanes")).alias("near_edited"), likeness(F.col("text_lanes"), F.col("next_lanes")).alias("near_next"), "copies",
    )
    # a row that repeats often is spread before it is written
    many = whole.filter("copies > 1").withColumn("_at", F.explode(F.expr(f"sequence(0L, (copies - 1) div {_STEP})"))).repartition("doc_id", "_at")
    many = many.withColumn("_i", F.explode(F.expr(f"sequence(1L, least({_STEP}L, copies - _at * {_STEP}))"))).drop("_at", "_i")
    return whole.filter("copies = 1").unionByName(many).drop("copies")
