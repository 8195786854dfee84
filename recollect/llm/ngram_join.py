"""Self-join of documents by the Jaccard similarity of their word n-grams: rare-first prefixes, then one check a pair.

A document's distinct n-grams are ordered by how often their cell of a count sketch was hit in the whole corpus (to an
eighth of a binary magnitude), then by hash. Two sets that are similar enough share an n-gram of their prefixes, within the length and positional bounds; each
such pair is checked once on the whole texts, after a suffix bound. Components need not every link: pairs that links
found so far connect anyway are not formed.
"""
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.cells import packed_bytes
from recollect.operators.components import connected_components
from recollect.session import materialize

#: Words of an n-gram, and the least 100 * intersection / union.
WORDS, PERCENT = 4, 85
#: The count sketch has a cell for so many n-grams of the corpus, but no fewer and no more cells than these powers of two;
#: a cell is a byte, and the sketch is sent to the tasks, so 16 MB at most.
PER_CELL, LEAST_LOG2, MOST_LOG2 = 512, 18, 24
#: N-grams to a hash range of the suffix bound, and most ranges.
PER_RANGE, RANGES_LOG2 = 4, 12
#: A fixed odd multiplier for hashes of byte strings, from a fixed generator with the table for bytes.
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (int(_RANDOM.integers(2**58, 2**61)) * 8 + 5) % 2**64
_INVERSE = pow(_BASE, -1, 2**64)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as a text has needed."""

    def __init__(self):
        self.n = 0
        self.up = self.down = np.empty(0, np.uint64)

    def reach(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 14)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                a = np.full(self.n, np.uint64(base))
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))


def _mix(h: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def ngram_hashes(text: str | None, powers: Powers, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word n-grams, ascending; of the whole sequence if it has fewer words; none without words.

    bytes.lower() changes A-Z only and bytes.split() splits at the bytes 9-13 and 32, which no longer character contains.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    whole = b" ".join(w)
    powers.reach(len(whole) + 1)
    sums = np.zeros(len(whole) + 1, np.uint64)
    np.cumsum(_BYTE[np.frombuffer(whole, np.uint8)] * powers.up[: len(whole)], dtype=np.uint64, out=sums[1:])
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = min(words, len(w))
    a, b = starts[: len(w) - n + 1], ends[n - 1 :]
    return np.unique(_mix((sums[b] - sums[a]) * powers.down[a] + (b - a).astype(np.uint64)))


def _cell(h: np.ndarray, log2: int) -> np.ndarray:
    return (h >> np.uint64(64 - log2)).astype(np.int64)


def range_counts(h: np.ndarray) -> np.ndarray:
    """How many hashes lie in each of equal ranges, a power of two of them that grows with the set."""
    log2 = min(RANGES_LOG2, max(1, (len(h) // PER_RANGE).bit_length()))
    return np.minimum(np.bincount((h >> np.uint64(64 - log2)).astype(np.int64), minlength=1 << log2), 65535).astype("<u2")


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the n-grams that only one of two sets holds, from their range_counts."""
    if len(x) < len(y):
        x, y = y, x
    x = x.astype(np.int64).reshape(len(y), -1).sum(axis=1)
    return int(np.abs(x - y).sum()) if x.max(initial=0) < 65535 and y.max(initial=0) < 65535 else 0


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    return (t.as_py() for t in batch.column("text"))


def sketch_log2(documents: DataFrame) -> tuple[int, int]:
    """The power of two of the sketch's cells, and how many tasks should count so that each fills its cells several times over."""
    size = documents.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    grams = size // 6  # bytes of a word and its space, about; only the speed depends on it
    log2 = min(MOST_LOG2, max(LEAST_LOG2, (grams // PER_CELL).bit_length()))
    return log2, max(1, grams // (4 << log2))


def sketch_counts(documents: DataFrame, words: int = WORDS) -> np.ndarray:
    """How many documents' n-grams fall in each of 2**k cells, over all documents, as bytes: eight times the binary logarithm.

    The bytes are put together in tasks, so 2**MOST_LOG2 of them at most meet on the driver, and no rows of cells. With
    cells beyond the least size tasks are merged, for each task sends every cell that it hits.
    """
    log2, tasks = sketch_log2(documents)

    def count(batches):
        powers, cells = Powers(), np.zeros(1 << log2, np.int64)
        for batch in batches:
            for t in _texts(batch):
                np.add.at(cells, _cell(ngram_hashes(t, powers, words), log2), 1)
        hit = np.flatnonzero(cells)
        for k in range(0, len(hit), 1 << 16):
            part = hit[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(cells[part])], ["cell", "n"])

    texts = documents.select("text")
    if log2 > LEAST_LOG2:
        texts = texts.coalesce(tasks)
    level = F.least(F.lit(255), F.round(8 * F.log2(F.sum("n") + 1))).cast("short")
    found = texts.mapInArrow(count, "cell int, n long").groupBy("cell").agg(level.alias("level"))
    return np.frombuffer(packed_bytes(found, "cell", "level", 1 << log2), np.uint8)


def prefixes(documents: DataFrame, counts: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (distinct n-grams), same (16 bytes, equal for equal sets; null for empty ones), prefix (array<long>, rare first), ranges (range_counts)."""
    names = ["doc_id", "n", "same", "prefix", "ranges"]
    log2 = len(counts).bit_length() - 1

    def make(batches):
        powers = Powers()
        for batch in batches:
            n, same, prefix, ranges = [], [], [], []
            for t in _texts(batch):
                h = ngram_hashes(t, powers, words)
                n.append(len(h))
                same.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                order = np.lexsort((h, counts[_cell(h, log2)]))[: len(h) - (percent * len(h) + 99) // 100 + 1] if len(h) else slice(0)
                prefix.append(h[order].view(np.int64))
                ranges.append(range_counts(h).tobytes())
            flat = np.concatenate([np.empty(0, np.int64), *prefix])
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(same, pa.binary()), lists, pa.array(ranges, pa.binary())], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, n long, same binary, prefix array<long>, ranges binary")


def bounds(n: Column, pos: Column, m: Column, pos2: Column, percent: int = PERCENT) -> Column:
    """Whether sets of n and m n-grams whose first common one stands at pos and pos2 (from 0) can still be similar enough."""
    length = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    return length & ((F.least(n - pos, m - pos2)) * (100 + percent) >= (n + m) * percent)


def likely_pairs(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of pairs(a, b) that the suffix bound leaves: what ranges of hashes show on one side only is no intersection. Drops no similar pair."""
    left, right = (sets.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("ranges").alias(f"ranges_{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "ranges_a", "ranges_b")

    def check(batches):
        for batch in batches:
            keep = []
            for n, x, y in zip(batch.column("n").to_pylist(), batch.column("ranges_a").to_pylist(), batch.column("ranges_b").to_pylist(), strict=True):
                most = (n - apart(np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2"))) // 2
                keep.append(most * 100 >= percent * (n - most))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def similar_pairs(pairs: DataFrame, documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Those of pairs(a, b) of doc_ids whose whole texts are similar enough; each checked once."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    left, right = (texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def check(batches):
        powers = Powers()
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                x, y = (ngram_hashes(t.as_py(), powers, words) for t in (ta, tb))
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(same > 0 and same * 100 >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a long, b long").distinct()


def jaccard_components(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of documents(doc_id, text); others columns are not read.

    Null and wordless texts are empty sets, linked with nothing: component_id is their own doc_id. Equal sets are one
    class, whose smallest doc_id stands for it in all that follows, so copies form no pairs. Rows that share a doc_id
    are one document with several texts (an empty one stands alone). A null doc_id takes its component from its class
    and is never one's name.
    An empty table gives no rows.

    First, members of each prefix n-gram are paired with one hub, the member that holds it earliest in its order (a
    group's most usual text); then members of the same n-gram that are not yet connected are paired with each other.
    Nothing is capped. Hashes have 64 bits: two different n-grams of one pair meet with a chance of about
    n**2 / 2**64. Tables between the steps are written to the shared folder.
    """
    docs = documents.select("doc_id", "text")
    sets = materialize(prefixes(docs, sketch_counts(docs, words), words, percent), "prefixes")
    classes = sets.filter("same IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("id"))
    heads = sets.join(classes.filter("id IS NOT NULL").withColumnRenamed("id", "doc_id"), ["same", "doc_id"]).select("doc_id", "n", "prefix", "ranges")
    signs = heads.select("doc_id", "n", "ranges")
    grams = heads.select(F.col("doc_id").alias("id"), F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "gram"))
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("gram")
    grams = materialize(grams.join(shared, "gram").distinct(), "shared-grams", release=True)

    hubs = grams.groupBy("gram").agg(F.min(F.struct("pos", "id", "n")).alias("hub"))
    star = grams.join(hubs, "gram").filter(F.col("id") != F.col("hub.id")).filter(bounds(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), percent))
    tried = materialize(star.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct(), "star-pairs")
    likely = materialize(likely_pairs(tried, signs, percent), "star-likely", release=True)
    links = materialize(similar_pairs(likely, docs, words, percent), "star-links", release=True)
    found = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    labelled = grams.join(found, "id", "left").select("gram", "id", "n", "pos", F.coalesce("component", "id").alias("component"))
    labelled = materialize(labelled, "labelled-grams")
    split = labelled.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("gram")
    mine = labelled.join(split, "gram", "left_semi")
    # sets similar enough have lengths of one class or of neighbouring ones, so a frequent n-gram is split by length
    length = F.floor(F.log(F.col("n")) / ((math.log(100 / percent) or 1e-6) * (1 + 1e-9))).cast("int")
    mine = mine.withColumn("length", length)
    theirs = mine.select("gram", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "pos", "component")), F.col("length").alias("own"), F.explode(F.array("length", F.col("length") - 1)).alias("length"))
    rest = mine.join(theirs, ["gram", "length"]).filter("component <> component2 AND (own > length OR id < id2)").filter(bounds(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2"), percent))
    rest = rest.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    likely = materialize(likely_pairs(rest, signs, percent), "other-likely", release=True)
    more = similar_pairs(likely, docs, words, percent)
    every = found.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # rows that share a doc_id but not a set tie their classes together
    named = sets.select("doc_id", "n", "same").join(classes, "same", "left")
    ties = named.filter("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    again = sets.filter("same IS NOT NULL").groupBy("doc_id").agg(F.min("same").alias("x"), F.max("same").alias("y")).filter("doc_id IS NOT NULL AND x <> y").select(F.col("doc_id").alias("u"))
    every = every.unionByName(ties.join(again, "u", "left_semi"))
    component = connected_components(every).withColumnRenamed("component", "least")
    # classes are small; then copies of one text, however many, meet a single row in a join that can be split
    labelled = materialize(classes.join(component, "id", "left").select("same", F.coalesce("least", "id").alias("component_id")), "class-components", release=True)
    words_ = sets.filter("same IS NOT NULL").select("doc_id", "n", "same").join(labelled, "same")
    none = sets.filter("same IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return words_.select("doc_id", "n", "component_id").unionByName(none).withColumnRenamed("n", "n_shingles")


def keep_representatives(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all columns: the smallest doc_id, of rows that share it the text of smallest hash.

    Documents that no link reaches stay, empty ones too; rows with a null doc_id, which nothing names, stay as they are.
    """
    found = jaccard_components(documents, words, percent)
    names = found.filter("doc_id = component_id").select("doc_id").distinct()
    # a row stands in one column, so that no name of its own can clash
    kept = documents.join(names, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.struct("*").alias("row"))
    nth = F.row_number().over(Window.partitionBy("id").orderBy("hash"))
    return kept.withColumn("nth", nth).filter("nth = 1").select("row.*").unionByName(documents.filter("doc_id IS NULL"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, m.c) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) m USING (doc_id)
"""
