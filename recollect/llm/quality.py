"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k on their ratio."""
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.ngram_join import _BYTE, Powers, _mix
from recollect.llm.samples import global_rank, labelled_sample
from recollect.operators.cells import packed_bytes

#: Cells of the models: hashed words, hashed pairs of neighbouring words, and pairs of neighbouring word shapes.
WORDS, PAIRS, SHAPES = 1 << 16, 1 << 16, 1 << 16
CELLS = WORDS + PAIRS + SHAPES
_PARTS = (slice(0, WORDS), slice(WORDS, WORDS + PAIRS), slice(WORDS + PAIRS, CELLS))
#: Labelled documents of each quality that are sampled at most.
SAMPLE = 2000
#: N-grams that a document counts for, however long: the sum of a long text's log-ratios would tell its length more than
#: its kind, and no one cut would fit short and long ones.
EFFECTIVE = 256
#: Fixes the noise.
SEED = "quality-1"
#: Added to each cell, in parts of the whole mass.
SMOOTH = 0.05
#: N-grams of no weight that each text's mean counts besides its own.
PRIOR = 20
#: What losing one good labelled document costs the cut, against keeping one bad one.
COST = 1.0
#: An odd multiplier that tells the first word of a pair from the second.
_SECOND = np.uint64(0x9E3779B97F4A7C15)
_LOWER, _UPPER, _DIGIT, _MARK = 1, 2, 4, 8
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = _LOWER
_CLASS[128:] = _LOWER
_CLASS[65:91] = _UPPER
_CLASS[48:58] = _DIGIT
for _c in b"!\"#$%&()*+/:;<=>?@[\\]^_`{|}~":
    _CLASS[_c] = _MARK


def features(text: str | None, powers: Powers) -> np.ndarray:
    """Cells of a text's words, of its pairs of neighbouring words, and of its pairs of word shapes (letters' cases, digits, marks, and whether a word repeats one of the two before)."""
    w = (text or "").encode("utf-8", "surrogatepass").split()
    if not w:
        return np.empty(0, np.int64)
    whole = np.frombuffer(b" ".join(w), np.uint8)
    powers.reach(len(whole) + 1)
    sums = np.zeros(len(whole) + 1, np.uint64)
    np.cumsum(_BYTE[whole] * powers.up[: len(whole)], dtype=np.uint64, out=sums[1:])
    lengths = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    h = _mix((sums[ends] - sums[starts]) * powers.down[starts] + lengths.astype(np.uint64))
    kinds = _CLASS[whole]
    count = lambda k: np.diff(np.concatenate([[0], np.cumsum(kinds == k)])[np.stack([starts, ends])], axis=0)[0]
    marks, upper, lower = count(_MARK), count(_UPPER), count(_LOWER)
    again = np.zeros(len(w), bool)
    again[1:] |= h[1:] == h[:-1]
    again[2:] |= h[2:] == h[:-2]
    shape = np.minimum(marks, 3) + 4 * np.minimum(upper, 2) + 12 * (lower > 0) + 24 * (count(_DIGIT) > 0) + 48 * again + 96 * np.minimum(lengths // 8, 2)
    shapes = (np.concatenate([[255], shape]) * 320 + np.concatenate([shape, [255]])) % SHAPES
    pairs = _mix(h[:-1] * _SECOND + h[1:])
    cell = lambda x: (x >> np.uint64(48)).astype(np.int64)
    return np.concatenate([cell(h), WORDS + cell(pairs), WORDS + PAIRS + shapes])


@dataclass
class Model:
    """Log-ratio of target to raw by cell, and the mean log-ratio below which a document is unlike the target."""

    ratio: np.ndarray
    cut: float

    def mean(self, cells: np.ndarray) -> float:
        """Mean log-ratio of a text's n-grams and PRIOR more of ratio 0, so that few words say little; that of an empty text is far below any."""
        return float(self.ratio[cells].sum()) / (len(cells) + PRIOR) if len(cells) else -100.0


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    return (t.as_py() for t in batch.column("text"))


def raw_counts(documents: DataFrame) -> np.ndarray:
    """How often each cell occurs in all documents. A fixed number of cells meets on the driver."""

    def count(batches):
        powers, cells = Powers(), np.zeros(CELLS, np.int64)
        for batch in batches:
            for t in _texts(batch):
                cells += np.bincount(features(t, powers), minlength=len(cells)) if t and len(t) > 100_000 else 0
                if t and len(t) <= 100_000:
                    np.add.at(cells, features(t, powers), 1)
        hit = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(cells[hit])], ["cell", "n"])

    found = documents.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return np.frombuffer(packed_bytes(found, "cell", "n", CELLS, "i8"), np.int64)


def cut_between(good: list[float], bad: list[float], cost: float = COST) -> float:
    """The cut that loses fewest good values (below it, each counts `cost`) and keeps fewest bad ones; of equal cuts the one amid the widest gap, then the lowest."""
    if not good or not bad:
        return -50.0
    x = np.array(good + bad)
    order = np.argsort(x, kind="stable")
    x, is_good = x[order], (np.arange(len(order)) < len(good))[order]
    # a cut below x[i] loses the good ones before it and keeps the bad ones from it on
    wrong = np.concatenate([[0], np.cumsum(np.where(is_good, cost, -1.0))]) + len(bad)
    gap = np.concatenate([[0.0], np.diff(x), [0.0]])
    wrong[1:-1][gap[1:-1] == 0] = np.inf  # equal values can't be parted
    i = min(range(len(wrong)), key=lambda i: (wrong[i], -gap[i], i))
    return float(x[0] - 1 if i == 0 else x[-1] + 1 if i == len(x) else (x[i - 1] + x[i]) / 2)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, cost: float = COST) -> Model:
    """The model from labels.quality (1: target) of at most `sample` documents of each value, and from all raw text.

    Without good documents all ratios are 0 and everything is kept; without bad ones nothing is cut but empty texts.
    """
    powers = Powers()
    rows = [(features(t, powers), q) for t, q in labelled_sample(documents, labels, "quality", sample)]
    raw = raw_counts(documents).astype(float)
    target = np.zeros(CELLS)
    for cells, q in rows:
        if q == 1:
            np.add.at(target, cells, 1)
    ratio = np.zeros(CELLS)
    for part in _PARTS:
        t, r = target[part], raw[part]
        if t.sum() and r.sum():
            prior = (r + 1) / (r + 1).sum()  # cells that the target sample lacks lean on the raw model
            t = t / t.sum() * (1 - SMOOTH) + SMOOTH * prior
            ratio[part] = np.log(t) - np.log(prior)
    model = Model(ratio, -50.0)
    model.cut = cut_between([model.mean(c) for c, q in rows if q == 1 and len(c)], [model.mean(c) for c, q in rows if q == 0 and len(c)], cost)
    return model


def _gumbel(doc_id, seed: str) -> float:
    u = (xxhash.xxh64_intdigest(f"{seed}/{doc_id}") >> 11) / 2.0**53
    return -math.log(-math.log(u + 2.0**-54))


def _weights(batch: pa.RecordBatch, model: Model, powers: Powers, seed: str) -> tuple[list[float], list[float]]:
    """log_weight (EFFECTIVE times the mean log-ratio) and gumbel_key (with noise that doc_id alone fixes) of each row."""
    w = [EFFECTIVE * model.mean(features(t, powers)) for t in _texts(batch)]
    return w, [x + _gumbel(d.as_py(), seed) for x, d in zip(w, batch.column("doc_id"), strict=True)]


def weigh(documents: DataFrame, model: Model, seed: str = SEED) -> DataFrame:
    """doc_id, log_weight, gumbel_key of every row."""

    def run(batches):
        powers = Powers()
        for batch in batches:
            w, key = _weights(batch, model, powers, seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w, pa.float64()), pa.array(key, pa.float64())], ["doc_id", "log_weight", "gumbel_key"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, log_weight double, gumbel_key double")


def _ranked(documents: DataFrame, model: Model, seed: str) -> tuple[DataFrame, int]:
    """weigh() with rank, the largest gumbel_key first and ties by doc_id, null first; and how many to keep."""
    ranked = global_rank(weigh(documents, model, seed).withColumn("_k", -F.col("gumbel_key")), "_k", "doc_id", name="quality-ranks")
    return ranked, ranked.agg(F.count_if(F.col("log_weight") >= EFFECTIVE * model.cut)).first()[0]


def quality_sample(documents: DataFrame, labels: DataFrame, seed: str = SEED, k: int | None = None, **how) -> DataFrame:
    """doc_id, log_weight, gumbel_key, rank, kept of every row: a sample without replacement by importance.

    The k largest gumbel_keys are kept (ties to the smaller doc_id, null first), which is sampling k documents in
    proportion to their weights. k is how many to keep; None: as many as have a log_weight that reaches the cut between
    labelled good and bad documents. Null and empty texts
    weigh least of all; repeated rows have one key and are ranked one after the other; an empty table gives no rows.
    """
    ranked, fits = _ranked(documents, fit(documents, labels, **how), seed)
    k = fits if k is None else k
    return ranked.drop("_k").withColumn("kept", (F.col("rank") <= k).cast("int"))


def keep_good(documents: DataFrame, labels: DataFrame, seed: str = SEED, k: int | None = None, **how) -> DataFrame:
    """The documents that quality_sample keeps, with all columns. Keys are made anew from the texts, so no text is shuffled.

    A null text reads as empty, and empty texts go first. Rows with equal keys and doc_ids share their fate: all of them
    stay if one does. Without labels all texts with words stay; an empty table gives no rows.
    """
    model = fit(documents, labels, **how)
    ranked, fits = _ranked(documents, model, seed)
    k = fits if k is None else k
    last = ranked.filter(F.col("rank") == k).select("gumbel_key", "doc_id").first()
    least = (float("inf"), 0) if last is None else (last["gumbel_key"], last["doc_id"])
    order = lambda d: (d is not None, d or 0)

    def run(batches):
        powers = Powers()
        for batch in batches:
            _, keys = _weights(batch, model, powers, seed)
            keep = [k > least[0] or k == least[0] and order(d.as_py()) <= order(least[1]) for k, d in zip(keys, batch.column("doc_id"), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
