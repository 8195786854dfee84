"""Language of each word by a linear-chain conditional random field, and of each text by its words' posteriors."""
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.samples import bounded_ids

#: Documents of each language that are sampled at most, training sequences made of them, and their words.
SAMPLE, SEQUENCES, LENGTH = 300, 4000, 40
#: Cells of the features' weights, words in the lexicon of each language, steps and rate of the training.
CELLS, LEXICON, STEPS, RATE = 1 << 17, 400, 60, 0.3
#: Words whose emissions a task remembers, and words in a block of texts whose chains are followed side by side.
MEMO, BLOCK = 400_000, 200_000
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; none if there is no letter among them."""
    found = _WORD.findall((text or "").lower())
    return found if any(any(map(str.isalpha, w)) for w in found) else []


class _Cells(dict):
    """Name of a feature -> its cell. Character n-grams are few; still, the memory is emptied when it grows large."""

    def __missing__(self, name: str) -> int:
        if len(self) > MEMO:
            self.clear()
        cell = self[name] = zlib.crc32(name.encode()) % CELLS
        return cell


def word_features(word: str, lexicon: dict[str, int], cells: _Cells) -> list[int]:
    """Cells of a word's affixes (edges are marked in the n-grams, and longer ones stand apart), character n-grams, and lexicon entries."""
    w = f"^{word}$"
    names = [w[i : i + 3] for i in range(len(w) - 2)]
    names += [w[i : i + 2] for i in range(0, len(w) - 1)]
    names += [w[:4], w[-4:]]
    if word in lexicon:
        names += [f"={word}", f"={lexicon[word]}"]
    return [cells[n] for n in names]


def forward_backward(emit: np.ndarray, trans: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of chains side by side: emit is (time, chain, state) of log scores; lengths must descend.

    Returns unary posteriors, summed pair posteriors, and the log partition of each chain. A step works on the chains
    that are that long, scaled to sum to one.
    """
    steps, chains, states = emit.shape
    top = emit.max(axis=2, keepdims=True)
    e = np.exp(emit - top)
    t = np.exp(trans)
    alpha, scale = np.zeros_like(e), np.ones((steps, chains))
    live = np.array([np.searchsorted(-lengths, -k, side="left") for k in range(steps)])
    for k in range(steps):
        n = live[k]
        a = e[k, :n] * (np.exp(start) if k == 0 else alpha[k - 1, :n] @ t)
        scale[k, :n] = a.sum(axis=1)
        alpha[k, :n] = a / scale[k, :n, None]
    beta = np.ones_like(e)
    pairs = np.zeros((states, states))
    for k in range(steps - 2, -1, -1):
        n = live[k + 1]
        after = e[k + 1, :n] * beta[k + 1, :n] / scale[k + 1, :n, None]
        pairs += (alpha[k, :n].T @ after) * t
        beta[k, :n] = after @ t.T
    mask = np.arange(steps)[:, None] < lengths[None, :]
    total = ((np.log(scale) + top[:, :, 0]) * mask).sum(axis=0)
    return alpha * beta * mask[:, :, None], pairs, total


@dataclass
class Model:
    """Languages, the lexicon, and the learned weights of features, transitions and starts."""

    langs: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    memo: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None
    cells: _Cells = field(default_factory=_Cells)

    def __getstate__(self):
        return self.__dict__ | {"memo": {}, "rows": None, "cells": _Cells()}

    def emissions(self, words: list[str]) -> np.ndarray:
        """(word, language) scores; those of distinct words are computed once and remembered up to a bound."""
        new = [w for w in dict.fromkeys(words) if w not in self.memo]
        if self.rows is None or len(self.memo) + len(new) > MEMO:
            self.memo, self.rows = {}, np.zeros((1024, len(self.langs)), np.float32)
            new = list(dict.fromkeys(words))
        if new:
            need = len(self.memo) + len(new)
            if need > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(need, 2 * len(self.rows)) - len(self.rows), len(self.langs)), np.float32)])
            cells = [word_features(w, self.lexicon, self.cells) for w in new]
            ends = np.cumsum([len(c) for c in cells])
            flat = np.fromiter((x for c in cells for x in c), np.int64, ends[-1])
            self.rows[len(self.memo) : need] = np.add.reduceat(self.weights[flat], np.concatenate([[0], ends[:-1]]), axis=0)
            self.memo.update(zip(new, range(len(self.memo), need), strict=True))
        return self.rows[np.fromiter((self.memo[w] for w in words), np.int64, len(words))]

    def label_words(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each list of words, the (word, language) posteriors."""
        out: list[np.ndarray] = [np.zeros((0, len(self.langs)))] * len(texts)
        order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            longest = len(texts[order[at]])
            block = order[at : at + max(1, BLOCK // longest)]
            at += len(block)
            emit = np.zeros((longest, len(block), len(self.langs)), np.float32)
            for j, i in enumerate(block):
                emit[: len(texts[i]), j] = self.emissions(texts[i])
            post, _, _ = forward_backward(emit, self.trans, self.start, np.array([len(texts[i]) for i in block]))
            for j, i in enumerate(block):
                out[i] = post[: len(texts[i]), j]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, share of the words' posteriors) of each text; unknown without letters or languages."""
        words = [words_of(t) for t in texts]
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        out = []
        for w, post in zip(words, self.label_words(words), strict=True):
            if len(w):
                p = post.sum(axis=0)
                out.append((self.langs[int(p.argmax())], float(min(1.0, p.max() / p.sum()))))
            else:
                out.append((UNKNOWN, 0.0))
        return out


def fit(rows: list[tuple[str, str]], sequences: int = SEQUENCES, steps: int = STEPS) -> Model:
    """Trains on (text, language) rows by gradient ascent on the likelihood of code-switched sequences.

    A sequence joins stretches of words of documents of any languages, so that transitions between languages, and
    words beside another language's, are learned.
    """
    docs = [(w, y) for t, y in rows if (w := words_of(t))]
    langs = sorted({y for _, y in docs})
    if not langs:
        return Model([], {}, np.zeros((CELLS, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    k = len(langs)
    counts = {y: Counter() for y in langs}
    for w, y in docs:
        counts[y].update(w)
    lexicon: dict[str, int] = {}
    for j, y in enumerate(langs):
        total = sum(counts[y].values())
        for w, n in sorted(counts[y].items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if n / total > max((counts[z][w] / max(1, sum(counts[z].values())) for z in langs if z != y), default=0):
                lexicon[w] = j
    rng = np.random.default_rng(7)
    vocab: dict[str, int] = {}
    seqs, labels = [], []
    by = {y: [w for w, z in docs if z == y] for y in langs}
    for _ in range(sequences):
        ws, ys = [], []
        while len(ws) < LENGTH:
            j = int(rng.integers(k))
            source = by[langs[j]][int(rng.integers(len(by[langs[j]])))]
            n = int(rng.integers(4, LENGTH + 1))
            i = int(rng.integers(max(1, len(source) - n + 1)))
            part = source[i : i + n][: LENGTH - len(ws)]
            ws += [vocab.setdefault(w, len(vocab)) for w in part]
            ys += [j] * len(part)
        seqs.append(ws)
        labels.append(ys)
    x, y = np.array(seqs).T, np.array(labels).T
    names = _Cells()
    cells = [word_features(w, lexicon, names) for w in vocab]
    sizes = np.array([len(c) for c in cells])
    flat = np.concatenate(cells).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(vocab)), sizes)
    weights, trans, start = np.zeros((CELLS, k), np.float32), np.zeros((k, k)), np.zeros(k)
    grads = [np.full_like(weights, 1e-8), np.full_like(trans, 1e-8), np.full_like(start, 1e-8)]
    gold = np.eye(k)[y]
    gold_pairs = np.einsum("tbi,tbj->ij", gold[:-1], gold[1:])
    lengths = np.full(x.shape[1], LENGTH)
    for _ in range(steps):
        emit = np.add.reduceat(weights[flat], offsets, axis=0)[x]
        post, pairs, _ = forward_backward(emit, trans, start, lengths)
        diff = (gold - post).reshape(-1, k)
        by_word = np.stack([np.bincount(x.ravel(), diff[:, j], len(vocab)) for j in range(k)], axis=1)
        g = np.stack([np.bincount(flat, by_word[owner, j], CELLS) for j in range(k)], axis=1)
        steps_of = (g - 0.1 * weights, gold_pairs - pairs - 0.1 * trans, (gold[0] - post[0]).sum(axis=0) - 0.1 * start)
        for a, d, s in zip((weights, trans, start), steps_of, grads, strict=True):
            s += (d * d).astype(s.dtype)
            a += (RATE * d / np.sqrt(s)).astype(a.dtype)
    return Model(langs, lexicon, weights, trans, start)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def sample_rows(documents: DataFrame, each: int = SAMPLE) -> list[tuple[str, str]]:
    """(text, lang) of at most `each` documents of each language, those with the smallest hash of doc_id; none is held out.

    Of rows that share doc_id and lang the least text counts, so that rows are bounded as ids are.
    """
    ids = documents.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang")
    ids = bounded_ids(ids.withColumnRenamed("lang", "_label"), each).withColumnRenamed("_label", "_lang")
    rows = documents.select("doc_id", "text", "lang").filter(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id").filter("lang = _lang").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).toPandas()
    rows = rows.sort_values(["doc_id", "lang"])
    return list(zip(rows["text"].tolist(), rows["lang"].tolist(), strict=True))


def identify(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of documents(doc_id, text, lang).

    Learns from documents whose crc32(doc_id as text) mod 5 is not 0 and whose text and lang are not null. Texts that
    are null or hold no letter are "und" with score 0, as are all if nothing could be learned. Texts are labelled whole,
    word by word; ties go to the first language in code-point order. held_out is false for a null doc_id. Repeated rows
    repeat their result, other columns are not read, and an empty table gives no rows.
    """
    model = fit(sample_rows(documents, sample))
    names = ["doc_id", "held_out", "lang_pred", "score"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                found = model.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def label_words(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, pos, word, lang, score for every word of every text: the labels within code-switched texts."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                words = [words_of(t) for t in part.column("text").to_pylist()]
                rows = [(d, i, w, model.langs[int(p.argmax())], float(p.max())) for d, ws, post in zip(part.column("doc_id").to_pylist(), words, model.label_words(words), strict=True) for i, (w, p) in enumerate(zip(ws, post, strict=True))]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64()), strict=True)], ["doc_id", "pos", "word", "lang", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, pos int, word string, lang string, score double")
