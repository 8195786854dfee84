"""Toxicity of restored text: a Viterbi search through character lattices undoes leetspeak, spacing and repetition."""
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.session import materialize

#: Entries that a task counts before it hands the counts on.
COUNTED = 500_000
#: Letters that a character may stand for besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i"}
#: Log-probabilities of the channel: a letter shown as it is, as a sign, shown again, followed by a separator; a separator that ends a word.
KEPT, SIGN, AGAIN, SEPARATED, BREAK = math.log(0.9), math.log(0.05), math.log(0.08), math.log(0.3), math.log(0.3)
#: Words whose result a task remembers; beyond, the memory is emptied.
MEMO = 400_000
#: Characters of a token up to which may_hold() is asked before its lattice is searched.
BOUNDED = 48
_EDGE = "\"#%&'()*,.:;<=>?[]^_`{}~!$|+-/\\…“”«»¿¡"
#: What gives a token's lattice a second path: a sign that may be a letter, a separator, a letter that may repeat the one before.
_MANY_PATHS = re.compile(r"[0-9@$!|+(€£¡.\-_*]|(.)\1")
#: Runs of pieces of up to three characters with one or more separators between them, which may be one word or several.
_SPLIT_UP = re.compile(r"(?<![^\s\"'(«“])[^\s.\-_*,;:?\"]{1,3}(?:[\s.\-_*]+[^\s.\-_*,;:?\"]{1,3})+(?=[.\-_*\"',;:?!)»”…]*(?:\s|$))")
_SEPARATORS = re.compile(r"[\s.\-_*]+")


def trigrams(words: Counter) -> Counter:
    """How often each three characters follow each other in words, with their ends marked."""
    out: Counter = Counter()
    for w, n in words.items():
        s = f"^^{w}$"
        for i in range(2, len(s)):
            out[s[i - 2 : i + 1]] += n
    return out


class CharModel:
    """Trigrams of the characters of words, backing off to pairs and single characters."""

    def __init__(self, words: Counter, runs: Counter | None = None):
        """runs: what trigrams() gives of the words, if that was counted elsewhere."""
        self.tri, self.two, self.one = trigrams(words) if runs is None else runs, Counter(), Counter()
        for k, n in self.tri.items():
            self.two[k[1:]] += n
            self.one[k[2]] += n
        self.before: Counter = Counter()
        for k, n in self.tri.items():
            self.before[k[:2]] += n
        self.before1: Counter = Counter()
        for k, n in self.two.items():
            self.before1[k[:1]] += n
        self.n = sum(self.one.values())
        self.memo: dict[str, float] = {}

    def __call__(self, before: str, c: str) -> float:
        k = before + c
        if (p := self.memo.get(k)) is None:
            one = (self.one[c] + 0.1) / (self.n + 10)
            two = (self.two[k[1:]] + 2 * one) / (self.before1[k[1]] + 2)
            p = self.memo[k] = math.log((self.tri[k] + 2 * two) / (self.before[k[:2]] + 2))
        return p


def restore(token: str, lm: CharModel) -> str:
    """The likeliest words behind a token: a path through its lattice, whose states are the last two characters of the word.

    Each character of the token stands for itself or a letter it resembles, repeats the letter before, separates two
    letters, or separates two words.
    """
    paths: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    known = lm.memo
    for c in token:
        new: dict[str, tuple[float, tuple | None]] = {}
        separates = c in ".-_* "
        own = [] if separates or c in LEET and not c.isalnum() else [(c, KEPT)]
        if c in LEET:
            own += [(x, SIGN) for x in LEET[c]]
        for state, (p, path) in paths.items():
            for x, cost in own:
                if (q := known.get(state + x)) is None:
                    q = lm(state, x)
                q += p + cost
                if (to := state[1] + x) not in new or q > new[to][0]:
                    new[to] = (q, (x, path))
                if x == state[1] and (state not in new or p + AGAIN > new[state][0]):
                    new[state] = (p + AGAIN, path)
            if separates:
                if state not in new or p + SEPARATED > new[state][0]:
                    new[state] = (p + SEPARATED, path)
                if path and path[0] != " ":
                    q = p + BREAK + lm(state, "$")
                    if "^^" not in new or q > new["^^"][0]:
                        new["^^"] = (q, (" ", path))
        paths = new or paths
    best = max(paths.items(), key=lambda x: (x[1][0] + lm(x[0], "$"), x[0]))[1][1]
    out = []
    while best:
        out.append(best[0])
        best = best[1]
    return "".join(reversed(out))


def may_hold(features: Iterable[str]) -> re.Pattern:
    """What a token matches if some path through its lattice gives a word that begins with one of the features' letters.

    A letter may be shown as it is or as a sign, again and again, with separators after it; a word begins at the token's
    start or after a separator.
    """
    shown: dict[str, set[str]] = defaultdict(set)
    for c, letters in LEET.items():
        for x in letters:
            shown[x].add(c)

    def one(word: str) -> str:
        out = []
        for x in word:
            chars = "".join(map(re.escape, sorted(shown.get(x, set()) | (set() if x in ".-_* " or x in LEET and not x.isalnum() else {x}))))
            out.append(f"[{chars}][{chars}.\\-_* ]*" if chars else "(?!)")
        return "".join(out)

    return re.compile("(?:^|[.\\-_* ])(?:" + "|".join(sorted({one(f.lstrip("=")) for f in features}) or ["(?!)"]) + ")")


def restored_words(text: str, lm: CharModel, memo: dict[str, str], may: re.Pattern | None = None) -> set[str]:
    """The distinct words of a text, lower-cased, with what hides in them and in runs of short pieces restored; a word with one path stays.

    may: a token that it doesn't match is left out unread, for none of its paths leads to a word of interest. The bound
    is for short tokens: on long ones it could take longer than the search that it saves.
    """
    worth = lambda t: may is None or len(t) > BOUNDED or may.search(t) is not None
    text = text.lower()
    tokens = set(text.split())
    tokens.update(_SEPARATORS.sub(" ", m.group()) for m in _SPLIT_UP.finditer(text))
    out = set()
    for t in tokens:
        if (w := memo.get(t)) is None:
            # signs at the edges are letters or punctuation: read both ways
            bare = t.strip(_EDGE)
            inner = t.strip("\"#%&'*,.:;<=>?[]^_`{}~-/\\…“”«»¿ ")
            if not bare or not (_MANY_PATHS.search(bare) or " " in bare):
                w = bare
            else:
                w = restore(bare, lm) if worth(bare) else ""
            if inner != bare and _MANY_PATHS.search(inner) and worth(inner):
                w += " " + restore(inner, lm)
            if len(memo) >= MEMO:
                memo.clear()
            memo[t] = w
        if w:
            out.update(w.split() if " " in w else (w,))
    return out


def word_features(word: str) -> list[str]:
    """The word and its beginnings of four to six letters."""
    return [f"={word}", *(word[:k] for k in (4, 5, 6) if len(word) > k)]


@dataclass
class Model:
    """Log-odds that features of restored words add to the prior's."""

    lm: CharModel
    prior: float
    weights: dict[str, float]
    memo: dict[str, str] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    may: re.Pattern | None = None

    def __post_init__(self):
        self.may = may_hold(self.weights)

    def __getstate__(self):
        return {"lm": self.lm, "prior": self.prior, "weights": self.weights, "memo": {}, "words": {}, "may": self.may}

    def weigh(self, word: str) -> float:
        if (w := self.words.get(word)) is None:
            if len(self.words) >= MEMO:
                self.words.clear()
            w = self.words[word] = max((self.weights.get(f, 0.0) for f in word_features(word)), default=0.0)
        return w

    def score(self, text: str | None) -> float:
        """Of the three words that weigh most: a long text has no more chances than a short one to add up little weights."""
        found = sorted(filter(None, map(self.weigh, restored_words(text or "", self.lm, self.memo, self.may))), reverse=True)[:3]
        return 1 / (1 + math.exp(-(self.prior + sum(found))))


def least_shingles(text: str) -> list[int]:
    """The three least hashes of a text's four-word shingles. A text that shares one with an earlier one says nothing new."""
    w = text.lower().split()
    return sorted({xxhash.xxh64_intdigest(" ".join(w[i : i + 4])) for i in range(max(1, len(w) - 3))})[:3]


def _distinct_rows(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Rows without near copies: those that share none of their least shingles with any earlier one."""
    seen: set[int] = set()
    kept = []
    for text, y in rows:
        least = least_shingles(text)
        if not seen & set(least):
            kept.append((text, y))
        seen |= set(least)
    return kept


def letter_words(text: str) -> Iterator[str]:
    return (x for x in (t.strip(_EDGE) for t in text.lower().split()) if x.isalpha())


def _enough(features: int) -> float:
    return math.log(10 * features + 10)


def _weight(clean: int, toxic: int, n: dict[int, int], enough: float) -> float | None:
    """What a feature that so many clean and toxic documents hold adds, or None: its likelihood ratio is one that chance rarely reaches among as many."""
    rate = n[1] / (n[0] + n[1])
    p = toxic / (toxic + clean)
    if toxic > 2 and p > rate:
        gain = toxic * math.log(p / rate) + (clean * math.log((1 - p) / (1 - rate)) if clean else 0)
        odds = math.log((toxic + 0.1) / (n[1] + 0.2)) - math.log((clean + 0.1) / (n[0] + 0.2))
        if gain > enough and odds > 2:
            return min(odds, 6.0)
    return None


def _within(words: Counter, weights: dict[str, float]) -> Counter:
    """How many of toxic documents' words hold a weighed beginning (with ""), and how many of those each longer weighed feature."""
    out: Counter = Counter()
    for w, k in words.items():
        f = word_features(w)
        for short in f[1:]:
            if short in weights:
                out[short, ""] += k
                for long in f:
                    if long in weights and (long[0] == "=" or len(long) > len(short)):
                        out[short, long] += k
    return out


def _model(lm: CharModel, n: dict[int, int], weights: dict[str, float], within: dict[tuple[str, str], int]) -> Model:
    # a beginning whose words nearly all share a longer one, or are one word, says no more than that
    told = {short for (short, long), k in within.items() if long and k >= 0.95 * within[short, ""]}
    weights = {f: w for f, w in weights.items() if f not in told}
    # the prior is that of a document in which none of them stands, and no more than rare
    return Model(lm, min(-2.5, math.log(n[1] / n[0]) - 1), weights)


def fit(rows: list[tuple[str, int]]) -> Model:
    """Features that toxic documents hold far oftener than others, of a few rows; learn() is the same over tables."""
    rows = _distinct_rows(rows)
    letters: Counter = Counter()
    for text, _ in rows:
        letters.update(letter_words(text))
    lm = CharModel(letters)
    memo: dict[str, str] = {}
    n = Counter(y for _, y in rows)
    if not n[0] or not n[1]:
        return Model(lm, -3.0 if not n[1] else 3.0, {})
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    toxic_words: Counter = Counter()
    for text, y in rows:
        words = restored_words(text, lm, memo)
        for f in {f for w in words for f in word_features(w)}:
            counts[f][y] += 1
        if y:
            toxic_words.update(words)
    enough = _enough(sum(1 for a in counts.values() if sum(a) > 2))
    weights = {f: w for f, a in counts.items() if (w := _weight(*a, n, enough)) is not None}
    return _model(lm, n, weights, _within(toxic_words, weights))


def _counted(table: DataFrame, columns: list[str], counts: Callable[[], Callable[[str, int, Counter], None]]) -> DataFrame:
    """How often each key of `columns` is counted over all rows of table(_text, _label): tasks count, and their counts meet.

    counts: gives a task its function (text, label, counter), whose keys are strings, or tuples of one string a column.
    """

    def run(batches):
        put, found = counts(), Counter()

        def out():
            keys = [k if isinstance(k, tuple) else (k,) for k in found]
            return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(len(columns))), pa.array(list(found.values()), pa.int64())], [*columns, "n"])

        for batch in batches:
            for t, y in zip(batch.column("_text"), batch.column("_label"), strict=True):
                put(t.as_py(), y.as_py(), found)
                if len(found) > COUNTED:
                    yield out()
                    found.clear()
        yield out()

    rows = table.select("_text", "_label").mapInArrow(run, ", ".join(f"{c} string" for c in columns) + ", n long")
    return rows.groupBy(*columns).agg(F.sum("n").alias("n"))


def _without_copies(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, _label, _text of every labelled document but near copies of one of smaller doc_id.

    A null label or doc_id is no label, a null text reads as empty. Of rows that share a doc_id the least text counts.
    """
    labels = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("_label"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text")).filter(~_held())
    rows = texts.join(labels, "doc_id").groupBy("doc_id", "_label").agg(F.min("_text").alias("_text"))

    def sign(batches):
        for batch in batches:
            least = [[x - (x >> 63 << 64) for x in least_shingles(t.as_py())] for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.list_(pa.int64()))], ["doc_id", "_label", "_text", "_least"])

    rows = materialize(rows.mapInArrow(sign, "doc_id long, _label int, _text string, _least array<long>"), "toxic-labelled", release=True)
    signs = rows.select("doc_id", F.explode("_least").alias("_sign"))
    copies = signs.join(signs.groupBy("_sign").agg(F.min("doc_id").alias("_first")), "_sign").filter("_first < doc_id").select("doc_id").distinct()
    return materialize(rows.drop("_least").join(copies, "doc_id", "left_anti"), "toxic-learned", release=True)


def learn(documents: DataFrame, labels: DataFrame) -> Model:
    """fit() over every labelled document that is not held out. What reaches the driver is the model: runs of three letters, and weighed features."""
    rows = _without_copies(documents, labels.filter(~_held()))
    n = Counter({r._label: r["count"] for r in rows.groupBy("_label").count().collect()})

    def spell(batches):
        for batch in batches:
            runs = trigrams(Counter(dict(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True))))
            yield pa.RecordBatch.from_arrays([pa.array(list(runs), pa.string()), pa.array(list(runs.values()), pa.int64())], ["run", "n"])

    words = _counted(rows, ["word"], lambda: lambda text, y, found: found.update(letter_words(text)))
    runs = words.mapInArrow(spell, "run string, n long").groupBy("run").agg(F.sum("n").alias("n"))
    lm = CharModel(Counter(), Counter({r.run: r.n for r in runs.collect()}))
    if not n[0] or not n[1]:
        return Model(lm, -3.0 if not n[1] else 3.0, {})

    def features():
        memo: dict[str, str] = {}

        def put(text, y, found):
            found.update((f, str(y)) for f in {f for w in restored_words(text, lm, memo) for f in word_features(w)})

        return put

    both = _counted(rows, ["feature", "label"], features).groupBy("feature").agg(*(F.coalesce(F.sum(F.when(F.col("label") == y, F.col("n"))), F.lit(0)).alias(k) for y, k in (("0", "clean"), ("1", "toxic"))))
    both = materialize(both, "toxic-features", release=True)
    enough = _enough(both.filter("clean + toxic > 2").count())

    def weigh(batches):
        for batch in batches:
            w = [_weight(c.as_py(), t.as_py(), n, enough) for c, t in zip(batch.column("clean"), batch.column("toxic"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("feature"), pa.array(w, pa.float64())], ["feature", "weight"])

    weighed = both.filter(f"toxic > 2 AND toxic > {n[1] / (n[0] + n[1])!r} * (toxic + clean)").mapInArrow(weigh, "feature string, weight double")
    weights = {r.feature: r.weight for r in weighed.filter("weight IS NOT NULL").collect()}

    def shared():
        memo: dict[str, str] = {}
        may = may_hold(f for f in weights if f[0] != "=")

        def put(text, y, found):
            found.update(_within(Counter(restored_words(text, lm, memo, may)), weights))

        return put

    within = {(r.short, r.long): r.n for r in _counted(rows.filter("_label = 1"), ["short", "long"], shared).collect()}
    return _model(lm, n, weights, within)


def _held() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents(doc_id, text).

    Learns labels.toxic from every labelled document whose crc32(doc_id as text) mod 3 is not 1, and from no other.
    Null and empty texts score the prior; without labels of both values nothing is learned. held_out is false
    for a null doc_id. Rows repeat their result if repeated; texts are scored whole.
    """
    model = learn(documents, labels)
    names = ["doc_id", "held_out", "score", "predicted"]

    def run(batches):
        for batch in batches:
            s = [model.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array([int(x >= 0.7) for x in s], pa.int32())], names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _held().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
