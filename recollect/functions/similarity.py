"""String similarities that Spark lacks, as Arrow-batched functions."""
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with a bonus of a tenth for each of up to four common first letters. Letters out of place count half, rounded down."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    common = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        common += 1
    return jaro + common * 0.1 * (1 - jaro)


def damerau_levenshtein(a: str, b: str) -> int:
    """Edits with swaps of neighbours, each part edited once."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[j - 1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows = [*rows[-1:], row]
    return rows[-1][-1]


def dice(a: str, b: str) -> float:
    """Twice the common pairs of letters over all pairs."""
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (a, b))
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else float(a == b)


def trigram(a: str, b: str) -> float:
    x, y = ({s[i : i + 3] for i in range(len(s) - 2)} for s in (a, b))
    return len(x & y) / len(x | y) if x or y else float(a == b)


def word_semantic(a: str, b: str) -> float:
    """Mean, weighted by the root of length, of each word's best match."""
    x, y = a.split(), b.split()
    if not x or not y:
        return 0.0
    weights = [len(w) ** 0.5 for w in x]
    return sum(k * max(jaro_winkler(w, v) for v in y) for w, k in zip(x, weights, strict=True)) / sum(weights)


def combined(a: str, b: str) -> float:
    """0.3 Jaro-Winkler, 0.25 Damerau-Levenshtein, 0.2 Dice, 0.15 trigrams, 0.1 words."""
    longest = max(len(a), len(b))
    edits = 1 - damerau_levenshtein(a, b) / longest if longest else 1.0
    return 0.3 * jaro_winkler(a, b) + 0.25 * edits + 0.2 * dice(a, b) + 0.15 * trigram(a, b) + 0.1 * word_semantic(a, b)


def string_similarity(a: Column, b: Column) -> Column:
    """combined() of two columns; null if either is."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else combined(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def _pairs_alike(a: str, b: str, least: float) -> float | None:
    """combined() if it is at least `least`; letters in twos and threes, which are quickly had, tell of nearly all that it can't be."""
    twos = 0.2 * dice(a, b) + 0.65
    if twos + 0.15 < least - 1e-9 or twos + 0.15 * trigram(a, b) < least - 1e-9:
        return None
    return s if (s := combined(a, b)) >= least else None


def similarity_from(a: Column, b: Column, least: float) -> Column:
    """combined() of two columns where it is at least `least`; else null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _pairs_alike(p, q, least) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run.asNondeterministic()(a, b)  # or a filter on it has it run a second time
