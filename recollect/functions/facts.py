"""Entities, relations and times in texts by rule, and query understanding."""
import re
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verb phrases that relate two entities, and the predicate that each stands for.
PREDICATES = {
    "was born in": "born_in", "is employed by": "works_at", "relocated to": "lives_in", "moved to": "lives_in", "moves to": "lives_in", "lives in": "lives_in", "lived in": "lives_in",
    "resides in": "lives_in", "born in": "born_in", "works at": "works_at", "works for": "works_at", "worked at": "works_at", "worked for": "works_at", "employed by": "works_at", "joined": "works_at",
    "married": "married_to", "visited": "visited", "met": "met", "founded": "founded", "leads": "leads", "manages": "manages",
}
SEASONS = {"spring": (3, 6), "summer": (6, 9), "autumn": (9, 12), "fall": (9, 12), "winter": (12, 15)}
_QUOTED = re.compile(r"\"([^\"]+)\"")
_DATE = re.compile(r"\b\d{4}-\d{2}-\d{2}\b")
_NAME = re.compile(r"\b[A-Z][\w'-]*(?:\s+[A-Z][\w'-]*)*")
_YEAR = re.compile(r"\b(19\d\d|20\d\d)\b")
_CLAUSE = re.compile(r"\?\s*|,?\s+and\s+(?=(?:what|who|when|where|which|how|why)\b)", re.I)


def extract_entities(text: str) -> list[tuple[str, str, int, int]]:
    """(name, kind, start, end) in bytes, in order: quoted spans, dates, then capitalized names that overlap neither."""
    found: list[tuple[str, str, int, int]] = []
    taken: list[tuple[int, int]] = []
    for kind, pattern, group in (("quoted", _QUOTED, 1), ("date", _DATE, 0), ("name", _NAME, 0)):
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                at = len(text[:a].encode())
                found.append((m.group(group), kind, at, at + len(m.group(group).encode())))
    return sorted(found, key=lambda e: e[2])


def normalize_predicate(phrase: str) -> str | None:
    """The predicate of the longest known phrase that the words of a text between two entities end with."""
    words = re.findall(r"[^\W_]+", phrase.lower())
    for n in range(min(3, len(words)), 0, -1):
        if (p := PREDICATES.get(" ".join(words[-n:]))) is not None:
            return p
    return None


def extract_relations(text: str) -> list[tuple[str, str, str]]:
    """(subject, predicate, object) of entities that stand next to each other around a known verb."""
    raw = text.encode()
    ents = extract_entities(text)
    out = []
    for (s, _, _, end), (o, _, start, _) in zip(ents, ents[1:]):
        p = normalize_predicate(raw[end:start].decode(errors="ignore").strip(" \""))
        if p:
            out.append((s, p, o))
    return out


def facts(text: Column) -> Column:
    """array<struct<subject, predicate, object>> of a text column."""

    @F.pandas_udf("array<struct<subject:string,predicate:string,object:string>>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([[{"subject": a, "predicate": p, "object": o} for a, p, o in extract_relations(t or "")] for t in s])

    return run(text)


def split_multi_part(query: str, most: int = 4) -> list[str]:
    """Parts of a question, at question marks and before clauses that begin a new one; four at most."""
    parts = [p.strip(" ,") for p in _CLAUSE.split(query)]
    return [p for p in parts if p][:most] or [query]


def temporal_range(query: str, as_of: datetime) -> tuple[datetime, datetime] | None:
    """[start, end) that a query speaks of: a year (with before, after, since), a season of one, yesterday, last week, month or year."""
    q = query.lower()
    day = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    month = day.replace(day=1)
    if "yesterday" in q:
        return day - timedelta(days=1), day
    if "last week" in q:
        start = day - timedelta(days=day.weekday() + 7)
        return start, start + timedelta(days=7)
    if "last month" in q:
        return (month - timedelta(days=1)).replace(day=1), month
    if "last year" in q:
        return month.replace(year=as_of.year - 1, month=1), month.replace(month=1)
    m = _YEAR.search(q)
    if not m:
        return None
    year = int(m.group())
    first, after = datetime(year, 1, 1), datetime(year + 1, 1, 1)
    for name, (a, b) in SEASONS.items():
        if re.search(rf"\b{name}\b", q):
            at = lambda k: datetime(year + (k - 1) // 12, (k - 1) % 12 + 1, 1)
            return at(a), at(b)
    if re.search(r"\bbefore\b", q):
        return datetime.min, first
    if re.search(r"\bafter\b", q):
        return after, datetime.max
    if re.search(r"\bsince\b", q):
        return first, datetime.max
    return first, after
