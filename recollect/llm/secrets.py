"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings, all in the JVM."""
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the contract, and the least length of what must be long. A run of one class of
# characters is as long as it gets, so for access and hex the length can stand in the pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = {"assign": (ASSIGN, 2, 12), "access": (ACCESS, 0, 18), "hex": (HEX, 0, 16)}

#: Strings worth an entropy test, and the window slid over them. Of a string that holds a placeholder, only the pieces
#: between '/' and '=' that hold none are tested. No pattern repeats a group: Java's matcher recurses once a repetition.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
PIECE = r"[A-Za-z0-9+_-]{20,}"
PLACEHOLDER = r"(?i)(example|placeholder|changeme|your[_-])"
WINDOW = 20
#: What is no secret whatever its entropy: digits alone, and words joined by marks (a letter first, then letters and marks).
DIGITS, JOINED, MARK = r"^[0-9_=-]+$", r"^[A-Za-z][A-Za-z_/=-]*$", r"[_/=-]"
#: Least bits a character by the class of a candidate's longest piece between '/' and '=', the first class that holds. Each
#: is what 99 of 100 uniformly random windows of its class reach, but for digits alone, which read as numbers. With windows
#: of 20 no attainable entropy lies within 0.0003 of these.
CLASS_BITS = (
    ("[0-9_-]+", 3.81), ("[0-9a-f_-]+|[0-9A-F_-]+", 2.902), ("[a-z_-]+|[A-Z_-]+", 3.215), ("[A-Za-z_-]+", 3.575),
    ("[a-z0-9_-]+", 3.4), ("[A-Z0-9_-]+", 3.34), (".*", 3.64),
)
#: Code points from '+' to 'z' hold every character of a candidate.
_FIRST, _SLOTS, _UNIT = 43, 80, 1_000_000


def _lit(s: str) -> str:
    return "r'" + s + "'" if "'" not in s else 'r"' + s + '"' if '"' not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def hits(text: str, pattern: str) -> str:
    """SQL: array<struct<h, at>>, what the pattern matches in text from left to right and the code point where each match starts.

    A match starts where the pieces and matches before it end; the running sum goes by blocks of 256 so that many
    matches stay cheap. What a lambda uses often is bound to a variable: the optimizer may move a column's
    expression into a lambda, where it would be computed for each element.
    """
    p = _lit(pattern)
    total = lambda a: f"aggregate({a}, 0, (s, x) -> s + x)"
    steps = f"zip_with(split({text}, {p}, -1), hs, (a, h) -> length(a) + coalesce(length(h), 0))"
    blocks = f"transform(sequence(0, size(d) div 256), b -> {total('slice(d, b * 256 + 1, 256)')})"
    upto = f"{total('slice(bs, 1, i div 256)')} + {total('slice(d, (i div 256) * 256 + 1, i % 256 + 1)')}"
    found = f"transform(array({steps}), d -> transform(array({blocks}), bs -> transform(hs, (h, i) -> named_struct('h', h, 'at', {upto} - length(h))))[0])[0]"
    none = "cast(array() as array<struct<h: string, at: int>>)"
    return f"transform(array(regexp_extract_all({text}, {p}, 0)), hs -> if(size(hs) = 0, {none}, {found}))[0]"


def window_entropy_spans(candidate: str, at: str, window: int = WINDOW, classes: tuple = CLASS_BITS) -> str:
    """SQL: struct(start, end) over the windows of a candidate whose entropy reaches its class's bits, or null.

    A fold along the characters keeps the count of each in the window and the sum of c log2 c in millionths, an
    integer, so each step adds one character and takes one away exactly.
    """
    clog = "array(" + ", ".join(f"{round(c * math.log2(c) * _UNIT) if c else 0}L" for c in range(window + 1)) + ")"
    # entropy = log2(w) - sum / w >= bits  <=>  sum <= (log2(w) - bits) * w; of equally long pieces the class of the last in order counts
    longest = f"array_max(transform(split({candidate}, '[/=]+'), q -> named_struct('n', length(q), 'q', q))).q"
    cases = " ".join(f"WHEN rlike(q, '^({p})$') THEN {math.floor((math.log2(window) - b) * window * _UNIT)}L" for p, b in classes)
    limit = f"transform(array({longest}), q -> CASE {cases} END)[0]"
    code = lambda i: f"ascii(get(cs, {i})) - {_FIRST}"
    into, out = "get(a.n, p.into)", "get(a.n, p.out)"
    change = f"a.s + get(f, {into} + 1) - get(f, {into}) + if(p.out is null, 0L, get(f, {out} - 1 + if(p.out = p.into, 1, 0)) - get(f, {out} + if(p.out = p.into, 1, 0)))"
    step = (
        f"transform(array(named_struct('into', {code('i')}, 'out', if(i < {window}, null, {code(f'i - {window}')}))), p -> "
        f"transform(array({change}), s -> named_struct("
        "'n', transform(a.n, (c, j) -> c + if(j = p.into, 1, 0) - if(j <=> p.out, 1, 0)), 's', s, "
        f"'lo', if(i >= {window - 1} AND s <= lim, coalesce(a.lo, i - {window - 1}), a.lo), 'hi', if(i >= {window - 1} AND s <= lim, i + 1, a.hi)))[0])[0]"
    )
    start = f"named_struct('n', array_repeat(0, {_SLOTS}), 's', 0L, 'lo', cast(null as int), 'hi', cast(null as int))"
    fold = f"aggregate(sequence(0, size(cs) - 1), {start}, (a, i) -> {step}, a -> if(a.lo is null, null, named_struct('start', {at} + a.lo, 'end', {at} + a.hi)))"
    return f"transform(array(filter(split({candidate}, ''), x -> x <> '')), cs -> transform(array({clog}), f -> transform(array({limit}), lim -> {fold})[0])[0])[0]"


def find_secrets(documents: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """documents with a column `out`: array<struct<start int, ord int, kind string, end int>>, in order.

    start and end are code points, end exclusive. Kinds: assign, access, hex by pattern (leftmost, not overlapping
    within a kind, dropped if too short) and entropy (the windows of a long string that look random for its class of
    characters, unless the allow-list has it; a placeholder excuses only its own piece of a path). Null text reads as
    empty: an empty array. Texts are scanned whole, in time about linear in their length; repeated rows repeat their
    result; an empty table gives no rows; other columns pass through, whatever their names (but none may be called `out`).
    """
    df = documents.select(F.struct("*").alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_secret_text"))
    found, none = [], "cast(array() as array<struct<start: int, ord: int, kind: string, end: int>>)"
    for ord_, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        name = f"_secret_{kind}"
        df = df.withColumn(name, F.expr(hits("_secret_text", pattern)))
        value = f"regexp_extract_all(_secret_text, {_lit(pattern)}, {group})" if group else f"transform({name}, x -> x.h)"
        spans = f"zip_with({name}, {value}, (x, v) -> if(length(v) >= {least}, named_struct('start', x.at, 'ord', {ord_}, 'kind', '{kind}', 'end', x.at + length(x.h)), null))"
        found.append(f"if(size({name}) = 0, {none}, filter({spans}, x -> x is not null))")
    df = df.withColumn("_secret_run", F.expr(hits("_secret_text", CANDIDATE)))
    pieces = f"transform(filter({hits('x.h', PIECE)}, y -> NOT rlike(y.h, {_lit(PLACEHOLDER)})), y -> named_struct('h', y.h, 'at', x.at + y.at))"
    words = f"flatten(transform(_secret_run, x -> if(rlike(x.h, {_lit(PLACEHOLDER)}), {pieces}, array(x))))"
    excused = f"rlike(x.h, {_lit(DIGITS)}) OR (rlike(x.h, {_lit(JOINED)}) AND rlike(x.h, {_lit(MARK)}))"
    entropy = f"filter(transform({words}, x -> if({excused}, null, {window_entropy_spans('x.h', 'x.at')})), x -> x is not null)"
    found.append(f"if(size(_secret_run) = 0, {none}, transform({entropy}, e -> named_struct('start', e.start, 'ord', {len(KINDS)}, 'kind', 'entropy', 'end', e.end)))")
    return df.select("_row.*", F.expr(f"array_sort(concat({', '.join(found)}))").alias(out))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_report(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy of every row; nulls, repeats and empty tables as in find_secrets."""
    df = find_secrets(documents.select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda x: x["kind"] != "entropy")
    return df.select("doc_id", *map(n, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), n("entropy"))


def redact(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """documents with every secret in text replaced by mark (overlapping spans by one), n_chars made to fit.

    A null text stays null; repeated rows repeat their result; an empty table gives no rows; columns pass through, whatever their names.
    """
    spans = "_secret_spans"
    while spans in map(str.lower, documents.columns):
        spans += "_"
    df = find_secrets(documents, out=spans)
    cut = (
        f"aggregate({spans}, named_struct('out', '', 'at', 0), (a, x) -> named_struct("
        f"'out', if(x.start >= a.at AND (a.at = 0 OR x.start > a.at OR a.out = ''), concat(a.out, substring(text, a.at + 1, x.start - a.at), '{mark}'), a.out), "
        "'at', greatest(a.at, x.end)), a -> concat(a.out, substring(text, a.at + 1)))"
    )
    hit = F.size(spans) > 0
    df = df.withColumn("text", F.when(hit, F.expr(cut)).otherwise(F.col("text")))
    return df.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(spans)


def _oracle_kind(kind: str, pattern: str, value: str, ord_: int, least: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, rid, {ord_} AS ord, '{kind}' AS kind, unnest(range(1, len(h) + 1)) AS i, h, v, s FROM (
      SELECT doc_id, rid, regexp_extract_all(t, '{p}') AS h, {value.format(p=p)} AS v, string_split_regex(t, '{p}') AS s FROM d WHERE regexp_matches(t, '{p}'))"""


def _oracle() -> str:
    parts = []
    for o, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        x = _oracle_kind(kind, pattern, "regexp_extract_all(t, '{p}', " + str(group) + ")", o, least)
        parts.append(f"SELECT doc_id, rid, ord, kind, i, h, s FROM ({x}) WHERE length(v[i]) >= {least}")
    words = _oracle_kind("entropy", CANDIDATE, "NULL", 3, 0)
    q = lambda p: p.replace("'", "''")
    pieces = _oracle_kind("entropy", PIECE, "NULL", 3, 0).replace("FROM d WHERE", "FROM (SELECT rid, st, x AS t, NULL AS doc_id FROM c WHERE odd) WHERE").replace("doc_id, rid,", "doc_id, rid, st,")
    at = "list_sum(list_transform(s[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0)::BIGINT"
    w = WINDOW
    longest = "list_max(list_transform(regexp_split_to_array(x, '[/=]+'), lambda p: {'n': length(p), 'q': p})).q"
    least = " ".join(f"WHEN regexp_full_match({longest}, '{p}') THEN {b}" for p, b in CLASS_BITS)
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
b AS ({" UNION ALL ".join(parts)}),
base AS (SELECT rid, ord, kind, {at} AS st, {at} + length(h[i]) AS en FROM b),
c AS (SELECT rid, h[i] AS x, {at} AS st, regexp_matches(h[i], '{q(PLACEHOLDER)}') AS odd FROM ({words})),
k AS (SELECT rid, x, st FROM c WHERE NOT odd UNION ALL SELECT rid, h[i] AS x, st + {at} AS st FROM ({pieces}) WHERE NOT regexp_matches(h[i], '{q(PLACEHOLDER)}')),
e AS (SELECT rid, st, x, CASE {least} END AS least, unnest(range(0, length(x) - {w - 1})) AS o FROM k
  WHERE NOT regexp_matches(x, '{q(DIGITS)}') AND NOT (regexp_matches(x, '{q(JOINED)}') AND regexp_matches(x, '{q(MARK)}'))),
g AS (SELECT rid, st, min(o) AS lo, max(o) AS hi FROM e WHERE list_aggregate(string_split(substr(x, o + 1, {w}), ''), 'entropy') >= least GROUP BY rid, st),
every AS (SELECT rid, ord, kind, st, en FROM base UNION ALL SELECT rid, 3, 'entropy', st + lo, st + hi + {w} FROM g),
r AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  count(*) FILTER (kind = 'entropy') AS n_entropy,
  string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, ord) FILTER (kind <> 'entropy') AS base, string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, ord) AS spans
  FROM every GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy FROM d LEFT JOIN r USING (rid)
"""


ORACLE = _oracle()
