"""Column functions over text. Lengths are bytes where the reference's are."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term in a text."""
    return F.when(F.length(term) == 0, F.lit(0)).otherwise(F.try_divide(F.octet_length(text) - F.octet_length(F.replace(text, term, F.lit(""))), F.octet_length(term))).cast("long")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits, repeats kept."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def scan_tokens(text: Column) -> Column:
    return F.array_distinct(tokenize(text))


def counts(items: Column) -> Column:
    """array<struct<t, tf>>: the distinct items in order, and how often each is there. They are sorted once and cut where they change."""

    def runs(a):
        n = F.size(a)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((i == 0) | (F.get(a, i) != F.get(a, i - 1))))
        each = lambda s: F.transform(s, lambda at, j: F.struct(F.get(a, at).alias("t"), (F.coalesce(F.get(s, j + 1), n) - at).alias("tf")))
        return F.transform(F.array(starts), each)[0]

    return F.transform(F.array(F.sort_array(items)), runs)[0]


def term_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms that the text holds; 0 for no terms."""
    q = scan_tokens(query)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, scan_tokens(text))), F.size(q)), F.lit(0.0))


def jaccard_sets(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(both_empty)).cast("double")


def word_jaccard(a: Column, b: Column, lower: bool = False, both_empty: float = 0.0) -> Column:
    f = F.lower if lower else (lambda c: c)
    return jaccard_sets(F.array_distinct(words(f(a))), F.array_distinct(words(f(b))), both_empty)


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct runs of n characters; none of a shorter text. Characters are cut once, so the work grows with the text."""
    grams = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0))), lambda i: F.concat(*(F.get(c, i + k) for k in range(n))))
    return F.when(F.length(text) < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.array(F.split(text, "")), grams)[0]))


def ngram_similarity(a: Column, b: Column, n: int = 3) -> Column:
    return jaccard_sets(char_ngrams(a, n), char_ngrams(b, n))


def normalize_content(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def cluster_key(text: Column) -> Column:
    """Length in steps of 50 bytes, number of words, and the first three words."""
    w = words(text)
    return F.concat_ws("_", (F.floor(F.octet_length(text) / 50) * 50).cast("string"), F.size(w).cast("string"), F.concat_ws("_", F.slice(w, 1, 3)))


def _entropy(items: Column, total: Column) -> Column:
    n = F.transform(F.array_distinct(items), lambda x: F.size(F.filter(items, lambda y: y == x)) / total)
    return F.aggregate(n, F.lit(0.0), lambda a, p: a - p * F.log2(p))


def byte_pairs(text: Column) -> Column:
    return F.regexp_extract_all(F.hex(F.encode(text, "utf-8")), F.lit("(..)"), F.lit(1))


def repetition_ratio(text: Column) -> Column:
    """1 - distinct bytes / bytes."""
    b = byte_pairs(text)
    return F.coalesce(1 - F.try_divide(F.size(F.array_distinct(b)), F.size(b)), F.lit(0.0))


def split_sentences(text: Column) -> Column:
    """Sentences end at . ! or ? before white space or the end."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def long_sentences(text: Column) -> Column:
    """Pieces between . ! and ? of over 10 bytes, trimmed."""
    return F.filter(F.transform(F.split(text, "[.!?]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.octet_length(s) > 10)


def ascii_language(text: Column) -> Column:
    """By the share of ASCII characters: over 0.95 en, over 0.8 mixed, else non_latin; unknown if empty."""
    share = F.try_divide(F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")), F.length(text))
    return F.when(F.length(text) == 0, "unknown").when(share > 0.95, "en").when(share > 0.8, "mixed").otherwise("non_latin")


def readability(text: Column) -> Column:
    w, s = words(text), F.size(F.filter(F.split(text, "[.!?]"), lambda x: F.trim(x) != ""))
    per_sentence = F.coalesce(F.try_divide(F.size(w), s), F.lit(0.0))
    per_word = F.coalesce(F.try_divide(F.octet_length(text), F.size(w)), F.lit(0.0))
    return F.greatest(F.lit(0.0), 1 - (F.least(per_sentence / 20, F.lit(1.0)) * 0.5 + F.least(per_word / 8, F.lit(1.0)) * 0.5))


def information_density(text: Column) -> Column:
    w = words(F.lower(text))
    return F.least(F.lit(1.0), 0.7 * F.coalesce(F.try_divide(F.size(F.array_distinct(w)), F.size(w)), F.lit(0.0)) + 0.3 * F.least(F.octet_length(text) / 1000, F.lit(1.0)))


def content_type(text: Column) -> Column:
    lines = F.size(F.split(text, "\n"))
    return (
        F.when(F.contains(text, F.lit("```")) | F.contains(text, F.lit("function")) | F.contains(text, F.lit("class ")), "code")
        .when(F.contains(text, F.lit("http")) | F.contains(text, F.lit("www.")), "web_content")
        .when((lines > 10) & (F.octet_length(text) > 1000), "document")
        .when(F.size(words(text)) < 10, "note").otherwise("text")
    )


def extract_html_text(html: Column) -> Column:
    """br and p tags become new lines, other tags go; trimmed."""
    broken = F.regexp_replace(html, r"(?i)<br\s*/?>|</?p(\s[^>]*)?>", "\n")
    return F.regexp_replace(F.regexp_replace(broken, r"<[^>]*>", ""), r"^\s+|\s+$", "")


def extract_rtf_text(rtf: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(rtf, r"\\[a-z]+-?[0-9]* ?", ""), r"[{}]", ""), r"^\s+|\s+$", "")


def matches_glob(text: Column, pattern: str) -> Column:
    """`*` matches all; one star stands for any middle; anything else is a substring."""
    if pattern == "*":
        return F.lit(True)
    if pattern.count("*") == 1:
        a, b = pattern.split("*")
        return F.startswith(text, F.lit(a)) & F.endswith(text, F.lit(b)) & (F.length(text) >= len(a) + len(b))
    return F.contains(text, F.lit(pattern))


def change_type(old: Column, new: Column) -> Column:
    """How new content differs from old: none, append, prepend, insert, truncate, modify or replace."""
    return (
        F.when(old == new, "none").when((F.length(old) == 0) & (F.length(new) > 0), "append")
        .when(F.startswith(new, old), "append").when(F.endswith(new, old), "prepend").when(F.contains(new, old), "insert")
        .when(F.startswith(old, new) | F.contains(old, new), "truncate").when(word_jaccard(old, new) > 0.3, "modify").otherwise("replace")
    )


def headings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^(#{1,6} .+)$"), F.lit(1))


def references(text: Column) -> Column:
    """Lines with a URL, a doi or square brackets."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"https?://|doi[:.]|\[[^\]]+\]"))


def keywords(text: Column) -> Column:
    """Lower-cased words of over three bytes, stripped of marks at their edges."""
    return F.filter(F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: F.octet_length(w) > 3)
