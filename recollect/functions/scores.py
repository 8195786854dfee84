"""Scores of single memories and relations as column arithmetic."""
import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a relation's type makes of its strength, and from which strength it counts as a relation.
EDGE_FACTORS = {"causes": 0.9, "caused_by": 0.9, "part_of": 0.8, "contains": 0.8, "semantic": 0.7}
COUNTED_FROM = {"related_to": 0.3, "depends_on": 0.5, "contains": 0.4, "part_of": 0.4, "similar_to": 0.6, "temporal": 0.2, "caused_by": 0.7}
OTHER_FACTOR, OTHER_COUNTED = 0.5, 0.5
#: Fixed values of promotion: what each policy weighs, and from which mean a memory is promoted.
PROMOTION = {"frequency": 0.4, "age": 0.3, "importance": 0.3}
PROMOTED_FROM = 0.6


def unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def by_type(rel_type: Column, values: dict[str, float], other: float) -> Column:
    pairs = (F.lit(x) for kv in values.items() for x in kv)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), rel_type), F.lit(other))


def edge_strength(text_similarity: Column, tag_jaccard: Column, rel_type: Column) -> Column:
    """A half, 0.3 of the texts' likeness and 0.2 of the tags', times the type's factor."""
    return unit((0.5 + 0.3 * text_similarity + 0.2 * tag_jaccard) * by_type(rel_type, EDGE_FACTORS, OTHER_FACTOR))


def adaptive_retention(retention: Column, engagement: Column, frequency: Column, idle_hours: Column, importance: Column, emotion: Column, floor: float = 0.001) -> Column:
    """A retention raised by engagement over 0.7, more than one access, access within six hours, importance over a half and emotion over 0.6; kept within floor and 1 - floor."""
    raised = retention * F.when(engagement > 0.7, 1 + (engagement - 0.7) * 0.5).otherwise(1.0)
    raised = raised * F.when(frequency > 1, 1 + F.log(F.greatest(frequency - 1, F.lit(1e-300))) * 0.2).otherwise(1.0)
    raised = raised * F.when(idle_hours < 6, 1 + (6 - idle_hours) / 6 * 0.3).otherwise(1.0)
    raised = raised * F.when(importance > 0.5, 1 + (importance - 0.5)).otherwise(1.0)
    raised = raised * F.when(emotion > 0.6, 1 + (emotion - 0.6) * 0.8).otherwise(1.0)
    return F.least(F.lit(1 - floor), F.greatest(F.lit(floor), raised))


def importance_recency(idle_hours: Column, age_hours: Column, importance: Column, accesses: Column, size: Column) -> Column:
    """Exponential, power and logarithmic decay of whole hours since the last access, mixed by use and importance, times 1.2, 1 or 0.8 by accesses a day."""
    idle, age = F.greatest(F.floor(idle_hours), F.lit(0)), F.greatest(F.floor(age_hours), F.lit(1))
    often = F.when(accesses > 10, 2.0).when(accesses > 5, 1.5).otherwise(1.0)
    long = F.when(size > 1000, 1.5).when(size > 100, 1.2).otherwise(1.0)
    half_life = 24.0 * (1 + 2 * importance) * often * long
    exponential = F.exp(-F.log(F.lit(2.0)) * idle / half_life)
    power = F.pow(1 + idle / 24.0, F.when(importance > 0.7, -0.5).otherwise(-0.8))
    logarithmic = F.when(idle < 1, 1.0).otherwise(1 - F.least(F.log(F.greatest(idle, F.lit(1))) / F.log(F.lit(168.0)), F.lit(1.0)))
    kinds = ((accesses > 20) & (importance > 0.8), accesses > 10, importance > 0.7)
    weights = ((0.2, 0.6, 0.2), (0.4, 0.4, 0.2), (0.5, 0.2, 0.3), (0.6, 0.3, 0.1))
    mixed = [e * exponential + p * power + g * logarithmic for e, p, g in weights]
    score = F.when(kinds[0], mixed[0]).when(kinds[1], mixed[1]).when(kinds[2], mixed[2]).otherwise(mixed[3])
    daily = accesses / (age / 24.0)
    return unit(score * F.when(daily > 1, 1.2).when(daily > 0.1, 1.0).otherwise(0.8))


def three_regime_recency(hours: Column) -> Column:
    """Within a day, within a week, and beyond: mixes of linear, exponential, logarithmic and bell-shaped decay. hours above 0."""
    days = hours / 24.0
    linear, exponential, bell = F.greatest(F.lit(0.0), 1 - hours / 168.0), F.exp(-hours / 72.0), F.exp(-F.pow(days, F.lit(2.0)) / 8)
    slow = F.greatest(F.lit(0.0), F.try_divide(F.lit(1.0), 1 + F.log(F.greatest(days, F.lit(1e-9)))))
    return F.when(hours < 24, 0.6 * exponential + 0.4 * bell).when(hours < 168, 0.4 * linear + 0.3 * exponential + 0.3 * slow).otherwise(0.7 * slow + 0.3 * linear)


def _entropy(text: str | None) -> float | None:
    if not text:
        return None if text is None else 0.0
    p = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)[1] / len(text.encode("utf-8", "surrogatepass"))
    return float(0.0 - (p * np.log2(p)).sum()) / 8


def character_entropy(text: Column) -> Column:
    """Bits a character over eight, with the length in bytes as the total, as it is for the reference; 0 for an empty text. Characters are sorted and counted once, as numbers."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_entropy(t) for t in texts], dtype="float64")

    return run(text)


def byte_similarity(a: Column, b: Column) -> Column:
    """Share of a's bytes that occur in b, less 0.3 of the difference in length; 0 if one is over twice as long, 1 if equal."""
    latin = lambda t: F.decode(F.encode(t, "UTF-8"), "ISO-8859-1")  # noqa: E731 one character a byte
    m, n = F.octet_length(a), F.octet_length(b)
    longest, common = F.greatest(m, n), m - F.length(F.call_function("translate", latin(a), latin(b), F.lit("")))
    score = F.greatest(F.lit(0.0), F.try_divide(common, longest) * (1 - 0.3 * F.abs(m - n) / longest))
    return F.when(a == b, 1.0).when((m == 0) | (n == 0) | (F.least(m, n) * 2 < longest), 0.0).otherwise(score)


def promotion(memory_type: Column, accesses: Column, age_hours: Column, importance: Column, from_accesses: int = 5, from_hours: float = 168.0, from_importance: float = 0.8) -> dict[str, Column]:
    """Each policy's share of its threshold, 1 at most and 0 for what is long-term already; their weighted mean; whether that promotes."""
    short = memory_type == "ShortTerm"
    share = lambda x: F.when(short, F.least(F.lit(1.0), x)).otherwise(0.0)
    parts = {"frequency": share(accesses / from_accesses), "age": share(age_hours / from_hours), "importance": share(importance / from_importance)}
    mean = sum((PROMOTION[k] * c for k, c in parts.items()), F.lit(0.0)) / sum(PROMOTION.values())
    return {**parts, "score": mean, "promote": mean >= PROMOTED_FROM}


def parameter_importance(integral: Column, change: Column, damping: float = 0.1) -> Column:
    """r / (1 + r) of r = |integral| / (damping + change squared)."""
    r = F.abs(integral) / (damping + change * change)
    return unit(r / (1 + r))


def graph_score(base: Column, related: Column, mean_strength: Column) -> Column:
    """A base raised by a tenth a relation, half at most, and 0.3 of their mean strength; unchanged where related is null, 1 at most."""
    return F.when(related.isNull(), base).otherwise(F.least(F.lit(1.0), base + F.least(related / 10, F.lit(0.5)) + 0.3 * mean_strength))
