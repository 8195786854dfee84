"""Forgetting curves and scores of importance as column arithmetic; t is hours."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ebbinghaus(t: Column, importance: Column, frequency: Column, emotion: Column) -> Column:
    life = 24.0 * (1 + 2 * importance) * (1 + 0.5 * frequency) * (1 + 1.5 * emotion)
    return _clamp(F.exp(-F.log(F.lit(2.0)) * t / life), 0.001, 0.999)


def power_law(t: Column, importance: Column, shape: float = 0.5) -> Column:
    return F.pow(1 + t / 24.0, -(shape * (1 + 0.5 * importance)))


def logarithmic(t: Column, connectivity: Column, scale: float = 24.0) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.log(1 + t / (scale * (1 + 0.5 * connectivity))) / F.log(F.lit(101.0)))


def gaussian(t: Column, sigma: float = 168.0) -> Column:
    return F.exp(-F.pow(t / sigma, F.lit(2.0)) / 2)


def hyperbolic(t: Column, scale: float = 24.0, a: float = 1.0) -> Column:
    return 1 / (1 + F.pow(t / scale, F.lit(a)))


def weibull(t: Column, scale: float = 168.0, k: float = 0.8) -> Column:
    return F.exp(-F.pow(t / scale, F.lit(k)))


def custom(t: Column, offset: float = 1.0, scale: float = 72.0, shape: float = 0.7, rate: float = 1.0) -> Column:
    return F.exp(-F.pow((t + offset) / scale, F.lit(shape)) * rate)


def hybrid(parts: list[tuple[float, Column]]) -> Column:
    """Weighted mean of models."""
    total = sum(w for w, _ in parts)
    out = F.lit(0.0)
    for w, c in parts:
        out = out + w * c
    return out / total


def recency_of_access(hours: Column, accesses: Column) -> Column:
    return (0.5 + 0.5 * F.exp(-hours / 24.0)) * F.least(1 + 0.25 * F.log(1 + accesses), F.lit(2.0))


def forgetting_probability(curve: Column, protection: Column, rate: float = 0.1) -> Column:
    return curve * (1 - protection) * rate


def replay_priority(importance, urgency, forgetting, interference, strategic) -> Column:
    return 0.3 * importance + 0.2 * urgency + 0.2 * forgetting + 0.15 * interference + 0.15 * strategic


def spaced_repetition_hours(replays: Column, importance: Column) -> Column:
    steps = F.array(*(F.lit(float(x)) for x in (1, 6, 24, 72, 168)))
    return F.element_at(steps, (F.least(replays, F.lit(4)) + 1).cast("int")) * (2 - importance)


def access_trend(first: Column, second: Column) -> Column:
    """Ratio ladder of the second half's rate to the first's."""
    r = F.try_divide(second, first)
    return F.when(r > 1.2, "increasing").when(r < 0.8, "decreasing").when((r >= 0.9) & (r <= 1.1), "stable").otherwise("irregular")
