"""Choices that follow from context: a strategy of replay for each memory, and features moved from one domain to another."""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of fitness and of priority, from which fitness two strategies are mixed, hours until a replay.
FITNESS, PRIORITY, MIXED_FROM, HOURS = (0.3, 0.25, 0.2, 0.15, 0.1), (0.3, 0.2, 0.2, 0.15, 0.15), 0.7, 24.0
SUCCESS = 0.7


@dataclass(frozen=True)
class Context:
    """The system as decisions see it: activity, load and time of day in 0..1, its past trends, variance and feedback, and how each strategy did."""

    activity: float
    load: float
    time_of_day: float
    trends: tuple[float, ...] = ()
    variance: float = 0.0
    feedback: int = 0
    history: tuple[tuple[str, tuple[float, ...]], ...] = ()

    def past(self, strategy: str) -> tuple[float, int]:
        seen = dict(self.history).get(strategy, ())
        return (sum(seen) / len(seen) if seen else 0.5), len(seen)


def _mix(weights: tuple, parts: list[Column]) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum((w * p for w, p in zip(weights, parts, strict=True)), F.lit(0.0))))


def replay_decisions(memories: DataFrame, context: Context) -> DataFrame:
    """key, strategy, fitness, priority, delay_hours, effectiveness, confidence of memories(key, score, use): score is a memory's importance, use how much it is used, both in 0..1.

    The fittest strategy is taken (the first by name of equals); if two and more are over 0.7, a mix of them.
    """
    score, c = F.col("score"), context
    suits = {
        "context_aware": F.lit(0.8 if c.variance > 0.1 else 0.5),
        "multi_objective": F.when((score > 0.6) & F.lit(c.activity > 0.5), 0.85).otherwise(0.7),
        "performance_driven": F.when((score > SUCCESS) & F.lit(len(c.trends) >= 3), 0.9).otherwise(0.6),
        "reinforcement_learning": F.lit(0.8 if c.feedback >= 10 else 0.4),
    }
    fit = {n: _mix(FITNESS, [F.lit(c.past(n)[0]), s, (score + F.col("use")) / 2, F.lit(1 - c.load), F.lit(c.time_of_day)]) for n, s in suits.items()}
    ranked = F.array(*(F.struct(F.round(-f, 12).alias("f"), F.lit(n).alias("name"), F.lit(c.past(n)[0]).alias("past"), F.lit(c.past(n)[1]).alias("seen")) for n, f in fit.items()))
    m = memories.select("key", "score", F.array_min(ranked).alias("best"), F.size(F.filter(ranked, lambda x: x["f"] < -MIXED_FROM)).alias("fit"))
    mixed = F.col("fit") >= 2
    name = F.when(mixed, "hybrid").otherwise(F.col("best.name"))
    factor = F.when(name == "performance_driven", F.when(score > SUCCESS, 1.2).otherwise(0.8)).when(name == "context_aware", c.trends[-1] if c.trends else 0.5).otherwise(1.0)
    slower = F.when(name == "performance_driven", 2 - score).when(name == "context_aware", 0.5 if c.activity > 0.7 else 1.5).otherwise(1.0)
    past, seen = (F.when(mixed, other).otherwise(F.col(f"best.{k}")) for k, other in (("past", 0.5), ("seen", 0)))
    return m.select(
        "key", name.alias("strategy"), (-F.col("best.f")).alias("fitness"), _mix(PRIORITY, [score, F.lit(c.activity), F.lit(1 - c.load), F.lit(c.time_of_day), factor]).alias("priority"),
        F.floor(HOURS * slower).cast("double").alias("delay_hours"), _mix((0.7, 0.3), [past, (c.activity + score) / 2]).alias("effectiveness"), F.least(F.lit(1.0), seen / 100).alias("confidence"),
    )


def align_domains(source: DataFrame, target: DataFrame) -> DataFrame:
    """key, embedding of source(key, embedding), each dimension brought to the target's mean and deviation; a dimension that does not vary takes the target's mean."""
    stats = lambda df, m, s: df.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("i").agg(F.avg("x").alias(m), F.stddev_pop("x").alias(s))
    both = stats(source, "m1", "s1").join(stats(target, "m2", "s2"), "i")
    # one row of as many entries as dimensions
    moves = F.broadcast(both.agg(F.array_sort(F.collect_list(F.struct("i", "m1", "s1", "m2", "s2"))).alias("moves")))
    move = lambda x, m: m["m2"] + F.when(m["s1"] > 0, (x - m["m1"]) / m["s1"] * m["s2"]).otherwise(0.0)
    return source.join(moves).select("key", F.zip_with(F.col("embedding").cast("array<double>"), "moves", move).alias("embedding"))


def discrepancy(source: DataFrame, target: DataFrame) -> DataFrame:
    """discrepancy: the mean over dimensions of how far the means of two domains lie apart; 1 if one is empty."""
    means = lambda df, m: df.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("i").agg(F.avg("x").alias(m))
    both = means(source, "a").join(means(target, "b"), "i")
    return both.agg(F.coalesce(F.avg(F.abs(F.col("a") - F.col("b"))), F.lit(1.0)).alias("discrepancy"))
