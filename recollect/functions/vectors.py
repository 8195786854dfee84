"""Column functions over array<double> vectors; a mismatch of lengths is no match."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def literal(values: list[float]) -> Column:
    """A vector as one expression: as many literals by as many calls take long to build."""
    return F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in values) + ")")


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector or a mismatch."""
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0)))


def euclidean(a: Column, b: Column) -> Column:
    return F.when(F.size(a) != F.size(b), float("inf")).otherwise(F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return F.when(F.size(a) != F.size(b), float("inf")).otherwise(_fold(a, b, lambda x, y: F.abs(x - y)))


def support_jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) & (y != 0)), lambda x: x))
    any_ = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda x: x))
    return F.coalesce(F.try_divide(both, any_), F.lit(1.0)).cast("double")


def angular(a: Column, b: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(a, b))))


def normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: F.try_divide(x, n)))


def distance(metric: str, a: Column, b: Column) -> Column:
    """Distance by name: cosine (1 for a zero vector), euclidean, manhattan, dot (negated)."""
    return {"cosine": lambda: 1 - cosine(a, b), "euclidean": lambda: euclidean(a, b), "manhattan": lambda: manhattan(a, b), "dot": lambda: -dot(a, b)}[metric]()
