"""Queries of a linear model over line items that goes on learning."""
import numpy as np
from pyspark.sql import functions as F

from recollect.functions import scores as S
from recollect.operators import continual as C
from recollect.plans.registry import query
from recollect.sources.tables import table

_NAMES = ("bias", "quantity", "discount", "tax")
_X = ("1::DOUBLE", "l_quantity::DOUBLE / 50", "l_discount::DOUBLE * 10", "l_tax::DOUBLE * 10")
_RATE, _STEPS = 0.2, 12


def _items(spark, sf_dir):
    x = F.array(F.lit(1.0), F.col("l_quantity") / 50.0, F.col("l_discount") * 10.0, F.col("l_tax") * 10.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", x.cast("array<double>").alias("x"), (F.col("l_extendedprice").cast("double") / 50000).alias("y"))


def _model_sql(p: str, where: str) -> str:
    """{p}m: moments of the rows; {p}0 .. : weights w0.. and path integrals o0.. after each step."""
    d = range(len(_X))
    ctes = [f"{p}m AS MATERIALIZED (SELECT " + ", ".join(f"avg(x{i} * x{j}) AS a{i}{j}" for i in d for j in d) + ", " + ", ".join(f"avg(x{i} * y) AS b{i}" for i in d) + f" FROM items WHERE {where})",
            f"{p}0 AS (SELECT " + ", ".join(f"0::DOUBLE AS w{i}, 0::DOUBLE AS o{i}" for i in d) + ")"]
    for s in range(_STEPS):
        g = [f"2 * ({' + '.join(f'a{i}{j} * w{j}' for j in d)} - b{i})" for i in d]
        ctes.append(f"{p}{s + 1} AS MATERIALIZED (SELECT " + ", ".join(f"w{i} - {_RATE}::DOUBLE * {g[i]} AS w{i}, o{i} + {_RATE}::DOUBLE * pow({g[i]}, 2) AS o{i}" for i in d) + f" FROM {p}{s}, {p}m)")
    return ", ".join(ctes)


_FIT = f"items AS MATERIALIZED (SELECT l_returnflag, {', '.join(f'{x} AS x{i}' for i, x in enumerate(_X))}, l_extendedprice::DOUBLE / 50000 AS y FROM lineitem), {_model_sql('f', '''l_returnflag <> 'R' ''')}, {_model_sql('g', '''l_returnflag = 'R' ''')}"
_F = f"fi AS (SELECT {', '.join(f'avg(pow(2 * (w0 * x0 + w1 * x1 + w2 * x2 + w3 * x3 - y) * x{i}, 2)) AS f{i}' for i in range(4))} FROM items, f{_STEPS} WHERE l_returnflag <> 'R')"


@query(f"WITH {_FIT}, {_F} " + " UNION ALL ".join(
    f"SELECT '{n}' AS parameter, round(a.w{i}, 7) AS weight, round(f{i}, 7) AS fisher, round(a.o{i}, 7) AS integral, round((abs(a.o{i}) / (0.1 + pow(a.w{i}, 2))) / (1 + abs(a.o{i}) / (0.1 + pow(a.w{i}, 2))), 7) AS importance, round(0.2 * f{i} * pow(b.w{i} - a.w{i}, 2), 9) AS penalty FROM f{_STEPS} a, g{_STEPS} b, fi"
    for i, n in enumerate(_NAMES)))
def model_protection(spark, sf_dir):
    """A model of prices learned from what was not returned: what its weights hold (Fisher information, path integrals), and what it would cost to move them to those of what was."""
    items = _items(spark, sf_dir)
    first, then = items.filter("l_returnflag <> 'R'"), items.filter("l_returnflag = 'R'")
    start = np.zeros(len(_NAMES))
    weights, taken = C.descend(*C.moments(first)[:2], start, _RATE, _STEPS)
    other, _ = C.descend(*C.moments(then)[:2], start, _RATE, _STEPS)
    fisher = C.fisher_information(first, weights)
    rows = [(n, *map(float, v)) for n, *v in zip(_NAMES, weights, fisher, taken, C.penalty(other, weights, fisher), strict=True)]
    df = spark.createDataFrame(rows, "parameter string, weight double, fisher double, integral double, penalty double")
    r = lambda c, k=7: F.round(c, k)
    return df.select("parameter", r("weight").alias("weight"), r("fisher").alias("fisher"), r("integral").alias("integral"), r(S.parameter_importance(F.col("integral"), F.col("weight"))).alias("importance"), r("penalty", 9).alias("penalty"))


@query()
def meta_learning(spark, sf_dir):
    """How a start for models of prices, one for each supplier, gets better by rounds: three ways, losses on suppliers learned from and on every fifth, held out."""
    t = C.few_shots(_items(spark, sf_dir), F.col("l_suppkey"), F.struct("l_orderkey", "l_linenumber"), 10)
    rows = []
    for kind, outer in (("maml", 0.3), ("first_order", 0.3), ("reptile", 0.7)):
        _, said = C.meta_train(t.filter("task % 5 <> 0"), np.zeros(len(_NAMES)), kind, rounds=4, outer=outer, held_out=t.filter("task % 5 = 0"))
        rows += [(kind, *x) for x in said]
    return spark.createDataFrame(rows, "kind string, round int, loss double, held_out double")
