"""Outlier factors and isolation beside plain versions."""
import math
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import outliers as O
from recollect.operators import vector_index as V
from recollect.operators.vector_index import VectorIndex


def plain_lof(points, k):
    n = len(points)
    d = np.array([[math.dist(a, b) for b in points] for a in points])
    near = [sorted((round(d[i, j], 12), j) for j in range(n) if j != i)[:k] for i in range(n)]
    last = [max(d[i, j] for _, j in near[i]) for i in range(n)]
    density = [1 / (np.mean([max(d[i, j], last[j]) for _, j in near[i]]) + 1e-10) for i in range(n)]
    return {i: np.mean([density[j] for _, j in near[i]]) / density[i] for i in range(n)}


@pytest.mark.parametrize("k", [3, 10])
def test_local_outlier_factors_meet_the_plain_version(spark, tmp_path, k):
    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(size=(60, 3)), rng.normal(size=(40, 3)) * 0.1 + 5, [[20, 20, 20.0]], np.full((15, 3), 2.0), [[2.0, 2.0, 2.5]]])
    v = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "key long, embedding array<double>").repartition(3)
    index = VectorIndex.build(v, str(tmp_path / "i"), "euclidean")
    got = {r.key: r.lof for r in O.local_outlier_factors(O.neighbour_graph(index, v, k)).collect()}
    want = plain_lof(points, k)
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-6) for i in want)
    assert got[100] > 3 and (k < 15 or max(want, key=want.get) == 100)


def test_a_single_row_has_no_factor(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 2.0])], "key long, embedding array<double>")
    assert O.local_outlier_factors(O.neighbour_graph(VectorIndex.build(v, str(tmp_path / "i"), "euclidean"), v, 5)).collect() == []


def rows(spark, n=400):
    rng = np.random.default_rng(4)
    data = [(i, float(x), float(y), "clash") for i, (x, y) in enumerate(rng.normal(size=(n, 2)))]
    return spark.createDataFrame([*data, (n, 30.0, -30.0, ""), (n + 1, None, float("nan"), None)], "id long, x double, y double, tree string").repartition(3)


def walk(tree, x, depth=0):
    if isinstance(tree, int):
        return depth + (2 * (math.log(tree - 1) + 0.5772156649) - 2 * (tree - 1) / tree if tree > 1 else 0)
    f, cut, below, above = tree
    return walk(below if x[f] < cut else above, x, depth + 1)


def test_isolation_meets_trees_walked_one_by_one(spark):
    df = rows(spark)
    got = {r.id: r.isolation for r in O.isolation_forest(df, "id", ["x", "y"], trees=30, seed=7).collect()}
    data = {r.id: (r.x if r.x is not None and math.isfinite(r.x) else 0.0, r.y if r.y is not None and math.isfinite(r.y) else 0.0) for r in df.collect()}
    size = math.isqrt(len(data))
    samples = O.tree_samples(df.select("id"), "id", 30, size, len(data), 7).collect()
    mine = [sorted(r.id for r in samples if r.tree == t) for t in range(30)]
    assert all(len(m) == size for m in mine) and len({tuple(m) for m in mine}) == 30 and len(set(sum(mine, []))) > 20 * size * 0.6
    forest = [O.grow(np.array([data[i] for i in m]), np.random.default_rng([7, t])) for t, m in enumerate(mine)]
    for i in (0, 17, 399, 400, 401):
        assert got[i] == pytest.approx(2 ** (-np.mean([walk(t, data[i]) for t in forest]) / O.mean_depth(size)))
    assert got[400] > sorted(got.values())[len(got) * 3 // 4]
    again = {r.id: r.isolation for r in O.isolation_forest(df.repartition(5), "id", ["x", "y"], trees=30, seed=7).collect()}
    assert again == got
    assert max(len(pickle.dumps(t)) for t in forest) < 100_000


def test_few_and_equal_rows(spark):
    few = rows(spark).limit(9)
    assert {r.isolation for r in O.isolation_forest(few, "id", ["x", "y"]).collect()} == {0.0}
    same = spark.range(50).select(F.col("id"), F.lit(1.0).alias("x"))
    assert {round(r.isolation, 9) for r in O.isolation_forest(same, "id", ["x"], trees=5).collect()} == {0.5}
    assert O.isolation_forest(few.limit(0), "id", ["x", "y"]).collect() == []


@pytest.mark.parametrize("tasks", [1, 7])
def test_neighbours_of_all_rows_meet_the_plain_version(spark, monkeypatch, tasks):
    monkeypatch.setattr(V, "ASKING_LEAST", 300 // tasks)
    monkeypatch.setattr(V, "AT_ONCE", 16)
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(size=(150, 3)), rng.integers(0, 3, (60, 3)) + 5.0, np.full((30, 3), 2.0)])
    data = [(i, p.tolist()) for i, p in enumerate(points)] + [(900, [0.0] * 3), (901, None), (902, [1.0, float("nan"), 0.0])]
    for k, kind in ((5, "double"), (300, "double"), (5, "float")):
        if kind == "float":
            data = [(i, None if p is None else np.float32(p).tolist()) for i, p in data]
        exact = {i: np.array(p) for i, p in data[:240]}
        got = {}
        for r in V.all_neighbours(spark.createDataFrame(data, f"key long, embedding array<{kind}>").repartition(3), k).collect():
            got.setdefault(r.key, {})[r.rank] = (r.other, round(r.distance, 9))
        assert got.keys() == exact.keys()
        for i, p in exact.items():
            want = sorted((round(math.dist(p, x), 12), j) for j, x in exact.items() if j != i)[:k]
            assert [got[i][n][0] for n in range(1, len(want) + 1)] == [j for _, j in want] and len(got[i]) == len(want)
            assert all(got[i][n][1] == pytest.approx(d, abs=1e-8) for n, (d, _) in enumerate(want, 1))


def test_rows_are_sent_once_to_a_task_however_many_cells_there_would_be(spark):
    """By cells, a row that asks was sent to nearly each of them."""
    plan = V.all_neighbours(spark.range(900).select(F.col("id").alias("key"), F.array((F.col("id") % 7 + 1).cast("double"), F.col("id").cast("double")).alias("embedding")), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "MapInArrow" in plan
