"""A linear model that goes on learning, beside NumPy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import continual as C


def made(spark, tasks=12, n=30, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for t in range(tasks):
        w = np.array([2.0, -1.0, 0.5]) + rng.normal(0, 0.1, 3)
        x = np.column_stack([np.ones(n), rng.normal(size=(n, 2))])
        rows += [(t, t * 1000 + i, a.tolist(), float(b), "clash") for i, (a, b) in enumerate(zip(x, x @ w + rng.normal(0, 0.01, n), strict=True))]
    return spark.createDataFrame(rows, "t long, id long, x array<double>, y double, i string").repartition(4), rows


def test_model_and_its_fisher_information_meet_numpy(spark):
    df, rows = made(spark)
    df = df.unionByName(spark.createDataFrame([(1, 1, None, 1.0, ""), (1, 2, [1.0, 2.0, 3.0], None, "")], df.schema))
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    xx, xy, n = C.moments(df)
    assert n == len(y) and np.allclose(xx, x.T @ x / n) and np.allclose(xy, x.T @ y / n)
    w, taken, g = np.zeros(3), np.zeros(3), None
    losses = [np.mean(y**2)]
    for _ in range(15):
        g = 2 / n * x.T @ (x @ w - y)
        w, taken = w - 0.1 * g, taken + 0.1 * g * g
        losses.append(np.mean((x @ w - y) ** 2))
    got, integral = C.descend(xx, xy, np.zeros(3), 0.1, 15)
    assert np.allclose(got, w) and np.allclose(integral, taken)
    assert losses[0] - losses[-1] == pytest.approx(taken.sum(), rel=0.3)  # to first order in the step
    fisher = C.fisher_information(df, w)
    assert np.allclose(fisher, np.mean((2 * (x @ w - y)[:, None] * x) ** 2, axis=0))
    assert np.allclose(C.penalty(w + 1, w, fisher, 2.0), fisher)
    assert C.moments(df.limit(0))[2] == 0 and C.fisher_information(df.limit(0), w).tolist() == [0, 0, 0]


def test_few_shots_part_each_task(spark):
    df, _ = made(spark, 3, 9)
    df = df.unionByName(spark.createDataFrame([(9, 1, [1.0, 0.0, 0.0], 1.0, ""), (None, 2, [1.0, 0.0, 0.0], 1.0, "")], df.schema))
    shots = C.few_shots(df, F.col("t"), F.col("id"), 3)
    got = {(r.task, r.part): r["count"] for r in shots.groupBy("task", "part").count().collect()}
    assert got == {(t, p): 3 for t in range(3) for p in ("support", "query")}
    assert sorted(map(tuple, shots.select("task", "part", "y").collect())) == sorted(map(tuple, C.few_shots(df.repartition(7), F.col("t"), F.col("id"), 3).select("task", "part", "y").collect()))


@pytest.mark.parametrize("kind", ["maml", "first_order", "reptile"])
def test_a_round_meets_numpy_and_rounds_help_held_out_tasks(spark, kind):
    df, _ = made(spark)
    tasks = C.few_shots(df, F.col("t"), F.col("id"), 8).cache()
    start = np.array([0.3, 0.2, 0.1])
    move, loss, n = C.meta_round(tasks, start, 0.05, 3, kind)
    groups = {}
    for r in tasks.collect():
        groups.setdefault(r.task, {"support": [], "query": []})[r.part].append((r.x, r.y))
    moves, losses = [], []
    for g in groups.values():
        (x, y), (xq, yq) = ((np.array([a for a, _ in g[p]]), np.array([b for _, b in g[p]])) for p in ("support", "query"))

        def adapted(s, x=x, y=y):
            for _ in range(3):
                s = s - 0.05 * 2 / len(y) * x.T @ (x @ s - y)
            return s

        query_loss = lambda s, xq=xq, yq=yq, f=adapted: np.mean((xq @ f(s) - yq) ** 2)
        losses.append(query_loss(start))
        if kind == "reptile":
            moves.append(adapted(start) - start)
        elif kind == "maml":  # against the slope of the query loss, by differences
            moves.append([-(query_loss(start + e) - query_loss(start - e)) / 2e-5 for e in np.eye(3) * 1e-5])
        else:
            w = adapted(start)
            moves.append(-2 / len(yq) * xq.T @ (xq @ w - yq))
    assert n == 12 and np.allclose(move, np.mean(moves, axis=0), atol=1e-6) and loss == pytest.approx(np.mean(losses))
    w, said = C.meta_train(tasks.filter("task < 9"), np.zeros(3), kind, rounds=6, outer=0.3, rate=0.05, steps=3, held_out=tasks.filter("task >= 9"))
    assert said[-1][2] < 0.5 * said[0][2] and said[-1][1] < 0.5 * said[0][1] and len(said) == 7
    assert C.meta_round(tasks.limit(0), start, 0.05, 3, kind)[2] == 0
