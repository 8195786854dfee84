"""A linear model that goes on learning: what its parameters hold of a task, the price of changing them, and starts that adapt to new tasks in a few steps."""
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.vectors import literal
from recollect.session import materialize


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Means of x xT and of x y over rows(x, y), and their number: what the squared loss of a linear model depends on.

    A task sums its batches as one product and sends one matrix, whose size is that of the features.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                z = np.column_stack([x, b.column(1).to_numpy(zero_copy_only=False), np.ones(b.num_rows)])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["m"])

    data = rows.select(F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    sums = data.mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    if not sums:
        return np.zeros((0, 0)), np.zeros(0), 0
    m = np.array([r.v for r in sums])
    d = int(round(len(m) ** 0.5))
    m = m.reshape(d, d)
    n = int(round(m[-1, -1]))
    return m[:-2, :-2] / n, m[:-2, -2] / n, n


def descend(xx: np.ndarray, xy: np.ndarray, start: np.ndarray, rate: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights after so many steps down the mean squared error, and each weight's path integral: the loss its moves took off."""
    w, taken = start.astype(float).copy(), np.zeros(len(start))
    for _ in range(steps):
        g = 2 * (xx @ w - xy)
        w, taken = w - rate * g, taken + rate * g * g
    return w, taken


def fisher_information(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """The mean square of each weight's gradient of the squared error over rows(x, y), a row at a time, in one pass with partial sums."""
    w = literal(list(weights))
    error = F.aggregate(F.zip_with("x", w, lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a) - F.col("y")
    each = rows.filter("x IS NOT NULL AND y IS NOT NULL").select(F.posexplode(F.transform("x", lambda a: F.pow(2 * error * a, F.lit(2.0)))).alias("i", "f"))
    found = {r.i: r.f for r in each.groupBy("i").agg(F.avg("f").alias("f")).collect()}  # a row a weight
    return np.array([found.get(i, 0.0) for i in range(len(weights))])


def penalty(weights: np.ndarray, kept: np.ndarray, fisher: np.ndarray, strength: float = 0.4) -> np.ndarray:
    """What each weight's departure from the kept one costs: half of strength * fisher * departure squared."""
    return 0.5 * strength * fisher * (weights - kept) ** 2


def few_shots(rows: DataFrame, task: Column, key: Column, shots: int) -> DataFrame:
    """task, part (support or query), x, y: of each task's rows(x, y) the `shots` of least hash of their keys to learn from, and the next to be judged by.

    Tasks with fewer than two rows are left out; one of fewer than 2 * shots is parted evenly.
    """
    t = rows.select(task.alias("task"), F.xxhash64(key).alias("h"), key.cast("string").alias("k"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("double").alias("y"))
    nth = F.row_number().over(Window.partitionBy("task").orderBy("h", "k"))
    t = t.filter("task IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").withColumn("nth", nth).filter(F.col("nth") <= 2 * shots)
    n = F.count(F.lit(1)).over(Window.partitionBy("task"))
    return t.withColumn("n", n).filter("n > 1").select("task", F.when(F.col("nth") <= F.floor(F.col("n") / 2), "support").otherwise("query").alias("part"), "x", "y")


def adapt(x: np.ndarray, y: np.ndarray, start: np.ndarray, rate: float, steps: int) -> np.ndarray:
    w = start
    for _ in range(steps):
        w = w - rate * 2 / len(y) * (x.T @ (x @ w - y))
    return w


def task_update(x: np.ndarray, y: np.ndarray, xq: np.ndarray, yq: np.ndarray, start: np.ndarray, rate: float, steps: int, kind: str) -> tuple[np.ndarray, float]:
    """Where one task would move the start, and the loss on its query rows once adapted.

    reptile: towards the adapted weights. maml: against the gradient of the query loss with respect to the start, which
    goes back through each inner step; first_order: as if the steps had not moved.
    """
    w = adapt(x, y, start, rate, steps)
    loss = float(np.mean((xq @ w - yq) ** 2))
    if kind == "reptile":
        return w - start, loss
    g = 2 / len(yq) * (xq.T @ (xq @ w - yq))
    if kind == "maml":
        for _ in range(steps):
            g = g - rate * 2 / len(y) * (x.T @ (x @ g))
    elif kind != "first_order":
        raise ValueError(f"no kind {kind!r}")
    return -g, loss


def meta_round(tasks: DataFrame, start: np.ndarray, rate: float, steps: int, kind: str) -> tuple[np.ndarray, float, int]:
    """The mean move and loss over all tasks of few_shots, each a small group of its own, and how many tasks there are."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        s = (g["part"] == "support").to_numpy()
        x, y = np.stack(list(g["x"])), g["y"].to_numpy()
        move, loss = task_update(x[s], y[s], x[~s], y[~s], start, rate, steps, kind)
        return pd.DataFrame({"move": [[*move, loss]]})

    moved = tasks.groupBy("task").applyInPandas(run, "move array<double>").select(F.posexplode("move").alias("i", "v"))
    found = moved.groupBy("i").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()  # a row a weight
    if not found:
        return np.zeros(len(start)), float("nan"), 0
    v = np.array([r.v for r in found])
    return v[:-1], float(v[-1]), found[0].n


def meta_train(tasks: DataFrame, start: np.ndarray, kind: str = "maml", rounds: int = 10, outer: float = 0.5, rate: float = 0.1, steps: int = 3, held_out: DataFrame | None = None) -> tuple[np.ndarray, list[tuple[int, float, float | None]]]:
    """The trained start, and round, loss of the tasks before it, loss of held-out tasks. What rounds pass on is one vector of weights."""
    tasks = materialize(tasks, "meta-tasks")
    held_out = held_out if held_out is None else materialize(held_out, "meta-held-out")
    w, said = start.astype(float), []
    judged = lambda: None if held_out is None else meta_round(held_out, w, rate, steps, kind)[1]
    for r in range(rounds):
        move, loss, n = meta_round(tasks, w, rate, steps, kind)
        said.append((r, loss, judged()))
        if not n:
            break
        w = w + outer * move
    said.append((rounds, meta_round(tasks, w, rate, steps, kind)[1], judged()))
    return w, said
