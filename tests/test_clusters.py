"""Clusters of whole tables beside plain versions that join two at a time."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import hierarchy as H
from recollect.operators import learning as L


def plain(rows, enough):
    """id -> the least id of its cluster: of all pairs of clusters the nearest joins, of equally near ones that with the least names."""
    points = {}
    for i, p in rows:
        points.setdefault(p, []).append(i)
    clusters = {min(ids): [(p, len(ids))] for p, ids in points.items()}
    mean = lambda a, b: round(sum(math.dist(p, q) * v * w for p, v in a for q, w in b) / sum(v for _, v in a) / sum(w for _, w in b), H.DIGITS)
    while len(clusters) > max(1, enough):
        _, a, b = min((mean(clusters[a], clusters[b]), a, b) for a in clusters for b in clusters if a < b)
        clusters[a] += clusters.pop(b)
    name = {p: c for c, ps in clusters.items() for p, _ in ps}
    return {i: name[p] for i, p in rows}


def made(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y), "clash") for i, (x, y) in rows], "id long, x double, y double, cluster string").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_meet_the_plain_version(spark, seed):
    rng = random.Random(seed)
    draw = (lambda: (rng.gauss(0, 1), rng.gauss(0, 3))) if seed == 1 else (lambda: (rng.randint(0, 3), rng.choice([0, 0, 1, 5])))  # ties and repeated points
    rows = [(i, draw()) for i in range(70)]
    for enough, block in ((12, H.BLOCK), (3, 9)):
        got = {r.id: r.cluster for r in H.hierarchical_clusters(made(spark, rows), "id", ["x", "y"], enough, block).collect()}
        assert got == plain(rows, enough)


def test_joins_rise_as_those_one_by_one(spark):
    rng = np.random.default_rng(3)
    rows = [(i, tuple(map(float, p))) for i, p in enumerate(rng.normal(size=(40, 2)))]
    got = sorted(r.d for r in H.merges(made(spark, rows), "id", ["x", "y"], 1, 11).collect())
    assert len(got) == 39 and got == sorted(got)


def test_edge_cases_of_clusters(spark):
    one = made(spark, [(4, (1, 1)), (2, (1, 1)), (9, (1, 1))])
    assert {(r.id, r.cluster) for r in H.hierarchical_clusters(one, "id", ["x", "y"], 2).collect()} == {(4, 2), (2, 2), (9, 2)}
    assert H.hierarchical_clusters(one.limit(0), "id", ["x"], 3).collect() == []
    some = one.withColumn("x", F.when(F.col("id") == 4, None).otherwise(F.col("x")))
    assert {(r.id, r.cluster) for r in H.hierarchical_clusters(some, "id", ["x", "y"], 2).collect()} == {(4, 4), (2, 2), (9, 2)}


def test_seeds_are_drawn_by_squared_distance(spark):
    """Two far groups of unlike size: the second seed stands in the other group all but always; seeds never repeat a point."""
    pts = [(f"a{i}", [i / 1000, 0.0]) for i in range(60)] + [(f"b{i}", [50 + i / 1000, 0.0]) for i in range(20)]
    v = spark.createDataFrame(pts, "key string, e array<double>").coalesce(2).cache()
    firsts = []
    for seed in range(12):
        (a, _), (b, _) = L.spread_seeds(v, 2, seed)
        assert a[0] != b[0]
        firsts.append(a)
    assert len(set(firsts)) > 6 and L.spread_seeds(v, 2, 3) == L.spread_seeds(v.repartition(5), 2, 3)
    same = spark.createDataFrame([("x", [1.0]), ("y", [1.0]), ("z", [2.0])], "key string, e array<double>")
    assert sorted(e for _, e in L.spread_seeds(same, 5)) == [[1.0], [2.0]]
    assert L.spread_seeds(v.limit(0), 3) == []


def test_rounds_end_where_each_row_is_nearest_its_mean(spark):
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal(c, 0.5, (30, 2)) for c in (0, 6, 12)])
    v = spark.createDataFrame([(str(i), p.tolist()) for i, p in enumerate(pts)], "key string, embedding array<double>")
    got = {int(r.key): r.cluster for r in L.kmeans_spread_start(v, 3).collect()}
    means = {c: pts[[i for i in got if got[i] == c]].mean(0) for c in set(got.values())}
    assert len(means) == 3 and all(min(means, key=lambda c: np.linalg.norm(pts[i] - means[c])) == got[i] for i in got)
    assert L.kmeans_spread_start(v.limit(0), 3).collect() == []


def test_seeded_clusters_take_as_many_rounds_as_their_sql(spark, monkeypatch):
    from recollect.operators import learning
    from recollect.plans import neighbours

    how = {}
    monkeypatch.setattr(learning, "kmeans_spread_start", lambda v, k, **h: how.update(h))
    neighbours.kmeans_spread_start(spark, "/root/testdata/sf0.001")
    assert how == {"rounds": 40, "moved": 0.0}


def test_clusters_take_few_rounds(spark, monkeypatch):
    """Joins within a box need no rounds of their own, nor do those that are too long to count."""
    wrote, write = [], H.materialize
    monkeypatch.setattr(H, "materialize", lambda df, name, **k: wrote.append(name) or write(df, name, **k))
    rng = np.random.default_rng(4)
    rows = [(i, tuple(map(float, p))) for i, p in enumerate(rng.normal(size=(150, 2)))]
    got = {r.id: r.cluster for r in H.hierarchical_clusters(made(spark, rows), "id", ["x", "y"], 15, 200).collect()}
    assert got == plain(rows, 15) and len(wrote) < 8
