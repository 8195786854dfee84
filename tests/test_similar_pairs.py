"""Pairs of like vectors beside every pair, over one block and many, with vectors of no length and repeated ones."""
import numpy as np
import pyarrow as pa
import pytest

from recollect.operators import graph as G


def brute(rows, threshold):
    out = {}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if x is None or y is None:
                continue
            n = np.linalg.norm(x) * np.linalg.norm(y)
            s = float(np.dot(x, y) / n) if n else 0.0
            if s >= threshold:
                out[min(a, b), max(a, b)] = s
    return out


@pytest.mark.parametrize("threshold", [0.97, 0.6, -0.5])
@pytest.mark.parametrize("block", [4096, 25])
def test_pairs_meet_every_pair(spark, block, threshold):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(9, 6)) * 4
    rows = [(f"k{i:03d}", (centers[i % 9] + rng.normal(size=6) * (0.4 if i % 3 else 2)).tolist()) for i in range(200)]
    rows += [(f"r{i}", [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(60)] + [("z1", [0.0] * 6), ("z2", [0.0] * 6), ("n", None)]
    v = spark.createDataFrame(rows, "key string, embedding array<double>").repartition(3)
    got = {(r.a, r.b): r.similarity for r in G.similar_pairs(v, threshold, block, sample=100).collect()}
    want = brute(rows, threshold)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_cells_that_lie_far_apart_never_meet():
    centers = np.array([[1.0, 0.0], [0.99, 0.14], [-1.0, 0.0], [0.0, 1.0]])
    near = G._near_cells(centers, np.array([0.05, 0.05, 0.05, -np.inf]), (2 - 2 * 0.95) ** 0.5)
    assert near == [[0, 1], [1], [2], []]


def test_no_vectors_no_pairs(spark):
    assert G.similar_pairs(spark.createDataFrame([], "key string, embedding array<double>"), 0.5).collect() == []


def test_pairs_and_copies_leave_in_small_batches(spark):
    """Every vector is like every other, in many blocks: no batch holds more than a strip's pairs, or COPIES rows."""
    v = spark.createDataFrame([(i, [1.0, i / 1e6]) for i in range(900)], "key long, embedding array<double>")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    pairs = G.similar_pairs(v, 0.5, 300)
    assert pairs.count() == 900 * 899 // 2
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "CoGroups" not in plan
    assert max(r.n for r in pairs.mapInArrow(sizes, "n long").collect()) <= G.STRIP * 900


@pytest.mark.parametrize("block", [None, 25])
def test_links_join_what_pairs_join_and_count_them_without_writing_them(spark, block):
    rng = np.random.default_rng(5)
    rows = [(f"k{i:03d}", rng.normal(size=6).tolist()) for i in range(150)] + [(f"r{i:03d}", [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(400)] + [("z1", [0.0] * 6), ("n", None)]
    v = spark.createDataFrame(rows, "key string, embedding array<double>").repartition(3)
    want, root = brute(rows, 0.85), {k: k for k, _ in rows}
    found = G.similar_links(v, 0.85, 1, block, sample=100).collect()

    def join(pairs):
        root = {k: k for k, _ in rows}
        for a, b in pairs:
            old, new = root[a], root[b]
            root = {k: new if r == old else r for k, r in root.items()}
        groups = {}
        for k, r in root.items():
            groups.setdefault(r, set()).add(k)
        return sorted(sorted(g) for g in groups.values())

    links = [(r.u, r.v) for r in found if r.v is not None]
    parts = 1 if block is None else -(-len(rows) // block) * 2  # a cell's last block may be small
    assert join(links) == join(want) and len(links) < len(rows) * parts < len(want)
    for k in root:
        of = [s for p, s in want.items() if k in p]
        assert sum(r.n for r in found if r.v is None and r.u == k) == len(of)
        assert abs(sum(r.s for r in found if r.v is None and r.u == k) - sum(of)) < 1e-6


@pytest.mark.parametrize("block", [None, 20])
def test_items_with_few_pairs_keep_them_all(spark, block):
    rng = np.random.default_rng(6)
    rows = [(f"k{i:03d}", rng.normal(size=4).tolist()) for i in range(120)]
    want = brute(rows, 0.9)
    n = {k: sum(k in p for p in want) for k, _ in rows}
    found = G.similar_links(spark.createDataFrame(rows, "key string, embedding array<double>"), 0.9, 4, block, sample=100).collect()
    links = {(min(r.u, r.v), max(r.u, r.v)) for r in found if r.v is not None}
    assert links <= want.keys() and {p for p in want if n[p[0]] < 4 or n[p[1]] < 4} <= links
