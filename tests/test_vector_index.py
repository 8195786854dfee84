"""The kept index of vectors beside brute force: exact search, recall of probes, adding, removing and reading back."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import vector_index as X

SCHEMA = "key long, embedding array<float>, cell string, v string"


def made(n, dims=12, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(8, dims)) * 3
    return (centers[rng.integers(0, 8, n)] + rng.normal(size=(n, dims))).astype(np.float32)


def table(spark, points, first=0):
    return spark.createDataFrame([(first + i, None if p is None else [float(x) for x in p], "clash", "clash") for i, p in enumerate(points)], SCHEMA).repartition(3)


def brute(keys, points, queries, k, metric):
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
    p = unit(np.asarray(points, float))
    out = {}
    for q in queries:
        d = np.round(np.sqrt(((p - p[list(keys).index(q)]) ** 2).sum(1)), 12)
        out[q] = [x for _, x in sorted((a, b) for a, b in zip(d, keys, strict=True) if b != q)][:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.key)
    return out


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_exact_search_meets_brute_force(spark, tmp_path, metric):
    p = made(700)
    p[50:60] = p[40]  # repeated points: ties go to the lesser key
    index = X.VectorIndex.build(table(spark, p), str(tmp_path / "index"), metric)
    queries = table(spark, p).filter("key % 50 = 0").withColumnRenamed("key", "query_id")
    got = index.search(queries, k=10, probes=1, exact=True)
    assert found(got) == brute(range(700), p, range(0, 700, 50), 10, metric)
    if metric == "cosine":
        r = got.filter("query_id = 0 and rank = 1").first()
        a, b = p[0].astype(float), p[r.key].astype(float)
        assert r.similarity == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def test_probes_find_nine_of_ten_and_more_with_more(spark, tmp_path):
    p = made(3000, seed=3)
    index = X.VectorIndex.build(table(spark, p), str(tmp_path / "index"), "euclidean")
    queries = table(spark, p).filter("key % 50 = 0").withColumnRenamed("key", "query_id").cache()
    truth = index.search(queries, exact=True).cache()
    mean = lambda probes: X.recall(index.search(queries, probes=probes), truth).agg(F.avg("recall")).first()[0]
    few, some = mean(1), mean(8)
    assert few < some and some >= 0.9 and mean(len(index.centers)) == 1.0


def test_removed_rows_are_not_found_and_come_back_when_added(spark, tmp_path):
    p = made(300, seed=5)
    path = str(tmp_path / "index")
    X.VectorIndex.build(table(spark, p), path, "euclidean")
    X.VectorIndex(spark, path).remove(spark.range(0, 300, 7).withColumnRenamed("id", "key"))
    index = X.VectorIndex(spark, path)
    queries = table(spark, p).filter("key % 50 = 1").withColumnRenamed("key", "query_id")
    left = [i for i in range(300) if i % 7]
    ids = [i for i in left if i % 50 == 1]
    want = brute(left, p[left], ids, 5, "euclidean")
    got = found(index.search(queries, k=5, exact=True))
    assert {q: got[q] for q in ids} == want and not any(x % 7 == 0 for xs in got.values() for x in xs)
    smaller = index.compact(str(tmp_path / "smaller"))
    assert found(smaller.search(queries, k=5, exact=True)) == got
    index.add(table(spark, p[:8]))  # 0 and 7 come back; others replace themselves
    index.add(table(spark, made(20, seed=9), first=1000))
    whole = [*range(8), *[i for i in left if i >= 8], *range(1000, 1020)]
    points = np.vstack([p[[i for i in whole if i < 300]], made(20, seed=9)])
    assert index.rows().count() == len(whole)
    assert found(X.VectorIndex(spark, path).search(queries, k=5, exact=True))[1] == brute(whole, points, [1], 5, "euclidean")[1]


def test_odd_vectors_take_no_part(spark, tmp_path):
    rows = [[1.0, 0.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], None, [0.5, 0.5], [2.0, 0.0]]
    df = table(spark, rows).unionByName(table(spark, [[0.1, 0.9]], first=5))  # 5 twice: the lesser vector counts
    index = X.VectorIndex.build(df, str(tmp_path / "index"))
    got = found(index.search(df.withColumnRenamed("key", "query_id"), k=10, exact=True))
    assert got == {0: [6, 5], 5: [0, 6], 6: [0, 5]}
    assert index.search(df.limit(0).withColumnRenamed("key", "query_id")).collect() == []
    with pytest.raises(ValueError, match="no vector"):
        X.VectorIndex.build(df.limit(0), str(tmp_path / "none"))
    with pytest.raises(ValueError, match="metric"):
        X.VectorIndex.build(df, str(tmp_path / "none"), "manhattan")


def test_large_cells_and_many_queries_are_cut_into_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 40)
    p = made(400, seed=7)
    index = X.VectorIndex.build(table(spark, p), str(tmp_path / "index"), "euclidean", cells=3)
    got = found(index.search(table(spark, p).withColumnRenamed("key", "query_id"), k=4, probes=2, exact=True))
    assert got == brute(range(400), p, range(400), 4, "euclidean")


def test_copies_of_queries_leave_in_small_batches(spark, tmp_path):
    import pyarrow as pa

    from recollect.operators import vector_index as X

    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 8))
    index = X.VectorIndex.build(spark.createDataFrame(list(enumerate(x.tolist())), "key long, embedding array<double>"), str(tmp_path / "index"), "euclidean")

    class Queries:
        dtypes = [("query_id", "bigint")]

        def mapInArrow(self, run, schema):
            return run

    b = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(x.tolist()), pa.array([None] * 2000, pa.float64())], ["query_id", "query", "bound"])
    cells = len(index.centers)
    for rest, each in ((False, 3), (True, cells - 3)):
        out = list(index._probed(Queries(), 3, np.ones(cells), rest=rest)(iter([b])))
        assert sum(o.num_rows for o in out) == 2000 * each and max(o.num_rows for o in out) <= X.LEAVING
        assert len({(q, c) for o in out for q, c in zip(o.column(0).to_pylist(), o.column(2).to_pylist(), strict=True)}) == 2000 * each
        assert all(np.array_equal(o.column(1)[0].as_py(), x[o.column(0)[0].as_py()]) for o in out)
