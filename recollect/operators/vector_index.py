"""A kept index of vectors: coarse cells, searched by probes, or exactly by the cells' radii; rows are added and removed without a rebuild."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.session import materialize

#: Cells are fitted on so many rows at most (those with the least hashes), and number as the root of all rows, so many at most.
SAMPLE, MOST_CELLS = 65_536, 4096
#: Rows of a cell, and queries, that meet in one task.
BLOCK = 8192
#: Where all rows ask for all, the rows that ask in one task: fewer if that leaves less than so many tasks, but not fewer than these.
ASKING, ASKING_TASKS, ASKING_LEAST = 16_384, 24, 512
#: Rows that are held against all centroids at once, and copies of queries in a batch that leaves a task.
AT_ONCE, LEAVING = 256, 8192


def fit_cells(points: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Centroids by Lloyd's rounds from the first rows; a cell that loses all rows keeps its place."""
    centers = points[:cells].copy()
    for _ in range(rounds):
        near = nearest_cells(points, centers, 1)[0][:, 0]
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centers))
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
        if np.array_equal(new, centers):
            break
        centers = new
    return centers


def nearest_cells(points: np.ndarray, centers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest centroids of each point, nearest first, ties to the lower number, and the distances to all."""
    d = np.empty((len(points), len(centers)))
    for at in range(0, len(points), 1024):
        x = points[at : at + 1024]
        d[at : at + 1024] = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (centers**2).sum(1)[None] - 2 * x @ centers.T, 0))
    return (d.argmin(axis=1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n]), d


def calibrate(points: np.ndarray, centers: np.ndarray, k: int = 10, queries: int = 256, share: float = 0.95) -> int:
    """How many of the nearest cells hold `share` of the k nearest of a sample's first rows, within that sample.

    Fewer rows lie farther apart than all do, so the share among all is rather greater.
    """
    order, _ = nearest_cells(points, centers, len(centers))
    asked = points[:queries]
    rank = np.empty((len(asked), len(centers)), np.int64)
    np.put_along_axis(rank, order[: len(asked)], np.arange(len(centers))[None], 1)
    places = [rank[i, order[keys, 0]] for i, keys, _ in block_neighbours(np.arange(len(points)), points, np.arange(len(asked)), asked, k)]
    places = np.sort(np.concatenate(places)) if places else np.zeros(0)
    return int(places[min(len(places) - 1, int(share * len(places)))]) + 1 if len(places) else 1


def usable(v: Column) -> Column:
    """Whether a vector takes part: finite numbers only, not all of them zero."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as one matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(v: Column) -> Column:
    return F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)))


def block_neighbours(keys: np.ndarray, points: np.ndarray, query_keys: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each query: its index, and the keys and distances of its k nearest rows with another key, ties to the lesser key.

    Products choose the rows that may be among them; distances are measured on differences.
    """
    size = (points**2).sum(1)
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        near = (q**2).sum(1)[:, None] + size[None] - 2 * q @ points.T
        for i, row in enumerate(near, start=at):
            other = np.flatnonzero(keys != query_keys[i])
            row = row[other]
            if len(row) > k:
                bound = np.partition(row, k - 1)[k - 1]
                other = other[row <= bound + 1e-9 * (1 + abs(bound) + size.max() + (queries[i] ** 2).sum())]
            d = np.sqrt(((points[other] - queries[i]) ** 2).sum(1))
            order = np.lexsort((keys[other], np.round(d, 12)))[:k]
            yield i, keys[other][order], d[order]


class VectorIndex:
    """Tables in one folder: `cells` (centroids), `rows` by cell, `sizes` (rows and radius of each cell, a part for each batch), `removed`.

    Each change is a batch with a number of its own; a removal hides the rows of earlier batches only, so that a key may
    come back. Written tables are only added to, until compact(). Vectors that are not usable() and null keys are left
    out; of rows that share a key in a batch the least vector counts. Vectors must be of one length.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        head = spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # MOST_CELLS rows at most
        self.metric, self.kind, self.probes = head[0]["metric"], head[0]["kind"], head[0]["probes"]
        self.centers = np.array([r.centroid for r in head], float)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """A new index of vectors(key, embedding) in an empty folder that all executors share. metric: cosine or euclidean."""
        if metric not in ("cosine", "euclidean"):
            raise ValueError(f"no metric {metric!r}")
        rows = cls._prepared(vectors, metric)
        cells = min(cells or max(1, round(rows.count() ** 0.5)), MOST_CELLS)
        fitted = rows.orderBy(F.xxhash64("key"), "key").limit(sample).toPandas()["v"]
        if not len(fitted):
            raise ValueError("no vector to index")
        points = np.stack(list(fitted))
        centers = fit_cells(points, min(cells, len(fitted)))
        kind = dict(vectors.dtypes)["key"]
        probes = calibrate(points, centers)
        table = [(i, c.tolist(), metric, kind, probes) for i, c in enumerate(centers)]
        vectors.sparkSession.createDataFrame(table, "cell int, centroid array<double>, metric string, kind string, probes int").coalesce(1).write.parquet(f"{path.rstrip('/')}/cells")
        index = cls(vectors.sparkSession, path)
        index._write(rows, 1)
        return index

    @staticmethod
    def _prepared(vectors: DataFrame, metric: str) -> DataFrame:
        v = vectors.select("key", F.col("embedding").cast("array<double>").alias("v")).filter(usable(F.col("v")) & F.col("key").isNotNull())
        v = v.groupBy("key").agg(F.min("v").alias("v"))
        return v.select("key", _unit(F.col("v")).alias("v")) if metric == "cosine" else v

    def _write(self, rows: DataFrame, batch: int) -> None:
        centers = self.centers

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, AT_ONCE):
                    part = b.slice(at, AT_ONCE)
                    near, d = nearest_cells(_matrix(part.column(1)), centers, 1)
                    far = np.take_along_axis(d, near, 1)[:, 0]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near[:, 0].astype(np.int32)), pa.array(far)], ["key", "v", "cell", "far"])

        spread = F.pmod(F.xxhash64("key"), F.lit(64))  # a cell's rows are written by so many tasks at most
        placed = rows.mapInArrow(assign, f"key {self.kind}, v array<double>, cell int, far double").withColumn("batch", F.lit(batch))
        placed.repartition("cell", spread).write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")
        sizes = self.spark.read.parquet(f"{self.path}/rows").filter(F.col("batch") == batch).groupBy("cell", "batch").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
        sizes.coalesce(1).write.mode("append").parquet(f"{self.path}/sizes")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return self.spark.createDataFrame([], schema)

    def _batches(self) -> int:
        last = lambda t: t.agg(F.max("batch")).first()[0] or 0
        return max(last(self._table("sizes", "cell int, batch int, n long, radius double")), last(self._table("removed", f"key {self.kind}, batch int")))

    def add(self, vectors: DataFrame) -> None:
        """Rows of vectors(key, embedding); those whose key is there already replace it."""
        batch = self._batches() + 1
        rows = self._prepared(vectors, self.metric)
        rows.select("key", F.lit(batch).alias("batch")).write.mode("append").parquet(f"{self.path}/removed")
        self._write(rows, batch + 1)

    def remove(self, keys: DataFrame) -> None:
        """The rows with these keys are not found any more; their place is given back by compact()."""
        keys.select(F.col("key").cast(self.kind).alias("key"), F.lit(self._batches() + 1).alias("batch")).write.mode("append").parquet(f"{self.path}/removed")

    def rows(self) -> DataFrame:
        """key, v, cell of the rows that are there."""
        all_ = self.spark.read.parquet(f"{self.path}/rows").select("key", "v", "cell", "batch")
        gone = self._table("removed", f"key {self.kind}, batch int").groupBy("key").agg(F.max("batch").alias("_gone"))
        left = all_.join(gone, "key", "left").filter(F.col("_gone").isNull() | (F.col("batch") > F.col("_gone")))
        return left.select("key", "v", "cell")

    def compact(self, path: str) -> VectorIndex:
        """The same index without removed rows, in another folder."""
        self.spark.read.parquet(f"{self.path}/cells").write.parquet(f"{path.rstrip('/')}/cells")
        index = VectorIndex(self.spark, path)
        index._write(self.rows().select("key", "v"), 1)
        return index

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False) -> DataFrame:
        """query_id, rank, key, distance, similarity: of each of queries(query_id, embedding) the k nearest rows found, its own key left out.

        Distances are Euclidean, between unit vectors if the metric is cosine, and similarity is then the cosine. Rows in
        the `probes` nearest cells are measured; without a number, in as many as calibrate() found to hold nine neighbours in ten and more. exact: cells whose radius reaches the k-th distance so found are, too,
        in a second pass, so that no neighbour is missed. Ties, to 12 digits, go to the lesser key. Queries that aren't
        usable() find nothing; repeated ones count once.
        """
        q = self._prepared(queries.select(F.col("query_id").alias("key"), "embedding"), self.metric).select(F.col("key").alias("query_id"), F.col("v").alias("query"))
        sizes = self._table("sizes", "cell int, batch int, n long, radius double").groupBy("cell").agg(F.sum("n"), F.max("radius")).collect()  # a row a cell
        probes = min(probes or self.probes, len(self.centers))
        n, radius = np.zeros(len(self.centers), np.int64), np.full(len(self.centers), -np.inf)
        for cell, count, far in sizes:
            n[cell], radius[cell] = count, far
        found = self._nearest(self._probed(q, probes, radius), n, k)
        if exact:
            bound = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).alias("bound"))
            more = self._probed(q.join(bound, "query_id", "left"), probes, radius, rest=True)
            found = _first(found.drop("rank").unionByName(self._nearest(more, n, k).drop("rank")), k)
        similarity = 1 - F.col("distance") * F.col("distance") / 2 if self.metric == "cosine" else F.lit(None).cast("double")
        return found.select("query_id", "rank", "key", "distance", similarity.alias("similarity"))

    def _probed(self, q: DataFrame, probes: int, radius: np.ndarray, rest: bool = False) -> DataFrame:
        """query_id, query, cell: each query at its nearest cells; or, rest, at the others that may hold something nearer than its bound."""
        centers = self.centers
        kind = dict(q.dtypes)["query_id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a query leaves as often as there are cells for it: neither its distances nor its copies are held for a whole batch
            for whole in batches:
                for first in range(0, whole.num_rows, AT_ONCE):
                    b = whole.slice(first, AT_ONCE)
                    near, d = nearest_cells(_matrix(b.column(1)), centers, probes)
                    if rest:
                        bound = b.column(2).to_numpy(zero_copy_only=False).astype(float)
                        reach = d - radius[None] <= np.where(np.isnan(bound), np.inf, bound * (1 + 1e-9) + 1e-6)[:, None]
                        np.put_along_axis(reach, near, False, 1)
                        reach[:, radius < 0] = False
                        row, cell = np.nonzero(reach)
                    else:
                        row, cell = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
                    for at in range(0, len(row), LEAVING):
                        take = pa.array(row[at : at + LEAVING])
                        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(cell[at : at + LEAVING].astype(np.int32))], ["query_id", "query", "cell"])

        return q.mapInArrow(run, f"query_id {kind}, query array<double>, cell int")

    def _nearest(self, probed: DataFrame, n: np.ndarray, k: int) -> DataFrame:
        """query_id, key, distance, rank: a cell's rows and the queries at it meet in blocks, so that no cell must fit one task."""
        parts = F.array(*(F.lit(int(max(1, -(-x // BLOCK)))) for x in n))
        of_cell = lambda c: F.get(parts, c)
        cut = lambda key, seed, of: F.pmod(F.xxhash64(F.lit(seed), key), of).cast("int")
        asked = probed.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).collect()  # a row a cell
        if not asked:
            return self.spark.createDataFrame([], f"query_id {dict(probed.dtypes)['query_id']}, key {self.kind}, distance double, rank int")
        across = np.ones(len(n), int)
        for r in asked:
            across[r.cell] = -(-r.m // BLOCK)
        groups = F.array(*(F.lit(int(x)) for x in across))
        rows = self.rows().filter(F.col("cell").isin([r.cell for r in asked]))
        rows = rows.select("key", "v", "cell", cut("key", 1, of_cell(F.col("cell"))).alias("part"), F.explode(F.sequence(F.lit(0), F.get(groups, F.col("cell")) - 1)).alias("group"))
        q = probed.select("query_id", "query", F.col("cell").alias("cell2"), F.explode(F.sequence(F.lit(0), of_cell(F.col("cell")) - 1)).alias("part2"), cut("query_id", 2, F.get(groups, F.col("cell"))).alias("group2"))

        def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out: dict[str, list] = {"query_id": [], "key": [], "distance": []}
            if len(a) and len(b):
                ids = b["query_id"].to_numpy()
                for i, keys, d in block_neighbours(a["key"].to_numpy(), np.stack(list(a["v"])), ids, np.stack(list(b["query"])), k):
                    out["query_id"] += [ids[i]] * len(d)
                    out["key"] += keys.tolist()
                    out["distance"] += d.tolist()
            return pd.DataFrame(out)

        met = rows.groupBy("cell", "part", "group").cogroup(q.groupBy("cell2", "part2", "group2")).applyInPandas(meet, f"query_id {dict(q.dtypes)['query_id']}, key {self.kind}, distance double")
        return _first(met, k)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query; Spark keeps k rows a query and task before it exchanges them."""
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 12), "key")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _keep_nearest(rows: np.ndarray, keys: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each row, in order, ties to the lesser key; and their places."""
    order = np.lexsort((keys, np.round(d, 12), rows))
    rows, keys, d = rows[order], keys[order], d[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    first = place < k
    return rows[first], keys[first], d[first], place[first]


def all_neighbours(vectors: DataFrame, k: int) -> DataFrame:
    """key, other, distance, rank: the k nearest other rows of every one of vectors(key, embedding) by Euclidean distance, exactly; ties, to 12 digits, to the lesser key.

    Each task has some rows that ask, and all rows pass by in batches: products tell which may be nearer than the k-th so
    far, and those are measured on differences. So every row is sent once to each task, a task holds its own rows and a
    batch, and k rows leave for each that asks. Rows that an index leaves out take no part.
    """
    kind = dict(vectors.dtypes)
    rows = VectorIndex._prepared(vectors, "euclidean")
    rows = materialize(rows.select("key", F.col("v").cast("array<float>").alias("v")) if kind["embedding"] == "array<float>" else rows, "asking-rows")
    n = rows.count()
    tasks = max(1, min(-(-n // ASKING_LEAST), max(ASKING_TASKS, -(-n // ASKING))))
    task = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))
    dealt = rows.select("key", "v", F.pmod(F.xxhash64("key"), F.lit(tasks)).cast("int").alias("mine"), task.alias("task"))
    dealt = dealt.select("task", (F.col("mine") == F.col("task")).alias("own"), "key", "v").repartitionById(tasks, "task").sortWithinPartitions(F.desc("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[np.ndarray, np.ndarray]] = []
        strips: list[list] = []

        def pass_by(keys: np.ndarray, points: np.ndarray) -> None:
            size = (points**2).sum(1)
            for strip in strips:
                names, q, bound, found = strip
                mine = (q**2).sum(1)
                near = mine[:, None] + size[None] - 2 * q @ points.T
                far = bound
                if len(keys) > k + 1:  # a row may meet itself
                    far = np.where(np.isfinite(bound), bound, np.partition(near, k, axis=1)[:, k] if not np.isfinite(bound).all() else bound)
                r, c = np.nonzero(near <= (far + 1e-9 * (1 + np.where(np.isfinite(far), far, 0) + size.max(initial=0) + mine))[:, None])
                other = keys[c] != names[r]
                r, c = r[other], c[other]
                d = np.sqrt(((points[c] - q[r]) ** 2).sum(1))
                strip[3] = r, _, d, place = _keep_nearest(*(np.concatenate([x, y]) for x, y in zip(found[:3], (r, keys[c], d), strict=True)), k)
                bound[r[place == k - 1]] = d[place == k - 1] ** 2

        def ask() -> None:
            names, points = (np.concatenate(x) for x in zip(*own, strict=True))
            for at in range(0, len(names), AT_ONCE):
                q = points[at : at + AT_ONCE]
                strips.append([names[at : at + AT_ONCE], q, np.full(len(q), np.inf), (np.empty(0, int), names[:0], np.empty(0), np.empty(0, int))])
            for x, y in own:
                pass_by(x, y)

        for b in batches:
            keys, points, asks = b.column(2).to_numpy(zero_copy_only=False), _matrix(b.column(3)).astype(float), int(b.column(1).to_numpy(zero_copy_only=False).sum())
            if asks:
                own.append((keys[:asks], points[:asks]))
            if asks < len(keys) and own:
                if not strips:
                    ask()
                pass_by(keys[asks:], points[asks:])
        if own and not strips:
            ask()
        for names, _, _, (r, keys, d, place) in strips:
            yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(keys), pa.array(d), pa.array(place.astype(np.int32) + 1)], ["key", "other", "distance", "rank"])

    return dealt.mapInArrow(run, f"key {kind['key']}, other {kind['key']}, distance double, rank int")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, recall: the share of each query's true neighbours (query_id, key) that were found."""
    hits = found.select("query_id", "key").distinct().withColumn("_hit", F.lit(1))
    return truth.select("query_id", "key").join(hits, ["query_id", "key"], "left").groupBy("query_id").agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))
