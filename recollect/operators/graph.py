"""Graph operators over edges(src, dst, rel_type, strength, confidence, valid_from, valid_to)."""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.vector_index import MOST_CELLS, fit_cells, nearest_cells
from recollect.session import materialize

#: Fixed weights of relation types, and what each hop leaves of a strength.
TYPE_WEIGHTS = {"causes": 1.0, "caused_by": 1.0, "part_of": 0.9, "contains": 0.9, "semantic": 0.8, "depends_on": 0.8, "related_to": 0.7, "similar_to": 0.7, "temporal": 0.6, "references": 0.6, "contradicts": 0.3}
OTHER_WEIGHT, HOP = 0.5, 0.8
#: Copies of vectors that leave a task at once, and rows of a block whose likeness to another block's is held at once.
COPIES, STRIP = 8192, 128
#: Rows of a block of vectors at least and at most, and how many blocks there are between these bounds.
LEAST_ROWS, MOST_ROWS, PARTS = 4096, 32_768, 24
MIN_CONFIDENCE = 0.6


def undirected(edges: DataFrame) -> DataFrame:
    """node, other for both ends of each edge, with the edge's columns."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    there = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), *rest)
    return there.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), *rest))


def neighbors(edges: DataFrame, nodes: list[str] | None = None, direction: str = "both", rel_type: str | None = None, min_strength: float | None = None, min_confidence: float | None = None) -> DataFrame:
    """node, other: distinct neighbours. All declared options hold."""
    e = edges
    for c, v in (("strength", min_strength), ("confidence", min_confidence)):
        if v is not None:
            e = e.filter(F.col(c) >= v)
    if rel_type:
        e = e.filter(F.col("rel_type") == rel_type)
    if direction == "both":
        e = undirected(e)
    else:
        a, b = ("src", "dst") if direction == "out" else ("dst", "src")
        e = e.select(F.col(a).alias("node"), F.col(b).alias("other"))
    if nodes is not None:
        e = e.filter(F.col("node").isin(nodes))
    return e.select("node", "other").distinct()


def valid_at(t: Column) -> Column:
    """valid_from <= t < valid_to, open ends where null."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (t < F.col("valid_to")))


def neighbors_as_of(edges: DataFrame, nodes: list[str], t: Column) -> DataFrame:
    return undirected(edges.filter(valid_at(t))).filter(F.col("node").isin(nodes)).select("node", "other", "rel_type", "strength")


def bfs(edges: DataFrame, seeds: list[str], depth: int) -> DataFrame:
    """seed, node, hops, path: every node within depth of each seed, by its fewest hops and, of those, the least path.

    Each level is one join of the frontier and one anti-join with what was seen; levels, and the links that all of them
    read, are written to the shared folder.
    """
    spark = edges.sparkSession
    links = materialize(undirected(edges.select("src", "dst")).distinct(), "links-by-node")
    frontier = seen = spark.createDataFrame([(s, s, 0, s) for s in seeds], "seed string, node string, hops int, path string")
    for d in range(1, depth + 1):
        step = frontier.join(links, "node").groupBy("seed", F.col("other").alias("node")).agg(F.min(F.concat_ws(">", "path", "other")).alias("path"))
        frontier = materialize(step.join(seen, ["seed", "node"], "left_anti").select("seed", "node", F.lit(d).alias("hops"), "path"), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def shortest_paths(edges: DataFrame, pairs: list[tuple[str, str]], depth: int = 10) -> DataFrame:
    """source, target, hops, length (nodes), path: none where the target is out of reach."""
    want = edges.sparkSession.createDataFrame(pairs, "seed string, node string")
    found = bfs(edges, sorted({a for a, _ in pairs}), depth).join(F.broadcast(want), ["seed", "node"])
    return found.select(F.col("seed").alias("source"), F.col("node").alias("target"), "hops", (F.col("hops") + 1).alias("length"), "path")


def expand_seeds(edges: DataFrame, seeds: list[tuple[str, float]], hops: int = 2, frontier: int = 16, expanded: int = 32, decay: float = HOP) -> DataFrame:
    """node, score, hops: scores spread over edges by strength and decay; the best per node, caps as the options say, seeds left out."""
    spark = edges.sparkSession
    links = materialize(undirected(edges).select("node", "other", "strength"), "links-by-node")
    level = spark.createDataFrame(seeds, "node string, score double")
    first = [s for s, _ in seeds]
    out = None
    for h in range(1, hops + 1):
        order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), F.asc("node"))
        level = level.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= frontier).drop("_r")
        level = level.join(links, "node").groupBy(F.col("other").alias("node")).agg(F.max(F.round(F.col("score") * F.col("strength") * decay, 12)).alias("score")).filter(~F.col("node").isin(first))
        level = materialize(level, "expanded")
        out = level.withColumn("hops", F.lit(h)) if out is None else out.unionByName(level.withColumn("hops", F.lit(h)))
    best = out.groupBy("node").agg(F.max("score").alias("score"), F.max_by("hops", F.struct("score", -F.col("hops"))).alias("hops"))
    return best.orderBy(F.desc("score"), "node").limit(expanded)


def relationship_strength(types: Column, hops: Column) -> Column:
    """0.8 to the hops, times the weights of the types along the path."""
    w = F.create_map(*(x for k, v in TYPE_WEIGHTS.items() for x in (F.lit(k), F.lit(v))))
    return F.pow(F.lit(HOP), hops) * F.aggregate(types, F.lit(1.0), lambda a, t: a * F.coalesce(F.try_element_at(w, t), F.lit(OTHER_WEIGHT)))


def graph_stats(edges: DataFrame) -> DataFrame:
    """nodes, edges, avg_degree, density, max_degree, hub of an undirected reading."""
    deg = undirected(edges).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    s = deg.agg(F.count(F.lit(1)).alias("nodes"), (F.sum("d") / 2).cast("long").alias("edges"), F.max("d").alias("max_degree"), F.min_by("node", F.struct(-F.col("d"), "node")).alias("hub"))
    n, e = F.col("nodes"), F.col("edges")
    return s.select("nodes", "edges", F.try_divide(2 * e, n).alias("avg_degree"), F.try_divide(e, n * (n - 1) / 2).alias("density"), "max_degree", "hub")


def infer_transitive(edges: DataFrame, rel_type: str, weight: float = 0.8) -> DataFrame:
    """src, dst, confidence of A->C from A->B and B->C that is not there yet, confidence at least 0.6."""
    e = edges.filter(F.col("rel_type") == rel_type).select("src", "dst", "confidence")
    b = e.select(F.col("src").alias("dst"), F.col("dst").alias("far"), F.col("confidence").alias("c2"))
    r = e.join(b, "dst").filter("src <> far").groupBy("src", F.col("far").alias("dst")).agg(F.max(F.col("confidence") * F.col("c2") * weight).alias("confidence"))
    return r.filter(F.col("confidence") >= MIN_CONFIDENCE).join(e.select("src", "dst"), ["src", "dst"], "left_anti")


def infer_symmetric(edges: DataFrame, rel_type: str, weight: float = 0.9) -> DataFrame:
    """The missing reverse of each edge."""
    e = edges.filter(F.col("rel_type") == rel_type).select("src", "dst", "confidence")
    r = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("confidence") * weight).alias("confidence"))
    return r.filter(F.col("confidence") >= MIN_CONFIDENCE).join(e.select("src", "dst"), ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def infer_inverse(edges: DataFrame, rel_type: str, inverse: str, weight: float = 1.0) -> DataFrame:
    """Reversed edges of the inverse type where there are none."""
    e = edges.filter((F.col("rel_type") == rel_type) & (F.col("confidence") * weight >= MIN_CONFIDENCE))
    r = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("confidence") * weight).alias("confidence"))
    return r.join(edges.filter(F.col("rel_type") == inverse).select("src", "dst"), ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def near_in_time(nodes: DataFrame, hours: float, weight: float = 0.7) -> DataFrame:
    """a, b, confidence: pairs of nodes(key, at) within hours of each other, a < b; an equi-join on time cells, not a cross join."""
    width = F.lit(int(hours * 3600))
    n = nodes.select("key", F.unix_timestamp(F.col("at").cast("timestamp")).alias("s")).withColumn("cell", F.floor(F.col("s") / width))
    m = n.select(F.col("key").alias("b"), F.col("s").alias("s2"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    p = n.join(m, "cell").filter((F.col("key") < F.col("b")) & (F.abs(F.col("s") - F.col("s2")) <= width))
    return p.select(F.col("key").alias("a"), "b", F.round((1 - F.floor(F.abs(F.col("s") - F.col("s2")) / 60) / (60 * hours)) * weight, 9).alias("confidence"))


def _near_cells(centers: np.ndarray, radius: np.ndarray, reach: float) -> list[list[int]]:
    """For each cell the cells, itself and those after it, whose points may lie within reach of its own."""
    out = []
    for i, c in enumerate(centers):
        far = np.sqrt(((centers[i:] - c) ** 2).sum(1)) - radius[i] - radius[i:]
        out.append((np.flatnonzero(far <= reach) + i).tolist())
    return out


def _placed(vectors: DataFrame, parts: int, threshold: float, sample: int) -> tuple[DataFrame, list[list[int]]]:
    """key, e, i of vectors(key, e): the cell of each, and for each cell those that any pair at the threshold may join it to.

    Cells are fitted on at most `sample` unit vectors, those of least hash; every row is placed, and a cell's radius is that
    of all its rows. Of a zero vector, which is like nothing, the cell doesn't matter.
    """
    unit = lambda x: np.divide(x, n := np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=n > 0)
    some = vectors.filter(F.exists("e", lambda x: x != 0)).orderBy(F.xxhash64("key"), "key").limit(sample).select("e").toPandas()["e"]
    points = unit(np.stack(list(some))) if len(some) else np.zeros((1, 1))
    centers = fit_cells(points, min(parts, MOST_CELLS, len(points)), 5)
    kind = dict(vectors.dtypes)["key"]

    def place(batches):
        for b in batches:
            if b.num_rows:
                x = unit(np.stack(b.column(1).to_numpy(zero_copy_only=False)))
                near, d = nearest_cells(x, centers, 1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near[:, 0].astype(np.int32)), pa.array(d[np.arange(len(x)), near[:, 0]])], ["key", "e", "i", "far"])

    placed = materialize(vectors.mapInArrow(place, f"key {kind}, e array<double>, i int, far double"), "placed")
    radius = np.full(len(centers), -1e9 if threshold > 0 else 0.0)
    for r in placed.filter(F.exists("e", lambda x: x != 0)).groupBy("i").agg(F.max("far").alias("far")).collect():  # a row a cell
        radius[r.i] = r.far
    reach = max(0.0, 2 - 2 * threshold) ** 0.5 + 1e-6 if threshold > 0 else np.inf  # below, what is like nothing is near enough
    return placed.select("key", "e", "i"), _near_cells(centers, radius, reach)


def _copies(vectors: DataFrame, threshold: float, block: int | None, sample: int) -> tuple[DataFrame, str, pa.DataType]:
    """key, e, i, j, second: for every two blocks i and j that meet the rows of i, and those of j as second; and the key's type.

    More rows than a block are placed in cells; two cells that lie farther apart than their radii and the threshold allow
    never meet, so what is measured follows how the vectors cluster. Cells are cut into blocks by their own size. Without a
    block's size, it grows with the rows between two bounds, so that a row's copies don't.
    """
    v = vectors.select("key", F.col("embedding").cast("array<double>").alias("e")).filter("e IS NOT NULL")
    rows = v.count()
    block = block or min(MOST_ROWS, max(LEAST_ROWS, -(-rows // PARTS)))
    parts = max(1, -(-rows // block))
    if parts > 1:
        v, near = _placed(v, parts, threshold, sample)
        sizes = {r.i: r["count"] for r in v.groupBy("i").count().collect()}  # a row a cell
        cuts = [max(1, -(-sizes.get(i, 0) // block)) for i in range(len(near))]
        start = np.concatenate([[0], np.cumsum(cuts)]).tolist()  # blocks are numbered through, cell by cell
        own = F.get(F.array(*(F.lit(int(x)) for x in start)), F.col("i")) + F.pmod(F.xxhash64("key"), F.get(F.array(*(F.lit(int(x)) for x in cuts)), F.col("i"))).cast("int")
        v = v.select("key", "e", "i", own.alias("block"))
        meets = [[k for j in near[i] for k in range(start[j], start[j + 1])] for i in range(len(near))]
    else:
        v, meets, start = v.select("key", "e", F.lit(0).alias("i"), F.lit(0).alias("block")), [[0]], [0, 1]
    met: list[list[int]] = [[] for _ in range(start[-1])]  # of each block those before it that it meets
    of = [i for i in range(len(meets)) for _ in range(start[i], start[i + 1])]
    for b, i in enumerate(of):
        for k in meets[i]:
            if k >= b:
                met[k].append(b)
    ahead = [[k for k in meets[i] if k >= b] for b, i in enumerate(of)]
    kind = dict(v.dtypes)["key"]

    key_type = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]

    def deal(batches):
        # the copies of a row grow with the blocks it meets: they leave in batches of one size
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                blocks = b.column(2).to_numpy().tolist()
                take = np.repeat(np.arange(len(blocks)), [len(ahead[x]) + len(met[x]) for x in blocks])
                left = np.array([k for x in blocks for k in [x] * len(ahead[x]) + met[x]], np.int32)
                right = np.array([k for x in blocks for k in ahead[x] + [x] * len(met[x])], np.int32)
                second = np.array([k for x in blocks for k in [False] * len(ahead[x]) + [True] * len(met[x])], bool)
                for k in range(0, len(take), COPIES):
                    rows = pa.array(take[k : k + COPIES])
                    columns = [b.column(0).take(rows), b.column(1).take(rows), *(pa.array(c[k : k + COPIES]) for c in (left, right, second))]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "e", "i", "j", "second"])

    return v.select("key", "e", "block").mapInArrow(deal, f"key {kind}, e array<double>, i int, j int, second boolean"), kind, key_type


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _meet(batches: Iterator[pa.RecordBatch], key_type: pa.DataType, threshold: float):
    """The keys of two blocks in order, and a function that gives their like pairs strip by strip: places of both keys, likeness."""
    t = pa.Table.from_batches(list(batches))
    same = t.column("i")[0].as_py() == t.column("j")[0].as_py()
    a, b = t.filter(pc.invert(t.column("second"))), t.filter(t.column("second"))
    if not len(a) or not len(b):
        return pa.array([], key_type), lambda: iter(())
    x, y = _unit(a.column("e")), _unit(b.column("e"))
    names, place = np.unique(np.concatenate([u.column("key").to_numpy() for u in (a, b)]), return_inverse=True)
    ka, kb = place[: len(x)], place[len(x) :]
    strip = max(1, STRIP * LEAST_ROWS // max(LEAST_ROWS, len(y)))

    def strips():
        for at in range(0, len(x), strip):
            s = x[at : at + strip] @ y.T
            p, q = np.nonzero(s >= threshold)
            k, m, v = ka[at + p], kb[q], s[p, q]
            keep = k < m if same else k != m
            yield k[keep], m[keep], v[keep]

    return pa.array(names, key_type), strips


def similar_pairs(vectors: DataFrame, threshold: float, block: int = 4096, sample: int = 65_536) -> DataFrame:
    """a, b, similarity: pairs of vectors(key, embedding) with cosine at least threshold, a < b.

    Two blocks meet as one matrix product a task; only pairs over the threshold leave it.
    """
    copies, kind, key_type = _copies(vectors, threshold, block, sample)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, strips = _meet(batches, key_type, threshold)
        for k, m, v in strips():  # a strip's pairs leave before the next one's are found
            if len(k):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.minimum(k, m))), names.take(pa.array(np.maximum(k, m))), pa.array(v)], ["a", "b", "similarity"])

    return copies.groupBy("i", "j").applyInArrow(pair, f"a {kind}, b {kind}, similarity double")


def spanning(k: np.ndarray, m: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Places of the pairs (k, m) that join what root, which holds each item's class, has not joined; root is brought up to date. Pairs of one k lie together."""
    out = []
    open_ = np.flatnonzero(root[k] != root[m])
    held = np.zeros(len(root), bool)
    for here in np.split(open_, np.flatnonzero(np.diff(k[open_])) + 1):
        if not len(here):
            continue
        own = root[k[here[0]]]
        classes, first = np.unique(root[m[here]], return_index=True)
        first, classes = first[classes != own], classes[classes != own]
        if len(classes):
            out.append(here[first])
            held[classes] = True
            root[held[root]] = own
            held[classes] = False
    return np.concatenate(out) if out else np.empty(0, int)


def similar_links(vectors: DataFrame, threshold: float, neighbours: int = 1, block: int | None = None, sample: int = 65_536) -> DataFrame:
    """u, v, n, s: what like pairs of vectors(key, embedding) come to, without the pairs. Rows without v tell of u's n pairs with summed likeness s, and add up; others link u and v.

    Links join all that pairs join, by no more than a tree for every two blocks. Items with fewer than `neighbours` pairs
    keep all of theirs, and pass nothing on: links between others join what pairs of two such items join.
    """
    copies, kind, key_type = _copies(vectors, threshold, block, sample)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, strips = _meet(batches, key_type, threshold)
        size = len(names)
        n, s, root = np.zeros(size, np.int64), np.zeros(size), np.arange(size)

        def links(k: np.ndarray, m: np.ndarray, sure: np.ndarray) -> Iterator[pa.RecordBatch]:
            both = sure[k] & sure[m]
            where = np.flatnonzero(both)
            take = np.concatenate([np.flatnonzero(~both), where[spanning(k[where], m[where], root)]])
            if len(take):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(k[take])), names.take(pa.array(m[take])), pa.nulls(len(take), pa.int64()), pa.nulls(len(take), pa.float64())], ["u", "v", "n", "s"])

        for k, m, v in strips():
            for x in (k, m):
                n += np.bincount(x, minlength=size)
                s += np.bincount(x, v, size)
            if neighbours <= 1:
                yield from links(k, m, np.ones(size, bool))
        sure = n >= neighbours  # in these two blocks alone; what is not keeps fewer pairs than that
        for k, m, _ in strips() if neighbours > 1 and n.any() else ():
            yield from links(k, m, sure)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.nulls(len(some), key_type), pa.array(n[some]), pa.array(s[some])], ["u", "v", "n", "s"])

    return copies.groupBy("i", "j").applyInArrow(digest, f"u {kind}, v {kind}, n long, s double")
