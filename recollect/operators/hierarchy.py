"""Agglomerative clusters of a whole table: clusters that are nearest to each other join, side by side in boxes of space and in each until none can."""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.components import connected_components
from recollect.session import materialize

#: Clusters of a box, which join in one task; clusters are never parted. A task holds so many times as many points, and as clusters that lie around its own.
BLOCK, POINTS, VIEW = 1024, 8, 16
#: Centers of clusters by which the driver cuts boxes.
SAMPLE = 4096
#: Distances count as equal that differ beyond this digit.
DIGITS = 9


def _points(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """cluster (the least key of equal rows), weight, v of the distinct points."""
    v = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    return rows.select(F.col(key).alias("cluster"), v.alias("v")).groupBy("v").agg(F.min("cluster").alias("cluster"), F.count(F.lit(1)).alias("weight")).select("cluster", "weight", "v")


def cut_boxes(centers: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """About so many boxes that fill space, with like shares of centers: [box, axis, (from, to)], the upper end left out."""
    out = []

    def cut(x: np.ndarray, box: np.ndarray, k: int) -> None:
        axis = int(np.argmax(np.ptp(x, axis=0))) if len(x) > 1 else 0
        if k < 2 or len(x) < 2 or not np.ptp(x[:, axis]) > 0:
            out.append(box)
            return
        at = np.quantile(x[:, axis], (k // 2 + rng.uniform(-0.3, 0.3)) / k)  # elsewhere in each round
        at = at if (x[:, axis] < at).any() else x[x[:, axis] > x[:, axis].min(), axis].min()
        low, high = box.copy(), box.copy()
        low[axis, 1] = high[axis, 0] = at
        cut(x[x[:, axis] < at], low, k // 2)
        cut(x[x[:, axis] >= at], high, k - k // 2)

    cut(centers, np.tile([-np.inf, np.inf], (centers.shape[1], 1)), parts)
    return np.stack(out)


def _far(x: np.ndarray, box: np.ndarray) -> np.ndarray:
    """How far from a box each row lies, 0 inside."""
    return np.sqrt((np.maximum(np.maximum(box[:, 0] - x, x - box[:, 1]), 0) ** 2).sum(1))


def distance_sums(p: np.ndarray, of: np.ndarray, w: np.ndarray, q: np.ndarray, starts: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Weighted sums of distances between the points of each cluster on the left, p with numbers `of` in order, and on the right, q from `starts` on."""
    total = np.zeros((int(of[-1]) + 1 if len(of) else 0, len(starts)))
    strip = max(1, (1 << 20) // max(1, len(q)))
    for at in range(0, len(p), strip):
        d = np.zeros((len(p[at : at + strip]), len(q)))
        for k in range(p.shape[1]):
            d += (p[at : at + strip, None, k] - q[None, :, k]) ** 2
        np.sqrt(d, out=d)
        d *= u
        d *= w[at : at + strip, None]
        rows, first = np.unique(of[at : at + strip], return_index=True)
        total[rows] += np.add.reduceat(np.add.reduceat(d, starts, axis=1), first, axis=0)
    return total


def join_nearest(sums: np.ndarray, weight: np.ndarray, core: np.ndarray, x: np.ndarray, box: np.ndarray, reach: float, most: float) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Joins (row, row that goes into it, distance) among the clusters of a box; and of each row its least distance, how far all clusters are known, and whether it is left.

    sums: of distances, a row for each cluster of the box and a column for each cluster known, in order of names; core: the
    rows' columns. Two clusters join that are each other's nearest, if no unknown one can be nearer: means of distances are
    no less than the distance of centers x, and all that is not known lies farther from the box than `reach`. What clusters
    around it do meanwhile brings none of them nearer. Rows are joined until none can be, or none by `most` at most.
    """
    n = len(core)
    row_of = np.full(len(weight), -1)
    row_of[core] = np.arange(n)
    alive, left = np.ones(len(weight), bool), np.ones(n, bool)
    near, low = np.zeros(n, int), np.full(n, np.inf)
    slack = 1e-9 * (1 + np.abs(x).max(initial=0))
    known = lambda y: reach + np.minimum(y - box[:, 0], box[:, 1] - y).min(axis=1) - slack
    sight, joins, stale = known(x), [], np.arange(n)
    while len(stale):
        for at in range(0, len(stale), 64):
            r = stale[at : at + 64]
            d = np.round(sums[r] / (weight[core[r], None] * weight), DIGITS)
            d[:, ~alive] = np.inf
            d[np.arange(len(r)), core[r]] = np.inf
            d[np.isnan(d)] = np.inf
            near[r] = d.argmin(axis=1)  # of equally near ones the least name makes the least pair
            low[r] = d[np.arange(len(r)), near[r]]
        other = row_of[near]
        ok = left & (other >= 0) & np.isfinite(low) & (low <= np.minimum(sight, most))
        a = np.flatnonzero(ok & ok[other] & (near[other] == core) & (np.arange(n) < other))
        b = other[a]
        joins += zip(a.tolist(), b.tolist(), low[a].tolist(), strict=True)
        sums[a] += sums[b]
        sums[:, core[a]] += sums[:, core[b]]
        v, w = weight[core[a]], weight[core[b]]
        x[a] = (x[a] * v[:, None] + x[b] * w[:, None]) / (v + w)[:, None]
        weight[core[a]] = v + w
        sight[a] = known(x[a])
        left[b] = alive[core[b]] = False
        moved = np.zeros(len(weight), bool)
        moved[core[a]] = moved[core[b]] = True
        stale = np.flatnonzero(left & (moved[near] | moved[core])) if len(a) else a
    return joins, low, sight, left


def _round(clusters: DataFrame, boxes: np.ndarray, turn: np.ndarray, reach: float, most: float) -> DataFrame:
    """clusters after a round, with low and bound (no other is nearer) of each, and rows of the joins a, b, d. Left out are those that join none by `most`.

    Each cluster goes to its box, and to those that it lies around.
    """
    kind = dict(clusters.dtypes)["cluster"]
    names = ["cluster", "ps", "ws", "at"]

    def deal(batches):
        for batch in batches:
            x = batch.column("at").flatten().to_numpy().reshape(batch.num_rows, -1) @ turn
            for i, box in enumerate(boxes):
                own, near = ((box[:, 0] <= x) & (x < box[:, 1])).all(1), _far(x, box) <= reach
                take = np.flatnonzero(own | near)
                if len(take):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), i, np.int32)), pa.array(own[take]), *(batch.column(c).take(pa.array(take)) for c in names)], ["box", "own", *names])

    def run(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(group.column("cluster").to_numpy(), kind="stable"))).combine_chunks()
        box = boxes[group.column("box")[0].as_py()]
        column = lambda c: group.column(c).combine_chunks() if isinstance(group.column(c).combine_chunks(), pa.Array) else group.column(c).chunk(0)
        flat = lambda c: column(c).flatten().to_numpy(zero_copy_only=False)
        ws = flat("ws")
        points, centers = flat("ps").reshape(len(ws), -1), flat("at").reshape(group.num_rows, -1)
        sizes = np.diff(column("ws").offsets.to_numpy())
        starts = np.concatenate([[0], np.cumsum(sizes)])
        own = group.column("own").to_numpy()
        core = np.flatnonzero(own)
        mine = np.repeat(own, sizes)
        of = np.repeat(np.arange(len(core)), sizes[core])
        weight = np.add.reduceat(ws, starts[:-1])
        joins, low, sight, left = join_nearest(distance_sums(points[mine], of, ws[mine], points, starts[:-1], ws), weight, core, centers[core] @ turn, box, reach, most)
        parts = [[i] for i in range(len(core))]
        for a, b, _ in joins:
            parts[a] += parts[b]
        bound = np.minimum(low, sight)
        stay = [i for i in np.flatnonzero(left & (bound <= most)).tolist()]
        took = [np.concatenate([np.arange(starts[core[j]], starts[core[j] + 1]) for j in parts[i]]) for i in stay]
        table, void = group.column("cluster"), len(joins)
        lists = lambda rows: pa.array([r.ravel().tolist() for r in rows] + [None] * void, pa.list_(pa.float64()))
        numbers = lambda v: pa.array(v[stay].tolist() + [None] * void, pa.float64())
        some = lambda v: pa.array([None] * len(stay) + list(v), pa.float64())
        pick = lambda before, rows, after: table.take(pa.array([None] * before + core[rows].tolist() + [None] * after, pa.int64()))
        a, b, d = (list(c) for c in zip(*joins, strict=True)) if joins else ([], [], [])
        return pa.table({"cluster": pick(0, stay, void), "ps": lists([points[t] for t in took]), "ws": lists([ws[t] for t in took]), "at": lists([np.average(points[t], axis=0, weights=ws[t]) for t in took]),
                         "low": numbers(low), "bound": numbers(bound), "a": pick(len(stay), a, 0), "b": pick(len(stay), b, 0), "d": some(d)})

    shape = f"cluster {kind}, ps array<double>, ws array<double>, at array<double>"
    dealt = clusters.select(*names).mapInArrow(deal, f"box int, own boolean, {shape}")
    return dealt.groupBy("box").applyInArrow(run, f"{shape}, low double, bound double, a {kind}, b {kind}, d double")


def merges(rows: DataFrame, key: str, columns: list[str], enough: int, block: int = BLOCK) -> DataFrame:
    """a, b, d: the joins of clusters, named by their least keys (b goes into a), by mean distance d between members.

    At least those that leave `enough` clusters. Each round cuts space into boxes, elsewhere than before, in which clusters
    join that are each other's nearest, which are joins that would come one by one, too, for the mean distance to a joined
    cluster is no less than the least to its parts. Once as many joins as are wanted are known, only shorter ones matter,
    and clusters that have none are done with. Rounds end when no shorter one is left.
    """
    # of equal rows all but the least join it at 0
    distinct = materialize(_points(rows, key, columns), "points")
    left = points = distinct.count()
    wanted, out, most, reach, view, turned = left - max(1, enough), None, np.inf, None, VIEW * block, 0
    clusters = distinct.select("cluster", F.col("v").alias("ps"), F.array(F.col("weight").cast("double")).alias("ws"), F.col("v").alias("at"))
    while left > 1 and wanted > 0:
        rng = np.random.default_rng(turned)
        turned += 1
        turn = np.linalg.qr(rng.normal(size=(len(columns), len(columns))))[0]
        sample = np.array([r.at for r in clusters.select("at").orderBy(F.xxhash64(F.lit(turned), "cluster")).limit(SAMPLE).collect()]) @ turn
        parts = max(-(-left // block), -(-points // (POINTS * block)))
        boxes = cut_boxes(sample, parts, rng)
        if reach is None:
            some = sample[:512]
            apart = np.sqrt(((some[:, None] - sample[None]) ** 2).sum(2))
            apart[np.arange(len(some)), np.arange(len(some))] = np.inf
            reach = float(np.median(apart.min(axis=1)))
        while reach > 0 and len(boxes) > 1 and max((_far(sample, b) <= reach).mean() for b in boxes) * left > view:
            reach = reach / 1.25 if reach > 1e-9 else 0.0
        step = materialize(_round(clusters, boxes, turn, reach, most), "cluster-round")
        joins, clusters = step.filter("d IS NOT NULL").select("a", "b", "d"), step.filter("cluster IS NOT NULL").drop("a", "b", "d")
        found, left, points, low, far = step.agg(F.count("d"), F.count("cluster"), F.coalesce(F.sum(F.size("ws")), F.lit(0)), F.min("bound"), F.percentile_approx(F.when(F.col("low") < float("inf"), F.col("low")), 0.9)).first()
        out = joins if out is None else out.unionByName(joins)
        known = out.count()
        if known >= wanted:
            high = out.agg(F.percentile_approx("d", min(1.0, wanted / known + 1e-3), 10_000)).first()[0]
            if out.filter(F.col("d") <= high).count() >= wanted:
                most = min(most, high)
            if low is None or out.filter(F.col("d") < low).count() >= wanted:
                break
        if not found:
            if len(boxes) == 1:
                break
            block, view = 2 * block, 2 * view
        reach = min(most, max(reach, far if far is not None else 0.0) * (1 if found else 1.5))
    return out if out is not None else distinct.select(F.col("cluster").alias("a"), F.col("cluster").alias("b"), F.lit(0.0).alias("d")).limit(0)


def _lowest(joins: DataFrame, n: int) -> DataFrame:
    """The n joins of least d, a and b: ranges are sorted side by side, and only counts of ranges meet."""
    ranged = materialize(joins.repartitionByRange("d", "a", "b").withColumn("_part", F.spark_partition_id()), "joins")
    before, cuts = 0, []
    for part, count in ranged.groupBy("_part").count().orderBy("_part").collect():  # a row a range
        cuts.append((part, max(0, min(count, n - before))))
        before += count
    if not cuts:
        return joins
    most = F.create_map(*(F.lit(x) for c in cuts for x in c))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("d", "a", "b"))
    return ranged.withColumn("_nth", nth).filter(F.col("_nth") <= most[F.col("_part")]).drop("_nth", "_part")


def hierarchical_clusters(rows: DataFrame, key: str, columns: list[str], enough: int, block: int = BLOCK) -> DataFrame:
    """key, cluster (its least key) of every row: the two clusters whose members' mean distance is least join, until `enough` are left.

    Equal rows are one point with a weight, and join first, whatever `enough` says, for nothing lies between them; there
    may thus be fewer clusters. Of equally near pairs (to 9 digits) that with the least names joins first. Nulls read as
    0. In each of few rounds points are measured against those that lie around their box, as far as joins still reach, not
    against all. One cluster's distinct points must fit one task.
    """
    distinct = materialize(_points(rows, key, columns), "points")
    total = distinct.count()
    joins = merges(rows, key, columns, enough, block)
    some = _lowest(joins, max(0, total - max(1, enough))).select(F.col("a").alias("u"), F.col("b").alias("v"))
    named = distinct.join(connected_components(some).withColumnRenamed("id", "cluster"), "cluster", "left").select("v", F.coalesce("component", "cluster").alias("cluster"))
    v = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))
    return rows.select(F.col(key), v.alias("v")).join(named, "v").select(key, "cluster")
