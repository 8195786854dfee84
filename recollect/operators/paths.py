"""Cheapest paths under constraints, rules run together, and graphs written in the formats that other tools read."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.graph import MIN_CONFIDENCE, infer_inverse, infer_symmetric, infer_transitive
from recollect.session import materialize


def cheapest_paths(edges: DataFrame, sources: list[str], cost: Column, rounds: int = 10, avoid: tuple[str, ...] = (), through: str | None = None) -> DataFrame:
    """source, node, cost, hops, path: the cheapest way of at most `rounds` steps from each source to every node, along edges(src, dst); of equal ones the least path.

    Each round relaxes the nodes that the last one made cheaper. Nodes to avoid are never entered; with `through` only
    paths that lead over that node count. Costs are not negative.
    """
    spark = edges.sparkSession
    e = edges.select("src", "dst", cost.alias("w"))
    if avoid:
        e = e.filter(~F.col("src").isin(*avoid) & ~F.col("dst").isin(*avoid))
    e = materialize(e.groupBy("src", "dst").agg(F.min("w").alias("w")), "cheapest-edges")
    seen = lambda node: F.lit(through is None) if through is None else node == through
    start = spark.createDataFrame([(s, s, 0.0, 0, s, through in (None, s)) for s in sources], "source string, node string, cost double, hops int, path string, met boolean")
    best = last = start
    for _ in range(rounds):
        step = last.join(e, last["node"] == e["src"]).select("source", F.col("dst").alias("node"), F.round(F.col("cost") + F.col("w"), 9).alias("cost"), (F.col("hops") + 1).alias("hops"), F.concat_ws(">", "path", "dst").alias("path"), (F.col("met") | seen(F.col("dst"))).alias("met"))
        every = best.withColumn("new", F.lit(False)).unionByName(step.withColumn("new", F.lit(True)))
        best = materialize(every.groupBy("source", "node", "met").agg(F.min(F.struct(*(F.col(c) for c in ("cost", "hops", "path")), "new")).alias("b")).select("source", "node", "met", "b.*"), "cheapest")
        last = best.filter("new").drop("new")
        best = best.drop("new")
        if last.isEmpty():
            break
    return best.filter("met").drop("met")


def infer_all(edges: DataFrame, rules: list[tuple]) -> DataFrame:
    """src, dst, rel_type, confidence, rule of every rule over the same edges, confident enough, best first.

    A rule is (kind, relation, inferred relation, weight); kind: transitive, symmetric or inverse. No rule sees what another infers.
    """
    out = None
    for kind, rel, to, weight in rules:
        found = {"transitive": lambda: infer_transitive(edges, rel, weight), "symmetric": lambda: infer_symmetric(edges, rel, weight), "inverse": lambda: infer_inverse(edges, rel, to, weight)}[kind]()
        found = found.select("src", "dst", F.lit(to).alias("rel_type"), "confidence", F.lit(kind).alias("rule"))
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("src", "dst", "rel_type").orderBy(F.desc("confidence"), "rule")
    return out.filter(F.col("confidence") >= MIN_CONFIDENCE).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n").orderBy(F.desc("confidence"), "src", "dst", "rel_type")


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graph_lines(edges: DataFrame, fmt: str) -> DataFrame:
    """part, line of a graph: json lines, csv, dot, graphml or gexf. Lines of part 0 stand first, then 1 (nodes), 2 (edges) and 3; within a part any order does."""
    spark = edges.sparkSession
    frame = {
        "json": ([], []), "csv": (["src,dst,rel_type,strength"], []), "dot": (["digraph memories {"], ["}"]),
        "graphml": (['<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'], ["</graph></graphml>"]),
        "gexf": (['<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed">'], ["</graph></gexf>"]),
    }
    if fmt not in frame:
        raise ValueError(f"unknown graph format {fmt}")
    s, d, r, w = (F.col(c) for c in ("src", "dst", "rel_type", "strength"))
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = {
        "json": F.to_json(F.struct("src", "dst", "rel_type", "strength")), "csv": F.concat_ws(",", s, d, r, w.cast("string")), "dot": F.concat(q(s), F.lit(" -> "), q(d), F.lit(" [label="), q(r), F.lit("];")),
        "graphml": F.concat(F.lit('<edge source="'), _xml(s), F.lit('" target="'), _xml(d), F.lit('"/>')), "gexf": F.concat(F.lit('<edge source="'), _xml(s), F.lit('" target="'), _xml(d), F.lit('" label="'), _xml(r), F.lit('"/>')),
    }[fmt]
    out = edges.select(F.lit(2).alias("part"), line.alias("line"))
    if fmt in ("graphml", "gexf"):
        node = edges.select(F.explode(F.array("src", "dst")).alias("n")).distinct()
        out = out.unionByName(node.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), _xml(F.col("n")), F.lit('"/>')).alias("line")))
    head, tail = frame[fmt]
    rows = [(0, x) for x in head] + [(3, x) for x in tail]
    return out.unionByName(spark.createDataFrame(rows, "part int, line string")) if rows else out
