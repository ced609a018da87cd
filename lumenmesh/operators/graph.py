"""Relational graph operators: distance joins, degrees, closures, set operations, components, shortest paths.

Nodes are (node_id, x, y); undirected edges are one row each with src < dst and usually con_type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import Scratch, hot_list


def distance_pairs(nodes: DataFrame, limit: float, hot_rows: int = 2_000, ends: bool = False) -> DataFrame:
    """(src, dst, d2), src < dst: all pairs of nodes at most `limit` apart (inclusive); with ends also (x1, y1, x2, y2).

    Cells as wide as the limit; each pair of cells meets once, crowded cells are salted. Nodes with a
    null id or a null or NaN position match nothing; an empty table gives no pairs.
    """
    p = nodes.select("node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("node_id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)").dropDuplicates(["node_id"])
    home = p.select(F.col("node_id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), G.cell(F.col("x"), limit).alias("cx"), G.cell(F.col("y"), limit).alias("cy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])
    guest = p.select("*", F.inline(steps))
    guest = guest.select(F.col("node_id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), (G.cell(F.col("x"), limit) + F.col("i")).alias("cx"), (G.cell(F.col("y"), limit) + F.col("j")).alias("cy"), ((F.col("i") == 0) & (F.col("j") == 0)).alias("same"))
    keys = ["cx", "cy"]
    if (hot := hot_list(home.select("cx", "cy"), ["cx", "cy"], hot_rows)) is not None:
        # guests come from the cells around too: both sides of a crowded cell and its neighbours are split
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        near = hot.select("cx", "cy", "n_salts", F.inline(around)).select((F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy"), F.when((F.col("i") == 0) & (F.col("j") == 0), F.col("n_salts")).otherwise(1).alias("own"), "n_salts")
        hot, keys = F.broadcast(near.groupBy("cx", "cy").agg(F.max("own").alias("m"), F.sum("n_salts").cast("int").alias("n"))), ["cx", "cy", "salt", "salt_b"]
        m, n = F.coalesce("m", F.lit(1)), F.coalesce("n", F.lit(1))
        salt, copy = (lambda v, k: F.pmod(F.xxhash64(v), k).cast("int")), (lambda k: F.explode(F.sequence(F.lit(0), k - 1)))
        home = home.join(hot, ["cx", "cy"], "left").select(*home.columns, salt("a", m).alias("salt"), copy(n).alias("salt_b"))
        guest = guest.join(hot, ["cx", "cy"], "left").select(*guest.columns, copy(m).alias("salt"), salt("b", n).alias("salt_b"))
    d2 = G.squared_distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    met = home.join(guest, keys).where((d2 <= limit * limit) & (~F.col("same") | (F.col("a") < F.col("b"))))
    first = F.col("a") < F.col("b")
    at = [F.when(first, F.col(p)).otherwise(F.col(q)).alias(c) for c, p, q in (("x1", "ax", "bx"), ("y1", "ay", "by"), ("x2", "bx", "ax"), ("y2", "by", "ay"))]
    return met.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), d2.alias("d2"), *(at if ends else []))


def typed_edges(nodes: DataFrame, short: float, long: float) -> DataFrame:
    """(src, dst, con_type) of the distance graph."""
    return distance_pairs(nodes, max(short, long)).select("src", "dst", G.edge_type(F.col("d2"), short, long).alias("con_type"))


def edge_type_of(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """con_type of given pairs (src, dst in any order); non_edge for pairs that are none."""
    p = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return p.join(edges.select("src", "dst", "con_type"), ["src", "dst"], "left").select("src", "dst", F.coalesce("con_type", F.lit("non_edge")).alias("con_type"))


def endpoints(edges: DataFrame) -> DataFrame:
    """(node_id, con_type): both ends of each edge; a self-loop counts twice."""
    kind = [c for c in ("con_type",) if c in edges.columns]
    return edges.select(F.explode(F.array("src", "dst")).alias("node_id"), *kind)


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node_id, degree); with nodes, isolated ones have 0."""
    d = endpoints(edges).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    return d if nodes is None else nodes.select("node_id").distinct().join(d, "node_id", "left").fillna(0, ["degree"])


def degrees_by_type(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, short_degree, long_degree) of all nodes."""
    d = endpoints(edges).groupBy("node_id").agg(*[F.count(F.when(F.col("con_type") == t, 1)).alias(f"{t}_degree") for t in ("short", "long")])
    return nodes.select("node_id").distinct().join(d, "node_id", "left").fillna(0, ["short_degree", "long_degree"])


def degree_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each edge type: nodes, edges, and least, greatest and mean degree."""
    d = degrees_by_type(edges, nodes).select(F.inline(F.array(*[F.struct(F.lit(t).alias("con_type"), F.col(f"{t}_degree").alias("d")) for t in ("short", "long")])))
    return d.groupBy("con_type").agg(F.count(F.lit(1)).alias("n_nodes"), (F.sum("d") / 2).cast("bigint").alias("n_edges"), F.min("d").alias("min_degree"), F.max("d").alias("max_degree"), F.round(F.avg("d"), 6).alias("avg_degree"), F.sum(F.when(F.col("d") == 0, 1).otherwise(0)).alias("n_isolated"))


def arg_max_degree(edges: DataFrame, least: int = 2) -> DataFrame:
    """All nodes of the greatest degree, if it exceeds `least`: (node_id, degree)."""
    d = degrees(edges)
    return d.join(d.agg(F.max("degree").alias("degree")).where(F.col("degree") > least), "degree").select("node_id", "degree")


def reduction_candidates(edges: DataFrame, gateways: DataFrame) -> DataFrame:
    """Nodes that can take an edge: degree at most the maximum less 2; others than gateways at least 1."""
    nodes = endpoints(edges).select("node_id").union(gateways.select("node_id")).distinct()
    d = degrees(edges, nodes)
    top = d.agg((F.max("degree") - 2).alias("room"))
    g = gateways.select("node_id", F.lit(True).alias("is_gateway")).distinct()
    return d.join(g, "node_id", "left").join(top, F.col("degree") <= F.col("room")).where("is_gateway or degree >= 1").select("node_id", "degree")


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are in a set of nodes."""
    keep = nodes.select("node_id").distinct()
    return edges.join(keep.withColumnRenamed("node_id", "src"), "src", "left_semi").join(keep.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(edges.columns)


def edge_closure(edges: DataFrame, new: DataFrame, existing: DataFrame) -> DataFrame:
    """Edges between new nodes and existing ones, and among the new ones."""
    n, e = new.select("node_id").distinct(), existing.select("node_id").union(new.select("node_id")).distinct()
    a = edges.join(n.withColumnRenamed("node_id", "src"), "src", "left_semi").join(e.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    b = edges.join(n.withColumnRenamed("node_id", "dst"), "dst", "left_semi").join(e.withColumnRenamed("node_id", "src"), "src", "left_semi")
    return a.select(edges.columns).union(b.select(edges.columns)).distinct()


def top_by(df: DataFrame, keys: list[str], order: list, k: int = 1) -> DataFrame:
    """The first k rows of each key by an explicit order; ties go by that order alone."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def sample_per(df: DataFrame, keys: list[str], ident: str, k: int | str, seed: int, purpose: str) -> DataFrame:
    """k rows of each key without replacement, by hashes: the same on every run and cluster."""
    draw = F.xxhash64(F.lit(seed), F.lit(purpose), *keys, ident)
    w = Window.partitionBy(*keys).orderBy(draw, ident)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= (F.col(k) if isinstance(k, str) else k)).drop("_n")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node_id, component): the least id of each connected component.

    Every node points to another of its component, at first to itself. In each round a node, and what it
    points to, is hooked to the least that its neighbours reach in two steps, and all pointers are
    shortened by one step; about as many rounds as the logarithm of the longest path. Ends when nothing moves.
    """
    spark = edges.sparkSession
    tmp = Scratch(spark, "components")
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e")).select("e.a", "e.b").where("a is not null and b is not null").distinct()
    both, _ = tmp.cut(both)
    every = both.select(F.col("a").alias("node_id"))
    every = (every if nodes is None else every.union(nodes.select(F.col("node_id").cast("bigint")))).where("node_id is not null").distinct()
    labels, path = tmp.cut(every.select("node_id", F.col("node_id").alias("component")))
    while True:
        # what each node points to, and what that points to
        far = labels.select(F.col("node_id").alias("component"), F.col("component").alias("far"))
        two, two_path = tmp.cut(labels.join(far, "component").select("node_id", "component", "far"))
        told = both.join(two.select(F.col("node_id").alias("b"), "far"), "b").groupBy("a").agg(F.min("far").alias("m"))
        told, told_path = tmp.cut(two.join(told, two["node_id"] == told["a"], "left").select("node_id", "component", F.least("far", F.coalesce("m", "far")).alias("m")))
        hooks = told.groupBy(F.col("component").alias("node_id")).agg(F.min("m").alias("h"))
        nxt, new = tmp.cut(told.join(hooks, "node_id", "left").select("node_id", F.col("component").alias("old"), F.least("component", "m", F.coalesce("h", "m")).alias("component")))
        done = nxt.where("old <> component").isEmpty()
        for p in (path, two_path, told_path):
            tmp.drop(p)
        labels, path = nxt.select("node_id", "component"), new
        if done:
            return labels


def bfs(edges: DataFrame, sources: DataFrame, together: bool = False) -> DataFrame:
    """(source, node_id, hops, parent): shortest paths by hops from each source; parent is the least one.

    sources: node_id. A source has hops 0 and a null parent; nodes out of reach have no row. With `together`
    all sources spread as one front: each node has one row, of the least source that is nearest.
    Levels are appended to one table until one reaches nothing new, so the plan does not grow with the depth.
    """
    tmp = Scratch(edges.sparkSession, "bfs")
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("e")).select("e.a", "e.b").where("a is not null and b is not null and a <> b").distinct()
    both, _ = tmp.cut(both)
    keys = ["node_id"] if together else ["source", "node_id"]
    start = sources.where("node_id is not null").select(F.col("node_id").cast("bigint").alias("source"), F.col("node_id").cast("bigint").alias("node_id"), F.lit(0).alias("hops"), F.lit(None).cast("bigint").alias("parent")).distinct()
    fronts, path = [], f"{tmp.root}/levels"
    level = lambda k: edges.sparkSession.read.schema(start.schema).parquet(f"{path}/hops_no={k}")
    start.write.parquet(f"{path}/hops_no=0")
    fronts.append(level(0))
    while not fronts[-1].isEmpty():
        told = fronts[-1].select("source", F.col("node_id").alias("a")).join(both, "a").select("source", F.col("b").alias("node_id"), "a")
        best = F.min(F.struct("source", "a")).alias("m") if together else F.min(F.struct("a")).alias("m")
        reached = told.groupBy(*keys).agg(best)
        # what a level reaches lies in that level, the one before or the next
        for old in fronts[-2:]:
            reached = reached.join(old.select(*keys), keys, "left_anti")
        k = len(fronts)
        reached.select(F.col("m.source") if together else F.col("source"), "node_id", F.lit(k).alias("hops"), F.col("m.a").alias("parent")).write.parquet(f"{path}/hops_no={k}")
        fronts.append(level(k))
    return edges.sparkSession.read.schema(start.schema).parquet(path).select("source", "node_id", "hops", "parent")


def path_edges(paths: DataFrame, path: str = "path") -> DataFrame:
    """(src, dst) of consecutive nodes of paths, undirected and distinct."""
    p = F.col(path)
    e = paths.where(F.size(p) > 1).select(F.explode(F.arrays_zip(F.slice(p, 1, F.size(p) - 1).alias("a"), F.slice(p, 2, F.size(p) - 1).alias("b"))).alias("e"))
    return e.select(F.least("e.a", "e.b").alias("src"), F.greatest("e.a", "e.b").alias("dst")).distinct()


def counts_along(tree: DataFrame, marked: DataFrame) -> DataFrame:
    """(source, node_id, n_marked): how many marked nodes lie on the path from the source to each node, both included.

    tree: (source, node_id, hops, parent) as `bfs` gives it. Sums are doubled along the parents: a tree of
    depth n takes about log2(n) rounds.
    """
    tmp = Scratch(tree.sparkSession, "along")
    m = marked.select("node_id", F.lit(1).alias("one")).distinct()
    now, path = tmp.cut(tree.join(m, "node_id", "left").select("source", "node_id", F.col("parent").alias("up"), F.coalesce("one", F.lit(0)).cast("bigint").alias("n")))
    while not now.where("up is not null").isEmpty():
        above = now.select("source", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("n").alias("more"))
        nxt, new = tmp.cut(now.join(above, ["source", "up"], "left").select("source", "node_id", F.col("next").alias("up"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        tmp.drop(path)
        now, path = nxt, new
    return now.select("source", "node_id", F.col("n").alias("n_marked"))


def thinned(nodes: DataFrame, radius: float) -> DataFrame:
    """Nodes kept if no kept node of a smaller id is within the radius: the greedy set in order of ids.

    Rounds: a node is kept once all smaller neighbours are dropped, dropped once one is kept.
    """
    tmp = Scratch(nodes.sparkSession, "thinned")
    pairs, _ = tmp.cut(distance_pairs(nodes, radius).select("src", "dst"))
    open_, path = tmp.cut(nodes.select("node_id").distinct())
    kept: list[DataFrame] = []
    while not open_.isEmpty():
        live = pairs.join(open_.withColumnRenamed("node_id", "src"), "src", "left_semi").join(open_.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
        now, _ = tmp.cut(open_.join(live.select(F.col("dst").alias("node_id")), "node_id", "left_anti"))
        kept.append(now)
        near = pairs.join(now.withColumnRenamed("node_id", "src"), "src", "left_semi").select(F.col("dst").alias("node_id"))
        nxt, new = tmp.cut(open_.join(now, "node_id", "left_anti").join(near, "node_id", "left_anti"))
        tmp.drop(path)
        open_, path = nxt, new
    out = nodes.limit(0).select("node_id") if not kept else kept[0]
    for k in kept[1:]:
        out = out.union(k)
    return nodes.join(out, "node_id", "left_semi")
