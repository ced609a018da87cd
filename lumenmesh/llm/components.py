"""Groups of directly or indirectly linked records, by seed-tree pruning.

Each round has two steps over an undirected graph whose edges shrink from round to round:

* selection: every vertex tells its neighbourhood (itself included) the smallest id in it;
* pruning: a vertex links the minima it was told of to the smallest of them, for the next round. A
  vertex that nobody named as a minimum drops out and hangs below its smallest minimum in a forest.

A vertex that is left alone is the seed of its group, and its smallest id. When no edges are left, seed
ids flow down the forest, from the vertices that dropped out last to those that dropped out first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")


def connected_groups(edges: DataFrame, src: str, dst: str, vertices: DataFrame | None = None, vertex: str = "node_id") -> DataFrame:
    """(node_id, group_id): one row per vertex; group_id is the smallest vertex id of its group.

    edges: rows linking two bigint columns; direction, repeats and order do not matter. A row with a
    null end links nothing, and its other end is a vertex only if it occurs elsewhere. A self-loop
    makes its end a vertex. vertices: further vertices, which may occur in no edge (nulls ignored).
    Empty inputs give an empty result. Extra columns are ignored.

    Hubs: minima are partly aggregated before they are shuffled, and what a vertex is told is spread by both
    ends. The joins carry one row per vertex on one side; nothing asks for their order of rows, so AQE may
    split a hub's partition (skew join), and below its threshold a hub's rows are streamed. Rounds are cut
    by tables in the shared folder, of which only the current ones are kept. They go on until no edge is left.
    """
    spark = edges.sparkSession
    tmp = Scratch(spark, "groups")
    ends = edges.select(F.col(src).cast("bigint").alias("s"), F.col(dst).cast("bigint").alias("d")).where("s is not null and d is not null")
    # undirected, distinct, without self-loops; self-loops are kept apart as mere vertices
    raw, raw_path = tmp.cut(ends.select(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).distinct())
    graph, graph_path = raw.where("a <> b"), None
    forest: list[DataFrame] = []
    while True:
        e = _both_ways(graph)
        least = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # (v, m): v was told that m is the minimum of a closed neighbourhood that holds v
        told = e.join(least, "u").select(F.col("v").alias("u"), "m").union(least).distinct()
        told, told_path = tmp.cut(told)
        best = told.groupBy("u").agg(F.min("m").alias("best"), F.max(F.col("m") == F.col("u")).alias("named"))
        best, best_path = tmp.cut(best)
        forest.append(best.where(~F.col("named")).select("u", F.col("best").alias("parent")))
        links = told.join(best.select("u", "best"), "u").where("m <> best")
        nxt, nxt_path = tmp.cut(links.select(F.col("best").alias("a"), F.col("m").alias("b")).distinct())
        tmp.drop(told_path)
        if graph_path:
            tmp.drop(graph_path)
        graph, graph_path = nxt, nxt_path
        if graph.isEmpty():
            break
    # seed ids flow down: the last to drop out hang below seeds, earlier ones below seeds or later ones
    # each level is written once: a vertex hangs below a seed or below one of any later level
    levels = [forest.pop().select("u", F.col("parent").alias("g"))]
    while forest:
        below = forest.pop()
        known = reduce(DataFrame.union, levels).select(F.col("u").alias("parent"), "g")
        hung = below.join(known, "parent", "left").select("u", F.coalesce("g", "parent").alias("g"))
        levels.append(tmp.cut(hung)[0] if forest else hung)
    labels = reduce(DataFrame.union, levels)
    everyone = [raw.select(F.col("a").alias(vertex)), raw.select(F.col("b").alias(vertex))]
    if vertices is not None:
        everyone.append(vertices.select(F.col(vertices.columns[0] if vertex not in vertices.columns else vertex).cast("bigint").alias(vertex)).where(F.col(vertex).isNotNull()))
    everyone = reduce(DataFrame.union, everyone).distinct()
    return everyone.join(labels.withColumnRenamed("u", vertex), vertex, "left").select(vertex, F.coalesce("g", vertex).alias("group_id"))


def group_sizes(groups: DataFrame) -> DataFrame:
    """(group_id, n_nodes) of each group, partly aggregated before the shuffle."""
    return groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_nodes"))
