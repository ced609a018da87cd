"""Targets on a grid, and which nodes cover them. A node names its targets by arithmetic: no join, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G


def targets(spark: SparkSession, max_x: float, max_y: float, spacing: float) -> DataFrame:
    """(ti, tj, tx, ty): the cells of the area and their centres; both ends included."""
    n, m = int(max_x // spacing), int(max_y // spacing)
    t = spark.range((n + 1) * (m + 1)).select(F.floor(F.col("id") / (m + 1)).alias("ti"), (F.col("id") % (m + 1)).alias("tj"))
    return t.select("ti", "tj", G.target_centre(F.col("ti"), spacing).alias("tx"), G.target_centre(F.col("tj"), spacing).alias("ty"))


def node_targets(nodes: DataFrame, radius: float, spacing: float, max_x: float, max_y: float, border_only: bool = False, corner: bool = False) -> DataFrame:
    """(node_id, ti, tj): targets within the radius of each node.

    border_only tests only the outer ring of the node's box and takes all cells inside it, as the
    covering heuristic marks them; corner measures to the cells' corners (legacy).
    """
    lim = lambda v, top: F.greatest(F.lit(0), F.least(F.lit(int(top // spacing)), v)).cast("bigint")
    lo = lambda c, top: lim(F.floor((F.col(c) - radius) / spacing), top)
    hi = lambda c, top: lim(F.floor((F.col(c) + radius) / spacing), top)
    n = nodes.where("x is not null and y is not null").select("node_id", "x", "y", lo("x", max_x).alias("i0"), hi("x", max_x).alias("i1"), lo("y", max_y).alias("j0"), hi("y", max_y).alias("j1"))
    n = n.select("*", F.explode(F.sequence("i0", "i1")).alias("ti")).select("*", F.explode(F.sequence("j0", "j1")).alias("tj"))
    ok = G.within(F.col("x"), F.col("y"), G.target_centre(F.col("ti"), spacing, corner), G.target_centre(F.col("tj"), spacing, corner), radius)
    if border_only:
        ok = ok | ((F.col("ti") > F.col("i0")) & (F.col("ti") < F.col("i1")) & (F.col("tj") > F.col("j0")) & (F.col("tj") < F.col("j1")))
    return n.where(ok).select("node_id", "ti", "tj")


def targets_per_node(covered: DataFrame) -> DataFrame:
    return covered.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_targets"))


def nodes_per_target(covered: DataFrame) -> DataFrame:
    return covered.groupBy("ti", "tj").agg(F.count(F.lit(1)).alias("n_nodes"))


def nodes_of_targets(covered: DataFrame) -> DataFrame:
    """(ti, tj, node_id): the list of nodes of each target, as rows, so that none is too long for a task."""
    return covered.select("ti", "tj", "node_id").distinct()


def uncovered(all_targets: DataFrame, covered: DataFrame) -> DataFrame:
    return all_targets.join(covered.select("ti", "tj"), ["ti", "tj"], "left_anti")


def coverage_ratio(all_targets: DataFrame, covered: DataFrame) -> DataFrame:
    """(n_targets, n_covered, ratio)."""
    seen = covered.select("ti", "tj").distinct().withColumn("hit", F.lit(1))
    t = all_targets.join(seen, ["ti", "tj"], "left")
    return t.agg(F.count(F.lit(1)).alias("n_targets"), F.count("hit").alias("n_covered")).withColumn("ratio", F.round(G.safe_ratio(F.col("n_covered"), F.col("n_targets")), 6))


def near_nodes_by_cell(nodes: DataFrame, others: DataFrame, radius: float, reach: int = 1) -> DataFrame:
    """(node_id, near_id): nodes in the cells (as wide as the radius) around each node, before any exact test."""
    around = lambda c: F.explode(F.sequence(G.cell(F.col(c), radius) - reach, G.cell(F.col(c), radius) + reach))
    a = nodes.select("node_id", "y", around("x").alias("cx")).select("node_id", "cx", around("y").alias("cy"))
    b = others.select(F.col("node_id").alias("near_id"), G.cell(F.col("x"), radius).alias("cx"), G.cell(F.col("y"), radius).alias("cy"))
    return a.join(b, ["cx", "cy"]).where("node_id <> near_id").select("node_id", "near_id")
