"""Capacities, traffic patterns and flow statistics as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import degrees


def gateway_capacity(edges: DataFrame, gateways: DataFrame, capacity: float, per_gateway: int) -> DataFrame:
    """(static_capacity, dynamic_capacity): links at the gateways, and ports of all gateways, times the capacity."""
    g = gateways.select("node_id").distinct()
    d = degrees(edges, g)
    static = d.join(g, "node_id", "left_semi").agg((F.sum("degree") * capacity).alias("static_capacity"), (F.count(F.lit(1)) * per_gateway * capacity).alias("dynamic_capacity"))
    return static


def pattern_nodes(candidates: DataFrame, n_patterns: int, k: int, draw) -> DataFrame:
    """(pattern_id, node_id): the k candidates of the smallest draw in each pattern.

    draw(pattern, node) is a deterministic expression; ranks beyond k are dropped before the shuffle.
    """
    c = candidates.select("node_id").distinct().select("node_id", F.explode(F.sequence(F.lit(0), F.lit(n_patterns - 1))).alias("pattern_id"))
    w = Window.partitionBy("pattern_id").orderBy(draw(F.col("pattern_id"), F.col("node_id")), "node_id")
    return c.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).select("pattern_id", "node_id")


def upper_bounds(patterns: DataFrame, edges: DataFrame, per_node: int | None = None) -> DataFrame:
    """(pattern_id, upper_bound): sum of the sources' degrees, each at most per_node if that is given."""
    d = patterns.join(degrees(edges), "node_id", "left").select("pattern_id", F.coalesce("degree", F.lit(0)).alias("degree"))
    v = F.col("degree") if per_node is None else F.least("degree", F.lit(per_node))
    return d.groupBy("pattern_id").agg(F.sum(v).cast("bigint").alias("upper_bound"))


def average_bounds(bounds: DataFrame, capacity: float, gateway_total: float | None = None) -> DataFrame:
    """(n_patterns, avg_bound): the mean over patterns times the capacity, each at most the gateways' capacity."""
    v = F.col("upper_bound") * capacity
    v = v if gateway_total is None else F.least(v, F.lit(gateway_total))
    return bounds.agg(F.count(F.lit(1)).alias("n_patterns"), F.round(F.avg(v), 6).alias("avg_bound"))


def series_ranges(df: DataFrame, series: list[str]) -> DataFrame:
    """(series, least, most) of columns that are plotted together; nulls are left out."""
    one = df.agg(*[f(c).cast("double").alias(f"{c}{k}") for c in series for k, f in (("<", F.min), (">", F.max))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("series"), F.col(f"{c}<").alias("least"), F.col(f"{c}>").alias("most")) for c in series])))


def benefits(paths: DataFrame, source_potential: DataFrame, sink_potential: DataFrame) -> DataFrame:
    """(src, dst, benefit) of paths (src, dst, n_new): what can flow over the path for each new node; positive only."""
    s = source_potential.where("potential > 0").select(F.col("node_id").alias("src"), F.col("potential").alias("s"))
    t = sink_potential.where("potential > 0").select(F.col("node_id").alias("dst"), F.col("potential").alias("t"))
    return paths.where("n_new > 0").join(s, "src").join(t, "dst").select("src", "dst", (F.least("s", "t") / F.col("n_new")).alias("benefit"))


def flow_arcs(edges: DataFrame, gateways: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, dst, capacity): unit arcs both ways, endless ones from -1 to the sources and from gateways to -2."""
    inf = F.lit(float("inf"))
    e = edges.select("src", "dst", F.lit(1.0).alias("capacity")).union(edges.select("dst", "src", F.lit(1.0)))
    return e.union(sources.select(F.lit(-1).cast("bigint"), "node_id", inf)).union(gateways.select("node_id", F.lit(-2).cast("bigint"), inf))


def residual_arcs(arcs: DataFrame, flows: DataFrame) -> DataFrame:
    """Capacities less the flow over each arc (src, dst, flow)."""
    return arcs.join(flows, ["src", "dst"], "left").select("src", "dst", (F.col("capacity") - F.coalesce("flow", F.lit(0.0))).alias("capacity"))
