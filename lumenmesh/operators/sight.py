"""Line of sight between points among buildings.

Buildings are hashed to square bins. A pair of points meets only the buildings of the bins that its ray
passes; those are tested exactly, and a pair that one of them crosses has no sight.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import Scratch
from .graph import distance_pairs


def building_bins(buildings: DataFrame, size: float, corners_only: bool = False) -> DataFrame:
    """(building_id, bx, by): bins of each building's box, or only of its corners. Empty rings have none."""
    b = buildings.where("size(ring) > 2")
    if corners_only:
        return b.select("building_id", F.explode("ring").alias("p")).select("building_id", G.cell(F.col("p.x"), size).alias("bx"), G.cell(F.col("p.y"), size).alias("by")).distinct()
    span = lambda c: F.sequence(F.floor(F.array_min(F.transform("ring", lambda p: p[c])) / size).cast("bigint"), F.floor(F.array_max(F.transform("ring", lambda p: p[c])) / size).cast("bigint"))
    return b.select("building_id", F.explode(span("x")).alias("bx"), "ring").select("building_id", "bx", F.explode(span("y")).alias("by"))


def ray_bins(pairs: DataFrame, size: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, *keep, bx, by): bins the ray of each pair passes; pairs has x1, y1, x2, y2."""
    c = lambda v: G.cell(F.col(v), size)
    return pairs.select("src", "dst", *keep, F.inline(G.grid_ray(c("x1"), c("y1"), c("x2"), c("y2")))).withColumnsRenamed({"x": "bx", "y": "by"})


def blocked_pairs(pairs: DataFrame, buildings: DataFrame, size: float, corners_only: bool = False) -> DataFrame:
    """Distinct (src, dst) of pairs that a building crosses.

    Pairs carry their ends and buildings their ring and box through the join on bins. Only where the box
    meets both the pair's box and its line is the outline tested.
    """
    end = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    box = [end(f, c).alias(n) for n, f, c in (("lx", F.array_min, "x"), ("hx", F.array_max, "x"), ("ly", F.array_min, "y"), ("hy", F.array_max, "y"))]
    bins = building_bins(buildings, size, corners_only).join(buildings.where("size(ring) > 2").select("building_id", "ring", *box), "building_id")
    met = ray_bins(pairs, size, ("x1", "y1", "x2", "y2")).join(bins, ["bx", "by"])
    x1, y1, x2, y2, lx, hx, ly, hy = (F.col(c) for c in ("x1", "y1", "x2", "y2", "lx", "hx", "ly", "hy"))
    near = (F.least(x1, x2) <= hx) & (F.greatest(x1, x2) >= lx) & (F.least(y1, y2) <= hy) & (F.greatest(y1, y2) >= ly)
    side = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (lx, hx) for y in (ly, hy)]
    near &= (F.least(*side) <= 0) & (F.greatest(*side) >= 0)
    return met.where(near).where(G.crosses(x1, y1, x2, y2, F.col("ring"))).select("src", "dst").distinct()


def sight_edges(nodes: DataFrame, buildings: DataFrame, short: float, long: float, size: float, corners_only: bool = False, self_pairs: bool = False) -> DataFrame:
    """(src, dst, con_type): pairs in reach that see each other. self_pairs adds each node with itself as short."""
    n = nodes.select("node_id", "x", "y")
    pairs, _ = Scratch(nodes.sparkSession, "sight").cut(distance_pairs(n, max(short, long), ends=True).withColumn("con_type", G.edge_type(F.col("d2"), short, long)).drop("d2"))
    clear = pairs.join(blocked_pairs(pairs, buildings, size, corners_only), ["src", "dst"], "left_anti").select("src", "dst", "con_type")
    return clear if not self_pairs else clear.union(n.select("node_id", "node_id", F.lit("short")))


def bin_pairs(nodes: DataFrame, buildings: DataFrame, size: float, threshold: float, limit: float) -> DataFrame:
    """(b1x, b1y, b2x, b2y, class, sight): pairs of occupied bins within the limit, by the distance of their centres.

    Class 1, up to the threshold: pairs of points are tested one by one (sight is null). Class 2: the
    sight between the centres stands for all pairs of points. Bins beyond the limit are not listed.
    """
    occupied = nodes.select(G.cell(F.col("x"), size).alias("bx"), G.cell(F.col("y"), size).alias("by")).distinct()
    key = F.xxhash64("bx", "by")
    c = occupied.select(key.alias("node_id"), "bx", "by", G.bin_centre(F.col("bx"), size).alias("x"), G.bin_centre(F.col("by"), size).alias("y"))
    p = distance_pairs(c, limit, ends=True).withColumn("class", F.when(F.col("d2") <= threshold * threshold, 1).otherwise(2))
    p = p.withColumns({f"b{k}{v}": G.cell(F.col(f"{v}{k}"), size) for k in (1, 2) for v in ("x", "y")})
    p, _ = Scratch(nodes.sparkSession, "bins").cut(p)
    blocked = blocked_pairs(p.where("class = 2"), buildings, size).withColumn("blocked", F.lit(True))
    out = p.join(blocked, ["src", "dst"], "left").select("b1x", "b1y", "b2x", "b2y", "class", F.when(F.col("class") == 2, F.col("blocked").isNull()).alias("sight"))
    same = c.select(F.col("bx").alias("b1x"), F.col("by").alias("b1y"), F.col("bx").alias("b2x"), F.col("by").alias("b2y"), F.lit(1).alias("class"), F.lit(None).cast("boolean").alias("sight"))
    return out.union(same)


def coarse_sight_edges(nodes: DataFrame, buildings: DataFrame, short: float, long: float, size: float, threshold: float) -> DataFrame:
    """The two-level approximation: exact sight for near bins, the bins' sight for far ones."""
    n = nodes.select("node_id", "x", "y")
    p = distance_pairs(n, max(short, long), ends=True).withColumn("con_type", G.edge_type(F.col("d2"), short, long)).drop("d2")
    p = p.withColumns({f"b{k}{v}": G.cell(F.col(f"{v}{k}"), size) for k in (1, 2) for v in ("x", "y")})
    bins = bin_pairs(nodes, buildings, size, threshold, max(short, long) + 2 * size)
    turned = bins.select(F.col("b2x").alias("b1x"), F.col("b2y").alias("b1y"), F.col("b1x").alias("b2x"), F.col("b1y").alias("b2y"), "class", "sight")
    p, _ = Scratch(nodes.sparkSession, "coarse").cut(p.join(bins.union(turned).distinct(), ["b1x", "b1y", "b2x", "b2y"]))
    near = p.where("class = 1")
    clear = near.join(blocked_pairs(near, buildings, size), ["src", "dst"], "left_anti")
    return clear.select("src", "dst", "con_type").union(p.where("class = 2 and sight").select("src", "dst", "con_type"))
