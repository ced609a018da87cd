"""Queries of the planning operators over graphs derived from the tables, and SQL for those that SQL can express.

Nodes come from `embeddings` (two of its dimensions as a position in 500 m by 500 m), gateways are every
fiftieth of them; a second, larger graph links suppliers to the parts they delivered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import capped, coverage, graph, measures, proximity, sight
from ..session import Scratch, table
from ..sources import osm, stats, store, text
from . import kernels as K
from . import legacy, pipeline, relaxation

SHORT, LONG, SPACING, RADIUS, SIDE = 10.0, 40.0, 10.0, 20.0, 500.0
PER_NODE, PER_GATEWAY, CAPACITY = 3, 10, 1000.0
PATTERNS, PERCENT, SEED = 20, 10, 101593
#: The largest graph a kernel takes in one task.
MAX_NODES, MAX_EDGES = 20_000, 4_000_000


def nodes(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k: (F.col("embedding")[k].cast("double") + 0.5) * SIDE
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), at(0).alias("x"), at(1).alias("y"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.typed_edges(nodes(spark, d), SHORT, LONG)


def gateways(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).where("node_id % 50 = 0").select("node_id")


def covered(spark: SparkSession, d: str, **how) -> DataFrame:
    return coverage.node_targets(nodes(spark, d), RADIUS, SPACING, SIDE, SIDE, **how)


def supply(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts as one graph; parts get negative ids."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (-F.col("l_partkey") - 1).alias("dst")).distinct()


def squares(spark: SparkSession, d: str) -> DataFrame:
    """Square buildings of 6 m by 6 m, placed by the keys of suppliers."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("building_id"), (F.col("s_suppkey") * 37 % 490).cast("double").alias("x"), (F.col("s_suppkey") * 101 % 490).cast("double").alias("y"))
    p = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    return s.select("building_id", F.array(p(0.0, 0.0), p(6.0, 0.0), p(6.0, 6.0), p(0.0, 6.0)).alias("ring"))


# --- relational queries -----------------------------------------------------


def distance_pairs(spark, d):
    return graph.distance_pairs(nodes(spark, d), LONG).select("src", "dst", F.round("d2", 6).alias("d2"))


def edge_types(spark, d):
    return edges(spark, d).groupBy("con_type").agg(F.count(F.lit(1)).alias("n_edges"))


def typed_edges(spark, d):
    return edges(spark, d)


def edge_type_lookup(spark, d):
    n = nodes(spark, d).select("node_id")
    return graph.edge_type_of(n.select(F.col("node_id").alias("src"), ((F.col("node_id") * 7 + 3) % n.count()).alias("dst")).where("src <> dst"), edges(spark, d)).distinct()


def degree_by_type(spark, d):
    return graph.degrees_by_type(edges(spark, d), nodes(spark, d))


def degree_summary(spark, d):
    return graph.degree_summary(edges(spark, d), nodes(spark, d))


def isolated_nodes(spark, d):
    return degree_by_type(spark, d).where("short_degree = 0").select("node_id")


def arg_max_degree(spark, d):
    return graph.arg_max_degree(edges(spark, d))


def reduction_candidates(spark, d):
    return graph.reduction_candidates(edges(spark, d).where("con_type = 'short'"), gateways(spark, d))


def first_edges(spark, d):
    return edges(spark, d).orderBy("src", "dst").limit(1000).select("src", "dst")


def grid_cell_counts(spark, d):
    return nodes(spark, d).groupBy(G.cell(F.col("x"), LONG).alias("cx"), G.cell(F.col("y"), LONG).alias("cy")).agg(F.count(F.lit(1)).alias("n_nodes"))


def linear_cells(spark, d):
    n = nodes(spark, d).select("node_id", G.linear_cell(G.cell(F.col("x"), LONG), G.cell(F.col("y"), LONG), 12).alias("cell"))
    i, j = G.cell_of_linear(F.col("cell"), 12)
    return n.select("node_id", "cell", i.alias("cx"), j.alias("cy"), G.bin_centre(i, LONG).alias("centre_x"), G.bin_centre(j, LONG, corner=True).alias("corner_y"))


def near_nodes_by_cell(spark, d):
    return coverage.near_nodes_by_cell(nodes(spark, d), nodes(spark, d), RADIUS)


def targets_per_node(spark, d):
    return coverage.targets_per_node(covered(spark, d))


def targets_per_node_marked(spark, d):
    return coverage.targets_per_node(covered(spark, d, border_only=True))


def nodes_per_target(spark, d):
    return coverage.nodes_per_target(covered(spark, d))


def legacy_targets_per_node(spark, d):
    return coverage.targets_per_node(covered(spark, d, corner=True))


def uncovered_targets(spark, d):
    return coverage.uncovered(coverage.targets(spark, SIDE, SIDE, SPACING), covered(spark, d))


def coverage_ratio(spark, d):
    return coverage.coverage_ratio(coverage.targets(spark, SIDE, SIDE, SPACING), covered(spark, d))


def induced_subgraph(spark, d):
    return graph.induced_subgraph(edges(spark, d), nodes(spark, d).where("node_id % 2 = 0"))


def edge_closure(spark, d):
    n = nodes(spark, d)
    return graph.edge_closure(edges(spark, d), n.where("node_id % 3 = 0"), n.where("node_id % 3 = 1"))


def _sets(spark, d):
    n = nodes(spark, d).select("node_id")
    return n.where("node_id % 2 = 0"), n.where("node_id % 3 = 0")


def node_set_except(spark, d):
    a, b = _sets(spark, d)
    return a.exceptAll(b)


def node_set_intersect(spark, d):
    a, b = _sets(spark, d)
    return a.intersect(b)


def node_set_union(spark, d):
    a, b = _sets(spark, d)
    return a.union(b).distinct()


def far_from_gateways(spark, d):
    """Nodes without a direct edge to a gateway."""
    g = gateways(spark, d)
    e = edges(spark, d)
    both = e.select("src", "dst").union(e.select("dst", "src"))
    near = both.join(g.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(F.col("src").alias("node_id"))
    return nodes(spark, d).select("node_id").join(g, "node_id", "left_anti").join(near, "node_id", "left_anti")


def gateway_capacity(spark, d):
    return measures.gateway_capacity(edges(spark, d).where("con_type = 'short'"), gateways(spark, d), CAPACITY, PER_GATEWAY)


def _patterns(spark, d):
    c = nodes(spark, d).where("node_id % 50 <> 0")
    return measures.pattern_nodes(c, PATTERNS, K.pattern_size(c.count(), PERCENT, PATTERNS)[0], lambda p, n: (n * 7919 + p * 104729 + n * p * 31) % 1000003)


def pattern_sample(spark, d):
    return _patterns(spark, d)


def upper_bound_per_pattern(spark, d):
    return measures.upper_bounds(_patterns(spark, d), edges(spark, d).where("con_type = 'short'"))


def dynamic_bound_per_pattern(spark, d):
    return measures.upper_bounds(_patterns(spark, d), edges(spark, d).where("con_type = 'short'"), PER_NODE)


def average_bound(spark, d):
    return measures.average_bounds(upper_bound_per_pattern(spark, d), CAPACITY, 150_000.0)


def link_numbering(spark, d):
    return text.static_links(edges(spark, d).where("con_type = 'short'"))


def dynamic_spec_links(spark, d):
    p = text.ports(nodes(spark, d), gateways(spark, d), 2, 3)
    return text.dynamic_links(edges(spark, d).where("con_type = 'short'"), p)


def spec_file(spark, d):
    n, g, e = nodes(spark, d), gateways(spark, d), edges(spark, d).where("con_type = 'short'")
    p = text.ports(n, g, 2, 3)
    return text.spec_lines(n.join(g, "node_id", "left_anti"), p, text.dynamic_links(e, p), g, CAPACITY).groupBy("value").agg(F.count(F.lit(1)).alias("n_lines"))


def graph_file(spark, d):
    return text.graph_lines(nodes(spark, d).select("node_id", F.floor("x").alias("x"), F.floor("y").alias("y")), edges(spark, d), gateways(spark, d))


def ray_cells(spark, d):
    n = nodes(spark, d)
    a = n.select(F.col("node_id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = n.select(F.col("node_id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    p = edges(spark, d).where("con_type = 'short'").join(a, "src").join(b, "dst")
    return sight.ray_bins(p, 2.0).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n_bins"), F.count_distinct("bx", "by").alias("n_distinct"))


def building_bins(spark, d):
    return sight.building_bins(squares(spark, d), 20.0)


def sight_edges(spark, d):
    return sight.sight_edges(nodes(spark, d), squares(spark, d), SHORT, LONG, 20.0)


def coarse_sight_edges(spark, d):
    return sight.coarse_sight_edges(nodes(spark, d), squares(spark, d), SHORT, LONG, 20.0, 30.0)


def supply_degrees(spark, d):
    return graph.degrees(supply(spark, d))


def supply_components(spark, d):
    return graph.components(supply(spark, d))


def components(spark, d):
    return graph.components(edges(spark, d).where("con_type = 'short'"), nodes(spark, d).select("node_id"))


def component_count(spark, d):
    return components(spark, d).agg(F.count_distinct("component").alias("n_components"))


def bfs_levels(spark, d):
    return graph.bfs(edges(spark, d).where("con_type = 'short'"), gateways(spark, d), together=True).select("node_id", "hops")


def shortest_path_lengths(spark, d):
    return graph.bfs(edges(spark, d).where("con_type = 'short'"), gateways(spark, d)).select("source", "node_id", "hops")


def supply_hops(spark, d):
    return graph.bfs(supply(spark, d), spark.range(1, 2).withColumnRenamed("id", "node_id")).groupBy("hops").agg(F.count(F.lit(1)).alias("n_nodes"))


def gateway_per_component(spark, d):
    """One node of each component, by an arithmetic draw."""
    draw = lambda component, node: (node * 7919 + component * 104729 + SEED) % 1000003
    return graph.top_by(components(spark, d), ["component"], [draw(F.col("component"), F.col("node_id")), "node_id"]).select("component", "node_id")


def thinned_nodes(spark, d):
    return graph.thinned(nodes(spark, d), 5.0).select("node_id")


def plot_segments(spark, d):
    return text.plot_edges(edges(spark, d).where("con_type = 'short'"), nodes(spark, d))


def plot_node_kinds(spark, d):
    return text.plot_nodes(nodes(spark, d), gateways(spark, d), nodes(spark, d).where("node_id % 2 = 0"))


def building_box(spark, d):
    """The box around all buildings of each area."""
    b = table(spark, d, "buildings")
    low, high = (lambda c: F.min(F.array_min(c))), (lambda c: F.max(F.array_max(c)))
    return b.groupBy("area_id").agg(low("building_lat").alias("min_lat"), high("building_lat").alias("max_lat"), low("building_lon").alias("min_lon"), high("building_lon").alias("max_lon"))


def building_metres(spark, d):
    """Corners of all buildings in metres north and east of their area's origin, on the ellipsoid."""
    b = table(spark, d, "buildings").join(table(spark, d, "map_areas"), "area_id").select("building_id", "min_lat", "min_lon", F.posexplode(F.arrays_zip("building_lat", "building_lon")).alias("pos", "p")).distinct()
    return b.select("building_id", "pos", F.round(G.meridian_metres(F.col("min_lat"), F.col("p.building_lat")), 4).alias("x"), F.round(G.parallel_metres(F.col("p.building_lat"), F.col("min_lon"), F.col("p.building_lon")), 4).alias("y"))


def capped_edges(spark, d):
    return capped.capped_edges(edges(spark, d), {"short": 50, "long": 50})


def flow_arcs(spark, d):
    return measures.flow_arcs(edges(spark, d).where("con_type = 'short'"), gateways(spark, d), nodes(spark, d).where("node_id % 50 <> 0").select("node_id")).groupBy("capacity").agg(F.count(F.lit(1)).alias("n_arcs"))


def nodes_of_targets(spark, d):
    return coverage.nodes_of_targets(covered(spark, d))


def degree_ranges(spark, d):
    return measures.series_ranges(degree_by_type(spark, d), ["short_degree", "long_degree"])


def bound_series(spark, d):
    """The curves of the static and the dynamic bound over the patterns."""
    rows = upper_bound_per_pattern(spark, d).withColumnRenamed("upper_bound", "static").join(dynamic_bound_per_pattern(spark, d).withColumnRenamed("upper_bound", "dynamic"), "pattern_id")
    return text.plot_series(rows, "pattern_id", ["static", "dynamic"])


def _tree(spark, d):
    return graph.bfs(edges(spark, d).where("con_type = 'short'"), gateways(spark, d))


def path_new_nodes(spark, d):
    """Nodes outside the network (the even ids) on the shortest path from each gateway to each node."""
    return graph.counts_along(_tree(spark, d), nodes(spark, d).where("node_id % 2 = 1")).withColumnRenamed("n_marked", "n_new")


def shortest_path_parents(spark, d):
    return _tree(spark, d).where("parent is not null").select("source", "node_id", "parent")


def shortest_path_edges(spark, d):
    return graph.path_edges(_tree(spark, d).where("parent is not null").select(F.array("parent", "node_id").alias("path")))


def static_spec_file(spark, d):
    """A specification with one transceiver pair for each edge."""
    n, g = nodes(spark, d), gateways(spark, d)
    links = text.static_links(edges(spark, d).where("con_type = 'short'"))
    return text.spec_lines(n.join(g, "node_id", "left_anti"), text.used_ports(links), links, g, CAPACITY).groupBy("value").agg(F.count(F.lit(1)).alias("n_lines"))


def residual_arcs(spark, d):
    """Residual capacities of the short graph after its maximum flow: one unit on each edge from another node to a gateway."""
    e, g = edges(spark, d).where("con_type = 'short'"), gateways(spark, d)
    both = e.select("src", "dst").union(e.select("dst", "src"))
    to = both.where("src % 50 <> 0 and dst % 50 = 0")
    flows = to.withColumn("flow", F.lit(1.0)).union(to.select("dst", "src", F.lit(-1.0)))
    arcs = measures.flow_arcs(e, g, nodes(spark, d).where("node_id % 50 <> 0").select("node_id")).where("capacity = 1")
    return measures.residual_arcs(arcs, flows)


def rounded_positions(spark, d):
    return nodes(spark, d).select("node_id", G.half_away(F.col("x") - 250).alias("x"), G.half_away(F.col("y") - 250).alias("y"))


# --- the map tables ---------------------------------------------------------

#: Areas have local metres of their own; this far apart they share one plane without meeting.
APART = 1_000_000.0


def map_nodes(spark, d):
    """Places with a known position, all areas in one plane; of several positions of a node the least counts."""
    p = proximity.known_points(table(spark, d, "nodes")).groupBy(F.col("id").alias("node_id")).agg(F.min(F.struct("area", "x", "y")).alias("m"))
    return p.select("node_id", (F.col("m.x") + F.col("m.area") * APART).alias("x"), F.col("m.y").alias("y"))


def map_links(spark, d):
    """Linked pairs of graph_edges, whichever graph names them; a pair of several types takes the least."""
    e = table(spark, d, "graph_edges").where("src is not null and dst is not null and src <> dst and not (con_type <=> 'non_edge')")
    return e.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.min("con_type").alias("con_type"))


def map_gateways(spark, d):
    return table(spark, d, "graph_gateways").where("node_id is not null").select("node_id").distinct()


def map_buildings(spark, d):
    """Outlines as rings in the common plane; broken ones are left out."""
    r = proximity.local_rings(table(spark, d, "buildings"), table(spark, d, "map_areas")).where("size(xs) > 2 and size(xs) = size(ys)")
    ring = F.zip_with("xs", "ys", lambda x, y: F.struct((x + F.col("area_id") * APART).alias("x"), y.alias("y")))
    return r.where(F.forall("xs", lambda v: v.isNotNull()) & F.forall("ys", lambda v: v.isNotNull())).groupBy("building_id").agg(F.min(ring).alias("ring"))


def map_typed_edges(spark, d):
    return graph.typed_edges(map_nodes(spark, d), SHORT, LONG)


def map_degree_by_type(spark, d):
    return graph.degrees_by_type(map_typed_edges(spark, d), map_nodes(spark, d))


def map_link_degrees(spark, d):
    return graph.degrees(map_links(spark, d))


def map_components(spark, d):
    return graph.components(map_links(spark, d), map_gateways(spark, d))


def map_hops(spark, d):
    """Least hops of every node from a gateway."""
    return graph.bfs(map_links(spark, d), map_gateways(spark, d), together=True).select("node_id", "hops")


def map_reduction_candidates(spark, d):
    return graph.reduction_candidates(map_links(spark, d), map_gateways(spark, d))


def map_building_bins(spark, d):
    return sight.building_bins(map_buildings(spark, d), 20.0)


def map_sight_edges(spark, d):
    return sight.sight_edges(map_nodes(spark, d), map_buildings(spark, d), SHORT, LONG, 20.0)


# --- files written and read again -------------------------------------------


def edge_list_round_trip(spark, d):
    path = f"{Scratch(spark, 'files').home()}/edges"
    text.write_edges(edges(spark, d), path)
    return text.edges_with_type(text.read_edges(spark, path), nodes(spark, d), SHORT, LONG)


def spec_round_trip(spark, d):
    """Links of a specification after it was written as lines and read again."""
    n, g, e = nodes(spark, d), gateways(spark, d), edges(spark, d).where("con_type = 'short'")
    p = text.ports(n, g, 2, 3)
    path = f"{Scratch(spark, 'files').home()}/spec"
    text.write_lines(text.spec_lines(n.join(g, "node_id", "left_anti"), p, text.dynamic_links(e, p), g, CAPACITY).coalesce(1), path)
    return text.read_spec(spark, path)["links"].select("u", "u_port", "v", "v_port", "capacity", "unit")


def sight_file_round_trip(spark, d):
    """The lines of a sight graph file, with how often each stands there."""
    path = f"{Scratch(spark, 'files').home()}/sight"
    text.write_lines(text.los_lines(nodes(spark, d).select("node_id", F.floor("x").alias("x"), F.floor("y").alias("y")), edges(spark, d)), path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n_lines"))


def stats_round_trip(spark, d):
    """Statistics rows appended to a file and read again; a missing value is written as N/A."""
    n = nodes(spark, d).where("node_id % 10 = 0")
    cast = lambda k, c, t: (F.when(F.col("node_id") % (k + 2) != 0, F.col("node_id") * (k + 1)) if t == "int" else F.when(F.col("node_id") % 3 != 0, F.floor(F.col("x")) / 2 + k)).cast(t).alias(c)
    path = f"{Scratch(spark, 'files').home()}/stats"
    for half in (0, 1):
        text.append_stats(n.where(F.floor(F.col("node_id") % 20 / 10) == half).select(*[cast(k, c, t) for k, (c, t) in enumerate(stats.RESULT_ROW.items())]), path)
    return text.read_stats(spark, path, stats.RESULT_ROW)


def graph_store_round_trip(spark, d):
    path = f"{Scratch(spark, 'files').home()}/graph"
    store.save_graph(path, nodes(spark, d), edges(spark, d), gateways(spark, d))
    g = store.load_graph(spark, path)
    return graph.degree_summary(g["edges"], g["nodes"])


def map_round_trip(spark, d):
    """Corners of the buildings after they were written as a map extract in XML and read again."""
    b = table(spark, d, "buildings").where("size(building_lat) > 2 and size(building_lat) = size(building_lon)").groupBy("building_id").agg(F.max(F.struct("building_lat", "building_lon")).alias("r"))
    b = b.select("building_id", F.col("r.building_lat").alias("lat"), F.col("r.building_lon").alias("lon"))
    corner = b.select("building_id", F.posexplode(F.arrays_zip("lat", "lon")).alias("pos", "p"))
    n = corner.select(F.format_string('<node id="%d" lat="%s" lon="%s"/>', F.col("building_id") * 1000 + F.col("pos"), F.col("p.lat"), F.col("p.lon")).alias("value"))
    refs = F.array_join(F.transform(F.sequence(F.lit(0), F.size("lat")), lambda k: F.format_string('<nd ref="%d"/>', F.col("building_id") * 1000 + k % F.size("lat"))), "")
    w = b.select(F.concat(F.format_string('<way id="%d">', "building_id"), refs, F.lit('<tag k="building" v="yes"/></way>')).alias("value"))
    path = f"{Scratch(spark, 'files').home()}/map"
    wrap = lambda batches: (pd.DataFrame({"value": ["<osm>" + "".join(x["value"]) + "</osm>"]}) for x in batches)
    # a document for each batch of elements, each in a file of its own
    n.union(w).mapInPandas(wrap, "value string").write.option("maxRecordsPerFile", 1).text(path)
    r = osm.building_rings(osm.read_map(spark, path))
    return r.select("building_id", F.size("lat").alias("n_corners"), F.round(F.array_min("lat"), 7).alias("least_lat"), F.round(F.array_max("lon"), 7).alias("most_lon"))


# --- scenario kernels -------------------------------------------------------


def _scenario(spark: SparkSession, d: str, run: Callable, schema: str, spread: int = 1) -> DataFrame:
    """Runs a kernel on the whole scenario graph, in `spread` groups that share its work by key.

    A kernel holds its graph in one task, so graphs above MAX_NODES nodes or MAX_EDGES edges are an error.
    """
    if (n := nodes(spark, d).count()) > MAX_NODES:
        raise ValueError(f"a scenario of {n} nodes; kernels take up to {MAX_NODES}")
    part = F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part")
    n = nodes(spark, d).select("node_id", "x", "y", part)
    e = edges(spark, d).select("src", "dst", "con_type", part)

    def one(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(b) > MAX_EDGES:
            raise ValueError(f"a scenario of {len(b)} edges; kernels take up to {MAX_EDGES}")
        ids = sorted(a["node_id"].tolist())
        points = {int(i): (x, y) for i, x, y in a[["node_id", "x", "y"]].itertuples(index=False)}
        adj = K.graph_of(b[["src", "dst"]].itertuples(index=False), ids)
        s = b[b["con_type"] == "short"]
        short = K.graph_of(s[["src", "dst"]].itertuples(index=False), ids)
        names = [f.strip().split()[0] for f in schema.split(",")]
        return pd.DataFrame(list(run(int(key[0]), points, adj, short, [i for i in ids if i % 50 == 0])), columns=names)

    return n.groupBy("part").cogroup(e.groupBy("part")).applyInPandas(one, schema)


def _cover(points, gates):
    return K.greedy_cover(points, gates, K.Grid(SPACING, RADIUS, SIDE, SIDE))


def _reduced(points, short, gates):
    return K.reduce_degrees(K.backbone(short, gates, _cover(points, gates)), short, gates)


def greedy_cover(spark, d):
    return _scenario(spark, d, lambda _, p, a, s, g: enumerate(_cover(p, g)), "turn bigint, node_id bigint")


def gateway_choice(spark, d):
    """Gateways as the scenarios choose them: one of each component, then random ones up to the quota."""
    return _scenario(spark, d, lambda _, p, a, s, g: enumerate(K.select_gateways(s, len(a), 0.02, SEED)), "turn bigint, node_id bigint")


def disconnected_cover(spark, d):
    """Covering nodes that the backbone does not reach."""
    on_tree = graph.endpoints(backbone_tree(spark, d)).select("node_id").union(gateways(spark, d)).distinct()
    return greedy_cover(spark, d).select("node_id").join(on_tree, "node_id", "left_anti")


def _neighbours(g: K.Graph) -> Iterator[tuple]:
    return ((n, sorted(g[n])) for n in sorted(g))


def _base(spark: SparkSession, d: str, joined: bool) -> DataFrame:
    """(node_id, neighbours) of the reduced backbone, if joined with all edges among its nodes; computed once and written."""

    def run(_, p, a, s, g):
        r = _reduced(p, s, g)
        return _neighbours({n: r[n] | a[n] & set(r) for n in r} if joined else r)

    return Scratch(spark, "base").cut(_scenario(spark, d, run, "node_id bigint, neighbours array<bigint>"))[0]


def _parts(df: DataFrame, spread: int = 8) -> DataFrame:
    return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))).repartition(spread, "part")


def _graph_of(a: pd.DataFrame) -> tuple[K.Graph, list[int]]:
    g = {int(n): {int(v) for v in vs} for n, vs in zip(a["node_id"], a["neighbours"])}
    return g, [n for n in sorted(g) if n % 50 == 0]


def _potentials(base: DataFrame, of_source: bool, spread: int = 8) -> DataFrame:
    """(node_id, potential) of each node of a network; its nodes are shared out among tasks."""

    def one(key: tuple, a: pd.DataFrame) -> pd.DataFrame:
        g, gates = _graph_of(a)
        res = K.residual(g, set(gates))
        mine = [n for n in sorted(g) if n % spread == int(key[0])]
        return pd.DataFrame({"node_id": mine, "potential": [float(K.source_potential(res, n, set(gates)) if of_source else K.sink_potential(res, n, set(gates))) for n in mine]}).astype({"node_id": "int64", "potential": "float64"})

    return _parts(base, spread).groupBy("part").applyInPandas(one, "node_id bigint, potential double")


def path_benefits(spark, d):
    """What the shortest paths over all edges between any two network nodes are worth per node not yet in the network."""
    base = _base(spark, d, True)
    source, _ = Scratch(spark, "potentials").cut(_potentials(base, True))

    def one(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        net, _ = _graph_of(a)
        adj = K.graph_of(b[["src", "dst"]].itertuples(index=False))
        senders = set(a.loc[a["potential"] > 0, "node_id"].tolist())
        rows = []
        for u in sorted(net):
            if u % 8 == int(key[0]) and u in senders:
                parent = K.bfs_tree(adj, [u])[1]
                rows += [(u, v, new) for v in sorted(net) if v in parent and (new := sum(x not in net for x in K.path_to(parent, v)))]
        return pd.DataFrame(rows, columns=["src", "dst", "n_new"]).astype("int64")

    sending = _parts(base.join(source, "node_id"))
    paths = sending.groupBy("part").cogroup(_parts(edges(spark, d).select("src", "dst")).groupBy("part")).applyInPandas(one, "src bigint, dst bigint, n_new bigint")
    return measures.benefits(paths, source, _potentials(base, False))


def best_path(spark, d):
    """The path of most benefit; ties go to the smallest ends."""
    return path_benefits(spark, d).orderBy(F.desc("benefit"), "src", "dst").limit(1)


def backbone_tree(spark, d):
    return _scenario(spark, d, lambda _, p, a, s, g: K.edges_of(K.backbone(s, g, _cover(p, g))), "src bigint, dst bigint")


def degree_reduction(spark, d):
    return _scenario(spark, d, lambda _, p, a, s, g: K.edges_of(_reduced(p, s, g)), "src bigint, dst bigint")


def max_flow_value(spark, d):
    return _scenario(spark, d, lambda _, p, a, s, g: [(K.max_flow(s, g), K.max_flow(a, g))], "short_flow double, full_flow double")


def source_potential(spark, d):
    return _potentials(_base(spark, d, False), True)


def sink_potential(spark, d):
    return _potentials(_base(spark, d, False), False)


def dynamic_augment(spark, d):
    def run(_, p, a, s, g):
        r = _reduced(p, s, g)
        return ((k, n) for k, path in enumerate(K.augment_dynamic(a, r, g, K.half_away_py(0.1 * len(r)))[1]) for n in path)

    return _scenario(spark, d, run, "turn bigint, node_id bigint")


def _static(p, a, s, g):
    r = _reduced(p, s, g)
    pn, pg = K.port_caps(r, g, PER_NODE, PER_GATEWAY)
    return K.augment_static(a, r, g, pn, pg, K.half_away_py(0.1 * len(r)))[0], pn, pg


def static_augment(spark, d):
    return _scenario(spark, d, lambda _, p, a, s, g: K.edges_of(_static(p, a, s, g)[0]), "src bigint, dst bigint")


def _networks(spark: SparkSession, d: str) -> DataFrame:
    """The static and the dynamic network after augmentation, with the port limits; computed once and written."""

    def run(k, p, a, s, g):
        r = _reduced(p, s, g)
        pn, pg = K.port_caps(r, g, PER_NODE, PER_GATEWAY)
        room = K.half_away_py(0.1 * len(r))
        net = K.augment_static(a, r, g, pn, pg, room)[0] if k else K.augment_dynamic(a, r, g, room)[0]
        return (("static" if k else "dynamic", n, sorted(net[n]), pn, pg) for n in sorted(net))

    return Scratch(spark, "networks").cut(_scenario(spark, d, run, "network string, node_id bigint, neighbours array<bigint>, per_node bigint, per_gateway bigint", 2))[0]


def _network(a: pd.DataFrame) -> tuple[K.Graph, list[int], int, int]:
    """(graph, gateways, port limits) of the rows of one network."""
    g = {int(n): {int(v) for v in vs} for n, vs in zip(a["node_id"], a["neighbours"])}
    return g, [n for n in sorted(g) if n % 50 == 0], int(a["per_node"].iloc[0]), int(a["per_gateway"].iloc[0])


def _each_pattern(k: int, g: K.Graph, gates: list[int], flow: Callable, seed: int, spread: int) -> Iterator[tuple]:
    c = sorted(set(g) - set(gates))
    if c:
        size, n = K.pattern_size(len(c), PERCENT, PATTERNS)
        for i in range(k, n, spread):
            yield (i, *flow(K.pattern(c, size, seed, i)))


def _pattern_flows(networks: DataFrame, kind: str, spread: int = 8) -> DataFrame:
    """Flow and bound of each pattern on one of the networks; seeds and limits are those of `pipeline.measure`."""

    def one(key: tuple, a: pd.DataFrame) -> pd.DataFrame:
        g, gates, pn, pg = _network(a)
        flow = (lambda ns: K.static_pattern_flow(g, gates, ns)) if kind == "static" else (lambda ns: K.dynamic_pattern_flow(g, gates, pn, pg, ns))
        return pd.DataFrame(list(_each_pattern(int(key[0]), g, gates, flow, SEED + (kind == "dynamic"), spread)), columns=["pattern_id", "max_flow", "upper_bound"])

    parts = networks.where(F.col("network") == kind).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return parts.repartition(spread, "part").groupBy("part").applyInPandas(one, "pattern_id bigint, max_flow double, upper_bound double")


def static_pattern_flows(spark, d):
    return _pattern_flows(_networks(spark, d), "static")


def dynamic_pattern_flows(spark, d):
    return _pattern_flows(_networks(spark, d), "dynamic")


def average_flows(spark, d):
    n = _networks(spark, d)
    a = _pattern_flows(n, "static").select(F.lit("static").alias("network"), "*").union(_pattern_flows(n, "dynamic").select(F.lit("dynamic"), "*"))
    return a.groupBy("network").agg(F.count(F.lit(1)).alias("n_patterns"), (F.avg("max_flow") * CAPACITY).alias("avg_flow"), (F.avg("upper_bound") * CAPACITY).alias("avg_bound"))


def equivalent_static_ports(spark, d):
    def one(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        static, g, pn, pg = _network(a[a["network"] == "static"])
        dynamic = _network(a[a["network"] == "dynamic"])[0]
        start = K.average_static_flow(static, g, PERCENT, PATTERNS, SEED)
        goal, _ = K.average_dynamic_flow(dynamic, g, pn, pg, PERCENT, PATTERNS, SEED + 1)
        adj = K.graph_of(b[["src", "dst"]].itertuples(index=False))
        row = K.equivalent_static(static, adj, g, pn, pg, goal, PERCENT, PATTERNS, SEED + 2, start)[1:] + (goal,)
        return pd.DataFrame([row], columns=["per_node", "per_gateway", "avg_flow", "avg_bound", "goal"])

    part = F.lit(0).alias("part")
    n = _networks(spark, d).select("*", part)
    return n.groupBy("part").cogroup(edges(spark, d).select("src", "dst", part).groupBy("part")).applyInPandas(one, "per_node bigint, per_gateway bigint, avg_flow double, avg_bound double, goal double")


def relaxed_bound(spark, d, n_max: int | None = None):
    """Bound of the relaxed program over all nodes and edges, for networks that cover what the reduced backbone covers.

    n_max is the number of nodes besides the gateways; by default that of the reduced backbone and what the
    augmentation may add. `converged` is false if the program was not solved to the tolerance; the bound holds anyway.
    """

    def run(_, p, a, s, g):
        r = _reduced(p, s, g)
        grid = K.Grid(SPACING, RADIUS, SIDE, SIDE)
        by: dict = {}
        for n in sorted(a):
            for c in grid.cells(*p[n], border_only=False):
                by.setdefault(c, []).append(n)
        covered = sorted({c for n in r for c in grid.cells(*p[n], border_only=False)})
        size = len(r) + K.half_away_py(0.1 * len(r)) if n_max is None else n_max
        prog = relaxation.placement_program(a, s, g, [by[c] for c in covered], size, 8)
        done = prog.certify()
        return [(len(prog.low), len(prog.rows), done.bound, done.gap, done.converged)]

    return _scenario(spark, d, run, "n_variables bigint, n_constraints bigint, bound double, gap double, converged boolean")


def _earlier(p, a, s, g):
    """Cover, backbone and reduced backbone by the earlier rules, with their greatest degree and size limit."""
    tree = legacy.backbone(a, g, legacy.cover(p, K.Grid(SPACING, RADIUS, SIDE, SIDE)))
    return legacy.reduce_degrees(tree, s, g)


def legacy_gateway_choice(spark, d):
    return _scenario(spark, d, lambda _, p, a, s, g: enumerate(legacy.gateways(a, len(a), 0.02, SEED)), "turn bigint, node_id bigint")


def legacy_cover(spark, d):
    return _scenario(spark, d, lambda _, p, a, s, g: enumerate(legacy.cover(p, K.Grid(SPACING, RADIUS, SIDE, SIDE))), "turn bigint, node_id bigint")


def legacy_backbone(spark, d):
    return _scenario(spark, d, lambda _, p, a, s, g: K.edges_of(legacy.backbone(a, g, legacy.cover(p, K.Grid(SPACING, RADIUS, SIDE, SIDE)))), "src bigint, dst bigint")


def legacy_reduction(spark, d):
    return _scenario(spark, d, lambda _, p, a, s, g: K.edges_of(_earlier(p, a, s, g)[0]), "src bigint, dst bigint")


def legacy_networks(spark, d):
    """Size, degree and flow of the networks that the earlier steps end with; n_max is 2 nodes above the backbone's."""

    def run(_, p, a, s, g):
        base, top, _ = _earlier(p, a, s, g)
        for kind, net in (("dynamic", legacy.augment_dynamic(a, base, g, len(base) + 2)), ("static", legacy.augment_static(a, base, g, len(base) + 2, top + 1))):
            flow, bound = legacy.average_flow(net, g, 0.05, PATTERNS, SEED)
            yield kind, len(net), max(K.degree(net, n) for n in net), flow, bound

    return _scenario(spark, d, run, "network string, n_nodes bigint, max_degree bigint, avg_flow double, avg_bound double")


def scenario_rows(spark, d):
    """Statistics rows of all scenarios in `configs`; run_id is config_id."""
    return pipeline.run_all(spark, pipeline.table_scenarios(table(spark, d, "configs")))


def master_rows(spark, d):
    s = pipeline.table_scenarios(table(spark, d, "configs"))
    return pipeline.master_rows(pipeline.run_all(spark, s), s)


NAMES = """distance_pairs edge_types typed_edges edge_type_lookup degree_by_type degree_summary isolated_nodes arg_max_degree
reduction_candidates first_edges grid_cell_counts linear_cells near_nodes_by_cell targets_per_node targets_per_node_marked
nodes_per_target legacy_targets_per_node uncovered_targets coverage_ratio induced_subgraph edge_closure node_set_except
node_set_intersect node_set_union far_from_gateways gateway_capacity pattern_sample upper_bound_per_pattern
dynamic_bound_per_pattern average_bound link_numbering dynamic_spec_links spec_file graph_file ray_cells building_bins
sight_edges coarse_sight_edges supply_degrees supply_components components component_count bfs_levels shortest_path_lengths
supply_hops gateway_per_component thinned_nodes plot_segments plot_node_kinds nodes_of_targets degree_ranges
bound_series path_new_nodes shortest_path_parents shortest_path_edges static_spec_file residual_arcs rounded_positions
map_typed_edges map_degree_by_type map_link_degrees map_components map_hops map_reduction_candidates map_building_bins map_sight_edges
edge_list_round_trip spec_round_trip sight_file_round_trip stats_round_trip graph_store_round_trip map_round_trip building_box building_metres capped_edges flow_arcs
gateway_choice greedy_cover disconnected_cover backbone_tree path_benefits best_path
degree_reduction max_flow_value source_potential sink_potential dynamic_augment static_augment static_pattern_flows
dynamic_pattern_flows average_flows equivalent_static_ports relaxed_bound scenario_rows master_rows
legacy_gateway_choice legacy_cover legacy_backbone legacy_reduction legacy_networks""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: globals()[n] for n in NAMES}


# --- SQL --------------------------------------------------------------------

_N = "n as (select vec_id node_id, (embedding[1]::double + 0.5) * 500 x, (embedding[2]::double + 0.5) * 500 y from embeddings)"
_E = (
    _N
    + """, d as (select a.node_id src, b.node_id dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) d2 from n a join n b on a.node_id < b.node_id),
e as (select src, dst, case when d2 <= 100 then 'short' else 'long' end con_type from d where d2 <= 1600),
ends as (select src node_id, con_type from e union all select dst, con_type from e)"""
)
_T = (
    _N
    + """, t as (select ti, tj, (ti + 0.5::double) * 10 tx, (tj + 0.5::double) * 10 ty from range(0, 51) a(ti), range(0, 51) b(tj)),
box as (select *, least(50, greatest(0, floor((x - 20) / 10)))::bigint i0, least(50, greatest(0, floor((x + 20) / 10)))::bigint i1,
  least(50, greatest(0, floor((y - 20) / 10)))::bigint j0, least(50, greatest(0, floor((y + 20) / 10)))::bigint j1 from n),
b as (select *, (x - tx) * (x - tx) + (y - ty) * (y - ty) <= 400 hit, ti > i0 and ti < i1 and tj > j0 and tj < j1 inside,
  (x - ti * 10) * (x - ti * 10) + (y - tj * 10) * (y - tj * 10) <= 400 corner_hit from box join t on ti between i0 and i1 and tj between j0 and j1)"""
)
_P = (
    _E
    + """, pt as (select p pattern_id, node_id from (select p, node_id, row_number() over (partition by p order by (node_id * 7919 + p * 104729 + node_id * p * 31) % 1000003, node_id) r, count(*) over (partition by p) m
  from n, range(0, 20) q(p) where node_id % 50 <> 0) where r <= round(m * 0.1)),
sd as (select node_id, count(*) degree from ends where con_type = 'short' group by 1),
pd as (select pattern_id, coalesce(degree, 0) degree from pt left join sd using (node_id))"""
)
_S = _E + ", both_ways as (select src a, dst b from e where con_type = 'short' union select dst, src from e where con_type = 'short')"


#: Walk from each node of the short graph to the least id of its component.
_C = _S + ", walk(node_id, c) as (select node_id, node_id from n union select b, c from walk join both_ways on a = node_id where c < b), comp as (select node_id, min(c) component from walk group by 1)"
#: Breadth-first search from each gateway over short edges; the parent is the least one.
_WALK = _S + ", walk(source, node_id, hops, parent) using key (source, node_id) as (select node_id, node_id, 0, null::bigint from n where node_id % 50 = 0 union (select w.source, b, min(w.hops) + 1, min(a) from walk w join both_ways on a = w.node_id left join recurring.walk o on o.source = w.source and o.node_id = b where o.node_id is null group by 1, 2))"
_MAP = """mn as (select node_id, m.x + m.a * 1000000.0::double x, m.y y from (select node_id, min({'a': area_id, 'x': node_x, 'y': node_y}) m from nodes where node_id is not null and area_id is not null
    and not isnan(node_x) and not isnan(node_y) and node_x <> -9999 and node_y <> -9999 group by 1)),
mc as (select *, floor(x / 40) gx, floor(y / 40) gy from mn),
me as (select a.node_id src, b.node_id dst, case when (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 100 then 'short' else 'long' end con_type
  from (select *, unnest([-1, 0, 1]) i from mc) a join mc b on b.gx = a.gx + i and b.gy between a.gy - 1 and a.gy + 1 and a.node_id < b.node_id where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1600)"""
_LINKS = """ml as (select least(src, dst) src, greatest(src, dst) dst from graph_edges where src is not null and dst is not null and src <> dst and con_type is distinct from 'non_edge' group by 1, 2),
mg as (select distinct node_id from graph_gateways where node_id is not null)"""
#: Whether a segment (x1, y1) to (x2, y2) crosses a square (qx, qy) of 6 m: a part of it inside, not the whole of it.
_CUT = """greatest(0.0, case when x2 = x1 then (case when x1 > qx and x1 < qx + 6 then 0 else 2 end) else least((qx - x1) / (x2 - x1), (qx + 6 - x1) / (x2 - x1)) end,
    case when y2 = y1 then (case when y1 > qy and y1 < qy + 6 then 0 else 2 end) else least((qy - y1) / (y2 - y1), (qy + 6 - y1) / (y2 - y1)) end) t0,
  least(1.0, case when x2 = x1 then 1 else greatest((qx - x1) / (x2 - x1), (qx + 6 - x1) / (x2 - x1)) end, case when y2 = y1 then 1 else greatest((qy - y1) / (y2 - y1), (qy + 6 - y1) / (y2 - y1)) end) t1,
  x1 between qx and qx + 6 and x2 between qx and qx + 6 and y1 between qy and qy + 6 and y2 between qy and qy + 6 whole"""
_Q = "q as (select s_suppkey b, (s_suppkey * 37 % 490)::double qx, (s_suppkey * 101 % 490)::double qy from supplier)"


def _blocked(name: str, source: str, keys: str) -> str:
    """Keys of the segments of a table that some square crosses which has a bin of 20 m in common with the segment's grid ray."""
    return f"""{name}_ray as (select {keys}, floor(x1 / 20)::bigint x, floor(y1 / 20)::bigint y, abs(floor(x2 / 20) - floor(x1 / 20))::bigint dx, abs(floor(y2 / 20) - floor(y1 / 20))::bigint dy,
  sign(floor(x2 / 20) - floor(x1 / 20))::bigint sx, sign(floor(y2 / 20) - floor(y1 / 20))::bigint sy, (abs(floor(x2 / 20) - floor(x1 / 20)) - abs(floor(y2 / 20) - floor(y1 / 20)))::bigint err, (abs(floor(x2 / 20) - floor(x1 / 20)) + abs(floor(y2 / 20) - floor(y1 / 20)))::bigint todo from {source}
  union all select {keys}, x + case when err >= 0 and dx > 0 then sx else 0 end, y + case when err >= 0 and dx > 0 then 0 else sy end, dx, dy, sx, sy, err + case when err >= 0 and dx > 0 then -2 * dy else 2 * dx end, todo - 1 from {name}_ray where todo > 0),
{name}_met as (select distinct {keys}, qx, qy from {name}_ray join q on x between floor(qx / 20) and floor((qx + 6) / 20) and y between floor(qy / 20) and floor((qy + 6) / 20)),
{name} as (select distinct {keys} from (select {keys}, {_CUT} from {name}_met join {source} using ({keys})) where t1 - t0 > 1e-7 and not whole)"""


_SIGHT = _E + f""", {_Q}, pair as (select src, dst, con_type, a.x x1, a.y y1, b.x x2, b.y y2 from e join n a on a.node_id = src join n b on b.node_id = dst),
{_blocked("blocked", "pair", "src, dst")}"""
_COARSE = _SIGHT + f""", bin as (select distinct floor(x / 20)::bigint bx, floor(y / 20)::bigint cy from n),
link as (select a.bx ax, a.cy ay, b.bx bx, b.cy cy, (a.bx + 0.5::double) * 20 x1, (a.cy + 0.5::double) * 20 y1, (b.bx + 0.5::double) * 20 x2, (b.cy + 0.5::double) * 20 y2 from bin a, bin b),
far as (select * from link where (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2) between 900.0001 and 6400),
{_blocked("shut", "far", "ax, ay, bx, cy")},
spot as (select *, floor(x1 / 20)::bigint ax, floor(y1 / 20)::bigint ay, floor(x2 / 20)::bigint bx, floor(y2 / 20)::bigint cy from pair),
kind as (select *, ((ax - bx) * (ax - bx) + (ay - cy) * (ay - cy)) * 400 <= 900 near from spot)"""
#: Nodes one after the other; a node is kept if none that was kept before is within 5 m.
_THIN = _N + """, o as (select *, row_number() over (order by node_id) r from n),
walk(r, kept) as (select 0::bigint, []::struct(i bigint, x double, y double)[] union all
  select o.r, case when len(list_filter(kept, lambda k: (k.x - o.x) * (k.x - o.x) + (k.y - o.y) * (k.y - o.y) <= 25)) = 0 then list_append(kept, {'i': node_id, 'x': o.x, 'y': o.y}) else kept end from walk join o on o.r = walk.r + 1)"""
#: Edges in order; one after the other is taken while both its ends have room of their type.
_CAP = _E + """, o as (select *, row_number() over (order by src, dst) r from e), start as (select map_from_entries(list((node_id, 0))) m from n),
walk(r, short_used, long_used, taken) as (select 0::bigint, m, m, false from start union all
  select o.r, case when con_type = 'short' and ok then u else short_used end, case when con_type = 'long' and ok then u else long_used end, ok
  from (select o.*, w.short_used, w.long_used, case when con_type = 'short' then w.short_used else w.long_used end m from walk w join o on o.r = w.r + 1) o,
    lateral (select m[src] < 50 and m[dst] < 50 ok), lateral (select map_from_entries(list_transform(map_entries(m), lambda x: {'k': x.key, 'v': x.value + (x.key in (src, dst))::int})) u))"""


def _metres_sql() -> str:
    """The meridian series and Vincenty's inverse formula for two points of one latitude, in eight rounds."""
    f, a = G.WGS84_F, G.WGS84_A
    b, n = a * (1 - f), f / (2 - f)
    a0 = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    terms = [(-3 / 2 * (n - n**3 / 8), 2), (15 / 16 * (n**2 - n**4 / 4), 4), (-35 / 48 * n**3, 6), (315 / 512 * n**4, 8)]
    arc = lambda v: f"{a0!r}::double * ({v} + " + " + ".join(f"{c!r}::double * sin({k} * {v})" for c, k in terms) + ")"
    parts = [
        """p as (select distinct building_id, min_lat, min_lon, unnest(range(0, greatest(len(building_lat), len(building_lon)))) pos, building_lat la, building_lon lo from buildings join map_areas using (area_id) where building_lat is not null and building_lon is not null)""",
        f"""v0 as (select building_id, pos, radians(min_lat) r1, radians(la[pos + 1]) r2, abs(radians(lo[pos + 1] - min_lon)) l, abs(radians(lo[pos + 1] - min_lon)) lam,
          sin(atan({1 - f!r}::double * tan(radians(la[pos + 1])))) su, cos(atan({1 - f!r}::double * tan(radians(la[pos + 1])))) cu from p)""",
    ]
    for k in range(9):
        parts.append(f"""a{k} as (select *, sqrt(cu * sin(lam) * cu * sin(lam) + cu * su * (1 - cos(lam)) * cu * su * (1 - cos(lam))) ss, su * su + cu * cu * cos(lam) cs from v{k})""")
        parts.append(f"""b{k} as (select *, atan2(ss, cs) sigma, case when ss = 0 then 0 else cu * cu * sin(lam) / ss end sa from a{k})""")
        parts.append(f"""c{k} as (select *, 1 - sa * sa c2, case when 1 - sa * sa = 0 then 0 else cs - 2 * su * su / (1 - sa * sa) end cm, {f / 16!r}::double * (1 - sa * sa) * (4 + {f!r}::double * (4 - 3 * (1 - sa * sa))) c from b{k})""")
        if k < 8:
            parts.append(f"""v{k + 1} as (select building_id, pos, r1, r2, l, su, cu, l + (1 - c) * {f!r}::double * sa * (sigma + c * ss * (cm + c * cs * (-1 + 2 * cm * cm))) lam from c{k})""")
    parts.append(f"""d as (select *, c2 * {(a**2 - b**2) / b**2!r}::double u2 from c8), g as (select *, 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))) ka, u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2))) kb from d)""")
    length = f"{b!r}::double * ka * (sigma - kb * ss * (cm + kb / 4 * (cs * (-1 + 2 * cm * cm) - kb / 6 * cm * (-3 + 4 * ss * ss) * (-3 + 4 * cm * cm))))"
    return "with " + ", ".join(parts) + f" select distinct building_id, pos::int pos, round(abs({arc('r2')} - {arc('r1')}), 4) x, round({length}, 4) y from g"


def oracle_sql() -> dict[str, str]:
    w = lambda ctes, body, rec="": f"with {rec}{ctes} {body}"
    marked = "select node_id, count(*) n_targets from b where {} group by 1"
    return {
        "distance_pairs": w(_E, "select src, dst, round(d2, 6) d2 from d where d2 <= 1600"),
        "edge_types": w(_E, "select con_type, count(*) n_edges from e group by 1"),
        "typed_edges": w(_E, "select * from e"),
        "edge_type_lookup": w(_E, ", p as (select distinct least(node_id, (node_id * 7 + 3) % m) src, greatest(node_id, (node_id * 7 + 3) % m) dst from (select *, count(*) over () m from n) where node_id <> (node_id * 7 + 3) % m) select src, dst, coalesce(con_type, 'non_edge') con_type from p left join e using (src, dst)"),
        "degree_by_type": w(_E, "select n.node_id, count(*) filter (con_type = 'short') short_degree, count(*) filter (con_type = 'long') long_degree from n left join ends using (node_id) group by 1"),
        "degree_summary": w(_E, """, g as (select n.node_id, k con_type, (select count(*) from ends where ends.node_id = n.node_id and ends.con_type = k) c from n, (values ('short'), ('long')) v(k))
            select con_type, count(*) n_nodes, (sum(c) / 2)::bigint n_edges, min(c) min_degree, max(c) max_degree, round(avg(c), 6) avg_degree, count(*) filter (c = 0) n_isolated from g group by 1"""),
        "isolated_nodes": w(_E, "select node_id from n where node_id not in (select node_id from ends where con_type = 'short')"),
        "arg_max_degree": w(_E, ", g as (select node_id, count(*) degree from ends group by 1) select * from g where degree = (select max(degree) from g) and degree > 2"),
        "reduction_candidates": w(_E, """, m as (select node_id from ends where con_type = 'short' union select node_id from n where node_id % 50 = 0),
            g as (select m.node_id, count(ends.node_id) degree from m left join ends on m.node_id = ends.node_id and con_type = 'short' group by 1)
            select * from g where degree <= (select max(degree) - 2 from g) and (node_id % 50 = 0 or degree >= 1)"""),
        "first_edges": w(_E, "select src, dst from e order by src, dst limit 1000"),
        "grid_cell_counts": w(_N, "select floor(x / 40)::bigint cx, floor(y / 40)::bigint cy, count(*) n_nodes from n group by 1, 2"),
        "linear_cells": w(_N, "select node_id, floor(x / 40)::bigint * 13 + floor(y / 40)::bigint cell, floor(x / 40)::bigint cx, floor(y / 40)::bigint cy, (floor(x / 40) + 0.5::double) * 40 centre_x, floor(y / 40) * 40 corner_y from n"),
        "near_nodes_by_cell": w(_N, "select a.node_id, b.node_id near_id from n a join n b on a.node_id <> b.node_id and abs(floor(a.x / 20) - floor(b.x / 20)) <= 1 and abs(floor(a.y / 20) - floor(b.y / 20)) <= 1"),
        "targets_per_node": w(_T, marked.format("hit")),
        "targets_per_node_marked": w(_T, marked.format("hit or inside")),
        "legacy_targets_per_node": w(_T, marked.format("corner_hit")),
        "nodes_per_target": w(_T, "select ti, tj, count(*) n_nodes from b where hit group by 1, 2"),
        "uncovered_targets": w(_T, "select * from t where (ti, tj) not in (select (ti, tj) from b where hit)"),
        "coverage_ratio": w(_T, ", c as (select distinct ti, tj from b where hit) select (select count(*) from t) n_targets, (select count(*) from c) n_covered, round((select count(*) from c) / (select count(*) from t), 6) ratio"),
        "induced_subgraph": w(_E, "select * from e where src % 2 = 0 and dst % 2 = 0"),
        "edge_closure": w(_E, "select * from e where src % 3 < 2 and dst % 3 < 2 and (src % 3 = 0 or dst % 3 = 0)"),
        "node_set_except": w(_N, "select node_id from n where node_id % 2 = 0 and node_id % 3 <> 0"),
        "node_set_intersect": w(_N, "select node_id from n where node_id % 6 = 0"),
        "node_set_union": w(_N, "select node_id from n where node_id % 2 = 0 or node_id % 3 = 0"),
        "far_from_gateways": w(_E, "select node_id from n where node_id % 50 <> 0 and node_id not in (select src from e where dst % 50 = 0 union select dst from e where src % 50 = 0)"),
        "gateway_capacity": w(_E, "select (select count(*) from ends where con_type = 'short' and node_id % 50 = 0) * 1000.0::double static_capacity, (select count(*) from n where node_id % 50 = 0) * 10 * 1000.0::double dynamic_capacity"),
        "pattern_sample": w(_P, "select * from pt"),
        "upper_bound_per_pattern": w(_P, "select pattern_id, sum(degree)::bigint upper_bound from pd group by 1"),
        "dynamic_bound_per_pattern": w(_P, "select pattern_id, sum(least(degree, 3))::bigint upper_bound from pd group by 1"),
        "average_bound": w(_P, "select count(*) n_patterns, round(avg(least(b * 1000.0::double, 150000.0)), 6) avg_bound from (select pattern_id, sum(degree) b from pd group by 1)"),
        "link_numbering": w(_E, """, m as (select src, dst, src n from e where con_type = 'short' union all select src, dst, dst from e where con_type = 'short'),
            r as (select src, dst, n, row_number() over (partition by n order by src, dst) port from m),
            k as (select a.src, a.dst, a.port p, b.port q from r a join r b on a.src = b.src and a.dst = b.dst and a.n = a.src and b.n = b.dst)
            select src u, p u_port, dst v, q v_port from k union all select dst, q, src, p from k"""),
        "dynamic_spec_links": w(_S, "select a u, i u_port, b v, j v_port from both_ways, range(1, 4) p(i), range(1, 4) q(j) where i <= case when a % 50 = 0 then 3 else 2 end and j <= case when b % 50 = 0 then 3 else 2 end"),
        "spec_file": w(_S, """, p as (select node_id, i from n, range(1, 4) q(i) where i <= case when node_id % 50 = 0 then 3 else 2 end), lines as (
            select unnest(['trafficSources:', 'FSONodes:', 'FSOLinks:', 'gateways:']) as value
            union all select node_id::varchar from n union all select node_id || '_fso' || i from p
            union all select a || '_fso' || x.i || 'To' || b || '_fso' || z.i || ' 1000Mbps' from both_ways join p x on x.node_id = a join p z on z.node_id = b)
            select value, count(*) n_lines from lines group by 1"""),
        "graph_file": w(_E, "select unnest(['Nodes:', 'Edges:', 'Gateways:']) as value union all select node_id || ' ' || floor(x)::bigint || ' ' || floor(y)::bigint from n union all select src || ' ' || dst || ' ' || con_type from e union all select node_id::varchar from n where node_id % 50 = 0"),
        "ray_cells": w(_E, "select src, dst, (1 + abs(floor(a.x / 2) - floor(b.x / 2)) + abs(floor(a.y / 2) - floor(b.y / 2)))::bigint n_bins, (1 + abs(floor(a.x / 2) - floor(b.x / 2)) + abs(floor(a.y / 2) - floor(b.y / 2)))::bigint n_distinct from e join n a on a.node_id = src join n b on b.node_id = dst where con_type = 'short'"),
        "building_bins": "with s as (select s_suppkey building_id, (s_suppkey * 37 % 490)::double x, (s_suppkey * 101 % 490)::double y from supplier) select building_id, bx, b.k \"by\" from s, range(0, 26) a(bx), range(0, 26) b(k) where bx between floor(x / 20) and floor((x + 6) / 20) and b.k between floor(y / 20) and floor((y + 6) / 20)",
        "supply_degrees": "with g as (select distinct l_suppkey s, -l_partkey - 1 p from lineitem) select node_id, count(*) degree from (select s node_id from g union all select p from g) group by 1",
        "supply_components": """with recursive g as (select distinct l_suppkey s, -l_partkey - 1 p from lineitem), step as (select s a, p b from g union all select p, s from g),
            walk(node_id, component) using key (node_id) as (select distinct a, a from step union (select b, min(w.component) from walk w join step on step.a = w.node_id join recurring.walk o on o.node_id = b where w.component < o.component group by 1))
            select node_id, component from walk""",
        "supply_hops": """with recursive g as (select distinct l_suppkey s, -l_partkey - 1 p from lineitem), step as (select s a, p b from g union all select p, s from g),
            walk(node_id, hops) using key (node_id) as (select 1::bigint, 0 union (select b, min(w.hops) + 1 from walk w join step on step.a = w.node_id left join recurring.walk o on o.node_id = b where o.node_id is null group by 1))
            select hops, count(*) n_nodes from walk group by 1""",
        "components": w(_S, ", walk(node_id, c) as (select node_id, node_id from n union select b, c from walk join both_ways on a = node_id where c < b) select node_id, min(c) component from walk group by 1", "recursive "),
        "component_count": w(_S, ", walk(node_id, c) as (select node_id, node_id from n union select b, c from walk join both_ways on a = node_id where c < b) select count(distinct c) n_components from (select node_id, min(c) c from walk group by 1)", "recursive "),
        "shortest_path_lengths": w(_S, ", walk(source, node_id, hops) using key (source, node_id) as (select node_id, node_id, 0 from n where node_id % 50 = 0 union (select w.source, b, min(w.hops) + 1 from walk w join both_ways on a = w.node_id left join recurring.walk o on o.source = w.source and o.node_id = b where o.node_id is null group by 1, 2)) select source, node_id, hops from walk", "recursive "),
        "bfs_levels": w(_S, ", walk(node_id, hops) using key (node_id) as (select node_id, 0 from n where node_id % 50 = 0 union (select b, min(w.hops) + 1 from walk w join both_ways on a = w.node_id left join recurring.walk o on o.node_id = b where o.node_id is null group by 1)) select node_id, hops from walk", "recursive "),
        "plot_segments": w(_E, "select src, dst, con_type, a.x x1, a.y y1, b.x x2, b.y y2 from e join n a on a.node_id = src join n b on b.node_id = dst where con_type = 'short'"),
        "plot_node_kinds": w(_N, "select node_id, x, y, case when node_id % 50 = 0 then 'gateway' when node_id % 2 = 0 then 'member' else 'other' end kind from n"),
        "building_box": "select area_id, min(list_min(building_lat)) min_lat, max(list_max(building_lat)) max_lat, min(list_min(building_lon)) min_lon, max(list_max(building_lon)) max_lon from buildings group by 1",
        "map_typed_edges": w(_MAP, "select src, dst, con_type from me"),
        "map_degree_by_type": w(_MAP, "select mn.node_id, count(*) filter (con_type = 'short') short_degree, count(*) filter (con_type = 'long') long_degree from mn left join (select src node_id, con_type from me union all select dst, con_type from me) using (node_id) group by 1"),
        "map_link_degrees": w(_LINKS, "select node_id, count(*) degree from (select src node_id from ml union all select dst from ml) group by 1"),
        "map_components": w(_LINKS, """, v as (select src node_id from ml union select dst from ml union select node_id from mg), b as (select src a, dst b from ml union all select dst, src from ml),
            walk(node_id, component) using key (node_id) as (select node_id, node_id from v union (select b, min(w.component) from walk w join b on b.a = w.node_id join recurring.walk o on o.node_id = b where w.component < o.component group by 1))
            select node_id, component from walk""", "recursive "),
        "map_hops": w(_LINKS, """, b as (select src a, dst b from ml union all select dst, src from ml),
            walk(node_id, hops) using key (node_id) as (select node_id, 0 from mg union (select b, min(w.hops) + 1 from walk w join b on b.a = w.node_id left join recurring.walk o on o.node_id = b where o.node_id is null group by 1))
            select node_id, hops from walk""", "recursive "),
        "map_reduction_candidates": w(_LINKS, ", g as (select node_id, count(a) degree from (select src node_id, 1 a from ml union all select dst, 1 from ml union all select node_id, null from mg) group by 1) select * from g where degree <= (select max(degree) - 2 from g) and (node_id in (select node_id from mg) or degree >= 1)"),
        "map_building_bins": """with r as (select building_id, area_id, [(v - min_lat) * 111320 + area_id * 1000000.0::double for v in building_lat] xs, [(v - min_lon) * 111320 * cos(radians(min_lat)) for v in building_lon] ys from buildings join map_areas using (area_id)
              where len(building_lat) > 2 and len(building_lat) = len(building_lon)),
            o as (select building_id, list_min(xs) lx, list_max(xs) hx, list_min(ys) ly, list_max(ys) hy from (select distinct building_id, xs, ys from r)),
            x as (select *, unnest(range(floor(lx / 20)::bigint, floor(hx / 20)::bigint + 1)) bx from o)
            select building_id, bx, unnest(range(floor(ly / 20)::bigint, floor(hy / 20)::bigint + 1)) "by" from x""",
        "nodes_of_targets": w(_T, "select ti, tj, node_id from b where hit"),
        "degree_ranges": w(_E, ", g as (select n.node_id, count(*) filter (con_type = 'short') s, count(*) filter (con_type = 'long') l from n left join ends using (node_id) group by 1) select 'short_degree' series, min(s)::double least, max(s)::double most from g union all select 'long_degree', min(l), max(l) from g"),
        "bound_series": w(_P, "select 'static' series, pattern_id::int x, sum(degree)::double y from pd group by 2 union all select 'dynamic', pattern_id::int, sum(least(degree, 3)) from pd group by 2"),
        "path_new_nodes": w(_WALK, ", path(source, node_id, hops, n_new) as (select source, node_id, 0, (node_id % 2)::bigint from walk where hops = 0 union all select w.source, w.node_id, w.hops, p.n_new + w.node_id % 2 from path p join walk w on w.source = p.source and w.parent = p.node_id and w.hops = p.hops + 1) select source, node_id, n_new from path", "recursive "),
        "shortest_path_parents": w(_WALK, "select source, node_id, parent from walk where parent is not null", "recursive "),
        "shortest_path_edges": w(_WALK, "select distinct least(parent, node_id) src, greatest(parent, node_id) dst from walk where parent is not null", "recursive "),
        "static_spec_file": w(_E, """, m as (select src, dst, src n from e where con_type = 'short' union all select src, dst, dst from e where con_type = 'short'),
            r as (select src, dst, n, row_number() over (partition by n order by src, dst) port from m),
            k as (select a.src, a.dst, a.port p, b.port q from r a join r b on a.src = b.src and a.dst = b.dst and a.n = a.src and b.n = b.dst), lines as (
            select unnest(['trafficSources:', 'FSONodes:', 'FSOLinks:', 'gateways:']) as value union all select node_id::varchar from n union all select n || '_fso' || port from r
            union all select src || '_fso' || p || 'To' || dst || '_fso' || q || ' 1000Mbps' from k union all select dst || '_fso' || q || 'To' || src || '_fso' || p || ' 1000Mbps' from k)
            select value, count(*) n_lines from lines group by 1"""),
        "residual_arcs": w(_E, ", b as (select src, dst from e where con_type = 'short' union all select dst, src from e where con_type = 'short') select src, dst, case when src % 50 <> 0 and dst % 50 = 0 then 0.0 when src % 50 = 0 and dst % 50 <> 0 then 2.0 else 1.0 end::double capacity from b"),
        "rounded_positions": w(_N, "select node_id, (sign(x - 250) * floor(abs(x - 250) + 0.5))::bigint x, (sign(y - 250) * floor(abs(y - 250) + 0.5))::bigint y from n"),
        "edge_list_round_trip": w(_E, "select * from e"),
        "spec_round_trip": w(_S, "select a u, i::int u_port, b v, j::int v_port, 1000::double capacity, 'Mbps' unit from both_ways, range(1, 4) p(i), range(1, 4) q(j) where i <= case when a % 50 = 0 then 3 else 2 end and j <= case when b % 50 = 0 then 3 else 2 end"),
        "sight_file_round_trip": w(_E, ", lines as (select unnest(['Node Positions', 'Edges']) as value union all select concat_ws(chr(9), node_id, floor(x)::bigint, floor(y)::bigint) from n union all select concat_ws(chr(9), src, dst, con_type) from e) select value, count(*) n_lines from lines group by 1"),
        "stats_round_trip": w(_N, "select " + ", ".join(f"case when node_id % {k + 2} <> 0 then node_id * {k + 1} end::int {c}" if t == "int" else f"case when node_id % 3 <> 0 then floor(x) / 2 + {k} end::double {c}" for k, (c, t) in enumerate(stats.RESULT_ROW.items())) + " from n where node_id % 10 = 0"),
        "graph_store_round_trip": w(_E, """, g as (select n.node_id, k con_type, (select count(*) from ends where ends.node_id = n.node_id and ends.con_type = k) c from n, (values ('short'), ('long')) v(k))
            select con_type, count(*) n_nodes, (sum(c) / 2)::bigint n_edges, min(c) min_degree, max(c) max_degree, round(avg(c), 6) avg_degree, count(*) filter (c = 0) n_isolated from g group by 1"""),
        "map_round_trip": "with b as (select building_id, max({'a': building_lat, 'o': building_lon}) r from buildings where len(building_lat) > 2 and len(building_lat) = len(building_lon) group by 1) select building_id, len(r.a)::int n_corners, round(list_min(r.a), 7) least_lat, round(list_max(r.o), 7) most_lon from b",
        "gateway_per_component": w(_C, f"select component, node_id from (select component, node_id, row_number() over (partition by component order by (node_id * 7919 + component * 104729 + {SEED}) % 1000003, node_id) r from comp) where r = 1", "recursive "),
        "thinned_nodes": w(_THIN, "select unnest(kept).i node_id from walk where r = (select max(r) from walk)", "recursive "),
        "capped_edges": w(_CAP, "select src, dst, con_type from walk join o using (r) where taken", "recursive "),
        "sight_edges": w(_SIGHT, "select src, dst, con_type from pair anti join blocked using (src, dst)", "recursive "),
        "coarse_sight_edges": w(_COARSE, "select src, dst, con_type from kind anti join blocked using (src, dst) where near union all select src, dst, con_type from kind anti join shut using (ax, ay, bx, cy) where not near", "recursive "),
        "building_metres": _metres_sql(),
        # with endless arcs from the source to all nodes but the gateways, every cut parts just the gateways from the others
        "max_flow_value": w(_E, "select count(*) filter (con_type = 'short')::double short_flow, count(*)::double full_flow from e where (src % 50 = 0) <> (dst % 50 = 0)"),
        "flow_arcs": w(_E, "select 1.0::double capacity, 2 * (select count(*) from e where con_type = 'short') n_arcs union all select 'inf'::double, (select count(*) from n)"),
    }
