"""The planning operators: golden edge counts, invariants, hand-made graphs, brute force."""

import itertools
import random

import numpy as np
import pytest

from lumenmesh.functions import geometry as G
from lumenmesh.operators import capped, coverage, graph, sight
from lumenmesh.plans import kernels as K
from lumenmesh.plans import legacy, network, pipeline, relaxation
from lumenmesh.sources import config, osm, points, stats, text
from pyspark.sql import functions as F


def _nodes(spark, rows):
    return spark.createDataFrame(rows, "node_id bigint, x double, y double")


@pytest.fixture(scope="module")
def seeded_pairs():
    xy = np.array(K.random_points(101593, 1000, 500, 500))
    assert xy[0].tolist() == [7.296658221366769, 405.35402721299323]
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(axis=2)
    i, j = np.triu_indices(1000, 1)
    return [(int(a), int(b), "short" if d <= 2500 else "long") for a, b, d in zip(i, j, d2[i, j]) if d <= 1_000_000]


@pytest.mark.parametrize(("cap", "n"), [(500, 257045), (50, 39128), (5, 4914)])
def test_seeded_edge_counts(seeded_pairs, cap, n):
    assert len(K.capped_edges(seeded_pairs, {"short": cap, "long": cap}, 1_000_000)) == n


@pytest.mark.parametrize(("cap", "n_cover", "recorded"), [(50, None, 129), (5, 99, 219)])
def test_seeded_cover_and_backbone(seeded_pairs, cap, n_cover, recorded):
    """The cover is that of a clean heap with ascending ids; the recorded backbone sizes hold as a band.

    Which of several shortest paths a backbone follows depends on the order of ties: here the smallest id.
    """
    r = random.Random(101593)
    xy = [(r.uniform(0, 500), r.uniform(0, 500)) for _ in range(1000)]
    e = K.capped_edges(seeded_pairs, {"short": cap, "long": cap}, 1_000_000)
    short = K.graph_of([x[:2] for x in e if x[2] == "short"], range(1000))
    gates = K.select_gateways(short, 1000, 0.01, r)
    cover = K.greedy_cover(dict(enumerate(xy)), gates, K.Grid(5.0, 50.0, 500.0, 500.0))
    assert n_cover is None or len(cover) == n_cover
    assert abs(len(K.backbone(short, gates, cover)) - recorded) <= 0.1 * recorded


def test_seeded_gateways(seeded_pairs):
    for cap, first in ((50, [756, 231]), (5, [754, 866])):
        r = random.Random(101593)
        [r.uniform(0, 500) for _ in range(2000)]
        e = K.capped_edges(seeded_pairs, {"short": cap, "long": cap}, 1_000_000)
        short = K.graph_of([x[:2] for x in e if x[2] == "short"], range(1000))
        got = K.select_gateways(short, 1000, 0.01, r)
        assert got[:2] == first and got[2:] == [370, 172, 644, 749, 170, 800, 855, 447]


def test_legacy_edge_count():
    p = K.random_points(3194576, 500, 1000, 500)
    e = K.legacy_edges(p, 100, 1000, 150, 50, 10**9)
    assert len(e) == 19632 and sum(u == v for u, v, _ in e) == 498


def test_capped_rounds_equal_the_sequential_scan(spark):
    r = random.Random(4)
    pairs = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(250)})
    rows = [(u, v, r.choice(["short", "long"])) for u, v in pairs]
    df = spark.createDataFrame(rows + rows[:3] + [(1, 1, "short"), (None, 2, "long"), (1, 2, None)], "src bigint, dst bigint, con_type string")
    want = K.capped_edges(rows, {"short": 3, "long": 2})
    assert sorted(map(tuple, capped.capped_edges(df, {"short": 3, "long": 2}).collect())) == want
    assert capped.capped_edges(df.limit(0), {"short": 1}).count() == 0


def test_distance_pairs_nulls_ties_and_crowds(spark):
    r = np.random.default_rng(2)
    xy = r.uniform(-30, 30, (120, 2))
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(xy)]
    df = _nodes(spark, [*rows, rows[0], (500, None, 1.0), (501, float("nan"), 1.0), (None, 1.0, 1.0)])
    want = {(i, j) for i, j in itertools.combinations(range(120), 2) if ((xy[i] - xy[j]) ** 2).sum() <= 100}
    for hot in (2, 2000):
        got = [(a, b) for a, b, _ in graph.distance_pairs(df, 10.0, hot).collect()]
        assert len(got) == len(want) and set(got) == want
    assert graph.distance_pairs(df.limit(0), 1.0).count() == 0


def test_degrees_and_self_loops(spark):
    e = spark.createDataFrame([(1, 2, "short"), (2, 2, "long")], "src bigint, dst bigint, con_type string")
    n = _nodes(spark, [(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)])
    assert {tuple(r) for r in graph.degrees(e, n).collect()} == {(1, 1), (2, 3), (3, 0)}
    assert {tuple(r) for r in graph.degrees_by_type(e, n).collect()} == {(1, 1, 0), (2, 1, 2), (3, 0, 0)}


def test_components_and_bfs(spark):
    r = random.Random(9)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(20)]
    g = K.graph_of(pairs, range(100, 130))
    e = spark.createDataFrame([*pairs, (None, 5)], "src bigint, dst bigint")
    got = dict(map(tuple, graph.components(e, spark.range(100, 130).withColumnRenamed("id", "node_id")).collect()))
    assert got == {n: p[0] for p in K.thin_components(g) for n in p}
    hops = {(r["node_id"]): (r["hops"], r["parent"]) for r in graph.bfs(e, spark.createDataFrame([(3,), (None,)], "node_id bigint")).collect()}
    h, p = K.bfs_tree(g, [3])
    assert hops == {n: (h[n], p.get(n)) for n in h}


def test_path_edges_and_thinning(spark):
    p = spark.createDataFrame([([1, 2, 3],), ([3, 2],), ([7],), ([],), (None,)], "path array<bigint>")
    assert {tuple(r) for r in graph.path_edges(p).collect()} == {(1, 2), (2, 3)}
    n = _nodes(spark, [(i, float(i), 0.0) for i in range(9)])
    assert sorted(r[0] for r in graph.thinned(n, 1.5).collect()) == [0, 2, 4, 6, 8]


def test_targets(spark):
    n = _nodes(spark, [(0, 12.0, 12.0), (1, None, 1.0)])
    exact = coverage.node_targets(n, 10.0, 5.0, 50.0, 50.0)
    grid = K.Grid(5.0, 10.0, 50.0, 50.0)
    for border in (False, True):
        got = {(r["ti"], r["tj"]) for r in coverage.node_targets(n, 10.0, 5.0, 50.0, 50.0, border_only=border).collect()}
        assert got == set(grid.cells(12.0, 12.0, border))
    t = coverage.targets(spark, 50.0, 50.0, 5.0)
    assert t.count() == 121 and coverage.uncovered(t, exact).count() == 121 - exact.count()


def test_grid_ray(spark):
    ends = [(0, 0, 3, 1), (0, 0, 0, 0), (2, 2, -1, 4), (0, 0, 2, 2), (5, 1, 5, -3)]
    df = spark.createDataFrame(ends, "a bigint, b bigint, c bigint, d bigint").select("*", G.grid_ray(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("cells"))
    for r in df.collect():
        c = [(p["x"], p["y"]) for p in r["cells"]]
        assert c[0] == (r["a"], r["b"]) and c[-1] == (r["c"], r["d"])
        assert len(c) == 1 + abs(r["c"] - r["a"]) + abs(r["d"] - r["b"])
        assert all(abs(p[0] - q[0]) + abs(p[1] - q[1]) == 1 for p, q in itertools.pairwise(c))
        if (r["a"], r["b"], r["c"], r["d"]) == (0, 0, 2, 2):
            assert c[1] == (1, 0)


def test_crosses(spark):
    ring = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 10D, 'y', 0D), named_struct('x', 10D, 'y', 10D), named_struct('x', 0D, 'y', 10D))"
    cases = {(-5, 5, 15, 5): True, (2, 2, 8, 8): False, (-5, 0, 15, 0): False, (-5, -1, 15, -1): False, (5, 5, 20, 5): True, (-5, 5, 5, 15): False, (0, 0, 10, 10): False, (-5, -5, 15, 15): True, (0, 3, 0, 30): False}
    df = spark.createDataFrame([(*map(float, k),) for k in cases], "a double, b double, c double, d double").withColumn("ring", F.expr(ring))
    for r in df.select("*", G.crosses(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.col("ring")).alias("hit")).collect():
        assert r["hit"] == cases[int(r["a"]), int(r["b"]), int(r["c"]), int(r["d"])], r


def test_sight(spark):
    ring = F.expr("array(named_struct('x', 4D, 'y', -2D), named_struct('x', 6D, 'y', -2D), named_struct('x', 6D, 'y', 2D), named_struct('x', 4D, 'y', 2D))")
    b = spark.range(1).select(F.col("id").alias("building_id"), ring.alias("ring"))
    n = _nodes(spark, [(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 5.0, 6.0)])
    got = {tuple(r) for r in sight.sight_edges(n, b, 8.0, 12.0, 3.0).collect()}
    assert got == {(1, 3, "short"), (2, 3, "short")}
    assert sight.sight_edges(n, b.limit(0), 8.0, 12.0, 3.0).count() == 3
    assert {tuple(r) for r in sight.sight_edges(n, b, 8.0, 12.0, 3.0, self_pairs=True).collect()} - got == {(i, i, "short") for i in (1, 2, 3)}
    near = {tuple(r) for r in sight.coarse_sight_edges(n, b, 8.0, 12.0, 3.0, 100.0).collect()}
    assert near == got


def test_ellipsoid(spark):
    r = spark.range(1).select(G.meridian_metres(F.lit(0.0), F.lit(90.0)).alias("m"), G.parallel_metres(F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("e"), G.parallel_metres(F.lit(45.0), F.lit(10.0), F.lit(10.01)).alias("p"), G.parallel_metres(F.lit(30.0), F.lit(5.0), F.lit(5.0)).alias("z")).first()
    assert r["m"] == pytest.approx(10001965.729, abs=0.01) and r["e"] == pytest.approx(111319.491, abs=0.001)
    assert r["p"] == pytest.approx(788.468, abs=0.005) and r["z"] == 0.0


HAND = [(0, 1), (1, 2), (2, 3), (2, 4), (2, 5), (2, 6), (6, 7), (7, 8), (9, 10), (10, 11), (11, 12), (12, 13), (12, 14)]


def test_degree_reduction_by_hand():
    g = K.graph_of(HAND)
    short = K.graph_of([*HAND, (8, 12), (6, 11), (0, 12)])
    out = K.reduce_degrees(g, short, [0, 9])
    top = lambda x: max(K.degree(x, n) for n in x)
    assert set(out) == set(g) and len(K.edges_of(out)) <= len(HAND) and top(out) <= top(g)
    assert all(v in short[u] for u, v in K.edges_of(out))


def _brute_flow(g, s, t):
    """Minimum cut over all splits."""
    inner = [n for n in g if n not in (s, t)]
    best = 10**9
    for k in range(len(inner) + 1):
        for c in itertools.combinations(inner, k):
            side = {s, *c}
            best = min(best, sum(1 for u in side for v in g[u] if v not in side))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_max_flow_is_min_cut(seed):
    r = random.Random(seed)
    g = K.graph_of([r.sample(range(8), 2) for _ in range(14)], range(8))
    f = K.Flow()
    for u, v in K.edges_of(g):
        f.arc(u, v, 1.0, 1.0)
    assert (f.run(0, 7) if 0 in f.out and 7 in f.out else 0) == _brute_flow(g, 0, 7)


@pytest.fixture(scope="module")
def small():
    s = pipeline.small_scenario()
    p, adj, short, gates, _ = pipeline.synthetic_sample(s, 1)
    return s, p, adj, short, gates, pipeline.plan_network(s, adj, short, p, gates)


def test_plan_invariants(small):
    s, p, adj, short, gates, plan = small
    grid = K.Grid(s.target_spacing, s.coverage_radius, s.max_x, s.max_y)
    assert plan["cover"][: len(gates)] == gates
    reach = {c for n in p for c in grid.cells(*p[n], border_only=True)}
    assert {c for n in plan["cover"] for c in grid.cells(*p[n], border_only=True)} == reach
    tree = plan["tree"]
    assert all(v in short[u] for u, v in K.edges_of(tree)) and set(gates) <= set(tree)
    assert all(any(g in c for g in gates) for c in K.thin_components(tree))
    red = plan["reduced"]
    assert set(red) == set(tree) and max(len(v) for v in red.values()) <= max(len(v) for v in tree.values())
    dyn, sta = plan["dynamic"], plan["static"]
    assert all(dyn[n] == (adj[n] & set(dyn)) for n in dyn)
    assert all(red[n] <= sta[n] for n in red)
    assert all(K.degree(sta, n) <= (plan["per_gateway"] if n in gates else plan["per_node"]) for n in sta)
    assert all(any(c & set(g) for g in [gates]) for c in map(set, K.thin_components(short)))


def test_statistics_row(spark, small):
    s, p, adj, short, gates, plan = small
    row = pipeline.measure(s, adj, plan, gates, 7)
    assert list(row) == list(stats.RESULT_ROW)
    assert row["static_avg_max_flow"] <= min(row["statc_upperbound_max_flow"], row["total_gateway_capacity_static"]) + 1e-6
    assert row["dynamic_avg_max_flow"] <= min(row["dynamic_upperbound_max_flow"], row["total_gateway_capacity_dynamic"]) + 1e-6
    assert row["Static_eq_fso_per_node"] >= row["number_of_fso_per_node"]
    rows = pipeline.run_all(spark, [s])
    assert rows.count() == 1
    assert pipeline.master_rows(rows, config.config_frame(spark, [s])).count() == 1


def test_scenario_rows_plan_the_configs_table(spark, tmp_path):
    rows = [(7, "sparse_10_2", 11, 0.05, "0.5 Gbps", 2, 8, 80.0, 400.0, 10, 30), (8, None, 12, float("nan"), None, 3, 8, 80.0, 400.0, 50, 40), (9, "dense_10_2", 11, None, "500", 2, 8, 80.0, 400.0, 10, 30)]
    schema = "config_id bigint, experiment_name string, seed bigint, gateway_to_node_ratio double, link_capacity string, fso_per_node int, fso_per_gateway int, max_short_edge_length double, max_long_edge_length double, percent_of_pattern_nodes int, number_of_nodes int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "configs.parquet"))
    s = {r["run_id"]: r for r in pipeline.table_scenarios(spark.read.parquet(str(tmp_path / "configs.parquet"))).collect()}
    assert [s[k]["link_capacity"] for k in (7, 8, 9)] == [500.0, 1000.0, 500.0] and [s[k]["gateway_to_node_ratio"] for k in (7, 8, 9)] == [0.05, 0.01, 0.01]
    assert [s[k]["max_short_per_node"] for k in (7, 8, 9)] == [5, 500, 500] and {r["n_patterns"] for r in s.values()} == {200}
    got = {r["run_id"]: r for r in network.scenario_rows(spark, str(tmp_path)).collect()}
    assert {k: (r["sample_no"], r["number_of_nodes_in_input_graph"], r["percent_of_pattern_nodes"]) for k, r in got.items()} == {7: (1, 30, 10), 8: (1, 40, 50), 9: (1, 30, 10)}
    assert got[7]["total_gateway_capacity_dynamic"] == got[7]["number_of_fso_per_gateway"] * got[7]["number_of_gateways"] * 500.0
    assert {r["run_id"] for r in network.master_rows(spark, str(tmp_path)).collect()} == {7, 8, 9}


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """A folder with a small `embeddings` table, and its scenario graph: points, all edges, short edges, gateways."""
    r = random.Random(5)
    rows = [(i, [0.0, r.uniform(-0.45, -0.2), r.uniform(-0.45, -0.2)]) for i in range(200)]
    d = str(tmp_path_factory.mktemp("crowd"))
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    e = network.edges(spark, d).collect()
    points = {n["node_id"]: (n["x"], n["y"]) for n in network.nodes(spark, d).collect()}
    adj = K.graph_of([(x["src"], x["dst"]) for x in e], points)
    short = K.graph_of([(x["src"], x["dst"]) for x in e if x["con_type"] == "short"], points)
    return d, points, adj, short, [0, 50, 100, 150]


def test_flows_are_measured_on_the_augmented_networks(spark, crowd):
    d, points, adj, short, gates = crowd
    red = network._reduced(points, short, gates)
    pn, pg = K.port_caps(red, gates, network.PER_NODE, network.PER_GATEWAY)
    room = K.half_away_py(0.1 * len(red))
    static, dynamic = K.augment_static(adj, red, gates, pn, pg, room)[0], K.augment_dynamic(adj, red, gates, room)[0]
    how = (network.PERCENT, network.PATTERNS)
    start, goal = K.average_static_flow(static, gates, *how, network.SEED), K.average_dynamic_flow(dynamic, gates, pn, pg, *how, network.SEED + 1)
    assert len(K.edges_of(dynamic)) > len(K.edges_of(static)) > len(K.edges_of(red))
    got = {r["network"]: (r["avg_flow"], r["avg_bound"]) for r in network.average_flows(spark, d).collect()}
    for kind, want in (("static", start), ("dynamic", goal)):
        assert got[kind] == pytest.approx([v * network.CAPACITY for v in want])
    want = K.equivalent_static(static, adj, gates, pn, pg, goal[0], *how, network.SEED + 2, start)[1:]
    assert tuple(network.equivalent_static_ports(spark, d).first()) == pytest.approx((*want, goal[0]))


def test_best_path_is_the_first_that_is_augmented(spark, crowd):
    d, points, adj, short, gates = crowd
    red = network._reduced(points, short, gates)
    net = {n: adj[n] & set(red) for n in red}
    res = K.residual(net, set(gates))
    want = {}
    for u, v in itertools.permutations(sorted(net), 2):
        hops, parent = K.bfs_tree(adj, [u])
        new = sum(x not in net for x in K.path_to(parent, v)) if v in hops else 0
        flow = min(K.source_potential(res, u, set(gates)), K.sink_potential(res, v, set(gates)))
        if new and flow > 0:
            want[u, v] = flow / new
    assert {(r["src"], r["dst"]): r["benefit"] for r in network.path_benefits(spark, d).collect()} == want
    best = network.best_path(spark, d).first()
    path = K.augment_dynamic(adj, red, gates, 1)[1][0]
    assert (best["src"], best["dst"]) == (path[0], path[-1])


def test_map_scenarios_are_refused(spark):
    s = pipeline.small_scenario(graph_type="map", n_nodes=0)
    with pytest.raises(ValueError, match="'map'"):
        pipeline.synthetic_sample(s, 1)
    with pytest.raises(Exception, match="graph type 'map'"):
        pipeline.run_all(spark, [s]).collect()


def test_equivalent_dynamic_graph_respects_ports(small):
    s, p, adj, short, gates, plan = small
    nodes = sorted(set(plan["dynamic"]) - set(gates))[:6]
    eq = K.EquivalentDynamic(plan["dynamic"], gates, 2, 4, nodes)
    for n in plan["dynamic"]:
        room = 4 if n in gates else 2
        assert sum(u == n for u, _ in eq.links) <= room and sum(v == n for _, v in eq.links) <= room
    assert eq.max_flow(nodes) <= 2 * len(nodes)


def test_run_writes_all_its_files(spark, tmp_path):
    s = [pipeline.small_scenario(), pipeline.small_scenario(seed=5, n_samples=2)]
    master = {tuple(r) for r in pipeline.run_to(spark, s, str(tmp_path)).collect()}
    frame = config.config_frame(spark, s)
    assert master == {tuple(r) for r in pipeline.master_rows(pipeline.run_all(spark, s), frame).collect()} and len(master) == 2
    assert text.read_stats(spark, f"{tmp_path}/stats", stats.RESULT_ROW).count() == 3
    rows = {(r["run_id"], r["sample_no"]): r for r in pipeline.run_all(spark, s).collect()}
    for name, size in (("static_spec", "number_of_nodes_in_static_graph"), ("dynamic_spec", "number_of_nodes_in_dynamic_graph")):
        for (run, no), r in rows.items():
            parts = text.read_spec(spark, f"{tmp_path}/{name}/run_id={run}/sample_no={no}")
            assert parts["sources"].count() + parts["gateways"].count() == r[size] and parts["gateways"].count() == r["number_of_gateways"]
            ports, links = {(x["node"], x["port"]) for x in parts["ports"].collect()}, parts["links"].collect()
            assert links and {(x["u"], x["u_port"]) for x in links} | {(x["v"], x["v_port"]) for x in links} <= ports
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/graph/run_id={run}/sample_no={no}").collect()]
    assert lines.index("Nodes:") == 0 and len(lines) == 3 + r["number_of_nodes_in_input_graph"] + r["number_of_edges_in_input_graph"] + r["number_of_gateways"]


def test_earlier_variants(small):
    r = random.Random(2)
    pts = {i: (r.uniform(0, 100), r.uniform(0, 100)) for i in range(40)}
    d2 = lambda a, b: (pts[a][0] - pts[b][0]) ** 2 + (pts[a][1] - pts[b][1]) ** 2
    pairs = [(a, b) for a in pts for b in pts if a < b]
    adj, short = (K.graph_of([e for e in pairs if d2(*e) <= q * q], pts) for q in (60, 30))
    sinks = legacy.gateways(adj, 40, 0.1, 7)
    assert len(sinks) == len(set(sinks)) == 5
    grid = K.Grid(10.0, 25.0, 100.0, 100.0)
    cov = legacy.cover(pts, grid)
    cells = lambda ns: {c for n in ns for c in grid.cells(*pts[n], border_only=False)}
    assert cells(cov) == cells(pts) and all(cells(cov[: k + 1]) > cells(cov[:k]) for k in range(len(cov)))
    for stale in (False, True):
        tree = legacy.backbone(adj, sinks, cov, stale)
        assert set(cov) | set(sinks) <= set(tree) and set(K.edges_of(tree)) <= set(K.edges_of(adj))
        assert stale or set(K.bfs_tree(tree, sinks)[0]) == set(tree)
    g, top, n_max = legacy.reduce_degrees(tree, short, sinks)
    assert n_max == int(1.1 * len(g)) and top <= max(K.degree(tree, n) for n in tree if n not in sinks)
    limit = len(g) + 3
    dyn = legacy.augment_dynamic(adj, g, sinks, limit)
    assert len(g) <= len(dyn) <= limit and all(adj[n] & set(dyn) - {n} <= dyn[n] for n in dyn)
    for last in (False, True):
        net = legacy.augment_static(adj, g, sinks, limit, top + 2, last)
        assert len(net) <= limit and all(g[n] <= net[n] for n in g)
        assert last or all(K.degree(net, n) <= max(top + 2, K.degree(g, n) if n in g else 0) for n in net)
    flow, bound = legacy.average_flow(dyn, sinks, 0.1, 5, 3)
    assert flow == K.max_flow(dyn, sinks) and legacy.average_flow(dyn, sinks, 0.1, 5, 3, from_pattern=True)[0] <= flow
    grown, cap, reached = legacy.raise_degrees(net, adj, sinks, reached_goal := legacy.average_flow(net, sinks, 0.1, 5, 3, True)[0] + 1, 0.1, 5, 3)
    assert all(net[n] <= grown[n] for n in net) and (reached >= reached_goal or cap > 0)
    assert legacy.raise_degrees(net, adj, sinks, 0.0, 0.1, 5, 3)[0] == net


def test_wide_program_bounds_the_flow_too():
    i = points.random_program_instance(3, 8, 14, 2, 3, short_share=1.0)
    narrow, wide = (relaxation.placement_program(i["adj"], i["short"], i["sinks"], i["targets"], 8, 8, wide=w).certify() for w in (False, True))
    assert min(narrow.bound, wide.bound) >= K.max_flow(i["adj"], i["sinks"]) - 1e-9
    assert narrow.converged and wide.converged and wide.bound >= narrow.bound - 1e-2


def test_relaxed_program_bounds_the_flow():
    i = points.random_program_instance(3, 8, 14, 2, 3, short_share=1.0)
    prog = relaxation.placement_program(i["adj"], i["short"], i["sinks"], i["targets"], 8, 8)
    value, x = prog.solve(rounds=6000)
    assert value >= K.max_flow(i["adj"], i["sinks"]) * 0.98 - 0.1
    assert (x >= -1e-6).all()


def test_relaxed_bound_is_certified():
    """maximise x + y, x + 2y <= 4, 3x + y <= 6, both at most 10: 2.8 at (1.6, 1.2)."""
    p = relaxation.Program()
    x, y = p.var("x", high=10.0), p.var("y", high=10.0)
    p.row([(x, 1.0), (y, 2.0)], 4.0)
    p.row([(x, 3.0), (y, 1.0)], 6.0)
    p.goal = {x: 1.0, y: 1.0}
    s = p.certify(tolerance=1e-6)
    assert s.converged and s.bound >= 2.8 - 1e-9 and s.bound == pytest.approx(2.8, abs=1e-4) and s.x == pytest.approx([1.6, 1.2], abs=1e-3)
    early = p.certify(rounds=3, tolerance=1e-9)
    assert not early.converged and early.bound >= 2.8 - 1e-9
    with pytest.raises(ArithmeticError):
        p.solve(rounds=3, tolerance=1e-9)
    for seed in range(4):
        i = points.random_program_instance(seed, 8, 14, 2, 3, short_share=1.0)
        s = relaxation.placement_program(i["adj"], i["short"], i["sinks"], i["targets"], 8, 8).certify()
        assert s.converged and s.bound >= K.max_flow(i["adj"], i["sinks"]) - 1e-6


def test_relaxed_bound_is_over_the_whole_graph(crowd, monkeypatch):
    """Runs the query's kernel on a corner of the scenario; all nodes and edges are in the program, and n_max binds."""
    _, points, adj, short, _ = crowd
    near = sorted(points, key=lambda n: points[n])[:40]
    adj, short = ({n: g[n] & set(near) for n in near} for g in (adj, short))
    gates = [n for n in near if adj[n]][:2]
    monkeypatch.setattr(network, "_scenario", lambda spark, d, run, schema: list(run(0, {n: points[n] for n in near}, adj, short, gates)))
    (n_vars, _, loose, _, _), = network.relaxed_bound(None, None)
    (_, _, tight, _, _), = network.relaxed_bound(None, None, 1)
    n, m = len(near), len(K.edges_of(adj))
    assert n_vars == 5 * n + 6 * m
    assert tight < loose
    red = network._reduced({n: points[n] for n in near}, short, gates)
    dyn = K.augment_dynamic(adj, red, gates, K.half_away_py(0.1 * len(red)))[0]
    assert loose >= K.max_flow(dyn, gates) - 1e-6


def test_spec_counts_and_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(1, 2), (2, 3)], "src bigint, dst bigint")
    n = _nodes(spark, [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 2.0, 0.0), (4, 9.0, 9.0)])
    g = spark.createDataFrame([(3,)], "node_id bigint")
    p = text.ports(n, g, 4, 4)
    links = text.dynamic_links(e, p)
    assert p.count() == 16 and links.count() == 2 * 4 * 4 * 2
    text.write_lines(text.spec_lines(n.join(g, "node_id", "left_anti"), p, links, g, 1000.0).coalesce(1), str(tmp_path / "spec"))
    back = text.read_spec(spark, str(tmp_path / "spec"))
    assert back["links"].count() == 64 and back["ports"].count() == 16 and back["sources"].count() == 3
    assert back["gateways"].first()["node"] == 3 and {r["unit"] for r in back["links"].collect()} == {"Mbps"}
    s = text.static_links(e)
    assert {tuple(r) for r in s.collect()} == {(1, 1, 2, 1), (2, 1, 1, 1), (2, 2, 3, 1), (3, 1, 2, 2)}


def test_spec_is_read_in_parts(spark, tmp_path):
    f = tmp_path / "spec.txt"
    f.write_text("trafficSources:\n" + "".join(f"{k}\n" for k in range(300)) + "FSOLinks:\r\n" + "".join(f"{k}_fso1To{k + 1}_fso2 10Mbps\r\n" for k in range(300)) + "gateways:\n7\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    parts = text.read_spec(spark, str(f))
    assert spark.read.text(str(f)).select("_metadata.file_block_start").distinct().count() > 5
    got = {k: v.count() for k, v in parts.items()}
    links = {(r["u"], r["v"], r["unit"]) for r in parts["links"].collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {"sources": 300, "ports": 0, "links": 300, "gateways": 1} and links == {(k, k + 1, "Mbps") for k in range(300)}


def test_text_files(spark, tmp_path):
    n = _nodes(spark, [(1, 0.5, 0.0), (2, 3.0, 0.0)])
    e = spark.createDataFrame([(1, 2)], "src bigint, dst bigint")
    text.write_edges(e, str(tmp_path / "e"))
    back = text.read_edges(spark, str(tmp_path / "e"))
    assert [tuple(r) for r in text.edges_with_type(back, n, 2.0, 9.0).collect()] == [(1, 2, "long")]
    lines = [r[0] for r in text.graph_lines(n, back.withColumn("con_type", F.lit("long")), spark.createDataFrame([(2,)], "node_id bigint")).collect()]
    assert lines == ["Nodes:", "1 0.5 0.0", "2 3.0 0.0", "Edges:", "1 2 long", "Gateways:", "2"]
    assert text.los_lines(n, back.withColumn("con_type", F.lit("long"))).collect()[1][0] == "1\t0.5\t0.0"
    rows = spark.createDataFrame([(1, 2.5), (None, None)], "a int, b double")
    text.append_stats(rows, str(tmp_path / "s"))
    text.append_stats(rows, str(tmp_path / "s"))
    assert text.read_stats(spark, str(tmp_path / "s"), {"a": "int", "b": "double"}).where("b is null").count() == 2


def test_config(spark, tmp_path):
    f = tmp_path / "c.txt"
    f.write_text("[global]\n" + "".join(f"{k}: {'synthetic' if k == 'graphType' else 'x' if 'file' in k or 'folder' in k or 'name' in k else '2'}\n" for k in config.GLOBAL) + "# note\n[synthetic]\n" + "".join(f"{k}: 3\n" for k in config.SYNTHETIC) + "no_of_runs: 10\n")
    s = config.read_config(str(f))
    assert s.n_nodes == 3 and s.max_x == 3.0 and s.experiment_name == "x"
    assert config.config_frame(spark, [s]).first()["pattern_percent"] == 2
    f.write_text("[global]\nseed: 1\n")
    with pytest.raises(KeyError):
        config.read_config(str(f))


def test_map_extract(spark, tmp_path):
    f = tmp_path / "m.osm"
    f.write_text(
        "<osm>" + "".join(f'<node id="{i}" lat="{47 + a}" lon="{8 + b}"/>' for i, (a, b) in enumerate([(0, 0), (0.001, 0), (0.001, 0.001), (0, 0.001)], 1))
        + '<way id="10"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="building" v="yes"/></way><way id="11"><nd ref="1"/><nd ref="4"/></way>'
        + '<way id="12"><nd ref="4"/><nd ref="3"/><nd ref="2"/><nd ref="4"/></way><way id="13"><nd ref="2"/><nd ref="3"/><nd ref="4"/><nd ref="2"/></way>'
        + '<relation id="20"><way_id role="outer" ref="12"/><tag k="building" v="yes"/></relation><relation id="21"><member type="way" role="outer" ref="13"/><tag k="building" v="no"/></relation></osm>'
    )
    rings = osm.building_rings(osm.read_map(spark, str(f)))
    assert {r["building_id"]: len(r["lat"]) for r in rings.collect()} == {10: 3, 12: 3, 13: 3}
    m = {r["building_id"]: r["ring"] for r in osm.local_metres(rings).collect()}
    assert m[10][1]["x"] == pytest.approx(111.18, abs=0.05) and m[10][2]["y"] == pytest.approx(76.05, abs=0.05)
    assert osm.corner_nodes(osm.local_metres(rings)).count() == 9


def test_point_sources(spark):
    assert points.seeded_points(spark, 101593, 3, 500, 500).first()["x"] == 7.296658221366769
    p = points.scattered_points(spark, 1, 500, 10, 20)
    assert p.where("x < 0 or x >= 10 or y < 0 or y >= 20").count() == 0 and p.select("x").distinct().count() == 500
