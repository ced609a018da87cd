"""Whole scenarios: points to statistics rows. Scenarios and samples run in parallel, one Arrow group each."""

from __future__ import annotations

import random
from dataclasses import fields, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import half_away_py
from ..operators import quantities
from ..session import Scratch
from ..sources import text
from ..sources.config import Scenario, config_frame
from ..sources.stats import RESULT_ROW
from . import kernels as K

ROW_SCHEMA = "run_id bigint, sample_no int, " + ", ".join(f"{c} {t}" for c, t in RESULT_ROW.items())


def plan_network(s: Scenario, adj: K.Graph, short: K.Graph, points: dict, gateways: list[int], fix_gateway_cap: bool = False) -> dict:
    """Cover, backbone, reduced backbone, dynamic and static network of one sample."""
    grid = K.Grid(s.target_spacing, s.coverage_radius, s.max_x, s.max_y)
    cover = K.greedy_cover(points, gateways, grid)
    tree = K.backbone(short, gateways, cover)
    reduced = K.reduce_degrees(tree, short, gateways)
    room = half_away_py(s.extra_node_ratio * len(reduced))
    dynamic, dynamic_paths = K.augment_dynamic(adj, reduced, gateways, room)
    per_node, per_gateway = K.port_caps(reduced, gateways, s.fso_per_node, s.fso_per_gateway, fix_gateway_cap)
    static, static_paths = K.augment_static(adj, reduced, gateways, per_node, per_gateway, room)
    return {"cover": cover, "tree": tree, "reduced": reduced, "dynamic": dynamic, "static": static, "per_node": per_node, "per_gateway": per_gateway, "dynamic_paths": dynamic_paths, "static_paths": static_paths}


def measure(s: Scenario, adj: K.Graph, plan: dict, gateways: list[int], seed: int) -> dict:
    """The statistics row of one sample."""
    c, percent, n = s.link_capacity, s.pattern_percent, s.n_patterns
    static, dynamic, pn, pg = plan["static"], plan["dynamic"], plan["per_node"], plan["per_gateway"]
    avg, bound = K.average_static_flow(static, gateways, percent, n, seed)
    davg, dbound = K.average_dynamic_flow(dynamic, gateways, pn, pg, percent, n, seed + 1)
    _, epn, epg, eavg, ebound = K.equivalent_static(static, adj, gateways, pn, pg, davg, percent, n, seed + 2, (avg, bound))
    values = (
        len(adj), len(K.edges_of(adj)), len(gateways), len(static), len(dynamic), pn, pg, percent, n,
        bound * c, float(sum(K.degree(static, g) for g in gateways)) * c, avg * c,
        dbound * c, float(pg * len(gateways)) * c, davg * c, epn, epg, eavg * c, ebound * c,
    )
    return dict(zip(RESULT_ROW, values))


def synthetic_sample(s: Scenario, sample_no: int) -> tuple[dict, K.Graph, K.Graph, list[int], random.Random]:
    """Points, graphs and gateways of a sample; the first one is fixed by the seed alone."""
    if s.graph_type != "synthetic":
        raise ValueError(f"scenarios of graph type {s.graph_type!r} can't be planned, only synthetic ones")
    r = random.Random(s.seed if sample_no == 1 else f"{s.seed}:{sample_no}")
    xy = [(r.uniform(0, s.max_x), r.uniform(0, s.max_y)) for _ in range(s.n_nodes)]
    pairs = []
    for u, (a, b) in enumerate(xy):
        for v in range(u + 1, len(xy)):
            d2 = (a - xy[v][0]) ** 2 + (b - xy[v][1]) ** 2
            if d2 <= s.max_short_edge_length**2:
                pairs.append((u, v, "short"))
            elif d2 <= s.max_long_edge_length**2:
                pairs.append((u, v, "long"))
    edges = K.capped_edges(pairs, {"short": s.max_short_per_node, "long": s.max_long_per_node}, s.max_edges)
    adj = K.graph_of([e[:2] for e in edges], range(s.n_nodes))
    short = K.graph_of([e[:2] for e in edges if e[2] == "short"], range(s.n_nodes))
    gateways = K.select_gateways(short, s.n_nodes, s.gateway_to_node_ratio, r)
    return dict(enumerate(xy)), adj, short, gateways, r


#: What all recorded scenarios share; it stands in where a row of `configs` has no value.
RECORDED = Scenario("synthetic", 101593, "", 0.01, 1000.0, 2, 10, 5.0, 50.0, 50.0, 1000.0, "", "", 0.1, 10, 200, 1, 1000, 500, 500, 1_000_000, 500.0, 500.0)
#: Edges per node of each type that the first words of an experiment's name stand for.
CAPS = {"dense": 500, "med_dense": 50, "sparse": 5}


def table_scenarios(configs: DataFrame) -> DataFrame:
    """Scenarios of a `configs` table, laid out as `config_frame` does, run_id being config_id.

    Capacities are brought to Mbps. The caps on edges per node come from the experiment's name; without a
    known one they are those of dense graphs, the loosest recorded. All else the table lacks is as recorded.
    """
    q = quantities.to_common_unit(configs, F.lit(None), F.lit(None).cast("string"), F.col("link_capacity"), F.lit(None).cast("string"), "Mbps", "bps")
    cap = F.lit(None).cast("bigint")
    for name, n in CAPS.items():
        cap = F.when(F.col("experiment_name").startswith(f"{name}_"), n).otherwise(cap)
    known = {
        "seed": "seed", "experiment_name": "experiment_name", "gateway_to_node_ratio": "gateway_to_node_ratio", "fso_per_node": "fso_per_node", "fso_per_gateway": "fso_per_gateway",
        "max_short_edge_length": "max_short_edge_length", "max_long_edge_length": "max_long_edge_length", "pattern_percent": "percent_of_pattern_nodes", "n_nodes": "number_of_nodes",
    }
    given = {ours: F.col(theirs) for ours, theirs in known.items()} | {"gateway_to_node_ratio": F.nanvl("gateway_to_node_ratio", F.lit(None).cast("double")), "link_capacity": F.col("q.result") / 1e6, "max_short_per_node": cap, "max_long_per_node": cap}
    kind = {"int": "bigint", "float": "double", "str": "string"}
    columns = [F.coalesce(given.get(f.name, F.lit(None)), F.lit(getattr(RECORDED, f.name))).cast(kind[f.type]).alias(f.name) for f in fields(Scenario)]
    return q.select(F.col("config_id").alias("run_id"), *columns).distinct()


LINES = "run_id bigint, sample_no int, file string, no bigint, value string"


def _sample(r: pd.Series) -> tuple[Scenario, int, dict, K.Graph, K.Graph, list[int], dict]:
    s = Scenario(**{n: r[n].item() if hasattr(r[n], "item") else r[n] for n in Scenario.__dataclass_fields__})
    k = int(r["sample_no"])
    points, adj, short, gateways, _ = synthetic_sample(s, k)
    return s, k, points, adj, short, gateways, plan_network(s, adj, short, points, gateways)


def _samples(spark, scenarios: list[Scenario] | DataFrame):
    """One group for each sample of each scenario, a task of its own as far as hashing keeps them apart."""
    frame = scenarios if isinstance(scenarios, DataFrame) else config_frame(spark, scenarios)
    samples = frame.withColumn("sample_no", F.explode(F.sequence(F.lit(1), F.col("n_samples").cast("int"))))
    return samples.repartition(min(max(1, samples.count()), 10_000), "run_id", "sample_no").groupBy("run_id", "sample_no")


def run_all(spark, scenarios: list[Scenario] | DataFrame) -> DataFrame:
    """Statistics rows of all samples of all scenarios: (run_id, sample_no, *RESULT_ROW).

    scenarios: a list, or a table as `config_frame` lays it out.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in g.iterrows():
            s, k, _, adj, _, gateways, plan = _sample(r)
            rows.append({"run_id": r["run_id"], "sample_no": k} | measure(s, adj, plan, gateways, s.seed + 1000 * k))
        return pd.DataFrame(rows)

    return _samples(spark, scenarios).applyInPandas(one, ROW_SCHEMA)


def _spec(net: K.Graph, gateways: list[int], ports: list[tuple[int, int]], links: list[tuple[int, int, int, int]], capacity: float) -> list[str]:
    gates = set(gateways)
    lines = ["trafficSources:", *(str(n) for n in sorted(net) if n not in gates), "FSONodes:", *(f"{n}_fso{i}" for n, i in ports)]
    return [*lines, "FSOLinks:", *(f"{u}_fso{i}To{v}_fso{j} {capacity:g}Mbps" for u, i, v, j in links), "gateways:", *map(str, sorted(gates))]


def sample_lines(s: Scenario, k: int, points: dict, adj: K.Graph, short: K.Graph, gateways: list[int], plan: dict) -> dict[str, list[str]]:
    """The files of a sample by name: statistics row, input graph, static and dynamic specification."""
    row = measure(s, adj, plan, gateways, s.seed + 1000 * k)
    graph = ["Nodes:", *(f"{n} {x} {y}" for n, (x, y) in sorted(points.items())), "Edges:", *(f"{u} {v} {'short' if v in short.get(u, ()) else 'long'}" for u, v in K.edges_of(adj)), "Gateways:", *map(str, gateways)]
    static, dynamic, gates = plan["static"], plan["dynamic"], set(gateways)
    used: dict[int, int] = {}
    links = []
    for u, v in K.edges_of(static):
        if u != v:
            used[u], used[v] = used.get(u, 0) + 1, used.get(v, 0) + 1
            links += [(u, used[u], v, used[v]), (v, used[v], u, used[u])]
    ports = [(n, i) for n in sorted(static) for i in range(1, used.get(n, 0) + 1)]
    cap = lambda n: plan["per_gateway"] if n in gates else plan["per_node"]
    free = [(n, i) for n in sorted(dynamic) for i in range(1, cap(n) + 1)]
    every = [(a, i, b, j) for u, v in K.edges_of(dynamic) if u != v for a, b in ((u, v), (v, u)) for i in range(1, cap(a) + 1) for j in range(1, cap(b) + 1)]
    return {"stats": [",".join("N/A" if row[c] is None else str(row[c]) for c in RESULT_ROW)], "graph": graph, "static_spec": _spec(static, gateways, ports, links, s.link_capacity), "dynamic_spec": _spec(dynamic, gateways, free, every, s.link_capacity)}


def run_to(spark, scenarios: list[Scenario] | DataFrame, folder: str) -> DataFrame:
    """Plans all samples and writes their files below a folder; returns the rows of the master file.

    stats/: one row for each sample, appended; master/: one for each scenario; graph/, static_spec/ and
    dynamic_spec/: a folder for each run and sample. Samples are planned once: their lines are a table from
    which all files are written.
    """

    def one(g: pd.DataFrame) -> pd.DataFrame:
        rows = [(r["run_id"], k, f, n, v) for _, r in g.iterrows() for s, k, *rest in [_sample(r)] for f, lines in sample_lines(s, k, *rest).items() for n, v in enumerate(lines)]
        return pd.DataFrame(rows, columns=["run_id", "sample_no", "file", "no", "value"])

    frame = scenarios if isinstance(scenarios, DataFrame) else config_frame(spark, scenarios)
    lines, _ = Scratch(spark, "lines").cut(_samples(spark, frame).applyInPandas(one, LINES))
    layout = ", ".join(f"{c} {t}" for c, t in RESULT_ROW.items())
    rows = lines.where("file = 'stats'").select("run_id", "sample_no", F.from_csv("value", layout, {"nullValue": "N/A"}).alias("r")).select("run_id", "sample_no", "r.*")
    text.append_stats(rows.select(*RESULT_ROW), f"{folder}/stats")
    for name in ("graph", "static_spec", "dynamic_spec"):
        some = lines.where(F.col("file") == name).repartition("run_id", "sample_no").sortWithinPartitions("run_id", "sample_no", "no")
        some.select("run_id", "sample_no", "value").write.mode("overwrite").partitionBy("run_id", "sample_no").text(f"{folder}/{name}")
    master = master_rows(rows, frame)
    master.write.mode("overwrite").option("header", True).csv(f"{folder}/master")
    return master


def master_rows(rows: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One averaged row for each scenario; flows count at most what the gateways carry."""
    keys = ["run_id", "fso_per_node", "max_short_per_node", "max_long_per_node", "pattern_percent"]
    s = rows.join(scenarios.select(*keys), "run_id")
    return s.groupBy(*keys).agg(
        F.avg("static_avg_max_flow").alias("avg_static_flow"),
        F.avg(F.least("statc_upperbound_max_flow", "total_gateway_capacity_static")).alias("avg_static_bound"),
        F.avg("dynamic_avg_max_flow").alias("avg_dynamic_flow"),
        F.avg(F.least("dynamic_upperbound_max_flow", "total_gateway_capacity_dynamic")).alias("avg_dynamic_bound"),
        F.avg("Static_eq_fso_per_node").alias("avg_static_ports"),
    )


def small_scenario(**changes) -> Scenario:
    """A scenario of a few dozen nodes, for trials."""
    base = Scenario("synthetic", 101593, "small", 0.05, 1000.0, 2, 4, 25.0, 60.0, 60.0, 150.0, "", "", 0.1, 25, 5, 1, 60, 20, 20, 100000, 200.0, 200.0)
    return replace(base, **changes)
