"""Scenario configuration: INI files and one-row DataFrames."""

from __future__ import annotations

import configparser
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession

#: Option names of the file (fixed values) and what they are called here.
GLOBAL = {
    "graphType": "graph_type",
    "seed": "seed",
    "experiment_name": "experiment_name",
    "gateway_to_node_ratio": "gateway_to_node_ratio",
    "link_capacity": "link_capacity",
    "fso_per_node": "fso_per_node",
    "fso_per_gateway": "fso_per_gateway",
    "target_spacing": "target_spacing",
    "coverage_radius": "coverage_radius",
    "max_short_edge_length": "max_short_edge_length",
    "max_long_edge_length": "max_long_edge_length",
    "output_statistics_file": "output_statistics_file",
    "graph_output_folder": "graph_output_folder",
    "ratio_of_max_added_nodes_in_step_4": "extra_node_ratio",
    "percent_of_pattern_nodes_in_avg_flow_calculation": "pattern_percent",
    "number_of_pattern_in_avg_flow_calculation": "n_patterns",
}
SYNTHETIC = {
    "no_of_samples": "n_samples",
    "number_of_nodes": "n_nodes",
    "max_short_edge_per_node": "max_short_per_node",
    "max_long_edge_per_node": "max_long_per_node",
    "max_no_of_edges": "max_edges",
    "max_x_coord": "max_x",
    "max_y_coord": "max_y",
}


@dataclass(frozen=True)
class Scenario:
    graph_type: str
    seed: int
    experiment_name: str
    gateway_to_node_ratio: float
    link_capacity: float
    fso_per_node: int
    fso_per_gateway: int
    target_spacing: float
    coverage_radius: float
    max_short_edge_length: float
    max_long_edge_length: float
    output_statistics_file: str
    graph_output_folder: str
    extra_node_ratio: float
    pattern_percent: int
    n_patterns: int
    n_samples: int = 1
    n_nodes: int = 0
    max_short_per_node: int = 0
    max_long_per_node: int = 0
    max_edges: int = 0
    max_x: float = 0.0
    max_y: float = 0.0


def read_config(path: str) -> Scenario:
    """Reads a scenario; no option has a default, and unknown ones are ignored. A missing one raises KeyError."""
    c = configparser.ConfigParser(interpolation=None, strict=False)
    c.optionxform = str
    with open(path, encoding="utf-8") as f:
        c.read_file(f)
    types = {f.name: {"int": int, "float": float, "str": str}[f.type] for f in fields(Scenario)}
    out = {ours: types[ours](c["global"][name]) for name, ours in GLOBAL.items()}
    if out["graph_type"] == "synthetic":
        out |= {ours: types[ours](c["synthetic"][name]) for name, ours in SYNTHETIC.items()}
    return Scenario(**out)


def config_frame(spark: SparkSession, scenarios: list[Scenario]) -> DataFrame:
    """One row for each scenario, with run_id."""
    ddl = {"int": "bigint", "float": "double", "str": "string"}
    schema = "run_id bigint, " + ", ".join(f"{f.name} {ddl[f.type]}" for f in fields(Scenario))
    return spark.createDataFrame([(k, *asdict(s).values()) for k, s in enumerate(scenarios)], schema)
