"""Statistics rows: fixed layouts of result files."""

from __future__ import annotations

#: Columns of a result row (fixed values, in file order; the spelling `statc_` is the format's).
RESULT_ROW = {
    "number_of_nodes_in_input_graph": "int",
    "number_of_edges_in_input_graph": "int",
    "number_of_gateways": "int",
    "number_of_nodes_in_static_graph": "int",
    "number_of_nodes_in_dynamic_graph": "int",
    "number_of_fso_per_node": "int",
    "number_of_fso_per_gateway": "int",
    "percent_of_pattern_nodes": "int",
    "number_of_patterns": "int",
    "statc_upperbound_max_flow": "double",
    "total_gateway_capacity_static": "double",
    "static_avg_max_flow": "double",
    "dynamic_upperbound_max_flow": "double",
    "total_gateway_capacity_dynamic": "double",
    "dynamic_avg_max_flow": "double",
    "Static_eq_fso_per_node": "int",
    "Static_eq_fso_per_gateway": "int",
    "Static_eq_avg_max_flow": "double",
    "Static_eq_avg_upperbound_flow": "double",
}
