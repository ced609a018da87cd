"""Graphs kept as tables: nodes, edges and gateways side by side in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PARTS = ("nodes", "edges", "gateways")


def save_graph(path: str, nodes: DataFrame, edges: DataFrame, gateways: DataFrame, mode: str = "overwrite") -> None:
    for name, df in zip(PARTS, (nodes, edges, gateways)):
        df.write.mode(mode).parquet(f"{path}/{name}")


def load_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in PARTS}
