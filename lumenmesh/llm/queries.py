"""Queries of the llm problems, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import sql
from .components import connected_groups, group_sizes
from .leakage import leaked
from .lookalike import look_alike_pairs, look_classes
from .packing import bin_fill, pack, token_counts


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "graph_edges").where("con_type is null or con_type <> 'non_edge'")
    return connected_groups(links.select("src", "dst"), "src", "dst", table(spark, d, "graph_gateways").select("node_id"))


def p3_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return group_sizes(p3_found(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(table(spark, d, "documents")))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return bin_fill(p7_containers(spark, d)).groupBy(F.col("unused") == 0).agg(F.count(F.lit(1)).alias("n_bins"), F.sum("n_tokens").alias("n_tokens"), F.sum("unused").alias("unused")).withColumnRenamed("(unused = 0)", "is_full")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Which items leaked, into how many documents."""
    found = leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_runs").alias("most_places"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(table(spark, d, "documents"))


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return look_classes(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(f)}


P3_SQL = """
with recursive links as (
  select distinct src a, dst b from graph_edges where src is not null and dst is not null and con_type is distinct from 'non_edge'
), step as (select a, b from links union select b, a from links),
v as (select a node_id from step union select node_id from graph_gateways where node_id is not null),
walk(node_id, group_id) using key (node_id) as (
  select node_id, node_id from v
  union (
    select b, min(w.group_id) from walk w join step on step.a = w.node_id join recurring.walk o on o.node_id = b
    where w.group_id < o.group_id group by 1
  )
)
"""


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql() | {
        "p3_found": P3_SQL + "select node_id, group_id from walk",
        "p3_group_sizes": P3_SQL + "select group_id, count(*) n_nodes from walk group by 1",
    }
