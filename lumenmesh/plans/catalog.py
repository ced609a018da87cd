"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import general, network

PARTS = [network, general]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for p in PARTS for k, f in p.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for p in PARTS for k, s in p.oracle_sql().items()}
