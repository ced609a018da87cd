"""Point and instance sources."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import kernels


def seeded_points(spark: SparkSession, seed: int, n: int, max_x: float, max_y: float) -> DataFrame:
    """(node_id, x, y) from the Mersenne twister, for scenarios of up to some thousand nodes."""
    return spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(kernels.random_points(seed, n, max_x, max_y))], "node_id bigint, x double, y double")


def scattered_points(spark: SparkSession, seed: int, n: int, max_x: float, max_y: float) -> DataFrame:
    """(node_id, x, y) of any number of nodes, made where they are used; hashes make them the same each time."""
    unit = lambda axis: F.pmod(F.xxhash64(F.lit(seed), F.lit(axis), "id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return spark.range(n).select(F.col("id").alias("node_id"), (unit("x") * max_x).alias("x"), (unit("y") * max_y).alias("y"))


def random_program_instance(seed: int, n: int, m: int, n_sinks: int, n_targets: int, short_share: float = 0.5) -> dict:
    """A connected random graph with short edges, sinks and targets, to try the relaxed program on."""
    r = random.Random(seed)
    while True:
        edges: set[tuple[int, int]] = set()
        while len(edges) < min(m, n * (n - 1) // 2):
            u, v = r.sample(range(n), 2)
            edges.add((min(u, v), max(u, v)))
        g = kernels.graph_of(edges, range(n))
        if len(kernels.thin_components(g)) == 1:
            break
    short = [e for e in sorted(edges) if r.random() < short_share]
    return {"adj": g, "short": kernels.graph_of(short, range(n)), "sinks": sorted(r.sample(range(n), n_sinks)), "targets": [sorted(r.sample(range(n), min(n, 3))) for _ in range(n_targets)]}
