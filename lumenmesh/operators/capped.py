"""Edges accepted in order while both ends have room: the sequential result, in parallel rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch


def capped_edges(edges: DataFrame, caps: dict[str, int], max_edges: int | None = None) -> DataFrame:
    """(src, dst, con_type): edges taken in order of (src, dst) while each end has room for their type.

    A round ranks the undecided edges at each end. An edge whose rank at both ends is within the room
    left is safe: at most that many come before it there. Edges at a full end are dropped. The first
    undecided edge is always decided, so the rounds end with what a sequential scan gives. Ranks are
    only kept up to the cap, which is also applied before the shuffle, so a hub's edges never meet.
    max_edges keeps the first of them in order. Self-loops and rows with nulls are left out.
    """
    tmp = Scratch(edges.sparkSession, "capped")
    top = max(caps.values())
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])
    todo, path = tmp.cut(edges.select("src", "dst", "con_type").where("src is not null and dst is not null and src <> dst and con_type is not null").where(F.col("con_type").isin(*caps)).distinct())
    used, used_path = tmp.cut(todo.limit(0).select(F.col("src").alias("n"), "con_type", F.lit(0).cast("bigint").alias("used")))
    taken: list[DataFrame] = []
    w = Window.partitionBy("n", "con_type").orderBy("src", "dst")
    while not todo.isEmpty():
        ends = todo.select(F.explode(F.array("src", "dst")).alias("n"), "con_type", "src", "dst").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
        room = cap[F.col("con_type")] - F.coalesce("used", F.lit(0))
        safe = ends.join(used, ["n", "con_type"], "left").where(F.col("rank") <= room)
        now, _ = tmp.cut(safe.groupBy("src", "dst", "con_type").agg(F.count(F.lit(1)).alias("k")).where("k = 2").drop("k"))
        taken.append(now)
        spent = now.select(F.explode(F.array("src", "dst")).alias("n"), "con_type").groupBy("n", "con_type").agg(F.count(F.lit(1)).alias("used"))
        nxt_used, new_used = tmp.cut(used.union(spent.select("n", "con_type", "used")).groupBy("n", "con_type").agg(F.sum("used").alias("used")))
        full = nxt_used.where(F.col("used") >= cap[F.col("con_type")]).select("n", "con_type")
        rest = todo.join(now, ["src", "dst", "con_type"], "left_anti")
        for end in ("src", "dst"):
            rest = rest.join(full.withColumnRenamed("n", end), [end, "con_type"], "left_anti")
        nxt, new = tmp.cut(rest.select("src", "dst", "con_type"))
        tmp.drop(path)
        tmp.drop(used_path)
        todo, path, used, used_path = nxt, new, nxt_used, new_used
    out = reduce(DataFrame.union, taken) if taken else todo
    return out if max_edges is None else out.orderBy("src", "dst").limit(max_edges)
