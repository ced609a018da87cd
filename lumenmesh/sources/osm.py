"""Map extracts in XML: nodes, ways and relations, and the building rings they make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..session import Scratch

NODE = "_id bigint, _lat double, _lon double"
_TAGS = "array<struct<_k: string, _v: string>>"
WAY = f"_id bigint, nd array<struct<_ref: bigint>>, tag {_TAGS}"
_MEMBER = "array<struct<_type: string, _role: string, _ref: bigint>>"
RELATION = f"_id bigint, member {_MEMBER}, way_id {_MEMBER}, tag {_TAGS}"


def read_map(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes (node_id, lat, lon), ways (way_id, refs, tags), relations (relation_id, outer_way, tags).

    The XML source splits large files by element; nothing is held whole. Outer members may be written
    `member` or `way_id`. The last value of a repeated tag counts.
    """
    xml = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t))
    tags = F.map_from_entries(F.transform(F.map_values(F.aggregate(empty("tag", _TAGS), F.create_map().cast("map<string,struct<k:string,v:string>>"), lambda m, t: F.map_concat(F.map_filter(m, lambda k, _: k != t["_k"]), F.create_map(t["_k"], F.struct(t["_k"].alias("k"), t["_v"].alias("v")))))), lambda e: F.struct(e["k"], e["v"])))
    nodes = xml("node", NODE).select(F.col("_id").alias("node_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon")).where("node_id is not null")
    ways = xml("way", WAY).select(F.col("_id").alias("way_id"), F.transform(empty("nd", "array<struct<_ref: bigint>>"), lambda n: n["_ref"]).alias("refs"), tags.alias("tags")).where("way_id is not null")
    members = F.filter(F.concat(empty("member", _MEMBER), empty("way_id", _MEMBER)), lambda m: m["_role"] == "outer")
    relations = xml("relation", RELATION).select(F.col("_id").alias("relation_id"), F.explode_outer(F.transform(members, lambda m: m["_ref"])).alias("outer_way"), tags.alias("tags")).where("relation_id is not null")
    return {"nodes": nodes, "ways": ways, "relations": relations}


def building_rings(parts: dict[str, DataFrame]) -> DataFrame:
    """(building_id, lat, lon): rings of ways tagged building, and of outer ways of such relations, in order.

    The repeated last corner is dropped; corners whose node is missing are left out.
    """
    built = F.map_contains_key(F.coalesce("tags", F.create_map().cast("map<string,string>")), "building")
    own = parts["ways"].where(built).select("way_id")
    outer = parts["relations"].where(built & F.col("outer_way").isNotNull()).select(F.col("outer_way").alias("way_id"))
    ids = own.union(outer).distinct()
    ring = parts["ways"].join(ids, "way_id", "left_semi").select("way_id", F.posexplode(F.slice("refs", 1, F.greatest(F.size("refs") - 1, F.lit(0)))).alias("pos", "node_id"))
    corner = ring.join(parts["nodes"], "node_id").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("c"))
    return corner.select(F.col("way_id").alias("building_id"), F.col("c.lat").alias("lat"), F.col("c.lon").alias("lon"))


def bounding_box(rings: DataFrame) -> DataFrame:
    """(min_lat, max_lat, min_lon, max_lon): one row."""
    return rings.agg(*[f(F.expr(f"{a}({c})")).alias(n) for c in ("lat", "lon") for f, a, n in ((F.min, "array_min", f"min_{c}"), (F.max, "array_max", f"max_{c}"))])


def local_metres(rings: DataFrame) -> DataFrame:
    """(building_id, ring array<struct<x, y>>): metres north and east of the lower corner, on WGS-84.

    The box is one row, so it is broadcast.
    """
    c = rings.join(F.broadcast(bounding_box(rings))).select("building_id", "min_lat", "min_lon", F.posexplode(F.arrays_zip("lat", "lon")).alias("pos", "p"))
    x = G.meridian_metres(F.col("min_lat"), F.col("p.lat"))
    y = G.parallel_metres(F.col("p.lat"), F.col("min_lon"), F.col("p.lon"))
    c = c.select("building_id", F.struct("pos", x.alias("x"), y.alias("y")).alias("q"))
    c = c.groupBy("building_id").agg(F.array_sort(F.collect_list("q")).alias("q"))
    return c.select("building_id", F.transform("q", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("ring"))


def corner_nodes(rings: DataFrame) -> DataFrame:
    """(node_id, building_id, pos, x, y): every corner is a node; ids are consecutive, in the order of building and position.

    Buildings are numbered by the corners before them: counts of ranges of buildings are summed first, so that
    no task sees more than a range.
    """
    sized = rings.where("building_id is not null and size(ring) > 0").select("building_id", "ring", F.size("ring").cast("bigint").alias("n"))
    spark = rings.sparkSession
    ranged, _ = Scratch(spark, "corners").cut(sized.repartitionByRange("building_id").sortWithinPartitions("building_id").withColumn("part", F.spark_partition_id()))
    # as many rows as ranges; windows over ranges and within each of them
    totals = ranged.groupBy("part").agg(F.sum("n").alias("n"))
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("building_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    first = ranged.withColumn("within", within).join(offsets, "part").select("building_id", (F.col("before") + F.col("within")).alias("first"), F.posexplode("ring").alias("pos", "p"))
    return first.select((F.col("first") + F.col("pos")).alias("node_id"), "building_id", "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
