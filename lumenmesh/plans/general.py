"""Queries of the general data problems p1, p2, p4, p5 and p6."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, nested, orphans, proximity, quantities
from ..session import Scratch, table
from ..sources import stats
from . import general_sql


def _elements(spark: SparkSession, d: str, keep: list[str], columns: list[str] | None = None, everything: bool = False) -> DataFrame:
    return nested.shred(table(spark, d, "osm_extracts"), keep=keep, columns=columns, everything=everything)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.links(_elements(spark, d, ["extract_id"], ["schema_path", "pos", "key", "parent_key"]))


def p1_unread(spark: SparkSession, d: str) -> DataFrame:
    """What no flat table holds: unknown schema paths, and payloads that can't be parsed."""
    return nested.unread(_elements(spark, d, ["extract_id"], ["schema_path", "error"], everything=True))


def p1_elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements of all extracts with their Dewey labels as text, for each record that was delivered."""
    e = _elements(spark, d, ["extract_id"]).where("error is null")
    dotted = F.array_join(F.col("label").cast("array<string>"), ".")
    above = F.array_join(F.slice("label", 1, F.size("label") - 1).cast("array<string>"), ".")
    return e.select("extract_id", dotted.alias("label"), above.alias("parent_label"), "schema_path", "pos", "key", "value").distinct()


def p1_path_counts(spark: SparkSession, d: str) -> DataFrame:
    return p1_elements(spark, d).groupBy("schema_path").agg(F.count(F.lit(1)).alias("n_rows"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    nodes, _ = Scratch(spark, "places").cut(proximity.known_points(table(spark, d, "nodes")))
    near = proximity.near_known(nodes, 5.0)
    rings = proximity.local_rings(table(spark, d, "buildings"), table(spark, d, "map_areas"))
    inside = proximity.containing_known(nodes, rings).select(F.col("region").alias("id_1"), F.col("id").alias("id_2"))
    return near.select(F.lit("near").alias("match_kind"), "*").unionByName(inside.select(F.lit("inside").alias("match_kind"), "*"))


def p2_cover_cells(spark: SparkSession, d: str) -> DataFrame:
    rings = proximity.local_rings(table(spark, d, "buildings"), table(spark, d, "map_areas"))
    rings = rings.select("building_id", "area_id", "xs", "ys").dropDuplicates()
    return proximity.polygon_cells(rings, "building_id", "area_id", "xs", "ys").groupBy("level", "interior").agg(F.count(F.lit(1)).alias("n_cells"))


def p4_capacities(spark: SparkSession, d: str) -> DataFrame:
    """Every record in 1000 bit/s, with where its unit was found, or why it has no value.

    Of a record delivered several times the newest row counts, at a tie the greater capacity; so it does of notes.
    """
    none = F.lit(None).cast("string")
    configs, links = table(spark, d, "configs"), table(spark, d, "fso_links")
    # the line names its transceivers before the capacity; links that have a unit need no note
    said = F.regexp_extract("link_line", r"(?s)^\s*\S+\s+(.*)$", 1)
    links = links.select("link_id", "capacity", "unit", said.alias("said"), "spec_id", "loaded_at")
    notes = configs.select(F.col("config_id").alias("spec_id"), "spec_note", "written_at").where("spec_note is not null").groupBy("spec_id").agg(F.max(F.struct("written_at", "spec_note")).alias("n")).select("spec_id", "n.spec_note")
    a = quantities.to_common_unit(configs, F.lit(None), none, F.col("link_capacity"), none, "Mbps", "kbps")
    b = quantities.to_common_unit(links.join(notes, "spec_id", "left"), F.col("capacity"), F.col("unit"), F.col("said"), F.col("spec_note"), "Mbps", "kbps")
    of = lambda df, name, key, t: df.select(F.lit(name).alias("record_table"), F.col(key).alias("record_id"), F.col(t).alias("t"), F.col("q.result").alias("capacity_kbps"), F.col("q.default_unit").alias("is_mbps"), F.col("q.unit_from").alias("unit_from"), F.col("q.status").alias("status"))
    out = of(a, "configs", "config_id", "written_at").unionByName(of(b, "fso_links", "link_id", "loaded_at")).where("record_id is not null")
    return out.groupBy("record_table", "record_id").agg(F.max(F.struct("t", "capacity_kbps", "is_mbps", "unit_from", "status")).alias("m")).select("record_table", "record_id", "m.capacity_kbps", "m.is_mbps", "m.unit_from", "m.status")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_capacities(spark, d).where("not is_mbps and capacity_kbps is not null").select("record_table", "record_id", "capacity_kbps")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(drift.timeline(table(spark, d, "stat_files")))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    """All rows of all files: the known result columns, and two approved fields replayed from the rescue column."""
    rows = drift.ingest(table(spark, d, "stat_files"), stats.RESULT_ROW)
    return drift.promote(rows, {"run_seconds": "double", "remark": "string"})


def _references_and_parents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What refers to what, and what there is; payloads are parsed once."""
    e = _elements(spark, d, ["captured_at"], ["kind", "key", "parent_kind", "parent_key"]).where("kind = 'way' or parent_kind in ('way', 'relation') and kind in ('nd', 'member')")
    e, _ = Scratch(spark, "elements").cut(e.select("captured_at", "kind", "key", F.col("parent_key").try_cast("bigint").alias("parent_key")))
    table_of = F.when(F.col("kind") == "nd", "way_nd").otherwise("relation_member")
    inner = e.where("kind <> 'way'").select(table_of.alias("ref_table"), F.col("parent_key").alias("ref_id"), F.col("key").alias("ref_key"), F.col("captured_at").alias("t"))
    port = lambda n, p: F.concat(F.col("spec_id").cast("string"), F.lit(":"), F.col(n).cast("string"), F.lit("_fso"), F.col(p).cast("string"))
    ends = F.explode(F.array(port("u", "u_port"), port("v", "v_port")))
    outer = table(spark, d, "fso_links").select(F.lit("fso_links").alias("ref_table"), F.col("link_id").alias("ref_id"), ends.alias("ref_key"), F.col("loaded_at").alias("t"))
    nodes = table(spark, d, "osm_nodes").select(F.lit("way_nd").alias("ref_table"), F.col("osm_node_id").cast("string").alias("ref_key"), F.col("loaded_at").alias("t"), F.col("node_version").cast("bigint").alias("version"), F.col("visible").alias("alive"))
    ways = e.where("kind = 'way'").select(F.lit("relation_member").alias("ref_table"), F.col("key").alias("ref_key"), F.col("captured_at").alias("t"), F.lit(1).cast("bigint").alias("version"), F.lit(True).alias("alive"))
    ports = table(spark, d, "fso_nodes").select(F.lit("fso_links").alias("ref_table"), port("node", "port").alias("ref_key"), "loaded_at", "retired_at")
    event = lambda t, version, alive: F.struct(t.alias("t"), F.lit(version).cast("bigint").alias("version"), F.lit(alive).alias("alive"))
    # a transceiver can only be retired once it is there
    stays = F.array(event(F.col("loaded_at"), 1, True))
    goes = F.array(event(F.col("loaded_at"), 1, True), event(F.greatest("loaded_at", "retired_at"), 2, False))
    turns = ports.select("ref_table", "ref_key", F.inline(F.when(F.col("retired_at").isNull(), stays).otherwise(goes)))
    return inner.unionByName(outer), nodes.unionByName(ways).unionByName(turns)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.orphans(*_references_and_parents(spark, d))
    # transceivers are keyed within their spec; the report names them as the links do
    return found.withColumn("ref_key", F.element_at(F.split("ref_key", ":"), -1))


def p6_pending(spark: SparkSession, d: str) -> DataFrame:
    return orphans.pending_counts(*_references_and_parents(spark, d))


def p6_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    return p6_found(spark, d).groupBy("ref_table", "ref_month", "cause").agg(F.count(F.lit(1)).alias("n_orphans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(f)}


P4_SQL = r"""
with notes as (
  select config_id spec_id, max(case
    when spec_note like '%megabytes per second%' or spec_note like '%MB/s%' then 8000
    when lower(spec_note) like '%gbps%' or lower(spec_note) like '%gbit/s%' or lower(spec_note) like '%gigabit per second%' then 1000000
    when lower(spec_note) like '%kbps%' or lower(spec_note) like '%kbit/s%' then 1
    when lower(spec_note) like '%mbps%' or lower(spec_note) like '%mbit/s%' or lower(spec_note) like '%megabit per second%' then 1000 end) note_kbps
  from configs group by 1
), texts as (
  select 'configs' record_table, config_id record_id, null::double num, null unit, link_capacity said, null::bigint note_kbps from configs
  union all
  select 'fso_links', link_id, capacity, unit, trim(regexp_extract(link_line, '^\S+\s+(.*)$', 1)), note_kbps
  from fso_links left join notes using (spec_id)
), parts as (
  select distinct record_table, record_id, note_kbps,
    coalesce(num::decimal(30,8), try_cast(try_cast(replace(regexp_extract(said, '[0-9][0-9,.]*(?:e[0-9]+)?'), ',', '') as double) as decimal(30,8))) num,
    coalesce(unit, nullif(regexp_extract(said, '[0-9][0-9,.]*(?:e[0-9]+)?\s*([A-DF-Za-df-z][A-Za-z]*(?:/[A-Za-z]+)?)', 1), '')) unit, unit is not null in_column
  from texts
), scaled as (
  select *, case when unit is null then null else
      (case when regexp_matches(unit, '(?i)byte') or regexp_matches(unit, 'B(ps|/s)') then 8 else 1 end)
      * (case when regexp_matches(unit, '^.i') and not regexp_matches(unit, '(?i)^(bit|kilo|giga|mib?it)') then 1.048576 else 1 end)
      * (case lower(unit[1]) when 'k' then 1000 when 'm' then 1000000 when 'g' then 1000000000 when 't' then 1000000000000 else 1 end) / 1000 end kbps
  from parts
), final as (
  select record_table, record_id, num, coalesce(kbps::decimal(30,8), note_kbps, 1000) kbps,
    case when unit is not null then (case when in_column then 'column' else 'text' end) when note_kbps is not null then 'note' else 'default' end unit_from from scaled
), records as (
  select record_table, record_id, max(((num * 1000000)::hugeint * (kbps * 1000000)::hugeint + 500000000000::hugeint) // 1000000000000::hugeint)::bigint capacity_kbps,
    bool_or(kbps = 1000) is_mbps, max(unit_from) unit_from, case when max(num) is null then 'no number' else 'ok' end status from final group by 1, 2
)
"""

P2_SQL = """
with n as (
  select distinct node_id, area_id, node_x x, node_y y, round(node_x * 100)::bigint cx, round(node_y * 100)::bigint cy from nodes
  where not isnan(node_x) and not isnan(node_y) and node_x <> -9999 and node_y <> -9999
), near as (
  select a.node_id id_1, b.node_id id_2 from (select *, unnest([-1, 0, 1]) i from (select *, floor(cx / 500) gx, floor(cy / 500) gy from n)) a
  join (select *, floor(cx / 500) gx, floor(cy / 500) gy from n) b
  on a.area_id = b.area_id and b.gx = a.gx + i and b.gy between a.gy - 1 and a.gy + 1 and a.node_id < b.node_id
  where (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= 250000
), closed as (
  select distinct building_id, area_id, min_lat, min_lon, case when building_lat[1] = building_lat[-1] and building_lon[1] = building_lon[-1] then building_lat[:-2] else building_lat end la,
    case when building_lat[1] = building_lat[-1] and building_lon[1] = building_lon[-1] then building_lon[:-2] else building_lon end lo
  from buildings join map_areas using (area_id) where len(building_lat) > 2
), corner as (
  select building_id, area_id, unnest(range(1, len(la) + 1)) k, len(la) m, [(v - min_lat) * 111320 for v in la] xs, [(v - min_lon) * 111320 * cos(radians(min_lat)) for v in lo] ys from closed where len(la) > 2
), side as (
  select building_id, area_id, xs[k] x1, ys[k] y1, xs[k % m + 1] x2, ys[k % m + 1] y2, list_min(xs) lx, list_max(xs) hx, list_min(ys) ly, list_max(ys) hy from corner
), inside as (
  select building_id id_1, node_id id_2 from side join n on side.area_id = n.area_id and x between lx and hx and y between ly and hy
  group by 1, 2 having count(*) filter ((y1 > y) <> (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1
)
select 'near' match_kind, id_1, id_2 from near union all select 'inside', id_1, id_2 from inside
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": general_sql.P1_FOUND,
        "p1_path_counts": general_sql.P1_PATHS,
        "p2_cover_cells": general_sql.P2_CELLS,
        "p5_found": general_sql.P5_FOUND,
        "p6_found": general_sql.P6 + "select * from found",
        "p6_orphans_by_month": general_sql.P6 + "select ref_table, ref_month, cause, count(*) n_orphans from found group by 1, 2, 3",
        "p6_pending": general_sql.P6_PENDING,
        "p2_found": P2_SQL,
        "p4_found": P4_SQL + "select record_table, record_id, capacity_kbps from records where not is_mbps and capacity_kbps is not null",
        "p4_capacities": P4_SQL + "select * from records",
    }
