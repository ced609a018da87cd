"""The general data operators against brute force and on awkward input."""

from datetime import datetime, timedelta
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenmesh.functions import units
from lumenmesh.operators import drift, nested, orphans, proximity, quantities
from lumenmesh.session import hot_keys
from pyspark.sql import functions as F

XML = """<?xml version="1.0" encoding="UTF-8"?><osm><!-- <nd> --><bounds a="1"/><way id='1'><nd ref="10"/><tag k="name" v="A &amp; B"/><nd ref="11"></nd></way>
<relation id="5"><way_id ref="2" role="outer"><way id="2"><nd ref="12"/><tag k="building" v="yes"/></way></way_id><member ref="1"/><tag k="type" v="site"/></relation></osm>"""
JSON = '{"osm": {"way": {"id": "3", "nd": [13, {"ref": 14}, "15"], "tag": {"a": "b"}, "meta": {"x": []}}, "relation": [{"id": 6, "member": {"way": {"id": 4, "nd": null, "tag": []}}, "tag": {"k": "q", "v": 1}}, null]}}'


def test_labels_and_parents():
    rows = nested.label_record(XML, "xml")
    by_label = {tuple(r["label"]): r for r in rows}
    for r in rows:
        above = by_label.get(tuple(r["label"][:-1]))
        assert (above["key"] if above else None) == r["parent_key"]
        assert r["schema_path"] == (f"{above['schema_path']}/" if above else "") + r["kind"]
    assert [(r["parent_key"], r["pos"], r["key"]) for r in rows if r["kind"] == "nd"] == [("1", 1, "10"), ("1", 2, "11"), ("2", 1, "12")]
    assert [(r["pos"], r["key"]) for r in rows if r["kind"] == "member"] == [(1, "2"), (2, "1")]


def test_json_layouts_and_bad_payloads():
    rows = nested.label_record(JSON, "json")
    assert [r["key"] for r in rows if r["kind"] == "nd"] == ["13", "14", "15"]
    assert [(r["parent_key"], r["key"]) for r in rows if r["kind"] == "tag"] == [("3", "a"), ("6", "q")]
    assert [r["key"] for r in rows if r["kind"] == "member"] == ["4"]
    assert nested.label_record(None, "xml") == [] and nested.label_record("  ", "json") == []
    assert list(nested.label_record("<osm><way>", "xml")[0]) == ["error"] and "error" in nested.label_record("{", "json")[0]
    assert nested.label_record("[1, 2]", "json") == [] and nested.label_record("﻿" + XML, None)
    deep = "[" * 100_000
    assert "error" in nested.label_record('{"way":' + deep, "json")[0]


def test_labels_count_all_children_and_unknown_paths_are_listed(spark):
    wrapped = "<osm><create><way id='4'><nd ref='1'/></way></create><way id='5'><bounds/><nd ref='2'/></way></osm>"
    rows = nested.label_record(wrapped, "xml")
    assert [(r["label"], r["schema_path"], r["key"]) for r in rows] == [((2,), "way", "5"), ((2, 2), "way/nd", "2")]
    every = {r["schema_path"]: r for r in nested.label_record(wrapped, "xml", everything=True)}
    assert set(every) == {"create", "create/way", "create/way/nd", "way", "way/bounds", "way/nd"} and every["create/way/nd"]["label"] == (1, 1, 1)
    odd = '{"elements": [{"type": "way", "nodes": [1]}, {"type": "node"}], "way": {"id": 1}}'
    df = spark.createDataFrame([(1, wrapped, "xml"), (2, odd, "json"), (2, odd, "json"), (3, "{", "json")], "extract_id bigint, payload string, payload_kind string")
    lost = {(r["schema_path"], r["error"] is not None): (r["n_rows"], r["n_records"]) for r in nested.unread(nested.shred(df, everything=True)).collect()}
    assert lost == {("create", False): (1, 1), ("create/way", False): (1, 1), ("create/way/nd", False): (1, 1), ("way/bounds", False): (1, 1), ("elements", False): (4, 1), ("elements/nodes", False): (2, 1), (None, True): (1, 1)}


def test_links_repeated_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, XML, "xml", 9), (1, XML, "xml", 9), (2, JSON, "json", 9), (3, None, None, 9), (4, "{", "json", 9)], "extract_id bigint, payload string, payload_kind string, key int")
    rows = {tuple(r) for r in nested.links(nested.shred(df)).collect()}
    assert ("extract", 1, "way", 1, "1") in rows and ("extract", 1, "way", 2, "2") not in rows
    assert ("way", 2, "tag", 0, "building") in rows and ("relation", 5, "member", 1, "2") in rows
    assert nested.links(nested.shred(df)).count() == len(rows)
    assert nested.links(nested.shred(df.limit(0))).count() == 0
    t = nested.tables_by_path(nested.shred(df))
    assert t["relation/member/way/nd"].select("key").distinct().collect()[0][0] == "12"
    assert t["way/nd"].where("parent_label <> slice(label, 1, 1)").count() == 0


def test_near_pairs_exact_distance_and_unknowns(spark):
    rows = [(1, 1, 0.0, 0.0), (2, 1, 3.0, 4.0), (3, 1, 3.01, 4.0), (4, 2, 0.0, 0.0), (5, 1, float("nan"), 0.0), (6, 1, None, 0.0), (7, 1, -9999.0, 0.0), (1, 1, 0.0, 0.0), (8, None, 0.0, 0.0), (9, 1, 0.0, 0.0), (None, 1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "node_id bigint, area_id bigint, node_x double, node_y double").withColumn("salt", F.lit("x"))
    want = [(1, 2), (1, 9), (2, 3), (2, 9)]
    assert sorted(map(tuple, proximity.near_pairs(df, 5.0).collect())) == want
    assert sorted(map(tuple, proximity.near_pairs(df, 5.0, hot_rows=1).collect())) == want
    assert proximity.near_pairs(df.limit(0), 5.0).count() == 0


def test_near_pairs_in_a_crowd(spark):
    r = np.random.default_rng(3)
    xy = np.round(r.uniform(-12, 12, (300, 2)), 2)
    df = spark.createDataFrame([(i, 1, float(a), float(b)) for i, (a, b) in enumerate(xy)], "node_id bigint, area_id bigint, node_x double, node_y double")
    c = np.round(xy * 100).astype(int)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if ((c[i] - c[j]) ** 2).sum() <= 250_000}
    got = [tuple(x) for x in proximity.near_pairs(df, 5.0, hot_rows=5).collect()]
    assert len(got) == len(want) and set(got) == want


def test_cover_splits_interior_from_boundary():
    p = proximity.corners([0, 60, 60, 30, 30, 0, 0], [0, 0, 60, 60, 30, 30, 0])
    r = np.random.default_rng(1)
    pts = r.uniform(-10, 70, (3000, 2))
    truth = proximity.contains(p, pts[:, 0], pts[:, 1])
    cells = {(s, int(a), int(b)): bool(i) for s, cx, cy, inner in proximity.cover(p) for a, b, i in zip(cx, cy, inner)}
    sizes = {s for s, _, _ in cells}
    for (x, y), inside in zip(pts, truth):
        hit = [cells[k] for s in sizes if (k := (s, int(x // s), int(y // s))) in cells]
        assert len(hit) <= 1 and (bool(hit) or not inside) and (not (hit and hit[0]) or inside)
    assert any(cells.values()) and len({s for s, _, _ in cells}) > 1


def test_cover_of_any_extent(spark):
    """A round region of 1,000 km has no more cells than one of 1 km; all points agree with the plain rule."""
    r = np.random.default_rng(2)
    turn = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    sizes, rows, pts = {}, [], []
    for k, radius in enumerate((15.0, 500.0, 500_000.0, 1e18)):
        ring = radius * np.stack((np.cos(turn) * 1.1, np.sin(turn) * (1 + 0.3 * np.sin(5 * turn))), axis=1)
        sizes[radius] = sum(len(cx) for _, cx, _, _ in proximity.cover(ring))
        rows.append((k, 1, ring[:, 0].tolist(), ring[:, 1].tolist()))
        pts.append(r.uniform(-1.4, 1.4, (200, 2)) * radius)
    assert sizes[500_000.0] < 10_000 and sizes[1e18] < 10_000
    pts = np.concatenate(pts)
    reg = spark.createDataFrame(rows, "building_id bigint, area_id bigint, xs array<double>, ys array<double>")
    df = spark.createDataFrame([(i, 1, float(a), float(b)) for i, (a, b) in enumerate(pts)], "node_id bigint, area_id bigint, node_x double, node_y double")
    want = {(k, i) for k, _, xs, ys in rows for i in np.flatnonzero(proximity.contains(np.array([xs, ys]).T, pts[:, 0], pts[:, 1])).tolist()}
    assert {tuple(x) for x in proximity.containing_regions(df, reg).collect()} == want


def test_containing_keeps_equal_rings_of_two_areas_and_far_places(spark):
    ring = ([0.0, 10.0, 10.0, 0.0], [0.0, 0.0, 10.0, 10.0])
    away = ([2e15, 2e15 + 16, 2e15 + 16, 2e15], [0.0, 0.0, 16.0, 16.0])
    reg = spark.createDataFrame([(1, 1, *ring), (1, 2, *ring), (2, 1, *away)], "building_id bigint, area_id bigint, xs array<double>, ys array<double>")
    pts = spark.createDataFrame([(1, 1, 5.0, 5.0), (2, 2, 5.0, 5.0), (3, 1, 2e15 + 8, 8.0), (4, 1, 2e15 + 9, 9.0), (5, 1, 1e300, 0.0), (6, 1, float("inf"), 0.0), (7, 1, 1e300, 0.0), (8, 1, 1e300, 6.0)], "node_id bigint, area_id bigint, node_x double, node_y double")
    assert sorted(map(tuple, proximity.containing_regions(pts, reg).collect())) == [(1, 1), (1, 2), (2, 3), (2, 4)]
    assert sorted(map(tuple, proximity.near_pairs(pts, 5.0).collect())) == [(3, 4), (5, 7)]


def test_containing_regions(spark):
    regions = [(1, 1, [0.0, 10.0, 10.0, 0.0], [0.0, 0.0, 10.0, 10.0]), (1, 1, [0.0, 10.0, 10.0, 0.0], [0.0, 0.0, 10.0, 10.0]), (2, 1, None, None), (3, 1, [], []), (4, 1, [0.0, 1.0], [0.0, 1.0]), (5, 1, [0.0, 9.0, 0.0], [0.0, 0.0, 0.0]), (6, 1, [0.0, None, 3.0], [0.0, 1.0, 2.0]), (7, 1, [0.0, 300.0, 300.0, 0.0, 0.0], [0.0, 0.0, 300.0, 300.0, 0.0]), (8, 2, [0.0, 10.0, 10.0], [0.0, 0.0, 10.0]), (9, 1, [1.0, 2.0, 3.0], [1.0])]
    reg = spark.createDataFrame(regions, "building_id bigint, area_id bigint, xs array<double>, ys array<double>")
    pts = spark.createDataFrame([(1, 1, 5.0, 5.0), (2, 1, 150.0, 20.0), (3, 1, -1.0, 5.0), (4, 2, 9.0, 5.0), (5, 1, None, 1.0)], "node_id bigint, area_id bigint, node_x double, node_y double")
    want = [(1, 1), (7, 1), (7, 2), (8, 4)]
    assert sorted(map(tuple, proximity.containing_regions(pts, reg).collect())) == want
    assert sorted(map(tuple, proximity.containing_regions(pts, reg, hot_rows=1).collect())) == want
    assert proximity.containing_regions(pts.limit(0), reg).count() == 0 and proximity.containing_regions(pts, reg.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "kbps"),
    [("10 Gbps", 10_000_000), ("1.25GB/s", 10_000_000), ("2 MiB/s", 16_777), ("(155,520 kbit/s)", 155_520), ("about 622080e3 bps", 622_080), ("12500 kilobytes/s", 100_000), ("1 MBIT/S", 1000), ("3 megabyte per second", 24_000), ("2,5 Mbps", 2_500), ("0.0005 kbps", 0), ("1500 b/s", 2), ("1 Kibit/s", 1), ("5 B/s", 0), ("0.04 Tbps per link", 40_000_000)],
)
def test_capacity_texts(text, kbps):
    n, u = units.parse_quantity(text)
    assert u.dims == units.RATE and units.half_up(units.convert(n, u) / 1000) == kbps


@pytest.mark.parametrize(
    ("text", "kbps"),
    [("10 000 Mbps", 10_000_000), ("10\u202f000,5 kbps", 10_001), ("1'000\u00a0Mbps", 1_000_000), ("1.000,5 Mbps", 1_000_500), ("1.000.000 kbps", 1_000_000), ("10G", 10_000_000), ("2 gigabits a second", 2_000_000), ("100Mbit", 100_000), ("3 megabytes each second", 24_000), ("2 Gbit per second", 2_000_000), ("1.000 Mbps", 1_000), ("port 3: 40 Mbps", 40_000)],
)
def test_more_spellings(text, kbps):
    n, u, unread = units.read_quantity(text)
    assert not unread and u.dims == units.RATE and units.half_up(units.convert(n, u) / 1000) == kbps


@pytest.mark.parametrize("text", ["10 0000 Mbps", "12 furlongs/s", "5foo", "1,00,00 Mbps", "7 kilobauds"])
def test_what_cannot_be_read_is_told(text):
    assert units.read_quantity(text)[2] and units.parse_quantity(text) is None


def test_units_in_long_texts_take_linear_time():
    note = "no unit here " * 100_000
    assert units.find_unit(note + "Gbit/s").scale == 10**9 and units.find_unit(note) is None
    assert units.read_unit("Gbit") == (units.find_unit("Gbps"), False) and units.read_unit("parsec") == (None, True) and units.read_unit("N/A") == (None, False)
    assert units.read_quantity("1000 per link")[1:] == (None, False) and units.read_quantity("x" * 10**6) == (None, None, False)


def test_units_of_other_dimensions():
    n, u = units.parse_quantity("20 °C", (0, 0, 0, 0, 1))
    assert units.convert(n, u) == Fraction(29315, 100)
    n, u = units.parse_quantity("speed 36 km/h", (0, -1, 1, 0, 0))
    assert units.convert(n, u) == 10
    n, u = units.parse_quantity("9.81 m/s^2", (0, -2, 1, 0, 0))
    assert units.convert(n, u) == Fraction(981, 100)
    assert units.find_unit("written by the nightly run") is None and units.find_unit(None) is None
    assert units.find_unit("#unit=kbps").scale == 1000 and units.find_unit("counts megabytes per second").scale == 8_000_000


@given(st.integers(0, 10**9), st.sampled_from(["", "k", "M", "G", "T"]), st.sampled_from(["bps", "bit/s", "b/s", "Bps", "B/s", "Byte/s"]))
@settings(max_examples=150, deadline=None)
def test_units_round_trip(n, prefix, unit):
    said, u = units.parse_quantity(f"{n:,} {prefix}{unit}")
    assert said == Decimal(n)
    assert u.scale == 1000 ** " kMGT".index(prefix or " ") * (8 if "B" in unit else 1)


def test_common_unit_sources_and_nulls(spark):
    rows = [(1, 10.0, "Gbps", "9 Mbps", None), (2, 2.0, None, "2 MB/s", None), (3, 3.0, None, "3.0", "unit is Gbit/s"), (4, None, None, None, "x"), (5, float("nan"), None, "7", None), (6, None, "Mbps", "", ""), (7, 5.0, None, None, None), (8, 1e300, "Gbps", None, None)]
    df = spark.createDataFrame(rows, "id int, n double, u string, t string, note string")
    q = quantities.to_common_unit(df, F.col("n"), F.col("u"), F.col("t"), F.col("note"), "Mbps", "kbps")
    got = {r["id"]: (r["q"]["result"], r["q"]["default_unit"], r["q"]["unit_from"]) for r in q.collect()}
    assert got == {1: (10_000_000, False, "column"), 2: (16_000, False, "text"), 3: (3_000_000, False, "note"), 4: (None, True, "default"), 5: (7_000, True, "default"), 6: (None, True, "column"), 7: (5_000, True, "default"), 8: (None, False, "column")}
    assert quantities.to_common_unit(df.limit(0), F.col("n"), F.col("u"), F.col("t"), F.col("note"), "Mbps", "kbps").count() == 0


def test_header_and_rows():
    assert drift.header_names('﻿ "a" ; b;"c d";', ";") == ["a", "b", "c d"]
    assert drift.header_names(None, ",") is None and drift.header_names("  ", ",") is None
    assert drift.header_names("a,a,b", ",") == ["a", "a#2", "b"]
    assert drift.rows_of('1,"x, y",3,\r\n\r\n4,,6', ",", 3) == [["1", "x, y", "3"], ["4", "", "6"]]
    assert drift.rows_of(None, ",", 2) == []
    assert [drift.value_type(v) for v in (["1", "-2", "NA"], ["1", "2.5e3"], ["1", "~3"], ["", "nan"], [])] == ["INT", "DOUBLE", "STRING", None, None]


def test_reconcile_places():
    assert drift.reconcile(["a", "b", "c"], ["a", "x", "c"]) == ({"x": "b"}, [], [])
    assert drift.reconcile(["a", "b", "c"], ["c", "b", "a"]) == ({}, [], [])
    assert drift.reconcile(["a", "b", "c"], ["x", "a", "c"]) == ({}, ["x"], ["b"])
    assert drift.reconcile(["a", "b", "c"], ["a", "c", "d", "e"]) == ({}, ["d", "e"], ["b"])


FILE = "file_id bigint, series_id bigint, file_seq int, delim string, stat_header string, body string, loaded_at timestamp"


def _files(n_files: int, seed: int):
    r = np.random.default_rng(seed)
    t = datetime(2024, 1, 1)
    rows, fresh = [], 0
    for s in range(3):
        names = ["a", "b", "c", "d"]
        for q in range(1, n_files + 1):
            for _ in range(r.integers(0, 3)):
                i, kind = int(r.integers(0, len(names))), r.integers(0, 4)
                fresh += 1
                if kind == 0:
                    names[i] = f"n{fresh}"
                elif kind == 1:
                    names.insert(i, f"n{fresh}")
                elif kind == 2 and len(names) > 2:
                    names.pop(i)
                else:
                    names[0], names[i] = names[i], names[0]
            body = "\n".join(",".join(r.choice(["1", "2.5", "x", "", "NA", "7", "8"], p=[0.4, 0.08, 0.02, 0.1, 0.1, 0.2, 0.1]) for _ in names) for _ in range(r.integers(0, 3)))
            rows.append((1000 * s + q, s, q, ",", None if r.random() < 0.3 else ",".join(names), body, t))
    return rows + rows[:2]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_blocks_equal_a_walk_through_the_series(spark, seed):
    rows = _files(12, seed)
    want = set()
    for s in range(3):
        schema = drift.Schema()
        for f, _, _, d, h, b, _ in sorted({r for r in rows if r[1] == s}, key=lambda r: r[2]):
            names = drift.header_names(h, d)
            body = drift.rows_of(b, d, len(names) if names else None)
            types = [drift.value_type([x[i] for x in body if i < len(x)]) for i in range(max(map(len, body), default=0))]
            schema, changes = drift.take(schema, names, types)
            want |= {(f, *c) for c in changes}
    df = spark.createDataFrame(rows, FILE)
    for block in (1, 3, 256):
        assert {tuple(r) for r in drift.changes(drift.timeline(df, least_block=block)).collect()} == want


def test_ingest_rescues_and_promotes(spark):
    t = datetime(2024, 1, 1)
    rows = [(1, 1, 1, ",", "a,b", "1,2\n3,x", t), (2, 1, 2, ",", "a,bb,extra", "5,6,7.5\n", t), (3, 1, 3, ",", None, "8,9,10,11", t), (3, 1, 3, ",", None, "8,9,10,12", t + timedelta(1)), (4, 2, 1, ",", None, "1", t), (5, None, 1, ",", "a", "1", t), (6, 1, 4, ",", "a", None, t)]
    files = spark.createDataFrame(rows, FILE)
    got = drift.ingest(files, {"a": "int", "b": "int"})
    by = {(r["file_id"], r["row_no"]): (r["a"], r["b"], r["_rescued"]) for r in got.collect()}
    assert by == {(1, 1): (1, 2, None), (1, 2): (3, None, '{"b":"x"}'), (2, 1): (5, 6, '{"extra":"7.5"}'), (3, 1): (8, 9, '{"extra":"10","field_4":"12"}'), (4, 1): (None, None, '{"field_1":"1"}'), (5, 1): (1, None, None)}
    more = drift.promote(got, {"extra": "double", "b": "string"})
    by = {(r["file_id"], r["row_no"]): (r["b"], r["extra"], r["_rescued"]) for r in more.collect()}
    assert by == {(1, 1): ("2", None, None), (1, 2): ("x", None, None), (2, 1): ("6", 7.5, None), (3, 1): ("9", 10.0, '{"field_4":"12"}'), (4, 1): (None, None, '{"field_1":"1"}'), (5, 1): (None, None, None)}
    assert drift.changes(drift.timeline(files.limit(0))).count() == 0


REF = "ref_table string, ref_id bigint, ref_key string, t timestamp, top int"
PAR = "ref_table string, ref_key string, t timestamp, version bigint, alive boolean, salt int"


def _brute(refs, parents):
    out = set()
    for tab, i, k, t, _ in refs:
        if k is None or t is None:
            continue
        mine = [p for p in parents if p[0] == tab and p[1] == k and p[2] is not None]
        seen = [(p[3], p[4] is not False) for p in mine if p[2] <= t]
        cause = "missing" if not mine else "late" if not seen else "deleted" if not max(seen)[1] else None
        if cause:
            out.add((tab, i, k, cause, t.strftime("%Y-%m")))
    return out


@pytest.mark.parametrize("hot", [1, 100_000])
def test_orphans_against_brute_force(spark, hot):
    r = np.random.default_rng(5)
    day = lambda: datetime(2024, 1, 1) + timedelta(days=int(r.integers(0, 120)))
    refs = [("t", int(r.integers(0, 50)), f"k{r.integers(0, 12)}" if r.random() > 0.4 else "k0", day(), 1) for _ in range(200)] + [("t", 1, None, day(), 1), ("t", 2, "k1", None, 1), ("u", 3, "k1", day(), 1)]
    parents = [("t", f"k{r.integers(0, 9)}", day(), int(r.integers(1, 6)), [True, False, None][r.integers(0, 3)], 1) for _ in range(60)] + [("t", None, day(), 1, True, 1)]
    parents += parents[:3]
    a, b = spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR)
    for batches in (1, 4):  # kept from batch to batch, or taken in at once
        assert {tuple(x) for x in orphans.orphans(a, b, hot_rows=hot, batches=batches).collect()} == _brute(refs, parents)
    got = [tuple(x) for x in orphans.orphans(a, b, hot_rows=hot).collect()]
    # versions that repeat with different states keep the one that is alive
    assert len(got) == len(set(got)) and set(got) == _brute(refs, parents)
    assert {x[3] for x in map(tuple, orphans.orphans(a, b.limit(0)).collect())} == {"missing"}
    assert orphans.orphans(a.limit(0), b).count() == 0


def test_pending_counts_follow_arrivals_and_deletions(spark):
    d = lambda m: datetime(2024, m, 5)
    refs = spark.createDataFrame([("t", 1, "a", d(1), 0), ("t", 2, "a", d(1), 0), ("t", 3, "b", d(2), 0)], REF)
    parents = spark.createDataFrame([("t", "a", d(3), 1, True, 0), ("t", "a", d(5), 2, False, 0), ("t", "a", d(6), 3, True, 0)], PAR)
    got = {r["period"]: (r["n_new"], r["n_changed"], r["n_pending"]) for r in orphans.pending_counts(refs, parents).collect()}
    assert got == {"2024-01": (2, 2, 2), "2024-02": (1, 1, 3), "2024-03": (0, -2, 1), "2024-05": (0, 2, 3), "2024-06": (0, -2, 1)}


def test_hot_keys_have_a_bound(spark):
    df = spark.range(1000).select((F.col("id") % 100).alias("k"))
    assert hot_keys(df, ["k"], 5, max_hot=10).count() <= 10
    assert hot_keys(df, ["k"], 5).count() == 100
