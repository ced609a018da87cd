"""SQL of the general data problems whose operators read nested records, covers and references."""

from __future__ import annotations

_LIST = "case when {0} is null or json_type({0}) = 'NULL' then [] when json_type({0}) = 'ARRAY' then {0}::json[] else [{0}] end"


def _list(v: str) -> str:
    """The items of a JSON value that may be a list, a single item or nothing."""
    return f"list_filter({_LIST.format(v)}, lambda x: x is not null and json_type(x) <> 'NULL')"


def _attr(name: str) -> str:
    """An attribute of a start tag, in either kind of quotes, unescaped."""
    raw = f"case when regexp_matches(tok, '\\s{name}\\s*=') then regexp_extract(tok, '\\s{name}\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)'')', 1) || regexp_extract(tok, '\\s{name}\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)'')', 2) end"
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&amp;", "&")):
        raw = f"replace({raw}, '{entity}', '{sign}')"
    return raw


#: Elements of all payloads, one row for each delivery: rid, extract_id, captured_at, path, kind, pos, key, parent_kind, parent_key.
#: XML is cut into tags whose depth is counted, JSON is opened level by level.
NODES = rf"""
doc as (select row_number() over () rid, extract_id, captured_at, payload_kind, payload from osm_extracts where payload is not null),
cut as (select rid, unnest(t) tok, generate_subscripts(t, 1) i from (select rid, regexp_extract_all(regexp_replace(payload, '<!--.*?-->', '', 'gs'), '<(?:[^>"'']|"[^"]*"|''[^'']*'')*>') t from doc where payload_kind = 'xml')),
mark as (select *, regexp_extract(tok, '^</?([\w:.-]+)', 1) as name, tok like '</%' closes, tok like '%/>' alone from cut where tok not like '<?%' and tok not like '<!%'),
deep as (select *, sum(case when closes then -1 when alone then 0 else 1 end) over (partition by rid order by i) + alone::int depth from mark),
open as (select rid, i, tok, name, depth, max(case when depth = 2 then i end) over w p2, max(case when depth = 3 then i end) over w p3, max(case when depth = 4 then i end) over w p4 from deep where not closes window w as (partition by rid order by i)),
x2 as (select rid, i, name as kind, {_attr("id")} as key from open where depth = 2 and name in ('way', 'relation')),
x3 as (select o.rid, o.i, p.i up, p.kind pk, p.key pkey, case when o.name = 'way_id' then 'member' else o.name end as kind, case when o.name = 'tag' then {_attr("k")} else {_attr("ref")} end as key
  from open o join x2 p on p.rid = o.rid and p.i = o.p2 where depth = 3 and ((p.kind = 'way' and o.name in ('nd', 'tag')) or (p.kind = 'relation' and o.name in ('member', 'way_id', 'tag')))),
x4 as (select o.rid, o.i, p.i up, {_attr("id")} as key from open o join x3 p on p.rid = o.rid and p.i = o.p3 where depth = 4 and o.name = 'way' and p.kind = 'member'),
x5 as (select o.rid, o.i, p.i up, p.key pkey, o.name as kind, case when o.name = 'tag' then {_attr("k")} else {_attr("ref")} end as key from open o join x4 p on p.rid = o.rid and p.i = o.p4 where depth = 5 and o.name in ('nd', 'tag')),
xml as (
  select rid, kind path, kind, row_number() over (partition by rid, kind order by i) pos, key, 'extract' parent_kind, null::varchar parent_key from x2
  union all select rid, pk || '/' || kind, kind, row_number() over (partition by rid, up, kind order by i), case when kind = 'member' then coalesce(key, (select min_by(x4.key, x4.i) from x4 where x4.rid = x3.rid and x4.up = x3.i)) else key end, pk, pkey from x3
  union all select rid, 'relation/member/way', 'way', row_number() over (partition by rid, up order by i), key, 'member', null from x4
  union all select rid, 'relation/member/way/' || kind, kind, row_number() over (partition by rid, up, kind order by i), key, 'way', pkey from x5
),
root as (select rid, case when json_type(payload::json -> 'osm') = 'OBJECT' then payload::json -> 'osm' else payload::json end j from doc where payload_kind = 'json' and json_valid(payload)),
jt as (select rid, 'way' as kind, unnest({_list("(j -> 'way')")}) v, generate_subscripts({_list("(j -> 'way')")}, 1) pos from root union all select rid, 'relation', unnest({_list("(j -> 'relation')")}), generate_subscripts({_list("(j -> 'relation')")}, 1) from root),
j1 as (select rid, kind, pos, v, case when json_type(v) = 'OBJECT' then v ->> 'id' else v ->> '$' end as key from jt),
jm as (select rid, key pkey, pos up, unnest(m) v, generate_subscripts(m, 1) pos from (select *, list_concat({_list("(v -> 'member')")}, {_list("(v -> 'way_id')")}) m from j1 where kind = 'relation')),
jw as (select rid, up, pos mpos, unnest({_list("(v -> 'way')")}) v, generate_subscripts({_list("(v -> 'way')")}, 1) pos from jm),
jways as (select rid, 'way' path, key, v from j1 where kind = 'way' union all select rid, 'relation/member/way', case when json_type(v) = 'OBJECT' then v ->> 'id' else v ->> '$' end, v from jw),
jn as (select rid, path, key pkey, unnest({_list("(v -> 'nd')")}) v, generate_subscripts({_list("(v -> 'nd')")}, 1) pos from jways),
jtag as (select rid, path, kind, pkey, case when json_type(t) = 'OBJECT' and not json_exists(t, '$.k') then json_keys(t) else list_transform({_list("t")}, lambda x: case when json_type(x) = 'OBJECT' then x ->> 'k' else x ->> '$' end) end ks from (select rid, path, 'way' as kind, key pkey, v -> 'tag' t from jways union all select rid, 'relation', 'relation', key, v -> 'tag' from j1 where kind = 'relation')),
js as (
  select rid, kind path, kind, pos, key, 'extract' parent_kind, null::varchar parent_key from j1
  union all select rid, 'relation/member', 'member', pos, case when json_type(v) = 'OBJECT' then coalesce(v ->> 'ref', (select min_by(case when json_type(w.v) = 'OBJECT' then w.v ->> 'id' else w.v ->> '$' end, w.pos) from jw w where w.rid = jm.rid and w.up = jm.up and w.mpos = jm.pos)) else v ->> '$' end, 'relation', pkey from jm
  union all select rid, path, 'way', pos, key, 'member', null from (select rid, 'relation/member/way' path, pos, case when json_type(v) = 'OBJECT' then v ->> 'id' else v ->> '$' end as key from jw)
  union all select rid, path || '/nd', 'nd', pos, case when json_type(v) = 'OBJECT' then v ->> 'ref' else v ->> '$' end, 'way', pkey from jn
  union all select rid, path || '/tag', 'tag', generate_subscripts(ks, 1), unnest(ks), kind, pkey from jtag
),
node as (select rid, extract_id, captured_at, payload, path, kind, pos, key, parent_kind, parent_key from (select * from xml union all select * from js) join doc using (rid))
"""

P1_FOUND = f"""with {NODES} select distinct parent_kind, case when parent_kind = 'extract' then extract_id else try_cast(parent_key as bigint) end parent_id, kind child_kind,
  (case when kind = 'tag' then 0 else pos end)::int child_pos, key child_key from node where parent_kind <> 'member'"""

#: A record that was delivered twice counts once.
P1_PATHS = f"with {NODES}, once as (select min(rid) rid from doc group by extract_id, payload) select path schema_path, count(*) n_rows from node semi join once using (rid) group by 1"

_PORTS = "(spec_id || ':' || {0} || '_fso' || {1})"
_REFS = f"""
refs as (
  select 'way_nd' ref_table, try_cast(parent_key as bigint) ref_id, key ref_key, captured_at t from node where kind = 'nd' and key is not null
  union all select 'relation_member', try_cast(parent_key as bigint), key, captured_at from node where kind = 'member' and key is not null
  union all select 'fso_links', link_id, unnest([{_PORTS.format("u", "u_port")}, {_PORTS.format("v", "v_port")}]), loaded_at from fso_links
), parents as (
  select 'way_nd' ref_table, osm_node_id::varchar ref_key, loaded_at t, node_version::bigint v, coalesce(visible, true) alive from osm_nodes
  union all select 'relation_member', key, captured_at, 1, true from node where kind = 'way'
  union all select 'fso_links', {_PORTS.format("node", "port")}, loaded_at, 1, true from fso_nodes
  union all select 'fso_links', {_PORTS.format("node", "port")}, greatest(loaded_at, retired_at), 2, false from fso_nodes where retired_at is not null
), ref as (select * from refs where ref_key is not null and t is not null), par as (select distinct * from parents where ref_key is not null and t is not null)
"""
P6 = f"""with {NODES}, {_REFS}, once as (select distinct * from ref), judged as (
  select r.ref_table, r.ref_id, r.ref_key, r.t, count(p.t) n, count(*) filter (p.t <= r.t) seen, max({{'v': p.v, 'alive': p.alive}}) filter (p.t <= r.t) top
  from once r left join par p on p.ref_table = r.ref_table and p.ref_key = r.ref_key group by all
), found as (
  select distinct ref_table, ref_id, string_split(ref_key, ':')[-1] ref_key, case when n = 0 then 'missing' when seen = 0 then 'late' else 'deleted' end cause, strftime(t, '%Y-%m') ref_month
  from judged where n = 0 or seen = 0 or not top.alive
)
"""
P6_PENDING = f"""with {NODES}, {_REFS}, by_period as (
  select ref_table, ref_key, period, max(top) top, sum(n) n_refs from (
    select ref_table, ref_key, strftime(t, '%Y-%m') period, {{'v': v, 'alive': alive}} top, 0 n from par union all select ref_table, ref_key, strftime(t, '%Y-%m'), null, 1 from ref) group by 1, 2, 3
), ended as (select *, max(top) over w top_now, sum(n_refs) over w so_far from by_period window w as (partition by ref_table, ref_key order by period)),
waits as (select *, case when top_now is null or not top_now.alive then so_far else 0 end waiting from ended),
moved as (select ref_table, period, n_refs, waiting - coalesce(lag(waiting) over (partition by ref_table, ref_key order by period), 0) change from waits),
per as (select ref_table, period, sum(n_refs)::bigint n_new, sum(change)::bigint n_changed from moved group by 1, 2)
select *, (sum(n_changed) over (partition by ref_table order by period))::bigint n_pending from per"""

#: Cells of 4 m times powers of 4: from no wider than the polygon, split where its outline touches.
P2_CELLS = """
with closed as (
  select distinct building_id, area_id, min_lat, min_lon, case when building_lat[1] = building_lat[-1] and building_lon[1] = building_lon[-1] then building_lat[:-2] else building_lat end la,
    case when building_lat[1] = building_lat[-1] and building_lon[1] = building_lon[-1] then building_lon[:-2] else building_lon end lo
  from (select distinct building_id, area_id, building_lat, building_lon from buildings) join map_areas using (area_id) where len(building_lat) > 2 and len(building_lat) = len(building_lon)
), poly as (
  select row_number() over () b, xs, ys, len(xs) m, list_min(xs) lx, list_max(xs) hx, list_min(ys) ly, list_max(ys) hy from (
    select [(v - min_lat) * 111320 for v in la] xs, [(v - min_lon) * 111320 * cos(radians(min_lat)) for v in lo] ys from closed where len(la) > 2)
), side as (select b, xs[k] x1, ys[k] y1, xs[k % m + 1] x2, ys[k % m + 1] y2 from (select *, unnest(range(1, m + 1)) k from poly)),
level as (select b, lx, hx, ly, hy, top, unnest(range(0, top + 1)) k from (select *, floor(ln(greatest(greatest(hx - lx, hy - ly) / 4, 1)) / ln(4))::bigint top from poly)),
sized as (select *, 4 * power(4, k) s from level),
cell as (select b, k, top, s, cx, unnest(range(floor(ly / s)::bigint, floor(hy / s)::bigint + 1)) cy from (select *, unnest(range(floor(lx / s)::bigint, floor(hx / s)::bigint + 1)) cx from sized)),
clip as (select c.b, c.k, c.top, c.cx, c.cy,
    greatest(0.0, case when x1 = x2 then (case when x1 between cx * s and cx * s + s then 0 else 2 end) else least((cx * s - x1) / (x2 - x1), (cx * s + s - x1) / (x2 - x1)) end,
      case when y1 = y2 then (case when y1 between cy * s and cy * s + s then 0 else 2 end) else least((cy * s - y1) / (y2 - y1), (cy * s + s - y1) / (y2 - y1)) end) t0,
    least(1.0, case when x1 = x2 then (case when x1 between cx * s and cx * s + s then 1 else 2 end) else greatest((cx * s - x1) / (x2 - x1), (cx * s + s - x1) / (x2 - x1)) end,
      case when y1 = y2 then (case when y1 between cy * s and cy * s + s then 1 else 2 end) else greatest((cy * s - y1) / (y2 - y1), (cy * s + s - y1) / (y2 - y1)) end) t1,
    ((y1 > (cy + 0.5::double) * s) <> (y2 > (cy + 0.5::double) * s)) and (cx + 0.5::double) * s < (x2 - x1) * ((cy + 0.5::double) * s - y1) / (case when y1 = y2 then 1 else y2 - y1 end) + x1 hit
  from cell c join side using (b)),
state as (select b, k, top, cx, cy, bool_or(t0 <= t1) edge, count(*) filter (hit) % 2 = 1 inner_ from clip group by all),
there as (select s.* from state s left join state p on p.b = s.b and p.k = s.k + 1 and p.cx = floor(s.cx / 4) and p.cy = floor(s.cy / 4) where s.k = s.top or p.edge)
select k::int "level", not edge interior, count(*) n_cells from there where (edge and k = 0) or (not edge and inner_) group by 1, 2
"""

_BOM = "chr(65279)"
#: A cell without padding, quotes and byte-order marks.
_CELL = "(case when len(trim({0}, E' \\t\\r\\n')) > 1 and trim({0}, E' \\t\\r\\n')[1] in ('\"', '''') and trim({0}, E' \\t\\r\\n')[1] = trim({0}, E' \\t\\r\\n')[-1] then trim(trim({0}, E' \\t\\r\\n')[2:-2], E' \\t\\r\\n') else trim({0}, E' \\t\\r\\n') end)"

P5_FOUND = rf"""
with recursive last as (select file_id, max({{'t': loaded_at, 's': series_id, 'q': file_seq, 'd': coalesce(nullif(delim, ''), ','), 'h': stat_header, 'b': body}}) m from stat_files where file_id is not null group by 1),
file as (select file_id, m.s series_id, m.d delim, m.b body, row_number() over (partition by m.s order by m.q, file_id) k,
  case when m.h is null or trim(replace(m.h, {_BOM}, ''), E' \t\r\n') = '' then null else [{_CELL.format("x")} for x in string_split(replace(m.h, {_BOM}, ''), m.d)] end raw from last where m.s is not null and m.q is not null),
named as (select *, case when raw[-1] = '' then raw[:-2] else raw end as names from file),
laid as (select *, last_value(names ignore nulls) over (partition by series_id order by k) layout from named),
step as (select *, lag(layout) over (partition by series_id order by k) before from laid),
new_one as (select series_id, file_id, k, i, layout[i] as name, list_contains(before, layout[i]) kept, before is null as opens from (select *, unnest(range(1, len(layout) + 1)) i from step)),
old_one as (select series_id, file_id, k, i, before[i] as name, list_contains(layout, before[i]) kept from (select *, unnest(range(1, len(before) + 1)) i from step)),
new_at as (select *, last_value(case when kept then name end ignore nulls) over b l, first_value(case when kept then name end ignore nulls) over a r, i - coalesce(max(case when kept then i end) over b, 0) turn from new_one
  window b as (partition by file_id order by i rows between unbounded preceding and 1 preceding), a as (partition by file_id order by i rows between 1 following and unbounded following)),
old_at as (select *, last_value(case when kept then name end ignore nulls) over b l, first_value(case when kept then name end ignore nulls) over a r, i - coalesce(max(case when kept then i end) over b, 0) turn from old_one
  window b as (partition by file_id order by i rows between unbounded preceding and 1 preceding), a as (partition by file_id order by i rows between 1 following and unbounded following)),
renamed as (select n.file_id, n.name, o.name was from new_at n join old_at o on n.file_id = o.file_id and not n.kept and not o.kept and n.l is not distinct from o.l and n.r is not distinct from o.r and n.turn = o.turn where not n.opens),
origin as (select n.series_id, n.file_id, n.k, n.i, n.name, case when n.kept then n.name else r.was end as was from new_one n left join renamed r on r.file_id = n.file_id and r.name = n.name),
col(series_id, k, name, id) as (select series_id, k, name, name || '@' || k from origin where was is null union all select o.series_id, o.k, o.name, c.id from col c join origin o on o.series_id = c.series_id and o.k = c.k + 1 and o.was = c.name),
cell as (select file_id, i, {_CELL.format("cells[i]")} v from (select file_id, cells, unnest(range(1, len(cells) + 1)) i from (select file_id, string_split(replace(line, {_BOM}, ''), delim) cells from (select file_id, delim, unnest(regexp_split_to_array(body, '\r\n|\n|\r')) line from named) where trim(replace(line, {_BOM}, ''), E' \t') <> ''))),
kind as (select file_id, i, max(case when regexp_full_match(v, '[-+]?\d+') then 0 when regexp_full_match(v, '[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?') then 1 else 2 end) t from cell where v not in ('', 'N/A', 'NA', 'null', 'None', '-', 'nan') group by 1, 2),
seen as (select o.file_id, o.name, ['INT', 'DOUBLE', 'STRING'][t + 1] typ, lag(['INT', 'DOUBLE', 'STRING'][t + 1]) over (partition by o.series_id, c.id order by o.k) before from origin o join col c on c.series_id = o.series_id and c.k = o.k and c.name = o.name join kind on kind.file_id = o.file_id and kind.i = o.i)
select file_id, 'renamed' change_kind, name column_name, was was_value from renamed
union all select file_id, 'added', name, '' from new_one n where not kept and not opens and not exists (select 1 from renamed r where r.file_id = n.file_id and r.name = n.name)
union all select file_id, 'removed', name, '' from old_one o where not kept and not exists (select 1 from renamed r where r.file_id = o.file_id and r.was = o.name)
union all select file_id, 'type_changed', name, before from seen where before <> typ
"""
