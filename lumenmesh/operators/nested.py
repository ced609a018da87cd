"""Deeply nested records turned into flat parent and child tables, by Dewey labelling.

Every element of a record gets a Dewey label: the ordinals on the way from the root to it, such as
(3, 1, 2), counted over all children of an element, known or not, so labels do not change when more kinds
become known. The label of an element's parent is the label without its last ordinal, so parent links need
no pointers; an element's schema path (the kinds on the way, such as relation/member/way/nd) tells which
flat table it belongs to. A record is parsed, labelled and linked within one task: no shuffle. The tables are
written side by side, one folder for each schema path. Paths that the layout does not know can be listed too.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Which child kinds each kind may hold, under which names they are written.
CHILDREN = {
    "extract": {"way": "way", "relation": "relation"},
    "way": {"nd": "nd", "tag": "tag"},
    "relation": {"member": "member", "way_id": "member", "tag": "tag"},
    "member": {"way": "way"},
    "nd": {},
    "tag": {},
}
#: The attribute that names an element of a kind, and the one that holds its value.
KEY = {"way": "id", "relation": "id", "nd": "ref", "member": "ref", "tag": "k"}
VALUE = {"tag": "v", "member": "role"}
#: What a record may be wrapped in.
ROOTS = ("osm",)

#: Columns of an element, in order; `error` stands alone in a row for a record that can't be parsed.
TYPES = {
    "label": pa.list_(pa.int32()), "schema_path": pa.string(), "kind": pa.string(), "pos": pa.int32(), "key": pa.string(), "value": pa.string(),
    "parent_path": pa.string(), "parent_kind": pa.string(), "parent_key": pa.string(), "error": pa.string(),
}
_SQL = {pa.list_(pa.int32()): "array<int>", pa.string(): "string", pa.int32(): "int"}


class Shape:
    """A schema path: what its elements may hold. Shapes of unknown paths are made as they are met."""

    __slots__ = ("above", "key", "kids", "kind", "known", "path", "value")

    def __init__(self, kind: str, above: Shape | None, known: bool):
        self.kind, self.above, self.known = kind, above, known
        self.path = "" if above is None else f"{above.path}/{kind}" if above.path else kind
        self.key, self.value = (KEY.get(kind), VALUE.get(kind)) if known else (None, None)
        self.kids: dict[str, Shape] = {}
        if known:
            own: dict[str, Shape] = {}
            for name, k in CHILDREN[kind].items():
                self.kids[name] = own.setdefault(k, Shape(k, self, True))

    def kid(self, name: str) -> Shape:
        if name not in self.kids:
            self.kids[name] = Shape(name, self, False)
        return self.kids[name]

    def paths(self) -> list[Shape]:
        """The known shapes below this one."""
        own = {id(k): k for k in self.kids.values() if k.known}.values()
        return [x for k in own for x in [k, *k.paths()]]


ROOT = Shape("extract", None, True)


def _xml_children(e: ET.Element, shape: Shape) -> Iterator[tuple[str, ET.Element, dict]]:
    for c in e:
        yield c.tag if c.tag[0] != "{" else c.tag.rpartition("}")[2], c, c.attrib


def _json_children(v: object, shape: Shape) -> Iterator[tuple[str, object, dict]]:
    """Children in document order; one value may stand for a list of one, and a bare value for its key."""
    if not isinstance(v, dict):
        return
    for name, x in v.items():
        k = shape.kids.get(name)
        if k is not None and k.known:
            if k.kind == "tag" and isinstance(x, dict) and "k" not in x:
                x = [{"k": a, "v": b} for a, b in x.items()]
            for c in x if isinstance(x, list) else (x,):
                if c is not None:
                    yield name, c, c if isinstance(c, dict) else {k.key: c}
        elif isinstance(x, (dict, list)):  # other bare values are fields
            for c in x if isinstance(x, list) else (x,):
                if c is not None:
                    yield name, c, c if isinstance(c, dict) else {}


def _text(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return json.dumps(v, ensure_ascii=False)


def walk(payload: str | None, payload_kind: str | None, everything: bool = False) -> Iterator[tuple]:
    """The labelled elements of one payload in the order of TYPES, parents before children.

    A null or blank payload holds none. One that cannot be parsed gives a single row that has only the
    error. Null elements are none. Elements of unknown paths take their ordinals, but come out only with
    `everything`: then their bare fields are no elements, and their kind is the name they are written under.
    """
    if payload is None or not payload.strip():
        return
    text = payload.lstrip("\ufeff \t\r\n")
    try:
        if (payload_kind or ("xml" if text[:1] == "<" else "json")) == "xml":
            root, children = ET.fromstring(text.encode("utf-8", "surrogatepass")), _xml_children
        else:
            root, children = json.loads(text), _json_children
            for name in ROOTS:
                if isinstance(root, dict) and isinstance(root.get(name), dict):
                    root = root[name]
    except (ValueError, RecursionError, ET.ParseError) as e:
        yield (None,) * 9 + (f"{type(e).__name__}: {e}",)
        return
    above: dict[tuple[int, ...], tuple[Shape, str | None]] = {(): (ROOT, None)}
    stack: list[tuple[tuple[int, ...], object]] = [((), root)]
    while stack:
        label, element = stack.pop()
        shape = above[label][0]
        counts: dict[str, int] = {}
        held = []
        n = 0
        for name, child, fields in children(element, shape):
            n += 1
            k = shape.kids.get(name)
            if k is None or not k.known:
                if not everything:
                    continue
                k = shape.kid(name)
            pos = counts[k.kind] = counts.get(k.kind, 0) + 1
            key = fields.get(k.key) if k.key else None
            if key is not None and type(key) is not str:
                key = _text(key)
            if key is None and k.kind == "member":  # a member without ref is known by the way it holds
                key = next((_text(f.get("id")) for m, _, f in children(child, k) if m in k.kids), None)
            value = fields.get(k.value) if k.value else None
            own = (*label, n)
            parent, parent_key = above[own[:-1]]
            yield own, k.path, k.kind, pos, key, _text(value), parent.path or "extract", parent.kind, parent_key, None
            if k.kids or everything:
                above[own] = (k, key)
                held.append((own, child))
        stack.extend(reversed(held))


def label_record(payload: str | None, payload_kind: str | None, everything: bool = False) -> list[dict]:
    """`walk` as dicts; an error has no other field."""
    return [{"error": r[-1]} if r[-1] is not None else dict(zip(TYPES, r)) for r in walk(payload, payload_kind, everything)]


def shred(df: DataFrame, payload: str = "payload", payload_kind: str = "payload_kind", keep: list[str] | None = None, columns: list[str] | None = None, everything: bool = False) -> DataFrame:
    """All elements of all payloads: the columns `keep` of their record (extract_id) and those of TYPES, or only `columns`.

    Each row has the Dewey label, the schema path that names its flat table, the position among its
    parent's children of the same kind, its key, and its parent's path, kind and key, found by
    truncating the label. Elements standing directly in a record have parent_kind extract and a null
    parent_key: their parent is the record. Repeated records give their rows again; an empty table
    gives none. Columns of df that are not in `keep` are never read, so their names cannot clash.
    """
    keep = ["extract_id"] if keep is None else keep
    names = [n for n in TYPES if columns is None or n in columns]
    ddl = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"{n} {_SQL[TYPES[n]]}" for n in names])
    at = [list(TYPES).index(n) for n in names]

    def batch(b: pa.RecordBatch, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
        found = list(zip(*rows)) if rows else [()] * len(TYPES)
        kept = [b.column(k).take(pa.array(of, pa.int32())) for k in range(len(keep))]
        return pa.RecordBatch.from_arrays(kept + [pa.array(found[k], TYPES[n]) for k, n in zip(at, names)], names=[*keep, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: list[int] = []
            rows: list[tuple] = []
            for i, (p, k) in enumerate(zip(b.column("_payload").to_pylist(), b.column("_kind").to_pylist())):
                for row in walk(p, k, everything):
                    rows.append(row)
                    if len(rows) == 50_000:  # long records leave in pieces
                        of += [i] * (len(rows) - len(of))
                        yield batch(b, of, rows)
                        of, rows = [], []
                of += [i] * (len(rows) - len(of))
            yield batch(b, of, rows)

    return df.select(*keep, F.col(payload).alias("_payload"), F.col(payload_kind).alias("_kind")).mapInArrow(run, ddl)


def store(nodes: DataFrame, record: str = "extract_id") -> DataFrame:
    """The flat tables of all schema paths, written side by side in the shared folder, one folder each; read as one, with its path in each row.

    A row has the record's key, the Dewey label, position, key, value and the parent's key, as far as nodes has them.
    """
    kept = [record, "label", "pos", "key", "value", "parent_key", "schema_path"]
    return Scratch(nodes.sparkSession, "tables").cut(nodes.where("schema_path is not null").select(*[c for c in kept if c in nodes.columns]), by="schema_path")[0]


def tables_by_path(nodes: DataFrame, record: str = "extract_id") -> dict[str, DataFrame]:
    """The flat tables by themselves, one for each known schema path, with the label of the parent.

    Elements are made once, whatever number of tables is read.
    """
    stored = store(nodes, record)
    parent = [F.slice("label", 1, F.size("label") - 1).alias("parent_label")] if "label" in stored.columns else []
    return {s.path: stored.where(F.col("schema_path") == s.path).select(*stored.columns[:-1], *parent) for s in ROOT.paths()}


def links(nodes: DataFrame, record: str = "extract_id") -> DataFrame:
    """Distinct parent-child links, read from the tables by path: (parent_kind, parent_id, child_kind, child_pos, child_key).

    A way or relation is a child of its record only if it stands directly in it; a member is a child
    by its ref, also when it holds the way. child_pos is 0 for tags, which have no order.
    """
    read = [s for s in ROOT.paths() if s.above.kind != "member"]
    of = lambda value: F.create_map(*[F.lit(v) for s in read for v in (s.path, value(s))])[F.col("schema_path")]
    direct = F.col("schema_path").isin([s.path for s in read if s.above is ROOT])
    return (
        store(nodes, record)
        .where(F.col("schema_path").isin([s.path for s in read]))
        .select(
            of(lambda s: s.above.kind).alias("parent_kind"),
            F.when(direct, F.col(record).cast("bigint")).otherwise(F.col("parent_key").try_cast("bigint")).alias("parent_id"),
            of(lambda s: s.kind).alias("child_kind"),
            F.when(of(lambda s: s.kind) == "tag", F.lit(0)).otherwise(F.col("pos")).cast("int").alias("child_pos"),
            F.col("key").alias("child_key"),
        )
        .distinct()
    )


def unread(nodes: DataFrame, record: str = "extract_id") -> DataFrame:
    """(schema_path, error, n_rows, n_records) of what no table holds: unknown paths of `shred(everything=True)`, and errors."""
    known = [s.path for s in ROOT.paths()]
    lost = nodes.where(F.col("error").isNotNull() | ~F.col("schema_path").isin(known))
    return lost.groupBy("schema_path", "error").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(record).alias("n_records"))
