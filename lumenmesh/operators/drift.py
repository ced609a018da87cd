"""Files whose fields drift, read into one consistent table; every change is reported.

Rescue-column ingestion. A series of files is read against the schema in force: the layout and the value
types that the files before it left. `hold` takes the fields that the schema knows and whose values have the
type it demands; unknown fields and those of another type are rescued as JSON, and fields that the schema
names but the file lacks are noted. `approve` makes changes of what was rescued and noted (renamed, added,
removed, type_changed): a renamed field is replayed into the column it was, an added one gets a new column.
The result is the schema that the next file is held to. Rows are enforced and rescued in the same way, and
approved fields are promoted later: their rescued values are replayed into typed columns.

The schema in force depends on all files before. A series is cut into blocks of consecutive files; each
block is folded alone into what it does to any schema, these summaries are chained per series, and then
all blocks run at once from the schema they start with. With blocks as long as the square root of the
longest series, neither step ever holds a whole series. Files are parsed where they are read, once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby, islice, zip_longest
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import let
from ..session import Scratch

#: Texts that stand for a missing value (fixed values).
MISSING = ("", "N/A", "NA", "null", "None", "-", "nan")
_INT = re.compile(r"[-+]?\d+")
_FLOAT = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_RANK = {"INT": 0, "DOUBLE": 1, "STRING": 2}


def cells(line: str, delim: str) -> list[str]:
    """The cells of a line without padding, quotes and byte-order marks. A quoted cell may hold the delimiter."""
    line = line.replace("﻿", "")
    if '"' in line:
        parts = [m[0] for m in re.finditer(rf'(?:\s*"(?:[^"]|"")*"\s*(?={re.escape(delim)}|$)|[^{re.escape(delim)}]*)(?:{re.escape(delim)}|$)', line)]
        parts = [p.removesuffix(delim) for p in (parts[:-1] if len(parts) > 1 and parts[-1] == "" and not line.endswith(delim) else parts)]
    else:
        parts = line.split(delim)
    out = []
    for p in parts:
        p = p.strip()
        if len(p) > 1 and p[0] == p[-1] and p[0] in "\"'":
            p = p[1:-1].replace('""', '"').strip()
        out.append(p)
    return out


def header_names(header: str | None, delim: str) -> list[str] | None:
    """Names of a header; a delimiter too many at the end names no field, a repeated name gets a number."""
    if header is None or not header.strip("﻿ \t\r\n"):
        return None
    names = cells(header.strip("\r\n"), delim)
    while names and not names[-1]:
        names.pop()
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}#{seen[n]}")
    return out or None


def rows_of(body: str | None, delim: str, width: int | None) -> list[list[str]]:
    """Rows of a body; blank lines are none, and an empty cell too many at the end is dropped."""
    out = []
    for line in re.split(r"\r\n|\n|\r", body or ""):
        if line.strip("﻿ \t"):
            row = cells(line, delim)
            if row and row[-1] == "" and (width is not None and len(row) == width + 1):
                row.pop()
            out.append(row)
    return out


def value_type(values: list[str]) -> str | None:
    t = None
    for v in values:
        if v in MISSING:
            continue
        k = "INT" if _INT.fullmatch(v) else "DOUBLE" if _FLOAT.fullmatch(v) else "STRING"
        if t is None or _RANK[k] > _RANK[t]:
            t = k
    return t


@dataclass
class Schema:
    """The schema in force: names in order, last seen type and first name of each column."""

    names: list[str] | None = None
    types: dict[str, str | None] = field(default_factory=dict)
    ids: dict[str, str] = field(default_factory=dict)


def reconcile(old: list[str], new: list[str]) -> tuple[dict[str, str], list[str], list[str]]:
    """(renamed: new name to old, added, removed): gone and new names in the same place are one column.

    The place of a name is the pair of surviving names around it and its turn among the names between them.
    """
    kept = set(old) & set(new)

    def places(names: list[str]) -> dict[tuple, str]:
        out, left, run = {}, None, []
        for n in [*names, None]:
            if n is None or n in kept:
                out |= {(left, n, i): x for i, x in enumerate(run)}
                left, run = n, []
            else:
                run.append(n)
        return out

    gone, come = places(old), places(new)
    renamed = {come[k]: gone[k] for k in come.keys() & gone.keys()}
    lost = set(renamed.values())
    return renamed, [n for n in new if n not in kept and n not in renamed], [n for n in old if n not in kept and n not in lost]


@dataclass
class Held:
    """A file held to a schema: the layout, types by position, the rescued fields as JSON, and names that it lacks."""

    names: list[str] | None
    types: list[str | None]
    rescued: str | None
    absent: list[str]


def hold(schema: Schema, names: list[str] | None, types: list[str | None]) -> Held:
    """Holds one file to the schema in force. A file without names is laid out as the schema is.

    Rescued are the fields that the schema does not name and those whose values are of another type than
    it demands: a JSON list of objects with the name, the position from 0, and the type (null without values).
    """
    names = schema.names if names is None else names
    if names is None:
        return Held(None, types, None, [])
    out = []
    for k, n in enumerate(names):
        t = types[k] if k < len(types) else None
        want = schema.types.get(n) if n in schema.ids else t
        if n not in schema.ids or (t is not None and want is not None and t != want):
            out.append({"name": n, "at": k, "type": t})
    absent = [n for n in schema.names or [] if n not in set(names)] if schema.names != names else []
    return Held(names, types, json.dumps(out, ensure_ascii=False) if out else None, absent)


def approve(schema: Schema, held: Held) -> tuple[Schema, list[tuple[str, str, str]]]:
    """The schema that a held file leaves, and its changes (kind, name, was), found in what was rescued and lacks.

    The first layout of a series is approved without a change.
    """
    if held.names is None:
        return schema, []
    rescued = {f["name"]: f["type"] for f in json.loads(held.rescued)} if held.rescued else {}
    changes: list[tuple[str, str, str]] = []
    if schema.names is None:
        return Schema(held.names, dict(rescued), {n: n for n in held.names}), changes
    renamed: dict[str, str] = {}
    ids = schema.ids
    if held.absent or any(n not in schema.ids for n in rescued):
        renamed, added, removed = reconcile(schema.names, held.names)
        changes += [("renamed", n, o) for n, o in renamed.items()] + [("added", n, "") for n in added] + [("removed", n, "") for n in removed]
        fresh = set(added)
        ids = {n: schema.ids[renamed.get(n, n)] for n in held.names if n not in fresh}
        used = set(ids.values())
        for n in added:
            i = n
            while i in used:
                i += "'"
            ids[n] = i
            used.add(i)
    types = {}
    for k, n in enumerate(held.names):
        t = held.types[k] if k < len(held.types) else None
        was = schema.types.get(renamed.get(n, n)) if n not in rescued or n in renamed or n in schema.ids else None
        # replayed into its column, a rescued field still may not have the type demanded there
        if n in rescued and t is not None and was is not None and t != was:
            changes.append(("type_changed", n, was))
        types[n] = was if t is None else t
    return Schema(held.names, types, ids), changes


def take(schema: Schema, names: list[str] | None, types: list[str | None]) -> tuple[Schema, list[tuple[str, str, str]]]:
    """Holds one file to the schema in force and approves what was rescued: the schema it leaves, and its changes."""
    return approve(schema, hold(schema, names, types))


_NAMES = pa.list_(pa.string())
_CHANGES = pa.list_(pa.struct([("change_kind", pa.string()), ("column_name", pa.string()), ("was_value", pa.string())]))


def _delivery(files: DataFrame) -> DataFrame:
    """The columns of files with the delivery's rank: the last one loaded counts, at a tie the greatest hash of its content."""
    cols = ["file_id", "series_id", "file_seq", "delim", "stat_header", "body"]
    return files.where("file_id is not null").select(F.col("file_id").cast("bigint"), F.col("series_id").cast("bigint"), F.col("file_seq").cast("bigint"), *cols[3:], F.struct(F.col("loaded_at").alias("t"), F.xxhash64(*cols[1:]).alias("h")).alias("delivery"))


def profiles(files: DataFrame) -> DataFrame:
    """(file_id, series_id, file_seq, names, types, delivery): the header and the value types of each position, one row per file.

    Of a file delivered several times the last delivery counts. Null delimiters count as a comma.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, types = [], []
            for d, h, t in zip(*(b.column(c).to_pylist() for c in ("delim", "stat_header", "body"))):
                d = d or ","
                n = header_names(h, d)
                rows = rows_of(t, d, len(n) if n else None)
                names.append(n)
                types.append([value_type(c) for c in zip_longest(*rows, fillvalue="")])
            kept = [b.column(c) for c in ("file_id", "series_id", "file_seq", "delivery")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, _NAMES), pa.array(types, _NAMES)], names=["file_id", "series_id", "file_seq", "delivery", "names", "types"])

    f = _delivery(files)
    found = f.mapInArrow(run, f"file_id bigint, series_id bigint, file_seq bigint, delivery {f.schema['delivery'].dataType.simpleString()}, names array<string>, types array<string>")
    last = found.groupBy("file_id").agg(F.max_by(F.struct("series_id", "file_seq", "names", "types", "delivery"), "delivery").alias("m"))
    return last.select("file_id", "m.*")


class _Summary:
    """What a block does to any schema: types by position before its first header, then its columns.

    origin: for each last column the index of the first header's column that it comes from, -1 if none.
    """

    def __init__(self, start: Schema):
        self.lead: list[str | None] = []
        self.first: list[str] | None = None
        self.state = Schema()

    def file(self, row: dict) -> None:
        names, types = row["names"], row["types"] or []
        if self.first is None and names is None:
            self.lead = [t if t is not None else o for o, t in zip_longest(self.lead, types)]
            return
        if self.first is None:
            self.first = names
        self.state, _ = take(self.state, names, types)

    def result(self) -> dict:
        at = {n: i for i, n in enumerate(self.first or [])}
        last = self.state.names or []
        return {"lead": self.lead, "first": self.first, "last": last, "origin": [at.get(self.state.ids[n], -1) for n in last], "last_types": [self.state.types.get(n) for n in last], "last_ids": [self.state.ids[n] for n in last]}


_BLOCK = pa.schema([("series_id", pa.int64()), ("block", pa.int64()), ("lead", _NAMES), ("first", _NAMES), ("last", _NAMES), ("origin", pa.list_(pa.int32())), ("last_types", _NAMES), ("last_ids", _NAMES)])
_CARRY = pa.schema([("series_id", pa.int64()), ("block", pa.int64()), ("names", _NAMES), ("types", _NAMES), ("ids", _NAMES)])
_READ = pa.schema([("series_id", pa.int64()), ("file_id", pa.int64()), ("file_seq", pa.int64()), ("layout", _NAMES), ("ids", _NAMES), ("rescued", pa.string()), ("absent", _NAMES), ("changes", _CHANGES)])
_DDL = {_BLOCK: "series_id bigint, block bigint, lead array<string>, first array<string>, last array<string>, origin array<int>, last_types array<string>, last_ids array<string>", _CARRY: "series_id bigint, block bigint, names array<string>, types array<string>, ids array<string>", _READ: "series_id bigint, file_id bigint, file_seq bigint, layout array<string>, ids array<string>, rescued string, absent array<string>, changes array<struct<change_kind:string,column_name:string,was_value:string>>"}


def _sorted_map(df: DataFrame, keys: list[str], order: list[str], run: Callable[[Iterator[dict]], Iterator[dict]], out: pa.Schema) -> DataFrame:
    """Runs over rows that are partitioned by keys and sorted by keys and order; rows of a key are neighbours."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = run(r for b in found for r in b.to_pylist())
        while some := list(islice(rows, 5_000)):
            yield pa.RecordBatch.from_pylist(some, schema=out)

    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInArrow(batches, _DDL[out])


def _summaries(rows: Iterator[dict]) -> Iterator[dict]:
    for key, group in groupby(rows, key=lambda r: (r["series_id"], r["block"])):
        s = _Summary(Schema())
        for r in group:
            s.file(r)
        yield {"series_id": key[0], "block": key[1], **s.result()}


def _chain(rows: Iterator[dict]) -> Iterator[dict]:
    """The schema each block of a series starts with."""
    for key, group in groupby(rows, key=lambda r: r["series_id"]):
        state = Schema()
        for r in group:
            n = state.names
            yield {"series_id": key, "block": r["block"], "names": n, "types": n and [state.types.get(x) for x in n], "ids": n and [state.ids[x] for x in n]}
            state, _ = take(state, None, r["lead"] or [])
            if (first := r["first"]) is not None:
                state, _ = take(state, first, [])
                from_first = [first[o] if o >= 0 else None for o in r["origin"]]
                last = r["last"]
                state = Schema(last, {n: t if t is not None else state.types.get(f) for n, f, t in zip(last, from_first, r["last_types"])}, {n: state.ids[f] if f is not None else i for n, f, i in zip(last, from_first, r["last_ids"])})


def _read(rows: Iterator[dict]) -> Iterator[dict]:
    for _, group in groupby(rows, key=lambda r: (r["series_id"], r["block"])):
        state = Schema()
        for r in group:
            if r["is_file"]:
                held = hold(state, r["names"], r["types"] or [])
                state, changes = approve(state, held)
                n = state.names
                yield {"series_id": r["series_id"], "file_id": r["file_id"], "file_seq": r["file_seq"], "layout": n, "ids": n and [state.ids[x] for x in n], "rescued": held.rescued, "absent": held.absent, "changes": [dict(zip(("change_kind", "column_name", "was_value"), c)) for c in changes]}
            elif (n := r["names"]) is not None:
                state = Schema(n, dict(zip(n, r["types"])), dict(zip(n, r["ids"])))


def timeline(files: DataFrame, least_block: int = 256) -> DataFrame:
    """Every file with its layout, the first name of each column, what was rescued of it, and its changes.

    (series_id, file_id, file_seq, layout, ids, rescued, absent, changes). Files without series or number
    follow none and are left out. Files of the same number follow each other by file_id. A file without
    header keeps the layout before it; before the first header there is none, and no change. An empty
    table gives no rows. Extra columns are ignored.
    """
    return timeline_of(Scratch(files.sparkSession, "profiles").cut(profiles(files))[0], least_block)


def timeline_of(found: DataFrame, least_block: int = 256) -> DataFrame:
    """`timeline` of what `profiles` gave."""
    p = found.where("series_id is not null and file_seq is not null")
    low, high = p.agg(F.min("file_seq"), F.max("file_seq")).first()
    low, high = low or 0, high or 0
    size = max(least_block, isqrt(high - low))
    p = p.select("series_id", F.floor((F.col("file_seq") - low) / size).cast("bigint").alias("block"), "file_id", "file_seq", "names", "types")
    rows = p.select(*p.columns, F.lit(None).cast("array<string>").alias("ids"), F.lit(True).alias("is_file"))
    if high - low >= size:  # else every series is one block, which starts with no schema
        carry = _sorted_map(_sorted_map(p, ["series_id", "block"], ["file_seq", "file_id"], _summaries, _BLOCK), ["series_id"], ["block"], _chain, _CARRY)
        none = F.lit(None).cast("bigint")
        rows = rows.union(carry.select("series_id", "block", none, none, "names", "types", "ids", F.lit(False)))
    return _sorted_map(rows, ["series_id", "block"], ["is_file", "file_seq", "file_id"], _read, _READ)


def changes(read: DataFrame) -> DataFrame:
    """(file_id, change_kind, column_name, was_value) of a timeline: what was made of its rescued and absent fields."""
    return read.select("file_id", F.inline("changes"))


def ingest(files: DataFrame, schema: dict[str, str], least_block: int = 256) -> DataFrame:
    """(file_id, series_id, file_seq, row_no, *schema, _rescued): all rows of all files in one table.

    Columns go by the first name they had in their series. A value that the schema names and that casts
    to its type is in its column; every other value that is not missing is in _rescued, a JSON object
    from the column's first name to the text (null if nothing was rescued). Values behind the last named
    column, or of files without any layout, are rescued as field_<position>. A file without series or
    number stands alone: its own header is its layout.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, no, rows = [], [], []
            for i, (d, t) in enumerate(zip(b.column("delim").to_pylist(), b.column("body").to_pylist())):
                for n, row in enumerate(rows_of(t, d or ",", None), 1):
                    at.append(i)
                    no.append(n)
                    rows.append(row)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("file_id").take(at), b.column("delivery").take(at), pa.array(no, pa.int64()), pa.array(rows, _NAMES)], names=["file_id", "delivery", "row_no", "cells"])

    f = _delivery(files)
    # parsed where it is read; what is shuffled are rows, which AQE may split and gather as it likes
    rows = f.mapInArrow(run, f"file_id bigint, delivery {f.schema['delivery'].dataType.simpleString()}, row_no bigint, cells array<string>")
    p, _ = Scratch(files.sparkSession, "profiles").cut(profiles(files))
    read = timeline_of(p, least_block)
    layout = p.select("file_id", "series_id", "file_seq", "delivery", "names").join(read.select("file_id", F.col("ids").alias("known")), "file_id", "left")
    layout = layout.select("file_id", "series_id", "file_seq", "delivery", F.coalesce("known", "names", F.array().cast("array<string>")).alias("ids"))
    raw = rows.join(layout, ["file_id", "delivery"])
    n = F.size("ids")
    spare = (F.size("cells") == n + 1) & (F.element_at("cells", -1) == "")
    stray = lambda k: let(F.concat(F.lit("field_"), (k + 1).cast("string")), lambda name: F.when(F.array_contains("ids", name), F.concat(name, F.lit("'"))).otherwise(name))
    held = F.transform(F.when(spare, F.slice("cells", 1, n)).otherwise(F.col("cells")), lambda v, k: F.struct(F.when(k < n, F.get("ids", k)).otherwise(stray(k)).alias("key"), v.alias("value")))
    named = F.map_from_entries(F.filter(held, lambda e: ~e["value"].isin(*MISSING)))
    return enforce(raw.select("file_id", "series_id", "file_seq", "row_no", named.alias("v")), "v", schema)


def enforce(df: DataFrame, values: str, schema: dict[str, str]) -> DataFrame:
    """Splits a map of texts into typed columns and the rescue column.

    A row is made by one generator, so that the map is worked out once and not for each column.
    """
    known = F.array(*map(F.lit, schema))

    def row(v: F.Column) -> F.Column:
        cast = {n: v[n].try_cast(t) for n, t in schema.items()}
        unfit = F.array(*[F.when(v[n].isNotNull() & c.isNull(), F.lit(n)) for n, c in cast.items()])
        rest = let(unfit, lambda u: F.map_filter(v, lambda k, _: ~F.array_contains(known, k) | F.coalesce(F.array_contains(F.filter(u, lambda x: x.isNotNull()), k), F.lit(False))))
        return F.struct(*[c.alias(n) for n, c in cast.items()], let(rest, lambda r: F.when(F.size(r) > 0, F.to_json(r))).alias("_rescued"))

    return df.select(*[c for c in df.columns if c != values], F.inline(F.transform(F.array(F.col(values)), row)))


def promote(table: DataFrame, approved: dict[str, str]) -> DataFrame:
    """Adds approved fields as typed columns and replays their rescued values into them.

    A column that is already there gets the values that its old type could not hold only where it is
    null; its type becomes the approved one. Values that still do not cast stay rescued.
    """

    def row(m: F.Column) -> F.Column:
        new = {n: m[n].try_cast(t) for n, t in approved.items()}
        taken = F.filter(F.array(*[F.when(c.isNotNull(), F.lit(n)) for n, c in new.items()]), lambda x: x.isNotNull())
        left = let(taken, lambda u: F.map_filter(m, lambda k, _: ~F.array_contains(u, k)))
        return F.struct(*[c.alias(f"_new_{k}") for k, c in enumerate(new.values())], let(left, lambda x: F.when(F.size(x) > 0, F.to_json(x))).alias("_left"))

    df = table.select("*", F.inline(F.transform(F.array(F.from_json("_rescued", "map<string,string>")), row)))
    cols = {n: F.coalesce(F.col(n).try_cast(t), F.col(f"_new_{k}")) if n in table.columns else F.col(f"_new_{k}") for k, (n, t) in enumerate(approved.items())}
    old = [cols.get(c, F.col(c)).alias(c) for c in table.columns if c != "_rescued"]
    return df.select(*old, *[c.alias(n) for n, c in cols.items() if n not in table.columns], F.col("_left").alias("_rescued"))
