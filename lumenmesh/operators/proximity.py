"""Points near other points, and the regions that contain points.

Both are answered by adaptive covers. A region is covered by square cells: those wholly inside it are interior,
those that its outline touches are boundary cells and are split further. Points join on their cell; a match
with an interior cell is accepted as it is, only one with a boundary cell gets the exact test.

Near pairs: the region of a point is the disc around it, covered by cells whose diagonal does not exceed the
distance: its own cell is interior, of the others each disc lists those of half the neighbourhood that it
touches, so each pair meets once.

Containing regions: polygons are covered by cells of 4 m times powers of 4, whatever their extent. Boundary
cells carry only the sides that can decide about points within them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, hot_keys

#: Metres of a degree of latitude, as the data's local metres define it (a fixed value).
METRES_PER_DEGREE = 111320
#: Width in metres of the cells of level 0; those of the next level are RATIO times as wide.
LEAST_SIZE, RATIO = 4.0, 4
#: Levels below the first one of a polygon. Its outline is followed down to this part of its extent; what is
#: coarser than level 0 then is left to the exact test.
DEPTH = 4
#: An unknown coordinate is null, NaN or this number (a fixed value of the data).
UNKNOWN = -9999.0
#: Cells beyond this number in either direction are not told apart; they accept nothing without a test.
FAR = 2**50
#: Sides worked on at once in a task.
CHUNK = 4_000


def known(c: str) -> F.Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) != F.lit(UNKNOWN))


def known_points(points: DataFrame, point: str = "node_id", area: str = "area_id", x: str = "node_x", y: str = "node_y") -> DataFrame:
    """Distinct (id, area, x, y) of points with a known position; null ids or areas match nothing."""
    p = points.select(F.col(point).alias("id"), F.col(area).alias("area"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return p.where(F.col("id").isNotNull() & F.col("area").isNotNull() & known("x") & known("y")).distinct()


def near_pairs(points: DataFrame, distance: float, point: str = "node_id", area: str = "area_id", x: str = "node_x", y: str = "node_y", unit: float = 0.01, hot_rows: int = 2_000) -> DataFrame:
    """Distinct (id_1, id_2), id_1 < id_2, of points of one area at most `distance` apart (inclusive).

    Positions are snapped to multiples of `unit`, the precision they are recorded in, and compared as
    integers, so that a pair at exactly the distance is not lost to rounding. Unknown positions match
    nothing; repeated rows count once; an empty table gives no pairs. Extra columns are ignored.
    """
    p, _ = Scratch(points.sparkSession, "near").cut(known_points(points, point, area, x, y))
    return near_known(p, distance, unit, hot_rows)


def near_known(p: DataFrame, distance: float, unit: float = 0.01, hot_rows: int = 2_000) -> DataFrame:
    """`near_pairs` of what `known_points` gave, written to a table.

    A crowded cell is split in both directions: its points are spread over salts, and so are the discs
    that reach it; each is copied to the salts of the other. The list of such cells has a proven bound:
    (2 * reach + 1) ** 2 for each of those that `crowded` gives.
    """
    r = round(distance / unit)
    s = max(1, isqrt(r * r // 2))  # the diagonal of a cell does not exceed the distance
    reach = -(-r // s)
    snapped = lambda c: F.round(F.col(c) / F.lit(unit)).alias(c)
    cell = lambda c: F.least(F.greatest(F.floor(F.col(c) / F.lit(s)), F.lit(-FAR)), F.lit(FAR)).cast("bigint")
    # positions within the cell; those of cells that are not told apart stay as they are
    offset = lambda v, c: F.when(F.abs(F.col(c)) < FAR, F.col(v) - F.col(c) * s).otherwise(F.col(v))
    p = p.select("id", "area", snapped("x"), snapped("y")).withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    p = p.select("id", "area", offset("x", "cx").alias("ox"), offset("y", "cy").alias("oy"), "cx", "cy")
    at = ["area", "cx", "cy"]
    around = lambda half: F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(0 if half else -reach, reach + 1) for j in range(-reach, reach + 1) if not half or i > 0 or j > 0]))
    i, j, ox, oy = (F.col(c) for c in ("i", "j", "ox", "oy"))
    # the cells of half the neighbourhood that the disc touches, by their least and greatest distance
    plain = (F.abs(F.col("cx")) < FAR) & (F.abs(F.col("cy")) < FAR)
    square = lambda v: v * v
    gap = lambda k, o: F.greatest(k * s - o, o - (k + 1) * s + 1, F.lit(0.0))
    far = lambda k, o: F.greatest(F.abs(k * s - o), F.abs((k + 1) * s - 1 - o))
    discs = p.select("*", around(True)).where(~plain | (square(gap(i, ox)) + square(gap(j, oy)) <= r * r))
    shifted = lambda o, c, k: F.when(F.abs(F.col(c)) < FAR, o - k * s).otherwise(o)
    inner = plain & (square(far(i, ox)) + square(far(j, oy)) <= r * r)
    discs = discs.select(F.col("id").alias("id_b"), "area", shifted(ox, "cx", i).alias("xb"), shifted(oy, "cy", j).alias("yb"), (F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), inner.alias("interior"))
    steps = [[F.col("area"), *[F.floor(F.col(c) / k).alias(c) for c in ("cx", "cy")]] for k in (256, 16, 1)]
    homes, keys, split = p, at, lambda df, v, as_home: df
    if (crowd := crowded(p, at, steps, hot_rows)[-1]) is not None:
        near = crowd.select("area", "cx", "cy", "n_salts", around(False)).select("area", (F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), F.lit(1).alias("n_homes"), "n_salts")
        near = near.union(crowd.select(*at, "n_salts", "n_salts")).groupBy(*at).agg(F.max("n_homes").alias("n_homes"), F.sum("n_salts").cast("int").alias("n_discs"))
        hot, keys = F.broadcast(near), [*at, "salt", "salt_b"]
        sizes = {c: F.coalesce(c, F.lit(1)) for c in ("n_homes", "n_discs")}

        def split(df: DataFrame, v: str, as_home: bool) -> DataFrame:
            mine, others = ("n_homes", "n_discs") if as_home else ("n_discs", "n_homes")
            salt, copy = F.pmod(F.xxhash64(v), sizes[mine]).cast("int"), F.explode(F.sequence(F.lit(0), sizes[others] - 1))
            return df.join(hot, at, "left").select(*df.columns, *([salt.alias("salt"), copy.alias("salt_b")] if as_home else [copy.alias("salt"), salt.alias("salt_b")]))

    homes = split(p, "id", True)
    exact = lambda a, b: square(ox - F.col(a)) + square(oy - F.col(b)) <= r * r
    others = split(p, "id", False).withColumnsRenamed({"id": "id_b", "ox": "xb", "oy": "yb"})
    same = homes.join(others, keys).where((F.col("id") < F.col("id_b")) & (plain | exact("xb", "yb")))
    apart = homes.join(split(discs, "id_b", False), keys).where((F.col("id") != F.col("id_b")) & (F.col("interior") | exact("xb", "yb")))
    met = same.select("id", "id_b").union(apart.select("id", "id_b"))
    # a pair meets in one cell only, unless an id has several positions
    return met.select(F.least("id", "id_b").alias("id_1"), F.greatest("id", "id_b").alias("id_2")).distinct()


def crowded(p: DataFrame, names: list[str], steps: list[list[F.Column]], hot_rows: int) -> list[DataFrame | None]:
    """For each step, from wide cells to narrow ones within them, the cells of too many points, as `hot_keys` has them.

    Narrow cells are counted only within crowded wide ones; None stands for no crowd. The lists are small
    tables of a proven bound.
    """
    rows, out, within = p.count(), [], None
    tmp = Scratch(p.sparkSession, "crowds")
    for step in steps:
        if rows <= hot_rows or (out and out[-1] is None):
            out.append(None)
            continue
        q = p
        if within is not None:
            wide, found = within
            q = p.withColumns({f"_{n}": c for n, c in zip(names, wide)}).join(F.broadcast(found.select(*[F.col(n).alias(f"_{n}") for n in names])), [f"_{n}" for n in names], "left_semi")
        found, _ = tmp.cut(hot_keys(q.select(*[c.alias(n) for n, c in zip(names, step)]), names, hot_rows, total=rows))
        within = step, found
        out.append(None if found.isEmpty() else found)
    return out


def corners(ring_x: np.ndarray, ring_y: np.ndarray) -> np.ndarray | None:
    """The corners of a ring without the repeated first one; None if it has fewer than three or a bad value."""
    if ring_x is None or ring_y is None or len(ring_x) != len(ring_y) or len(ring_x) < 3:
        return None
    p = np.array([ring_x, ring_y], dtype=float).T
    if not np.isfinite(p).all():
        return None
    if (p[0] == p[-1]).all():
        p = p[:-1]
    return p if len(p) >= 3 else None


def contains(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd rule for many points at once: sides by points."""
    (x1, y1), (x2, y2) = p.T[:, :, None], np.concatenate((p[1:], p[:1])).T[:, :, None]
    rise = np.where(y1 == y2, 1.0, y2 - y1)
    hits = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / rise + x1)
    return hits.sum(axis=0) % 2 == 1


def size_of(level: int) -> float:
    return LEAST_SIZE * float(RATIO) ** level


def _runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position within the owner) of counts[k] items for each owner k."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


class _Sides:
    """The sides of many polygons in flat arrays."""

    def __init__(self, rings: list[np.ndarray]):
        self.n = np.array([len(p) for p in rings])
        self.start = np.cumsum(self.n) - self.n
        p = np.concatenate(rings)
        q = np.concatenate([np.concatenate((r[1:], r[:1])) for r in rings])
        self.x1, self.y1, self.x2, self.y2 = p[:, 0], p[:, 1], q[:, 0], q[:, 1]
        self.low = np.minimum.reduceat(p, self.start, axis=0)
        self.high = np.maximum.reduceat(p, self.start, axis=0)

    def touch(self, side: np.ndarray, x0: np.ndarray, y0: np.ndarray, size: float) -> np.ndarray:
        """Whether each side touches the closed cell it is paired with."""
        first, last = np.zeros(len(side)), np.ones(len(side))
        for a, b, lo in ((self.x1, self.x2, x0), (self.y1, self.y2, y0)):
            a, d = a[side], b[side] - a[side]
            flat = d == 0
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                u, v = (lo - a) / d, (lo + size - a) / d
            if flat.any():  # a side along the other axis is in the cell's strip or it is not
                within = (a[flat] >= lo[flat]) & (a[flat] <= lo[flat] + size)
                u[flat], v[flat] = np.where(within, 0.0, 2.0), np.where(within, 1.0, 2.0)
            np.maximum(first, np.minimum(u, v), out=first)
            np.minimum(last, np.maximum(u, v), out=last)
        return first <= last

    def inside(self, poly: np.ndarray, x: np.ndarray, cy: np.ndarray, size: float) -> np.ndarray:
        """Even-odd rule for centres of cells: each row of cells of a polygon is scanned once."""
        out = np.zeros(len(poly), bool)
        rows, row = np.unique(np.stack((poly, cy)), axis=1, return_inverse=True)
        row = row.ravel()
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(rows.shape[1] + 1))
        work = np.cumsum(self.n[rows[0]]) // (64 * CHUNK)
        for k in np.unique(work):
            some = np.flatnonzero(work == k)
            owner, nth = _runs(self.n[rows[0, some]])
            side = self.start[rows[0, some[owner]]] + nth
            y = (rows[1, some[owner]] + 0.5) * size
            hit = (self.y1[side] > y) != (self.y2[side] > y)
            side, y, owner = side[hit], y[hit], owner[hit]
            cut = (self.x2[side] - self.x1[side]) * (y - self.y1[side]) / (self.y2[side] - self.y1[side]) + self.x1[side]
            q = order[ends[some[0]] : ends[some[-1] + 1]]
            # cuts and centres in order of row and place: a centre is inside if an odd number of cuts lies behind it
            keys = np.concatenate((owner, row[q] - some[0]))
            turn = np.lexsort((np.repeat([0, 1], [len(cut), len(q)]), np.concatenate((cut, x[q])), keys))
            is_cut = turn < len(cut)
            seen = np.cumsum(is_cut)
            total = np.cumsum(np.bincount(owner, minlength=len(some)))
            behind = np.empty(len(turn), np.int64)
            behind[turn] = total[keys[turn]] - seen
            out[q] = behind[len(cut) :] % 2 == 1
        return out


def cover_all(rings: list[np.ndarray]) -> Iterator[tuple]:
    """(polygon, level, cell x, cell y, is interior, sides, sides of each cell) of the cells that cover polygons, level by level.

    A polygon starts with cells no wider than it is; those that its outline touches are split, DEPTH times
    at most. Sides are numbers in `_Sides`, of boundary cells only: those that cross the cell's strip of
    rows and do not end left of it; no other can change the even-odd rule for a point of the cell.
    """
    g = _Sides(rings)
    extent = (g.high - g.low).max(axis=1)
    top = np.floor(np.log(np.maximum(extent / LEAST_SIZE, 1.0)) / np.log(RATIO)).astype(int)
    # far from the origin cells must be so wide that their numbers are exact
    far = np.abs(np.stack((g.low, g.high))).max(axis=(0, 2)) / FAR
    exact = np.ceil(np.log(np.maximum(far / LEAST_SIZE, 1.0)) / np.log(RATIO)).astype(int)
    top = np.maximum(top, exact)
    least = np.maximum(exact, top - DEPTH)
    none = np.zeros(0, np.int64)
    poly = cx = cy = cell = side = none
    for k in range(top.max(), -1, -1):
        size = size_of(k)
        new = np.flatnonzero(top == k)
        if len(new):
            first, last = np.floor(g.low[new] / size).astype(np.int64), np.floor(g.high[new] / size).astype(np.int64)
            width = last - first + 1
            owner, nth = _runs(width[:, 0] * width[:, 1])
            own, pos = _runs(g.n[new[owner]])
            cell, side = np.concatenate((cell, own + len(poly))), np.concatenate((side, g.start[new[owner[own]]] + pos))
            poly = np.concatenate((poly, new[owner]))
            cx, cy = np.concatenate((cx, first[owner, 0] + nth % width[owner, 0])), np.concatenate((cy, first[owner, 1] + nth // width[owner, 0]))
        if not len(poly):
            continue
        hit = g.touch(side, cx[cell] * size, cy[cell] * size, size)
        cell, side = cell[hit], side[hit]
        edge = np.zeros(len(poly), bool)
        edge[cell] = True
        rest = np.flatnonzero(~edge)  # cells off the outline are wholly inside or wholly outside
        if len(rest):
            full = rest[g.inside(poly[rest], (cx[rest] + 0.5) * size, cy[rest], size)]
            yield poly[full], k, cx[full], cy[full], np.ones(len(full), bool), none, np.zeros(len(full), np.int64)
        done = np.flatnonzero(edge & (least[poly] == k))
        if len(done):
            yield (poly[done], k, cx[done], cy[done], np.zeros(len(done), bool), *_deciding(g, poly[done], cx[done] * size, cy[done] * size, size))
        split = np.flatnonzero(edge & (least[poly] < k))
        number = np.full(len(poly), -1)
        number[split] = np.arange(len(split))
        keep = number[cell] >= 0
        n = RATIO * RATIO
        cell, side = (number[cell[keep]][:, None] * n + np.arange(n)).ravel(), np.repeat(side[keep], n)
        poly = np.repeat(poly[split], n)
        cx, cy = (cx[split, None] * RATIO + np.arange(n) % RATIO).ravel(), (cy[split, None] * RATIO + np.arange(n) // RATIO).ravel()


def _deciding(g: _Sides, poly: np.ndarray, x0: np.ndarray, y0: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """(sides, sides of each cell) that can be hit by a ray from a point of a cell along x."""
    found, counts = [], np.zeros(len(poly), np.int64)
    work = np.cumsum(g.n[poly]) // (64 * CHUNK)
    slack = size * 1e-6
    for k in np.unique(work):
        some = np.flatnonzero(work == k)
        owner, nth = _runs(g.n[poly[some]])
        side, at = g.start[poly[some[owner]]] + nth, some[owner]
        ok = (np.maximum(g.y1[side], g.y2[side]) >= y0[at] - slack) & (np.minimum(g.y1[side], g.y2[side]) <= y0[at] + size + slack)
        ok &= (np.maximum(g.x1[side], g.x2[side]) >= x0[at] - slack) & (g.y1[side] != g.y2[side])
        found.append(side[ok])
        counts[some] = np.bincount(owner[ok], minlength=len(some))
    return np.concatenate(found), counts


def cover(p: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, cell x, cell y, is interior) of the cells that cover one polygon, adaptively split."""
    return [(size_of(k), cx, cy, inner) for _, k, cx, cy, inner, _, _ in cover_all([p])]


def polygon_cells(regions: DataFrame, region: str, area: str, ring_x: str, ring_y: str) -> DataFrame:
    """(region, area, level, cx, cy, interior, sides): the cells of each polygon; sides only on boundary cells.

    Regions with a null id or area, and rings that `corners` rejects, have no cells. Polygons are covered
    many at a time, in pieces of about CHUNK sides.
    """
    r = regions.select(F.col(region).alias("region"), F.col(area).alias("area"), F.col(ring_x).cast("array<double>").alias("xs"), F.col(ring_y).cast("array<double>").alias("ys")).where("region is not null and area is not null and size(xs) > 2 and size(xs) = size(ys)")
    schema = f"region {r.schema['region'].dataType.simpleString()}, area {r.schema['area'].dataType.simpleString()}, level int, cx bigint, cy bigint, interior boolean, sides array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, areas = b.column(0), b.column(1)
            rings, at, n = [], [], 0
            for i, (xs, ys) in enumerate(zip(b.column(2), b.column(3))):
                if (p := corners(xs.values.to_numpy(zero_copy_only=False), ys.values.to_numpy(zero_copy_only=False))) is not None:
                    rings.append(p)
                    at.append(i)
                    n += len(p)
                if rings and (n >= CHUNK or i + 1 == b.num_rows):
                    yield from _batches(rings, ids.take(pa.array(at)), areas.take(pa.array(at)))
                    rings, at, n = [], [], 0
            if rings:
                yield from _batches(rings, ids.take(pa.array(at)), areas.take(pa.array(at)))

    return r.mapInArrow(run, schema)


def _batches(rings: list[np.ndarray], ids: pa.Array, areas: pa.Array) -> Iterator[pa.RecordBatch]:
    g = _Sides(rings)
    names = ["region", "area", "level", "cx", "cy", "interior", "sides"]
    ends = np.stack((g.x1, g.y1, g.x2, g.y2), axis=1)
    for poly, k, cx, cy, inner, side, counts in cover_all(rings):
        sides = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(4 * counts))), pa.int32()), pa.array(ends[side].ravel()))
        of = pa.array(poly)
        yield pa.RecordBatch.from_arrays([ids.take(of), areas.take(of), pa.array(np.full(len(poly), k, np.int32)), pa.array(cx), pa.array(cy), pa.array(inner), sides], names=names)


def local_rings(regions: DataFrame, areas: DataFrame, area: str = "area_id", lat: str = "building_lat", lon: str = "building_lon") -> DataFrame:
    """Rings as local metres of their area, in xs and ys. Regions of an unknown area are dropped."""
    r = regions.join(areas.select(F.col("area_id").alias(area), F.col("min_lat").alias("_lat0"), F.col("min_lon").alias("_lon0")), area)
    xs = F.transform(lat, lambda v: (v - F.col("_lat0")) * METRES_PER_DEGREE)
    ys = F.transform(lon, lambda v: (v - F.col("_lon0")) * METRES_PER_DEGREE * F.cos(F.radians("_lat0")))
    return r.withColumns({"xs": xs, "ys": ys}).drop("_lat0", "_lon0")


def containing_regions(points: DataFrame, regions: DataFrame, point: str = "node_id", area: str = "area_id", x: str = "node_x", y: str = "node_y", region: str = "building_id", ring_x: str = "xs", ring_y: str = "ys", hot_rows: int = 100_000) -> DataFrame:
    """Distinct (region, id): regions whose ring contains a point of the same area.

    Rings may be open or closed and concave; null, empty, unequal or short rings and rings with a null
    or NaN corner contain nothing. Points as in `near_pairs`. Only points in boundary cells are tested.
    """
    p, _ = Scratch(points.sparkSession, "inside").cut(known_points(points, point, area, x, y))
    return containing_known(p, regions, area, region, ring_x, ring_y, hot_rows)


def containing_known(p: DataFrame, regions: DataFrame, area: str = "area_id", region: str = "building_id", ring_x: str = "xs", ring_y: str = "ys", hot_rows: int = 100_000) -> DataFrame:
    """`containing_regions` of what `known_points` gave, written to a table.

    Points are joined with the cells of each level in use; those of a crowded cell are spread over salts,
    to which the polygons' cells there are copied.
    """
    tmp = Scratch(p.sparkSession, "cells")
    rings = regions.select(region, area, ring_x, ring_y).dropDuplicates()
    cells, path = tmp.cut(polygon_cells(rings, region, area, ring_x, ring_y), by="level")
    # a level for each power of RATIO between the least cells and the widest polygon
    used = sorted((r[0] for r in cells.select("level").distinct().collect()), reverse=True)
    at = ["area", "cx", "cy"]
    cell = lambda c, k: F.floor(F.col(c) / F.lit(size_of(k))).cast("bigint").alias(f"c{c}")
    steps = [[F.col("area"), cell("x", k), cell("y", k)] for k in used]
    met = []
    for k, step, hot in zip(used, steps, crowded(p, at, steps, hot_rows)):
        # read alone, so that the planner knows the size of each level
        some = p.sparkSession.read.schema(cells.drop("level").schema).parquet(f"{path}/level={k}")
        placed, keys = p.select("id", "x", "y", *step), at
        if hot is not None:
            n, keys = F.coalesce("n_salts", F.lit(1)), [*at, "salt"]
            placed = placed.join(F.broadcast(hot), at, "left").select(*placed.columns, F.pmod(F.xxhash64("id"), n).cast("int").alias("salt"))
            some = some.join(F.broadcast(hot), at, "left").select(*some.columns, F.explode(F.sequence(F.lit(0), n - 1)).alias("salt"))
        met.append(placed.join(some, keys).where(F.col("interior") | sides_contain("x", "y")).select("region", "id"))
    if not met:
        return cells.join(p, F.lit(False)).select("region", "id")
    return reduce(DataFrame.union, met).distinct()


def sides_contain(x: str, y: str) -> F.Column:
    """The exact even-odd test as an expression over the deciding sides of a boundary cell: x1, y1, x2, y2 of one after the other."""
    px, py = F.col(x), F.col(y)

    def crossed(i: F.Column) -> F.Column:
        x1, y1, x2, y2 = (F.get("sides", i + k) for k in range(4))
        return ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)

    places = F.when(F.size("sides") > 0, F.sequence(F.lit(0), F.size("sides") - 1, F.lit(4)))
    return F.coalesce(F.size(F.filter(places, crossed)) % 2 == 1, F.lit(False))
