"""Scalar geometry and small arithmetic as column expressions, with driver-side twins where kernels need them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS-84 ellipsoid (fixed values).
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563


def squared_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def within(x1: Column, y1: Column, x2: Column, y2: Column, radius: float) -> Column:
    """Inclusive."""
    return squared_distance(x1, y1, x2, y2) <= radius * radius


def edge_type(d2: Column, short: float, long: float) -> Column:
    """short, long or null by squared distance."""
    return F.when(d2 <= short * short, "short").when(d2 <= long * long, "long")


def cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(size)).cast("bigint")


def linear_cell(i: Column, j: Column, max_j: int) -> Column:
    return i * F.lit(max_j + 1) + j


def cell_of_linear(c: Column, max_j: int) -> tuple[Column, Column]:
    i = F.floor(c / F.lit(max_j + 1)).cast("bigint")
    return i, c - i * F.lit(max_j + 1)


def target_centre(i: Column, spacing: float, corner: bool = False) -> Column:
    """Centre of a target cell; with corner=True its lower corner, as the legacy mode has it."""
    return (i + F.lit(0.0 if corner else 0.5)) * F.lit(spacing)


bin_centre = target_centre


def half_away(v: Column) -> Column:
    """Rounds halves away from zero."""
    return F.round(v).cast("bigint")


def half_away_py(v: float) -> int:
    return math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1)


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d, null where d is not positive."""
    return F.when(d > 0, n / d)


def choose(n: int, r: int) -> int:
    return math.comb(n, r) if 0 <= r <= n else 0


def meridian_metres(lat1: Column, lat2: Column) -> Column:
    """Length of the meridian arc between two latitudes on WGS-84, by the series in the third flattening."""
    n = WGS84_F / (2 - WGS84_F)
    a0 = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    terms = [(-3 / 2 * (n - n**3 / 8), 2), (15 / 16 * (n**2 - n**4 / 4), 4), (-35 / 48 * n**3, 6), (315 / 512 * n**4, 8)]

    def arc(lat: Column) -> Column:
        p = F.radians(lat)
        return a0 * (p + sum((F.lit(c) * F.sin(F.lit(float(k)) * p) for c, k in terms), F.lit(0.0)))

    return F.abs(arc(lat2) - arc(lat1))


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once instead of copied into every place."""
    return F.transform(F.array(value), body)[0]


def parallel_metres(lat: Column, lon1: Column, lon2: Column, rounds: int = 8) -> Column:
    """Geodesic distance between two points of one latitude on WGS-84, by Vincenty's inverse formula.

    Null where it does not converge (nearly antipodal points) and for null arguments.
    """
    f, b = WGS84_F, WGS84_A * (1 - WGS84_F)

    def with_basis(u: Column) -> Column:
        # u: reduced latitude (sine, cosine) and difference in longitude
        su, cu, start = u["s"], u["c"], u["l"]

        def angles(lam: Column) -> Column:
            ss2 = cu * F.sin(lam) * cu * F.sin(lam) + cu * su * (1 - F.cos(lam)) * cu * su * (1 - F.cos(lam))
            return F.struct(F.sqrt(ss2).alias("ss"), (su * su + cu * cu * F.cos(lam)).alias("cs"), lam.alias("lam"))

        def azimuth(v: Column) -> Column:
            sa = F.when(v["ss"] == 0, F.lit(0.0)).otherwise(cu * cu * F.sin(v["lam"]) / v["ss"])
            return F.struct(v["ss"].alias("ss"), v["cs"].alias("cs"), v["lam"].alias("lam"), F.atan2(v["ss"], v["cs"]).alias("sigma"), sa.alias("sa"), (1 - sa * sa).alias("c2"))

        def middle(v: Column) -> Column:
            cm = F.when(v["c2"] == 0, F.lit(0.0)).otherwise(v["cs"] - 2 * su * su / v["c2"])
            return F.struct(v.alias("v"), cm.alias("cm"), (F.lit(f / 16) * v["c2"] * (4 + f * (4 - 3 * v["c2"]))).alias("c"))

        def state(lam: Column) -> Column:
            return let(let(angles(lam), azimuth), middle)

        def following(m: Column) -> Column:
            v, cm, c = m["v"], m["cm"], m["c"]
            return start + (1 - c) * f * v["sa"] * (v["sigma"] + c * v["ss"] * (cm + c * v["cs"] * (-1 + 2 * cm * cm)))

        def length(m: Column) -> Column:
            v, cm = m["v"], m["cm"]
            u2 = v["c2"] * ((WGS84_A**2 - b**2) / b**2)
            ka = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
            kb = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
            d = kb * v["ss"] * (cm + kb / 4 * (v["cs"] * (-1 + 2 * cm * cm) - kb / 6 * cm * (-3 + 4 * v["ss"] * v["ss"]) * (-3 + 4 * cm * cm)))
            return F.when(F.abs(following(m) - v["lam"]) < 1e-9, b * ka * (v["sigma"] - d))

        lam = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda x, _: let(state(x), following))
        return let(let(lam, state), length)

    u = F.atan(F.lit(1 - f) * F.tan(F.radians(lat)))
    return let(F.struct(F.sin(u).alias("s"), F.cos(u).alias("c"), F.abs(F.radians(lon2 - lon1)).alias("l")), with_basis)


def grid_ray(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Cells (x, y) that a segment between two integer cells passes, in order: 1 + dx + dy of them.

    At a tie the step goes in x first. A deterministic fold; explode it to join on cells.
    """
    dx, dy = F.abs(x1 - x0), F.abs(y1 - y0)
    sx, sy = F.signum(x1 - x0).cast("bigint"), F.signum(y1 - y0).cast("bigint")
    at = lambda x, y: F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"))
    first = F.struct(x0.cast("bigint").alias("x"), y0.cast("bigint").alias("y"), (dx - dy).cast("bigint").alias("e"), F.array(at(x0, y0)).alias("cells"))

    def step(s: Column, _: Column) -> Column:
        in_x = (s["e"] >= 0) & (dx > 0)
        x, y = F.when(in_x, s["x"] + sx).otherwise(s["x"]), F.when(in_x, s["y"]).otherwise(s["y"] + sy)
        e = F.when(in_x, s["e"] - 2 * dy).otherwise(s["e"] + 2 * dx)
        return F.struct(x.alias("x"), y.alias("y"), e.cast("bigint").alias("e"), F.concat(s["cells"], F.array(at(x, y))).alias("cells"))

    steps = F.when(dx + dy > 0, F.sequence(F.lit(1).cast("bigint"), (dx + dy).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, first, step)["cells"]


def crosses(ax: Column, ay: Column, bx: Column, by: Column, ring: Column, eps: float = 1e-9) -> Column:
    """Whether a segment crosses a ring (array of struct x, y, open): part of it strictly inside, part outside.

    A segment wholly inside, and one that only touches the outline, does not cross. The segment is cut
    where it meets the sides; each piece is judged by its midpoint.
    """
    turned = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    sides = F.zip_with(ring, turned, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"), (q["x"] - p["x"]).alias("ex"), (q["y"] - p["y"]).alias("ey")))
    dx, dy = bx - ax, by - ay

    def cut(s: Column) -> Column:
        den = dx * s["ey"] - dy * s["ex"]
        t = ((s["x1"] - ax) * s["ey"] - (s["y1"] - ay) * s["ex"]) / den
        v = ((s["x1"] - ax) * dy - (s["y1"] - ay) * dx) / den
        return F.when((F.abs(den) > eps) & (t > 0) & (t < 1) & (v >= -eps) & (v <= 1 + eps), t)

    def side_of(m: Column, of: Column) -> Column:
        """1 strictly inside, -1 strictly outside, 0 on the outline."""
        return let(F.struct((ax + dx * m).alias("x"), (ay + dy * m).alias("y")), lambda p: placed(p["x"], p["y"], of))

    def placed(px: Column, py: Column, of: Column) -> Column:
        hits = F.size(F.filter(of, lambda s: ((s["y1"] > py) != (s["y2"] > py)) & (px < s["ex"] * (py - s["y1"]) / s["ey"] + s["x1"])))

        def on(s: Column) -> Column:
            cross = F.abs((px - s["x1"]) * s["ey"] - (py - s["y1"]) * s["ex"])
            dot = (px - s["x1"]) * s["ex"] + (py - s["y1"]) * s["ey"]
            square = s["ex"] * s["ex"] + s["ey"] * s["ey"]
            return (cross <= 1e-7 * F.greatest(F.lit(1.0), F.sqrt(square))) & (dot >= 0) & (dot <= square)

        return F.when(F.exists(of, on), 0).when(hits % 2 == 1, 1).otherwise(-1)

    def judged(of: Column) -> Column:
        cuts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.filter(F.transform(of, cut), lambda t: t.isNotNull())))
        return let(cuts, lambda c: let(F.filter(F.zip_with(c, F.slice(c, F.lit(2), F.size(c)), lambda p, q: F.when(q - p > 1e-7, (p + q) / 2)), lambda m: m.isNotNull()), lambda m: F.transform(m, lambda v: side_of(v, of))))

    # each part is bound once: sides, cuts, pieces and places
    found = let(let(sides, judged), lambda v: F.array_contains(v, 1) & F.array_contains(v, -1))
    return F.coalesce(found, F.lit(False))
