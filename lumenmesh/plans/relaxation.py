"""The relaxed placement program: an upper bound for the flow of any network of a given size.

Constraints are coordinate rows; the program is solved by a primal-dual hybrid gradient kernel in numpy.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

from .kernels import Graph, edges_of


class Solution(NamedTuple):
    bound: float
    residual: float
    gap: float
    x: np.ndarray
    converged: bool
    rounds: int


class Program:
    """maximise c.x subject to A.x <= b (or = b) and bounds, built row by row."""

    def __init__(self) -> None:
        self.names: dict[tuple, int] = {}
        self.low: list[float] = []
        self.high: list[float] = []
        self.rows: list[tuple[list[int], list[float], float, bool]] = []
        self.goal: dict[int, float] = {}

    def var(self, *name, low: float = 0.0, high: float = np.inf) -> int:
        if name not in self.names:
            self.names[name] = len(self.low)
            self.low.append(low)
            self.high.append(high)
        return self.names[name]

    def row(self, terms: Iterable[tuple[int, float]], bound: float, equal: bool = False) -> None:
        i, v = zip(*terms)
        self.rows.append((list(i), list(v), bound, equal))

    def coordinates(self) -> list[tuple[int, int, float]]:
        """(row, column, value) of the constraint matrix."""
        return [(r, i, v) for r, (cols, vals, _, _) in enumerate(self.rows) for i, v in zip(cols, vals)]

    def certify(self, rounds: int = 20_000, tolerance: float = 1e-4) -> Solution:
        """Solves the program until residual and gap, relative to the sizes of b and the goal, are within the tolerance.

        The bound is the least dual objective met. It holds for any multipliers, so also if rounds run out; only
        how close it is to the optimum is then unknown, and `converged` is false. Steps are restarted from the
        better of the last and the mean iterate, and balanced anew at each restart.
        """
        m, n = len(self.rows), len(self.low)
        sizes = [len(x[0]) for x in self.rows]
        r = np.repeat(np.arange(m), sizes)
        c = np.fromiter((i for x in self.rows for i in x[0]), np.int64, len(r))
        v = np.fromiter((w for x in self.rows for w in x[1]), float, len(r))
        b = np.array([x[2] for x in self.rows])
        equal = np.array([x[3] for x in self.rows])
        cost = np.zeros(n)
        for i, w in self.goal.items():
            cost[i] = -w
        low, high = np.array(self.low), np.array(self.high)
        times, back = (lambda x: np.bincount(r, v * x[c], m)), (lambda y: np.bincount(c, v * y[r], n))
        # diagonal steps: each row and column is scaled by its own absolute sum
        tau = 0.9 / np.maximum(np.bincount(c, np.abs(v), n), 1e-9)
        sigma = 0.9 / np.maximum(np.bincount(r, np.abs(v), m), 1e-9)
        scale = 1 + float(np.max(np.abs(b), initial=0.0))

        def judge(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
            """(dual objective, residual, gap) as a maximum; columns take the bound that their reduced cost asks for."""
            reduced = cost + back(y)
            end = np.where(reduced > 0, low, high)
            dual = float(b @ y - np.sum(np.where(reduced == 0, 0.0, reduced) * np.where(reduced == 0, 0.0, end)))
            off = times(x) - b
            off = float(np.max(np.where(equal, np.abs(off), np.maximum(off, 0)), initial=0.0)) / scale
            value = float(-cost @ x)
            return dual, off, abs(dual - value) / (1 + abs(dual) + abs(value)) if np.isfinite(dual) else np.inf

        x, y = np.clip(np.zeros(n), low, high), np.zeros(m)
        x0, y0, sx, sy, k, since, weight = x, y, np.zeros(n), np.zeros(m), 0, np.inf, 1.0
        best = np.inf
        for t in range(1, rounds + 1):
            x1 = np.clip(x - tau / weight * (cost + back(y)), low, high)
            y1 = y + sigma * weight * (times(2 * x1 - x) - b)
            y = np.where(equal, y1, np.maximum(y1, 0))
            x = x1
            sx, sy, k = sx + x, sy + y, k + 1
            if t % 100 and t < rounds:
                continue
            marks = [(*judge(*p), p) for p in ((x, y), (sx / k, sy / k))]
            best = min(best, *(d for d, *_ in marks))
            dual, off, gap, at = min(marks, key=lambda q: max(q[1], q[2]))
            error = max(off, gap)
            if error <= tolerance:
                return Solution(best, off, gap, at[0], True, t)
            if error <= 0.5 * since or k >= 0.3 * t:
                dx, dy = np.linalg.norm((at[0] - x0) / np.sqrt(tau)), np.linalg.norm((at[1] - y0) / np.sqrt(sigma))
                if dx > 1e-9 and dy > 1e-9:
                    weight = float(np.sqrt(weight * dy / dx))
                x, y = at
                x0, y0, sx, sy, k, since = x, y, np.zeros(n), np.zeros(m), 0, error
        return Solution(best, off, gap, at[0], False, rounds)

    def solve(self, rounds: int = 20_000, tolerance: float = 1e-4) -> tuple[float, np.ndarray]:
        """(bound, primal solution); raises ArithmeticError if rounds run out before both are within the tolerance."""
        s = self.certify(rounds, tolerance)
        if not s.converged:
            raise ArithmeticError(f"not solved in {rounds} rounds: residual {s.residual:.2g}, gap {s.gap:.2g}")
        return s.bound, s.x


def placement_program(adj: Graph, short: Graph, sinks: list[int], targets: list[list[int]], n_max: int, d_max: int, wide: bool = False) -> Program:
    """Nodes X and Y (in the network, in the backbone), edges E and B, backbone flow F and traffic flow G.

    With `wide`, the other recorded set of bounds: the backbone may take any edge and have any degree at sinks, and
    backbone and traffic flow are bounded by the number of nodes instead of by 1 and by degrees.
    """
    p = Program()
    nodes, gates = sorted(adj), set(sinks)
    pairs = [e for e in edges_of(adj) if e[0] != e[1]]
    arcs = pairs + [(v, u) for u, v in pairs]
    x = {n: p.var("X", n, high=1.0, low=1.0 if n in gates else 0.0) for n in nodes}
    y = {n: p.var("Y", n, high=1.0, low=1.0 if n in gates else 0.0) for n in nodes}
    e = {a: p.var("E", *sorted(a), high=1.0) for a in arcs}
    bb = {a: p.var("B", *sorted(a), high=1.0 if wide or a[1] in short.get(a[0], ()) else 0.0) for a in arcs}
    f = {a: p.var("F", *a, high=1.0) for a in arcs}
    g = {a: p.var("G", *a, high=1.0) for a in arcs}
    most = (lambda n: float(len(nodes))) if wide else (lambda n: float(len(adj[n])))
    ft = {n: p.var("FT", n, high=(float(len(nodes)) if wide else 1.0) if n in gates else 0.0) for n in nodes}
    gs = {n: p.var("GS", n, high=0.0 if n in gates else most(n)) for n in nodes}
    gt = {n: p.var("GT", n, high=float(len(adj[n])) if n in gates else 0.0) for n in nodes}
    near: dict[int, list[tuple[int, int]]] = {n: [] for n in nodes}
    for a in arcs:
        near[a[0]].append(a)
    for u, v in pairs:
        p.row([(e[u, v], 2.0), (x[u], -1.0), (x[v], -1.0)], 0.0)
        p.row([(bb[u, v], 1.0), (e[u, v], -1.0)], 0.0)
        p.row([(bb[u, v], 2.0), (y[u], -1.0), (y[v], -1.0)], 0.0)
    for n in nodes:
        p.row([(y[n], 1.0), (x[n], -1.0)], 0.0)
        fed = [] if n in gates or not near[n] else [(y[n], -1.0 / len(nodes))]
        if near[n]:
            p.row([(f[a], 1.0) for a in near[n]] + [(f[a[::-1]], -1.0) for a in near[n]] + [(ft[n], 1.0)] + fed, 0.0, True)
            p.row([(g[a], 1.0) for a in near[n]] + [(g[a[::-1]], -1.0) for a in near[n]] + [(gt[n], 1.0), (gs[n], -1.0)], 0.0, True)
            if not (wide and n in gates):
                p.row([(bb[a], 1.0) for a in near[n]], float(d_max))
        if n not in gates:
            p.row([(gs[n], 1.0), (x[n], -most(n))], 0.0)
    for a in arcs:
        p.row([(f[a], 1.0), (bb[a], -1.0)], 0.0)
        p.row([(g[a], 1.0), (e[a], -1.0)], 0.0)
    for t in targets:
        if t:
            p.row([(y[n], -1.0) for n in t], -1.0)
    p.row([(x[n], 1.0) for n in nodes], float(n_max + len(gates & set(nodes))))
    for n in nodes:
        p.goal[gs[n]] = 1.0
    return p
