"""Variants of the planning steps as earlier records have them, each behind its own name.

They differ from `kernels` in rules, not in form: graphs are dicts of sets, and ties go to the smallest id.
"""

from __future__ import annotations

import heapq
import math
import random

from ..functions.geometry import choose
from . import kernels as K
from .kernels import Graph, Grid


def gateways(g: Graph, n_nodes: int, ratio: float, seed: int | random.Random) -> list[int]:
    """One node of each component, then any nodes up to 1 + the whole part of ratio * n; edges do not matter."""
    r = seed if isinstance(seed, random.Random) else random.Random(seed)
    parts, nodes = K.thin_components(g), sorted(g)
    quota = min(max(1 + int(ratio * n_nodes), len(parts)), len(nodes))
    out = [p[int(r.random() * len(p))] for p in parts]
    while len(out) < quota:
        n = nodes[int(r.random() * len(nodes))]
        if n not in out:
            out.append(n)
    return out


def cover(points: dict[int, tuple[float, float]], grid: Grid) -> list[int]:
    """A greedy cover without gateways: a node marks the targets of its circle, and all counts it shares are brought up to date."""
    circle = {n: set(grid.cells(*p, border_only=False)) for n, p in points.items()}
    by: dict[tuple[int, int], list[int]] = {}
    for n in sorted(circle):
        for c in circle[n]:
            by.setdefault(c, []).append(n)
    left = {n: len(c) for n, c in circle.items()}
    heap = [(-k, n) for n, k in left.items() if k]
    heapq.heapify(heap)
    out = []
    while heap:
        k, n = heapq.heappop(heap)
        if -k != left[n]:
            continue
        out.append(n)
        touched = set()
        for c in circle[n] & by.keys():
            for m in by.pop(c):
                left[m] -= 1
                touched.add(m)
        for m in touched:
            if left[m] > 0:
                heapq.heappush(heap, (-left[m], m))
    return out


def backbone(adj: Graph, sinks: list[int], covering: list[int], stale: bool = False) -> Graph:
    """Joins the covering nodes by shortest paths over all edges, the shortest first.

    With `stale`, distances pushed after each step are those of one fixed terminal, the last that the
    searches met, as the recorded program has it, instead of those of the node that was just joined.
    """
    terminals = list(dict.fromkeys([*sinks, *covering]))
    trees = {t: K.bfs_tree(adj, [t]) for t in terminals}
    rank = {t: k for k, t in enumerate(terminals)}
    g: Graph = {t: set() for t in terminals}
    open_ = set(covering)
    heap: list[tuple[float, int, int]] = []

    def push(t: int, among) -> None:
        for k in among:
            heapq.heappush(heap, (trees[t][0].get(k, K.INF) + 1, rank[t], rank[k]))

    for t in sinks:
        push(t, terminals)
    fixed = max((t for t in terminals if t in trees[terminals[-1]][0]), default=None) if terminals else None
    while heap and open_:
        d, i, j = heapq.heappop(heap)
        i, j = terminals[i], terminals[j]
        if j not in open_:
            continue
        if d < K.INF:
            p = K.path_to(trees[i][1], j)
            for a, b in zip(p, p[1:]):
                g.setdefault(a, set()).add(b)
                g.setdefault(b, set()).add(a)
        open_.discard(j)
        push(fixed if stale else j, sorted(open_))
    return g


def reduce_degrees(g: Graph, short: Graph, sinks: list[int]) -> tuple[Graph, int, int]:
    """(graph, greatest degree, size limit): edges move away from the nodes other than sinks of the greatest degree.

    Nodes are ranked by falling degree; those at the top give, sinks and those at least 2 below take.
    Whether a gateway is still reached is not asked. The limit is 1.1 times the nodes.
    """
    g = {n: set(v) for n, v in g.items()} | {s: set(g.get(s, ())) for s in sinks}
    gates = set(sinks)
    while True:
        ranked = sorted((n for n in g if n not in gates), key=lambda n: (-K.degree(g, n), n))
        top = K.degree(g, ranked[0]) if ranked else 0
        if top <= 1:
            break
        takers = [*sinks, *(n for n in reversed(ranked) if K.degree(g, n) <= top - 2)]
        move = None
        for n in (n for n in ranked if K.degree(g, n) == top):
            for s in sinks:
                hops, parent = K.bfs_tree(g, [s])
                below = sorted(v for v in g[n] if parent.get(v) == n)
                if n in hops and below:
                    move = next(((n, c, v) for c in takers for v in below if v in short.get(c, ()) and c not in (n, v)), None)
                    break
            if move:
                break
        if not move:
            break
        n, c, v = move
        g[n].discard(v)
        g[v].discard(n)
        g[c].add(v)
        g[v].add(c)
    return g, max((K.degree(g, n) for n in g if n not in gates), default=0), int(1.1 * len(g))


def _best(adj: Graph, g: Graph, sinks: list[int], n_max: int, trees: dict, allowed) -> tuple[list[int] | None, list[int] | None]:
    """(path of most benefit, last path that was looked at) over unordered pairs of network nodes, valued both ways."""
    gates = set(sinks)
    res = K.residual(g, gates)
    nodes = sorted(g)
    sp = {n: K.source_potential(res, n, gates) for n in nodes}
    tp = {n: K.sink_potential(res, n, gates) for n in nodes}
    best, found, last = 0.0, None, None
    for a, i in enumerate(nodes[:-1]):
        if i not in trees:
            trees[i] = K.bfs_tree(adj, [i])
        hops, parent = trees[i]
        for j in nodes[a + 1 :]:
            if j not in hops:
                continue
            last = p = K.path_to(parent, j)
            if not allowed(p):
                continue
            k = sum(x not in g for x in p)
            if k == 0 or k + len(g) > n_max:
                continue
            value = max(min(sp[i], tp[j]), min(sp[j], tp[i])) / k
            if value > best:
                best, found = value, p
    return found, last


def augment_dynamic(adj: Graph, base: Graph, sinks: list[int], n_max: int) -> Graph:
    """All edges among the network's nodes, then the new nodes of the best path, again and again, never beyond n_max nodes."""
    g = {n: base[n] | (adj.get(n, set()) & base.keys()) - {n} for n in base}
    trees: dict = {}
    while len(g) <= n_max and len(g) < len(adj):
        found, _ = _best(adj, g, sinks, n_max, trees, lambda p: True)
        if found is None:
            return g
        for x in [x for x in found if x not in g]:
            g[x] = set()
            for y in adj[x] & g.keys():
                if y != x:
                    g[x].add(y)
                    g[y].add(x)
    return g


def augment_static(adj: Graph, base: Graph, sinks: list[int], n_max: int, d_max: int, last_pair: bool = False) -> Graph:
    """Adds the best path whose ends have a free port and whose network nodes within have two; then edges up to d_max.

    With `last_pair` the path added is that of the last pair looked at instead of the best one, as the
    recorded program has it; it then stops when that path brings nothing new.
    """
    g = {n: set(v) for n, v in base.items()}
    room = lambda n: d_max - K.degree(g, n)
    allowed = lambda p: len(p) > 1 and room(p[0]) >= 1 and room(p[-1]) >= 1 and all(x not in g or room(x) >= 2 for x in p[1:-1])
    trees: dict = {}
    while len(g) <= n_max and len(g) < len(adj):
        found, last = _best(adj, g, sinks, n_max, trees, allowed)
        path = last if last_pair and found is not None else found
        if path is None or sum(x not in g for x in path) + len(g) > n_max:
            break
        before = sum(map(len, g.values())), len(g)
        for a, b in zip(path, path[1:]):
            g.setdefault(a, set()).add(b)
            g.setdefault(b, set()).add(a)
        if (sum(map(len, g.values())), len(g)) == before:
            break
    nodes = sorted(g)
    for k, u in enumerate(nodes):
        for v in nodes[k + 1 :]:
            if v in adj.get(u, ()) and v not in g[u] and room(u) >= 1 and room(v) >= 1:
                g[u].add(v)
                g[v].add(u)
    return g


def average_flow(g: Graph, sinks: list[int], share: float, patterns: int, seed: int, from_pattern: bool = False) -> tuple[float, float]:
    """(mean flow, mean bound) over patterns of a share of the nodes, rounded up.

    The sources of a pattern count for the bound only: all nodes but the sinks send, so each flow is the
    network's maximum. from_pattern lets only the sources send.
    """
    gates = set(sinks) & g.keys()
    candidates = sorted(g.keys() - gates)
    if not candidates:
        return 0.0, 0.0
    k = min(len(candidates), math.ceil(share * len(g)))
    n = min(choose(len(g), k), patterns)
    drawn = [K.pattern(candidates, k, seed, i) for i in range(n)]
    whole = None if from_pattern else K.max_flow(g, gates)
    return K.average([(K.max_flow(g, gates, p) if whole is None else whole, float(sum(K.degree(g, x) for x in p))) for p in drawn])


def raise_degrees(g: Graph, adj: Graph, sinks: list[int], goal: float, share: float, patterns: int, seed: int) -> tuple[Graph, int, float]:
    """(graph, degree limit, mean flow): adds edges from what the source still reaches to what still reaches the sink.

    The first end may have one edge more than the limit, the second may not; the limit rises by one until the mean flow
    reaches the goal or no edge can be added.
    """
    g = {n: set(v) for n, v in g.items()}
    gates = set(sinks) & g.keys()
    limit = max((K.degree(g, n) for n in g), default=0)
    flow = average_flow(g, sinks, share, patterns, seed, from_pattern=True)[0]
    while flow < goal:
        grown = False
        while True:
            res = K.residual(g, gates)
            ahead, behind = _reached(res, K.SRC), _reached(res, K.SNK)
            edge = next(((i, j) for i in ahead for j in behind if i != j and j in adj.get(i, ()) and j not in g[i] and K.degree(g, i) < limit + 1 and K.degree(g, j) < limit), None)
            if edge is None:
                break
            g[edge[0]].add(edge[1])
            g[edge[1]].add(edge[0])
            grown = True
        flow = average_flow(g, sinks, share, patterns, seed, from_pattern=True)[0]
        limit += 1
        if not grown:
            break
    return g, limit, flow


def _reached(res: K.Flow, start: int) -> list[int]:
    """Nodes that residual arcs lead to from a node, in the direction of the arcs."""
    seen, todo = {start}, [start]
    while todo:
        for e in res.out.get(todo.pop(), ()):
            if res.cap[e] > 0 and res.to[e] not in seen:
                seen.add(res.to[e])
                todo.append(res.to[e])
    return sorted(seen - {K.SRC, K.SNK})
