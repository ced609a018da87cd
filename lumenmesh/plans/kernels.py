"""Order-dependent graph heuristics and flows for one scenario, run inside grouped Arrow tasks.

Graphs of some hundred to some thousand nodes; scenarios, samples, patterns and source nodes run in parallel.
Ties always go to the smallest id. A graph is a dict from a node to the set of its neighbours.
"""

from __future__ import annotations

import heapq
import random
from collections import deque
from dataclasses import dataclass

from ..functions.geometry import half_away_py

Graph = dict[int, set[int]]
INF = float("inf")
SRC, SNK = -1, -2


def graph_of(edges, nodes=()) -> Graph:
    g: Graph = {int(n): set() for n in nodes}
    for u, v in edges:
        g.setdefault(int(u), set()).add(int(v))
        g.setdefault(int(v), set()).add(int(u))
    return g


def edges_of(g: Graph) -> list[tuple[int, int]]:
    return sorted((u, v) for u in g for v in g[u] if u <= v)


def degree(g: Graph, n: int) -> int:
    return len(g[n]) + (n in g[n])


# --- points and edges -------------------------------------------------------


def random_points(seed: int, n: int, max_x: float, max_y: float) -> list[tuple[float, float]]:
    """Positions from the Mersenne twister, x and y by turns."""
    r = random.Random(seed)
    return [(r.uniform(0, max_x), r.uniform(0, max_y)) for _ in range(n)]


def capped_edges(pairs, caps: dict[str, int], max_edges: int | None = None, port_cap=None) -> list[tuple[int, int, str]]:
    """Accepts ordered pairs (u, v, type) while both ends have room for their type.

    port_cap, if given, gives the room of a node for edges of any type instead.
    """
    used: dict = {}
    out = []
    for u, v, t in pairs:
        k = (u, t) if port_cap is None else u
        m = (v, t) if port_cap is None else v
        room = (lambda x: caps[t]) if port_cap is None else port_cap
        if used.get(k, 0) < room(u) and used.get(m, 0) < room(v):
            used[k] = used.get(k, 0) + 1
            used[m] = used.get(m, 0) + 1
            out.append((u, v, t))
            if max_edges is not None and len(out) >= max_edges:
                break
    return out


def legacy_edges(points, short: float, long: float, max_short: int, max_long: int, max_edges: int) -> list[tuple[int, int, str]]:
    """The legacy edge rule: ordered pairs, self-loops included; the last node is never first, the last two never second.

    Each order of a pair is offered once; an edge that is there already takes room, and counts, again.
    """
    n, used_s, used_l, seen, offered = len(points), [0] * len(points), [0] * len(points), {}, 0
    for a in range(n - 1):
        for b in range(n - 2):
            d2 = (points[a][0] - points[b][0]) ** 2 + (points[a][1] - points[b][1]) ** 2
            if d2 <= short * short:
                t, used, cap = "short", used_s, max_short
            elif d2 <= long * long:
                t, used, cap = "long", used_l, max_long
            else:
                continue
            if used[a] < cap and used[b] < cap:
                used[a] += 1
                used[b] += 1
                seen[min(a, b), max(a, b)] = t
                offered += 1
                if offered == max_edges:
                    return [(u, v, k) for (u, v), k in sorted(seen.items())]
    return [(u, v, k) for (u, v), k in sorted(seen.items())]


def thin_components(g: Graph) -> list[list[int]]:
    """Connected components, largest first, then by least id."""
    seen: set[int] = set()
    out = []
    for n in sorted(g):
        if n in seen:
            continue
        seen.add(n)
        part, todo = [n], [n]
        while todo:
            for v in g[todo.pop()]:
                if v not in seen:
                    seen.add(v)
                    part.append(v)
                    todo.append(v)
        out.append(sorted(part))
    return sorted(out, key=lambda p: (-len(p), p[0]))


def select_gateways(short: Graph, n_nodes: int, ratio: float, seed: int | random.Random) -> list[int]:
    """One node of each component, then random nodes with a short edge up to round(ratio * n), at least one.

    Drawn like `choice` and `sample` by one uniform number each, so that a seed fixes them.
    """
    r = seed if isinstance(seed, random.Random) else random.Random(seed)
    quota = max(1, half_away_py(ratio * n_nodes))
    out = [p[int(r.random() * len(p))] for p in thin_components(short)]
    for _ in range(n_nodes):
        if len(out) >= quota:
            break
        drawn: list[int] = []
        while len(drawn) < quota - len(out):
            n = int(r.random() * n_nodes)
            if n not in drawn:
                drawn.append(n)
        for n in drawn:
            if n not in out and short.get(n) and len(out) < quota:
                out.append(n)
    return out


# --- cover and backbone -----------------------------------------------------


@dataclass
class Grid:
    spacing: float
    radius: float
    max_x: float
    max_y: float

    def cells(self, x: float, y: float, border_only: bool) -> list[tuple[int, int]]:
        s, r = self.spacing, self.radius
        top_i, top_j = int(self.max_x // s), int(self.max_y // s)
        lim = lambda v, top: max(0, min(top, int(v)))
        i0, i1 = lim((x - r) // s, top_i), lim((x + r) // s, top_i)
        j0, j1 = lim((y - r) // s, top_j), lim((y + r) // s, top_j)
        out = []
        for i in range(i0, i1 + 1):
            for j in range(j0, j1 + 1):
                inner = border_only and i0 < i < i1 and j0 < j < j1
                if inner or ((i + 0.5) * s - x) ** 2 + ((j + 0.5) * s - y) ** 2 <= r * r:
                    out.append((i, j))
        return out


def greedy_cover(points: dict[int, tuple[float, float]], gateways: list[int], grid: Grid, exact_decrement: bool = False) -> list[int]:
    """A covering set: gateways first, then again and again the node with the most uncovered targets.

    A chosen node marks its border-tested box. Counts of nodes in the cells within one radius (two with
    exact_decrement) are brought up to date; others may be too optimistic, as a chosen node that adds
    nothing is passed over.
    """
    circle = {n: grid.cells(*p, border_only=False) for n, p in points.items()}
    left = {n: len(c) for n, c in circle.items() if c}
    bins: dict[tuple[int, int], list[int]] = {}
    for n, (x, y) in sorted(points.items()):
        bins.setdefault((int(x // grid.radius), int(y // grid.radius)), []).append(n)
    covered: set[tuple[int, int]] = set()
    total = (int(grid.max_x // grid.spacing) + 1) * (int(grid.max_y // grid.spacing) + 1)
    last = dict(left)  # what a node was queued with; a count that falls to 0 is not queued again
    heap = [(-c, n) for n, c in left.items() if n not in set(gateways)]
    heapq.heapify(heap)
    reach = 2 if exact_decrement else 1
    out: list[int] = []
    done = set(gateways)

    def choose(n: int) -> bool:
        new = [c for c in grid.cells(*points[n], border_only=True) if c not in covered]
        covered.update(new)
        if not new:
            return False
        bx, by = int(points[n][0] // grid.radius), int(points[n][1] // grid.radius)
        fresh = set(new)
        for i in range(bx - reach, bx + reach + 1):
            for j in range(by - reach, by + reach + 1):
                for m in bins.get((i, j), ()):
                    if m in left and m not in done and (k := sum(c in fresh for c in circle[m])):
                        left[m] -= k
                        if left[m] > 0:
                            last[m] = left[m]
                            heapq.heappush(heap, (-left[m], m))
        return True

    for g in gateways:
        choose(g)
        out.append(g)
    while heap and len(covered) < total:
        c, n = heapq.heappop(heap)
        if n in done or -c != last[n]:
            continue
        done.add(n)
        if choose(n):
            out.append(n)
    return out


def bfs_tree(g: Graph, sources: list[int], banned: frozenset[int] = frozenset()) -> tuple[dict[int, int], dict[int, int]]:
    """(hops, parent) from a set of sources; the parent is the smallest node of the level before."""
    hops = {s: 0 for s in sources}
    parent: dict[int, int] = {}
    front = sorted(hops)
    while front:
        nxt = []
        for u in front:
            for v in sorted(g.get(u, ())):
                if v not in hops and v not in banned:
                    hops[v] = hops[u] + 1
                    parent[v] = u
                    nxt.append(v)
        front = sorted(nxt)
    return hops, parent


def path_to(parent: dict[int, int], n: int) -> list[int]:
    p = [n]
    while p[-1] in parent:
        p.append(parent[p[-1]])
    return p[::-1]


def backbone(short: Graph, gateways: list[int], cover: list[int]) -> Graph:
    """Grows a tree from the gateways over the covering nodes, always along a shortest path of least hops."""
    terminals = list(dict.fromkeys([*gateways, *cover]))
    trees = {t: bfs_tree(short, [t]) for t in terminals}
    rank = {t: k for k, t in enumerate(terminals)}
    g: Graph = {n: set() for n in gateways}
    done = set(gateways)
    heap: list[tuple[int, int, int]] = []

    def push(t: int) -> None:
        hops = trees[t][0]
        for k in terminals:
            if k not in done and k in hops:
                heapq.heappush(heap, (hops[k] + 1, rank[t], rank[k]))

    for t in gateways:
        push(t)
    while heap:
        _, i, j = heapq.heappop(heap)
        j = terminals[j]
        if j in done:
            continue
        p = path_to(trees[terminals[i]][1], j)
        for a, b in zip(p, p[1:]):
            g.setdefault(a, set()).add(b)
            g.setdefault(b, set()).add(a)
        done.add(j)
        push(j)
    return g


def reduce_degrees(g: Graph, short: Graph, gateways: list[int], check_reach: bool = True) -> Graph:
    """Moves edges away from nodes of the greatest degree while that is above 2 and some move is valid.

    A move replaces (n, u), n of the greatest degree and u below it in the tree from the gateways, by a
    short edge (u, v) to a node of degree at most the greatest less 2, from which a gateway is still
    reached without (n, u).
    """
    g = {n: set(v) for n, v in g.items()}
    gates = set(gateways)
    while True:
        top = max((degree(g, n) for n in g), default=0)
        if top <= 2:
            return g
        _, parent = bfs_tree(g, sorted(gates & set(g)))
        room = [n for n in sorted(g) if degree(g, n) <= top - 2 and (n in gates or degree(g, n) >= 1)]
        move = None
        for n in sorted(x for x in g if degree(g, x) == top):
            for u in sorted(v for v in g[n] if parent.get(v) == n):
                for v in room:
                    if v in (n, u) or v not in short.get(u, ()):
                        continue
                    if check_reach and v not in gates:
                        g[n].discard(u)
                        g[u].discard(n)
                        ok = not gates.isdisjoint(bfs_tree(g, [v])[0])
                        g[n].add(u)
                        g[u].add(n)
                        if not ok:
                            continue
                    move = (n, u, v)
                    break
                if move:
                    break
            if move:
                break
        if not move:
            return g
        n, u, v = move
        g[n].discard(u)
        g[u].discard(n)
        g[u].add(v)
        g[v].add(u)


# --- flows ------------------------------------------------------------------


class Flow:
    """Maximum flow by level graphs and blocking flows; keeps its residual network."""

    def __init__(self) -> None:
        self.out: dict[int, list[int]] = {}
        self.to: list[int] = []
        self.cap: list[float] = []

    def arc(self, u: int, v: int, c: float, back: float = 0.0) -> None:
        for a, b, k in ((u, v, c), (v, u, back)):
            self.out.setdefault(a, []).append(len(self.to))
            self.to.append(b)
            self.cap.append(k)

    def copy(self) -> Flow:
        f = Flow()
        f.out, f.to, f.cap = self.out, self.to, list(self.cap)
        return f

    def run(self, s: int, t: int, banned: frozenset[int] = frozenset(), limit: float = INF) -> float:
        if s == t or s not in self.out or t not in self.out:
            return 0.0
        total = 0.0
        while total < limit:
            level = {s: 0}
            todo = deque([s])
            while todo and t not in level:
                u = todo.popleft()
                for e in self.out[u]:
                    v = self.to[e]
                    if self.cap[e] > 0 and v not in level and v not in banned:
                        level[v] = level[u] + 1
                        todo.append(v)
            if t not in level:
                break
            at = dict.fromkeys(level, 0)
            path: list[int] = []
            u = s
            while True:
                if u == t:
                    push = min([limit - total, *(self.cap[e] for e in path)])
                    if push == INF:
                        return INF
                    total += push
                    cut = None
                    for k, e in enumerate(path):
                        self.cap[e] -= push
                        self.cap[e ^ 1] += push
                        if cut is None and self.cap[e] <= 0:
                            cut = k
                    if total >= limit:
                        return total
                    u = self.to[path[cut] ^ 1]
                    path = path[:cut]
                    continue
                arcs = self.out[u]
                while at[u] < len(arcs):
                    e = arcs[at[u]]
                    v = self.to[e]
                    if self.cap[e] > 0 and level.get(v) == level[u] + 1:
                        path.append(e)
                        u = v
                        break
                    at[u] += 1
                else:
                    if u == s:
                        break
                    level[u] = -1
                    u = self.to[path.pop() ^ 1]
        return total


def flow_network(g: Graph, gateways, sources=None) -> Flow:
    """Unit arcs both ways on each edge, endless arcs from the source to non-gateways and from gateways to the sink."""
    f = Flow()
    gates = set(gateways) & set(g)
    for u, v in edges_of(g):
        if u != v:
            f.arc(u, v, 1.0, 1.0)
    for n in sorted(set(g) - gates if sources is None else sources):
        f.arc(SRC, n, INF)
    for n in sorted(gates):
        f.arc(n, SNK, INF)
    return f


def max_flow(g: Graph, gateways, sources=None) -> float:
    return flow_network(g, gateways, sources).run(SRC, SNK)


def residual(g: Graph, gateways) -> Flow:
    f = flow_network(g, gateways)
    f.run(SRC, SNK)
    return f


def source_potential(res: Flow, n: int, gateways) -> float:
    """What can still flow from a node to the sink."""
    return INF if n in gateways else res.copy().run(n, SNK, frozenset([SRC]))


def sink_potential(res: Flow, n: int, gateways) -> float:
    """What can still flow from the source to a node, without the arcs between them."""
    f = res.copy()
    for e in f.out.get(SRC, ()):
        if f.to[e] == n:
            f.cap[e] = f.cap[e ^ 1] = 0.0
    return f.run(SRC, n, frozenset([SNK]))


def augment_dynamic(adj: Graph, base: Graph, gateways: list[int], max_new: int) -> tuple[Graph, list[list[int]]]:
    """Adds the new nodes of the path of most benefit, with all their edges, until max_new nodes are added.

    Benefit: what can flow over the path, least of the source potential of its first and the sink
    potential of its last node, per new node.
    """
    g = {n: set(v) for n, v in base.items()}
    gates = set(gateways)
    for n in g:
        g[n] |= adj.get(n, set()) & set(g)
    trees: dict[int, dict[int, int]] = {}
    added, paths = 0, []
    while added < max_new and len(g) < len(adj):
        res = residual(g, gates)
        nodes = sorted(g)
        sp = {n: source_potential(res, n, gates) for n in nodes}
        tp = {n: sink_potential(res, n, gates) for n in nodes}
        best, found = 0.0, None
        for u in nodes:
            if sp[u] <= 0:
                continue
            if u not in trees:
                trees[u] = bfs_tree(adj, [u])[1]
            tree = trees[u]
            for v in nodes:
                if v == u or tp[v] <= 0 or v not in tree:
                    continue
                p = path_to(tree, v)
                k = sum(x not in g for x in p)
                if k and min(sp[u], tp[v]) / k > best:
                    best, found = min(sp[u], tp[v]) / k, p
        if found is None:
            break
        new = [x for x in found if x not in g]
        for x in new:
            g[x] = set()
        for x in new:
            for y in adj[x]:
                if y in g:
                    g[x].add(y)
                    g[y].add(x)
        added += len(new)
        paths.append(found)
    return g, paths


def port_caps(base: Graph, gateways, per_node: int, per_gateway: int, fix_gateway_cap: bool = False) -> tuple[int, int]:
    """Port limits raised to the degrees that are there already.

    By default a gateway degree above its limit is written to the limit of other nodes, as the recorded
    statistics have it; fix_gateway_cap raises the gateways' own.
    """
    gates = set(gateways)
    top_g = max((degree(base, n) for n in base if n in gates), default=0)
    if top_g > per_gateway:
        if fix_gateway_cap:
            per_gateway = top_g
        else:
            per_node = top_g
    return max(per_node, max((degree(base, n) for n in base if n not in gates), default=0)), per_gateway


def fill_edges(g: Graph, adj: Graph, gateways, per_node: int, per_gateway: int) -> bool:
    """Adds edges between nodes that are there, in order, while both ends have a free port."""
    gates = set(gateways)
    cap = lambda n: per_gateway if n in gates else per_node
    grown = False
    for u in sorted(g):
        for v in sorted(adj.get(u, ())):
            if v in g and v != u and v not in g[u] and degree(g, u) < cap(u) and degree(g, v) < cap(v):
                g[u].add(v)
                g[v].add(u)
                grown = True
    return grown


def augment_static(adj: Graph, base: Graph, gateways: list[int], per_node: int, per_gateway: int, max_new: int) -> tuple[Graph, list[list[int]]]:
    """Like `augment_dynamic`, but whole paths are added, and only those that the free ports allow."""
    gates = set(gateways)
    g = {n: set(v) for n, v in base.items()}
    fill_edges(g, adj, gates, per_node, per_gateway)
    room = lambda n: (per_gateway if n in gates else per_node) - degree(g, n)
    trees: dict[int, dict[int, int]] = {}
    added, paths = 0, []
    while added < max_new and len(g) < len(adj):
        res = residual(g, gates)
        nodes = sorted(g)
        sp = {n: source_potential(res, n, gates) for n in nodes}
        tp = {n: sink_potential(res, n, gates) for n in nodes}
        best, found = 0.0, None
        for u in nodes:
            if sp[u] <= 0 or room(u) < 1:
                continue
            if u not in trees:
                trees[u] = bfs_tree(adj, [u])[1]
            for v in nodes:
                if v == u or tp[v] <= 0 or room(v) < 1 or v not in trees[u]:
                    continue
                p = path_to(trees[u], v)
                k = sum(x not in g for x in p)
                if k and min(sp[u], tp[v]) / k > best and len(p) >= 3 and all(x not in g or room(x) >= 2 for x in p[1:-1]):
                    best, found = min(sp[u], tp[v]) / k, p
        if found is None:
            break
        added += sum(x not in g for x in found)
        for a, b in zip(found, found[1:]):
            g.setdefault(a, set()).add(b)
            g.setdefault(b, set()).add(a)
        paths.append(found)
    return g, paths


# --- traffic patterns -------------------------------------------------------


def pattern_size(candidates: int, percent: float, patterns: int) -> tuple[int, int]:
    """(nodes of a pattern, number of patterns): at least one node; all of them make one pattern."""
    k = max(1, half_away_py(candidates * percent / 100.0))
    return (candidates, 1) if k >= candidates else (k, patterns)


def pattern(candidates: list[int], k: int, seed: int, ordinal: int) -> list[int]:
    return sorted(random.Random(f"{seed}:{ordinal}").sample(sorted(candidates), k))


def static_pattern_flow(g: Graph, gateways, nodes: list[int]) -> tuple[float, float]:
    """(maximum flow, upper bound) of one pattern: the bound is the sum of the sources' degrees."""
    return max_flow(g, gateways, nodes), float(sum(degree(g, n) for n in nodes))


class EquivalentDynamic:
    """The directed links that movable transceivers would take for one traffic pattern.

    Cheapest paths from the pattern nodes to the gateways are laid one after the other; a link in use
    gets dearer. A node whose ports in one direction are used up keeps only the links it has.
    """

    def __init__(self, g: Graph, gateways, per_node: int, per_gateway: int, nodes: list[int], increment: int = 5, patience: int = 100):
        self.gates = set(gateways) & set(g)
        self.cost: dict[int, dict[int, int]] = {u: {v: 1 for v in sorted(vs) if v != u} for u, vs in g.items()}
        self.back: dict[int, set[int]] = {u: set(vs) - {u} for u, vs in g.items()}
        self.exits = dict.fromkeys(self.gates, 1)
        self.links: set[tuple[int, int]] = set()
        self.used: set[int] = set()
        cap = lambda n: per_gateway if n in self.gates else per_node
        self.room_in, self.room_out = ({n: cap(n) for n in g} for _ in range(2))
        self.increment = increment
        entry = dict.fromkeys(nodes, 1)
        connected = set()
        while entry and (p := self._cheapest(entry)):
            self._lay(p, kept=set(zip(p, p[1:])))
            self._keep(p)
            connected.add(p[0])
            del entry[p[0]]
            self._close_entries(p, entry)
        self.unconnected = sorted(set(nodes) - connected)
        entry, idle = {n: 1 for n in nodes}, 0
        while idle < patience and (p := self._cheapest(entry)):
            fresh = self._lay(p, kept=set())
            if fresh:
                self._keep(p)
            entry[p[0]] += increment
            idle = 0 if fresh else idle + 1
            self._close_entries(p, entry)

    def _close_entries(self, p: list[int], entry: dict[int, int]) -> None:
        """A saturated node also loses its way in from the source."""
        for n in p[1:]:
            if self.room_in[n] == 0:
                entry.pop(n, None)

    def _cheapest(self, entry: dict[int, int]) -> list[int] | None:
        best = {n: c for n, c in entry.items()}
        parent: dict[int, int] = {}
        heap = [(c, n) for n, c in sorted(entry.items())]
        heapq.heapify(heap)
        done: set[int] = set()
        end: tuple[int, int] | None = None
        while heap:
            c, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if end is not None and c >= end[0]:
                break
            if u in self.exits and (end is None or c + self.exits[u] < end[0]):
                end = (c + self.exits[u], u)
            for v, w in self.cost[u].items():
                if v not in done and c + w < best.get(v, INF):
                    best[v] = c + w
                    parent[v] = u
                    heapq.heappush(heap, (c + w, v))
        return None if end is None else path_to(parent, end[1])

    def _keep(self, p: list[int]) -> None:
        self.links.update(zip(p, p[1:]))
        self.used.update(p)

    def _lay(self, p: list[int], kept: set[tuple[int, int]]) -> bool:
        """Makes the path dearer and uses up its ports; links in use and those in `kept` stay open."""
        fresh = False
        fixed = self.links | kept
        for u, v in zip(p, p[1:]):
            if v in self.cost[u]:
                self.cost[u][v] += self.increment
            fresh |= (u, v) not in self.links
            if self.room_out[u] >= 1:
                self.room_out[u] -= 1
                if self.room_out[u] == 0:
                    for y in [y for y in self.cost[u] if (u, y) not in fixed]:
                        del self.cost[u][y]
                    if u in self.exits:
                        del self.exits[u]
            if self.room_in[v] >= 1:
                self.room_in[v] -= 1
                if self.room_in[v] == 0:
                    for x in [x for x in self.back[v] if v in self.cost[x] and (x, v) not in fixed]:
                        del self.cost[x][v]
        return fresh

    def max_flow(self, nodes: list[int]) -> float:
        f = Flow()
        for u, v in sorted(self.links):
            f.arc(u, v, 1.0)
        for n in sorted(nodes):
            f.arc(SRC, n, INF)
        for n in sorted(self.gates):
            f.arc(n, SNK, INF)
        return f.run(SRC, SNK)


def dynamic_pattern_flow(g: Graph, gateways, per_node: int, per_gateway: int, nodes: list[int]) -> tuple[float, float]:
    """(maximum flow, upper bound) of one pattern on its equivalent directed graph."""
    eq = EquivalentDynamic(g, gateways, per_node, per_gateway, nodes)
    lost = set(eq.unconnected)
    return eq.max_flow(nodes), float(sum(min(per_node, degree(g, n)) for n in nodes if n not in lost))


def average(values: list[tuple[float, float]]) -> tuple[float, float]:
    n = max(1, len(values))
    return sum(v for v, _ in values) / n, sum(b for _, b in values) / n


def average_static_flow(g: Graph, gateways, percent: float, patterns: int, seed: int) -> tuple[float, float]:
    c = sorted(set(g) - set(gateways))
    if not c:
        return 0.0, 0.0
    k, m = pattern_size(len(c), percent, patterns)
    return average([static_pattern_flow(g, gateways, pattern(c, k, seed, i)) for i in range(m)])


def average_dynamic_flow(g: Graph, gateways, per_node: int, per_gateway: int, percent: float, patterns: int, seed: int) -> tuple[float, float]:
    c = sorted(set(g) - set(gateways))
    if not c:
        return 0.0, 0.0
    k, m = pattern_size(len(c), percent, patterns)
    return average([dynamic_pattern_flow(g, gateways, per_node, per_gateway, pattern(c, k, seed, i)) for i in range(m)])


def equivalent_static(g: Graph, adj: Graph, gateways, per_node: int, per_gateway: int, goal: float, percent: float, patterns: int, seed: int, start: tuple[float, float]) -> tuple[Graph, int, int, float, float]:
    """Ports a fixed network needs to carry what the movable one carries: raised by one until it does, or no edge is left."""
    g = {n: set(v) for n, v in g.items()}
    avg, bound = start
    while avg < goal:
        per_node += 1
        per_gateway += 1
        if not fill_edges(g, adj, gateways, per_node, per_gateway):
            break
        avg, bound = average_static_flow(g, gateways, percent, patterns, seed)
    return g, per_node, per_gateway, avg, bound
