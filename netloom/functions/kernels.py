"""NumPy kernels for what is sequential by nature: curve comparison, shortest paths, tree decomposition, bag tables.

They get the rows of one group and know nothing of Spark.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict

import numpy as np

REPEAT_SQUARED = 1e-24
SHORTEST = 1e-12
#: Prepared segments are longer than the root of this.
PREPARED_SQUARED = 1e-12
#: Share of an edge's length that a corridor weight always has, so that of equal routes the shorter wins.
LENGTH_TIE_BREAK = 1e-6
BEND = 1e-12


# --- polylines ------------------------------------------------------------------------------------------------------


def clean(points: np.ndarray) -> np.ndarray | None:
    points = np.asarray(points, float).reshape(-1, 2)
    if len(points) < 2 or not np.isfinite(points).all():
        return None
    if (((points[1:] - points[:-1]) ** 2).sum(axis=1) > REPEAT_SQUARED).all():
        kept = points
    else:
        out = [points[0]]
        for p in points[1:]:
            if ((p - out[-1]) ** 2).sum() > REPEAT_SQUARED:
                out.append(p)
        kept = np.array(out)
    return kept if len(kept) >= 2 and length(kept) > SHORTEST else None


def length(points: np.ndarray) -> float:
    return float(np.hypot(*(points[1:] - points[:-1]).T).sum())


def orient(points: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    kept = math.dist(points[0], first) + math.dist(points[-1], last)
    turned = math.dist(points[-1], first) + math.dist(points[0], last)
    return points[::-1] if turned < kept else points


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate((a, b[1:] if ((a[-1] - b[0]) ** 2).sum() <= REPEAT_SQUARED else b))


def resample(points: np.ndarray, n: int) -> np.ndarray:
    n = max(2, n)
    step = points[1:] - points[:-1]
    size = np.sqrt((step**2).sum(axis=1))
    long = size > SHORTEST
    start, step, size = points[:-1][long], step[long], size[long]
    ends = np.cumsum(size)
    begins = ends - size
    t = np.arange(n) * ends[-1] / (n - 1)
    k = np.clip(np.searchsorted(begins, t, "right") - 1, 0, len(size) - 1)
    out = start[k] + ((t - begins[k]) / size[k])[:, None] * step[k]
    out[0], out[-1] = points[0], points[-1]
    return out


def prepared(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(starts, vectors, squared lengths) of the segments that are long enough."""
    step = points[1:] - points[:-1]
    squared = (step**2).sum(axis=1)
    on = squared > PREPARED_SQUARED
    return (points[:-1][on], step[on], squared[on]) if on.any() else None


def projections(points: np.ndarray, line: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, clamped shares) of every point from every segment."""
    start, step, squared = line
    off = points[:, None, :] - start[None]
    share = np.clip((off * step[None]).sum(axis=2) / squared[None], 0, 1)
    gap = off - share[:, :, None] * step[None]
    return (gap**2).sum(axis=2), share


def distances(points: np.ndarray, line: tuple[np.ndarray, np.ndarray, np.ndarray], block: int = 4096) -> np.ndarray:
    """Distance of each point from the polyline, in blocks of points."""
    return np.concatenate([np.sqrt(projections(points[i : i + block], line)[0].min(axis=1)) for i in range(0, len(points), block)])


# --- local edge costs -----------------------------------------------------------------------------------------------


def _tangents(line: tuple[np.ndarray, np.ndarray, np.ndarray], k: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Unit tangents at shares of segments; the bisector at bends, unless the line turns back there."""
    unit = line[1] / np.sqrt(line[2])[:, None]
    out = unit[k].copy()
    for there, other in (((share <= BEND) & (k > 0), k - 1), ((share >= 1 - BEND) & (k < len(unit) - 1), k + 1)):
        at = np.flatnonzero(there)
        if len(at):
            both = unit[k[at]] + unit[other[at]]
            norm = np.sqrt((both**2).sum(axis=1))
            good = norm > BEND
            out[at[good]] = both[good] / norm[good][:, None]
    return out


def sample_tangents(line: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    start, step, squared = line
    size = np.sqrt(squared)
    ends = np.cumsum(size)
    begins = ends - size
    t = np.arange(n) * ends[-1] / (n - 1)
    k = np.clip(np.searchsorted(begins, t, "right") - 1, 0, len(size) - 1)
    share = np.clip((t - begins[k]) / size[k], 0, 1)
    return start[k] + share[:, None] * step[k], _tangents(line, k, share)


def directed_distance_tangent(points: np.ndarray, tangents: np.ndarray, line: tuple[np.ndarray, np.ndarray, np.ndarray], weight: float) -> float:
    d2, share = projections(points, line)
    k = d2.argmin(axis=1)
    row = np.arange(len(points))
    dot = np.abs((tangents * _tangents(line, k, share[row, k])).sum(axis=1))
    angle = np.where(dot >= 1 - 1e-12, 0.0, np.arccos(np.minimum(dot, 1)) / (math.pi / 2))
    return float((np.sqrt(d2[row, k]) + weight * angle).mean())


def mean_distance_tangent(a: np.ndarray, b: np.ndarray, samples: int, weight: float) -> float:
    p, q = prepared(a), prepared(b)
    if p is None or q is None:
        return math.inf
    return (directed_distance_tangent(*sample_tangents(p, samples), q, weight) + directed_distance_tangent(*sample_tangents(q, samples), p, weight)) / 2


def corridor_exceedance(a: np.ndarray, b: np.ndarray, samples: int, radius: float) -> float:
    p, q = prepared(a), prepared(b)
    if p is None or q is None:
        return math.inf
    return float(sum(np.maximum(distances(resample(x, samples), y) / radius - 1, 0).mean() for x, y in ((a, q), (b, p))) / 2)


def densified(points: np.ndarray, share: float | None) -> np.ndarray:
    if share is None:
        return points
    n = max(1, round(1 / share))
    t = np.arange(n) / n
    inner = points[:-1, None, :] + t[None, :, None] * (points[1:] - points[:-1])[:, None, :]
    return np.concatenate((inner.reshape(-1, 2), points[-1:]))


def hausdorff(a: np.ndarray, b: np.ndarray, share: float | None = None) -> float:
    """Discrete: vertices (or densified points) of each line against the segments of the other."""
    p, q = prepared(a), prepared(b)
    if p is None or q is None:
        return math.inf
    return float(max(distances(densified(a, share), q).max(), distances(densified(b, share), p).max()))


def discrete_frechet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of one curve (n, 2), or of each of many (r, n, 2), from each of as many (r, m, 2)."""
    row = None
    for i in range(a.shape[-2]):
        d = np.sqrt(((b - a[..., i, :].reshape(-1, 1, 2)) ** 2).sum(axis=2))
        new = np.empty_like(d)
        for j in range(d.shape[1]):
            if row is None:
                reach = new[:, j - 1] if j else None
            elif j == 0:
                reach = row[:, 0]
            else:
                reach = np.minimum(np.minimum(row[:, j], row[:, j - 1]), new[:, j - 1])
            new[:, j] = d[:, j] if reach is None else np.maximum(d[:, j], reach)
        row = new
    return row[:, -1]


def time_warping(a: np.ndarray, b: np.ndarray, window: int | None, normalise: bool) -> np.ndarray:
    """Root of the least sum of squared distances, of one curve (n, 2) or many (r, n, 2) and many (r, m, 2); steps stay within ``window`` - 1 of the diagonal."""
    n, m = a.shape[-2], b.shape[1]
    width = max(n, m) if window is None else max(window, abs(n - m) + 1)
    row = np.full((len(b), m + 1), np.inf)
    row[:, 0] = 0
    for i in range(n):
        new = np.full_like(row, np.inf)
        for j in range(max(0, i - width + 1), min(m, i + width)):
            d = ((b[:, j] - a[..., i, :]) ** 2).sum(axis=1)
            new[:, j + 1] = d + np.minimum(np.minimum(row[:, j], row[:, j + 1]), new[:, j])
        row = new
    out = np.sqrt(row[:, m])
    return out / math.sqrt(n) if normalise else out


# --- shortest paths -------------------------------------------------------------------------------------------------


class Network:
    """Arcs of an undirected multigraph, grouped by the vertex they leave, in edge order.

    Edge k is arc k along its direction and arc ~k against it. Vertices are numbered in the order of their ids.
    """

    def __init__(self, u: np.ndarray, v: np.ndarray):
        self.ids, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
        n = len(u)
        tail, head = ends, np.concatenate((ends[n:], ends[:n]))
        arc = np.concatenate((np.arange(n), ~np.arange(n)))
        order = np.lexsort((arc < 0, np.where(arc < 0, ~arc, arc), tail))
        self.arcs, self.tails, self.heads = arc[order].tolist(), tail[order].tolist(), head[order].tolist()
        self.edge = np.where(arc < 0, ~arc, arc)[order]
        self.first = np.searchsorted(tail[order], np.arange(len(self.ids) + 1)).tolist()

    def number(self, vertex: int) -> int | None:
        k = int(np.searchsorted(self.ids, vertex))
        return k if k < len(self.ids) and self.ids[k] == vertex else None

    def weighed(self, weights: np.ndarray) -> list[float]:
        """The weights of the arcs, in the network's order."""
        return np.asarray(weights, float)[self.edge].tolist()

    def ways(self, weights: list[float], start: int, goals: set[int]) -> dict[int, tuple[float, list[int]]]:
        """For each goal that can be reached from another vertex: the least weight and the arcs that have it.

        Vertices are settled by (weight, id), each over the arc that first offered its least weight. The search ends
        when all goals are settled.
        """
        s = self.number(start)
        open_goals = {k for g in goals if g != start and (k := self.number(g)) is not None}
        found: dict[int, tuple[float, list[int]]] = {}
        if s is None or not open_goals:
            return found
        offer = {s: 0.0}
        over = {s: -1}
        settled: set[int] = set()
        frontier = [(0.0, s)]
        while frontier and open_goals:
            far, here = heapq.heappop(frontier)
            if here in settled:
                continue
            settled.add(here)
            if here in open_goals:
                open_goals.discard(here)
                found[int(self.ids[here])] = far, self._back(over, here)
            for slot in range(self.first[here], self.first[here + 1]):
                there = self.heads[slot]
                if there not in settled and far + weights[slot] < offer.get(there, math.inf):
                    offer[there] = far + weights[slot]
                    over[there] = slot
                    heapq.heappush(frontier, (offer[there], there))
        return found

    def _back(self, over: dict[int, int], at: int) -> list[int]:
        out: list[int] = []
        while (slot := over[at]) >= 0:
            out.append(self.arcs[slot])
            at = self.tails[slot]
        out.reverse()
        return out


def route_line(arcs: list[int], lines: list[np.ndarray]) -> np.ndarray:
    """The polyline along the arcs; a vertex between two of them counts once."""
    out = np.concatenate([lines[k] if k >= 0 else lines[~k][::-1] for k in arcs])
    sizes = np.array([len(lines[k if k >= 0 else ~k]) for k in arcs])
    return np.delete(out, np.cumsum(sizes)[:-1], axis=0)


def corridor_weights(lengths: np.ndarray, samples: np.ndarray, source: np.ndarray, rho: float) -> np.ndarray:
    """Length times the share of an edge's samples beyond ``rho`` of the source line; samples is (edges, n, 2)."""
    line = prepared(source)
    if line is None:
        return np.full(len(lengths), np.inf)
    far = distances(samples.reshape(-1, 2), line).reshape(samples.shape[:2])
    share = np.where(np.isfinite(far).all(axis=1), (far > rho).mean(axis=1), 1.0)
    return share * lengths + LENGTH_TIE_BREAK * lengths


# --- tree decomposition ---------------------------------------------------------------------------------------------


def _eliminate(neighbours: dict[int, set[int]], fill: bool) -> tuple[int, list[frozenset[int]], list[tuple[int, int]]]:
    """(width, bags, tree edges by bag number) of the min-fill or min-degree elimination order; ties by id."""
    left = {v: set(n) for v, n in neighbours.items()}
    order: list[tuple[int, frozenset[int]]] = []

    def price(v: int) -> int:
        n = left[v]
        return sum(len(n - left[x]) - 1 for x in n) // 2 if fill else len(n)

    prices = {v: price(v) for v in left}
    while left:
        n_left = len(left)
        if all(len(n) == n_left - 1 for n in left.values()):
            break
        v = min(left, key=lambda x: (prices[x], x))
        around = left.pop(v)
        del prices[v]
        order.append((v, frozenset(around)))
        for x in around:
            left[x].discard(v)
        for x in around:
            left[x] |= around - {x}
        touched = set(around)
        if fill:
            for x in around:
                touched |= left[x]
        for x in touched:
            prices[x] = price(x)
    bags: list[frozenset[int]] = [frozenset(left)] if left else []
    tree: list[tuple[int, int]] = []
    for v, around in reversed(order):
        # the bag that holds all its neighbours; without neighbours any bag will do: an empty separator
        host = next((k for k, b in enumerate(bags) if around <= b), None)
        bag = around | {v}
        if host is not None and bags[host] == around:
            bags[host] = bag
        else:
            bags.append(bag)
            if host is not None:
                tree.append((host, len(bags) - 1))
    return max(map(len, bags), default=1) - 1, bags, tree


class Decomposition:
    """Rooted bags in postorder. ``owned`` has the numbers of each bag's edges; each edge is in its highest bag."""

    def __init__(self, vertices: list[int], edges: list[tuple[int, int, int]]):
        if not vertices:
            raise ValueError("a decomposition needs vertices")
        neighbours: dict[int, set[int]] = {v: set() for v in vertices}
        for _, u, v in edges:
            if u != v:
                neighbours[u].add(v)
                neighbours[v].add(u)
        by_fill, by_degree = _eliminate(neighbours, True), _eliminate(neighbours, False)
        self.fill_width, self.degree_width = by_fill[0], by_degree[0]
        self.heuristic = "minimum_fill_in" if by_fill[0] <= by_degree[0] else "minimum_degree"
        self.width, bags, tree = by_fill if by_fill[0] <= by_degree[0] else by_degree
        self._root(bags, tree)
        self.owned: list[list[tuple[int, int, int]]] = [[] for _ in self.bags]
        for edge in sorted(edges):
            k = min((k for k, b in enumerate(self.bags) if edge[1] in b and edge[2] in b), key=lambda k: (self.depth[k], self.bags[k]))
            self.owned[k].append(edge)

    def _root(self, bags: list[frozenset[int]], tree: list[tuple[int, int]]) -> None:
        near: dict[int, set[int]] = {k: set() for k in range(len(bags))}
        for a, b in tree:
            near[a].add(b)
            near[b].add(a)
        keys = [tuple(sorted(b)) for b in bags]
        # peeling leaves finds the centre
        degree = {k: len(n) for k, n in near.items()}
        left, leaves = set(near), [k for k, d in degree.items() if d <= 1]
        while len(left) > 2:
            left -= set(leaves)
            following = []
            for k in leaves:
                for x in near[k]:
                    if x in left:
                        degree[x] -= 1
                        if degree[x] == 1:
                            following.append(x)
            leaves = following
        root = min(left, key=lambda k: keys[k])
        parent, depth, children = {root: None}, {root: 0}, defaultdict(list)
        queue = [root]
        for k in queue:
            for x in sorted(near[k] - set(parent), key=lambda x: keys[x]):
                parent[x], depth[x] = k, depth[k] + 1
                children[k].append(x)
                queue.append(x)
        order, stack = [], [(root, False)]
        while stack:
            k, done = stack.pop()
            if done:
                order.append(k)
            else:
                stack.append((k, True))
                stack += [(x, False) for x in reversed(children[k])]
        at = {k: i for i, k in enumerate(order)}
        self.bags = [keys[k] for k in order]
        self.parent = [None if parent[k] is None else at[parent[k]] for k in order]
        self.depth = [depth[k] for k in order]
        self.children = [[at[x] for x in children[k]] for k in order]
        self.separator = [tuple(v for v in self.bags[i] if p is not None and v in self.bags[p]) for i, p in enumerate(self.parent)]

    def problems(self, vertices: list[int], edges: list[tuple[int, int, int]]) -> list[str]:
        """What makes this no valid rooted decomposition; empty if all holds."""
        out = []
        if {v for b in self.bags for v in b} != set(vertices):
            out.append("the bags do not hold just the vertices")
        for e, u, v in edges:
            holding = [k for k, b in enumerate(self.bags) if u in b and v in b]
            if not holding:
                out.append(f"edge {e} is in no bag")
        for v in vertices:
            n = sum(v in b for b in self.bags)
            links = sum(p is not None and v in self.bags[k] and v in self.bags[p] for k, p in enumerate(self.parent))
            if n - links != 1:
                out.append(f"the bags of vertex {v} are not connected")
        if max(map(len, self.bags)) - 1 != self.width:
            out.append("the width is not that of the largest bag")
        if sum(p is None for p in self.parent) != 1 or self.parent[-1] is not None or any(p is not None and p <= k for k, p in enumerate(self.parent)):
            out.append("the order is no postorder with one root")
        owned = [e for mine in self.owned for e in mine]
        if sorted(owned) != sorted(edges):
            out.append("edges are not owned once each")
        for k, mine in enumerate(self.owned):
            p = self.parent[k]
            if any(u not in self.bags[k] or v not in self.bags[k] or (p is not None and u in self.bags[p] and v in self.bags[p]) for _, u, v in mine):
                out.append(f"bag {k} owns an edge that is not in it or that its parent could own")
        return out


OBJECTIVES = ("additive", "bottleneck", "length_weighted_additive")
#: Cells of one bag's table, 8 bytes each.
MOST_CELLS = 100_000_000


class TooLarge(ValueError):
    """A bag's table would have more cells than allowed."""


def solve_bags(tree: Decomposition, domains: dict[int, np.ndarray], costs: dict[int, np.ndarray], weights: dict[int, float], objective: str, counts: list[tuple[int, int]] | None = None, most_cells: int = MOST_CELLS) -> tuple[float, dict[int, int]] | None:
    """The least objective and a mapping that has it, or None if there is none.

    ``counts`` is given, for each bag done, its states of finite value and its message's entries of finite value.

    ``domains`` are sorted candidates, ``costs`` a matrix (candidates of u, candidates of v) for each edge with infinity
    where it is not allowed. Of equal values a bag's lexicographically smallest state wins.
    """
    join = np.maximum if objective == "bottleneck" else np.add
    messages: dict[int, np.ndarray] = {}
    choices: list[np.ndarray] = []
    for k, bag in enumerate(tree.bags):
        shape = tuple(len(domains[v]) for v in bag)
        if math.prod(shape) > most_cells:
            raise TooLarge(f"a bag has {math.prod(shape)} states; prune first, set a state limit, or solve by joins")
        axis = {v: i for i, v in enumerate(bag)}

        def spread(table: np.ndarray, variables: tuple[int, ...]) -> np.ndarray:
            order = sorted(range(len(variables)), key=lambda i: axis[variables[i]])
            view = table.transpose(order)
            full = [1] * len(bag)
            for i, size in zip(order, view.shape, strict=True):
                full[axis[variables[i]]] = size
            return view.reshape(full)

        value = np.zeros(shape)
        for e, u, v in tree.owned[k]:
            factor = weights.get(e, 1.0) if objective == "length_weighted_additive" else 1.0
            value = join(value, spread(costs[e] * factor, (u, v)))
        for c in tree.children[k]:
            value = join(value, spread(messages.pop(c), tree.separator[c]))
        kept = [axis[v] for v in tree.separator[k]]
        gone = [i for i in range(len(bag)) if i not in kept]
        flat = value.transpose(kept + gone).reshape([shape[i] for i in kept] + [-1])
        if not flat.shape[-1] or not flat.size:
            return None
        best = flat.argmin(axis=-1)
        choices.append(best)
        messages[k] = np.take_along_axis(flat, best[..., None], axis=-1)[..., 0]
        if counts is not None:
            counts.append((int(np.isfinite(value).sum()), int(np.isfinite(messages[k]).sum())))
    total = float(messages[len(tree.bags) - 1])
    if not math.isfinite(total):
        return None
    picked: dict[int, int] = {}
    for k in reversed(range(len(tree.bags))):
        bag, sep = tree.bags[k], tree.separator[k]
        gone = [v for v in bag if v not in sep]
        at = int(choices[k][tuple(picked[v] for v in sep)])
        for v, i in zip(gone, np.unravel_index(at, [len(domains[v]) for v in gone]), strict=True):
            picked[v] = int(i)
    return total, {v: int(domains[v][i]) for v, i in sorted(picked.items())}
