"""Paths, local costs, pruning, decomposition and the dynamic program, over tables of many graph pairs at once.

requests(pair_id, edge_id, u, v, target_u, target_v) name source edges and where their ends are mapped;
costs add ``value`` and ``witness``. A request that has no finite cost has no row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import StrEnum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import geometry as geo
from netloom.functions import kernels
from netloom.operators.components import connected_components
from netloom.plans.durable import durable

REQUEST = ["pair_id", "edge_id", "target_u", "target_v"]
#: Pairs of curves that one array pass compares.
CURVES_AT_ONCE = 4096


def buckets_of(requests: DataFrame) -> int:
    """Groups that a pair's source edges (or start vertices) are dealt to, as many as the cluster has slots; each task holds one target graph."""
    return max(8, requests.sparkSession.sparkContext.defaultParallelism)


class Objective(StrEnum):
    ADDITIVE = "additive"
    BOTTLENECK = "bottleneck"
    LENGTH_WEIGHTED = "length_weighted_additive"


class CostName(StrEnum):
    RELATIVE_LENGTH = "relative_length_error"
    LOG_LENGTH = "log_length_distortion"
    MEAN_DISTANCE_TANGENT = "mean_distance_tangent"
    HAUSDORFF = "hausdorff_distance"
    CORRIDOR = "symmetric_corridor_exceedance"
    FRECHET = "discrete_frechet_distance"
    WARPING = "dynamic_time_warping_distance"


class Dominance(StrEnum):
    """Whether dominated candidates are pruned; AUTO does so for the cost whose program is the most expensive to feed."""

    OFF = "off"
    ON = "on"
    AUTO = "auto"

    def applies(self, cost: Cost) -> bool:
        return self is Dominance.ON or (self is Dominance.AUTO and cost.name == CostName.FRECHET)


# --- components and arc consistency ---------------------------------------------------------------------------------


def vertex_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, vertex_id, component): the smallest vertex of the component; isolated vertices have their own."""
    node = F.struct("graph", F.col("u").alias("id"))
    found = connected_components(edges.select(node.alias("u"), F.struct("graph", F.col("v").alias("id")).alias("v")))
    named = found.select("node.graph", F.col("node.id").alias("vertex_id"), F.col("component.id").alias("component"))
    return vertices.select("graph", "vertex_id").join(named, ["graph", "vertex_id"], "left").withColumn("component", F.coalesce("component", "vertex_id"))


def source_arcs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair_id, s, o) for both directions of every distinct adjacent pair of source vertices."""
    e = pairs.select("pair_id", F.col("source").alias("graph")).join(edges.select("graph", "u", "v"), "graph")
    return e.select("pair_id", F.col("u").alias("s"), F.col("v").alias("o")).unionByName(e.select("pair_id", F.col("v").alias("s"), F.col("u").alias("o"))).distinct()


def arc_consistency(candidates: DataFrame, pairs: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The candidates left when each has, for each source neighbour, another candidate in its target component.

    Within a round a candidate is supported by a neighbour iff that has at least one candidate in the component besides
    the candidate itself, so counts for each (vertex, component) replace pairs of candidates. Rounds end when nothing
    is removed; the fixpoint does not depend on their order.
    """
    comp = vertex_components(vertices, edges)
    placed = pairs.select("pair_id", F.col("target").alias("graph")).join(comp, "graph").select("pair_id", F.col("vertex_id").alias("target_vertex"), "component")
    now = durable(candidates.select("pair_id", "source_vertex", "target_vertex").distinct().join(placed, ["pair_id", "target_vertex"]))
    arcs = durable(source_arcs(pairs, edges))
    n = now.count()
    while True:
        counts = now.groupBy("pair_id", F.col("source_vertex").alias("o"), "component").agg(F.count("*").alias("k"))
        mine = now.join(arcs.withColumnRenamed("s", "source_vertex"), ["pair_id", "source_vertex"])
        own = now.select("pair_id", F.col("source_vertex").alias("o"), "target_vertex", F.lit(1).alias("also"))
        held = mine.join(counts, ["pair_id", "o", "component"], "left").join(own, ["pair_id", "o", "target_vertex"], "left")
        lost = held.where(F.coalesce("k", F.lit(0)) - F.coalesce("also", F.lit(0)) < 1).select("pair_id", "source_vertex", "target_vertex").distinct()
        left = durable(now.join(lost, ["pair_id", "source_vertex", "target_vertex"], "left_anti"))
        m = left.count()
        if m == n:
            return left.select("pair_id", "source_vertex", "target_vertex")
        now, n = left, m


def all_requests(candidates: DataFrame, pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Every request that candidates allow: (candidates of u) x (candidates of v), without equal targets."""
    e = pairs.select("pair_id", F.col("source").alias("graph")).join(edges.select("graph", "edge_id", "u", "v"), "graph").drop("graph")
    cu = candidates.select("pair_id", F.col("source_vertex").alias("u"), F.col("target_vertex").alias("target_u"))
    cv = candidates.select("pair_id", F.col("source_vertex").alias("v"), F.col("target_vertex").alias("target_v"))
    return e.join(cu, ["pair_id", "u"]).join(cv, ["pair_id", "v"]).where("target_u <> target_v").select("pair_id", "edge_id", "u", "v", "target_u", "target_v")


# --- paths and costs ------------------------------------------------------------------------------------------------

_LINE = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def _lines(column: pa.ChunkedArray) -> list[np.ndarray]:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten()
    xy = np.stack((flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)), axis=1) if len(flat) else np.zeros((0, 2))
    size = np.array([0 if x is None else x for x in array.value_lengths().to_pylist()], int)
    ends = np.cumsum(size)
    return [xy[b - n : b] for b, n in zip(ends, size, strict=True)]


def _packed(lines: list[np.ndarray]) -> pa.Array:
    xy = np.concatenate(lines) if lines else np.zeros((0, 2))
    ends = np.concatenate(([0], np.cumsum([len(x) for x in lines]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])).cast(_LINE)


@dataclass(frozen=True)
class Cost:
    """A local edge cost: guided costs compare curves, the others the length of the shortest path with the edge's."""

    name: str
    options: dict = field(default_factory=dict)
    #: Of a registered cost; it travels to the workers with it.
    function: Callable[..., float] | None = None

    def __post_init__(self):
        o = self.options
        known = DEFAULTS[self.name] if self.name in DEFAULTS else _GUIDED | CUSTOM[self.name].options
        unknown = set(o) - set(known)
        if unknown:
            raise ValueError(f"{self.name} has no option {sorted(unknown)}; it has {sorted(known)}")
        object.__setattr__(self, "options", known | o)
        o = self.options
        for key, good in (
            ("rho", lambda x: math.isfinite(x) and x > 0), ("edge_samples", lambda x: x >= 2), ("curve_samples", lambda x: x >= 2), ("tangent_weight", lambda x: math.isfinite(x) and x >= 0),
            ("corridor_radius", lambda x: x is None or (math.isfinite(x) and x > 0)), ("densify", lambda x: x is None or 0 < x <= 1), ("warping_window", lambda x: x is None or x >= 1),
        ):
            if key in o and not good(o[key]):
                raise ValueError(f"{self.name}: {key} must not be {o[key]!r}")

    @property
    def guided(self) -> bool:
        return self.name not in (CostName.RELATIVE_LENGTH, CostName.LOG_LENGTH)

    def of(self, sources: list[np.ndarray], witnesses: list[np.ndarray]) -> np.ndarray:
        """Values of source lines (oriented u to v) against as many witnesses (target u to target v)."""
        o = self.options
        both = list(zip(sources, witnesses, strict=True))
        if self.function is not None:
            return np.array([float(self.function(a, b, **{k: x for k, x in o.items() if k not in _GUIDED})) for a, b in both])
        if self.name in (CostName.RELATIVE_LENGTH, CostName.LOG_LENGTH):
            raise ValueError("length costs need distances")
        if self.name == CostName.MEAN_DISTANCE_TANGENT:
            return np.array([kernels.mean_distance_tangent(a, b, o["curve_samples"], o["tangent_weight"]) for a, b in both])
        if self.name == CostName.HAUSDORFF:
            return np.array([kernels.hausdorff(a, b, o["densify"]) for a, b in both])
        if self.name == CostName.CORRIDOR:
            radius = o["rho"] if o["corridor_radius"] is None else o["corridor_radius"]
            return np.array([kernels.corridor_exceedance(a, b, o["curve_samples"], radius) for a, b in both])
        out = [np.zeros(0)]
        for k in range(0, len(both), CURVES_AT_ONCE):
            one, other = (np.stack([kernels.resample(x, o["curve_samples"]) for x in part[k : k + CURVES_AT_ONCE]]) for part in (sources, witnesses))
            out.append(kernels.discrete_frechet(one, other) if self.name == CostName.FRECHET else kernels.time_warping(one, other, o["warping_window"], o["normalize"]))
        return np.concatenate(out)

    def of_length(self, distance: float, length: float) -> float:
        if not (length > kernels.SHORTEST and distance > kernels.SHORTEST and math.isfinite(distance)):
            return math.inf
        return abs(distance / length - 1) if self.name is CostName.RELATIVE_LENGTH else abs(math.log(distance / length))


_GUIDED = {"rho": 10.0, "edge_samples": 12}
DEFAULTS: dict[CostName, dict] = {
    CostName.RELATIVE_LENGTH: {},
    CostName.LOG_LENGTH: {},
    CostName.MEAN_DISTANCE_TANGENT: _GUIDED | {"curve_samples": 64, "tangent_weight": 1.0},
    CostName.HAUSDORFF: _GUIDED | {"densify": None},
    CostName.CORRIDOR: _GUIDED | {"curve_samples": 64, "corridor_radius": None},
    CostName.FRECHET: _GUIDED | {"curve_samples": 64},
    CostName.WARPING: _GUIDED | {"curve_samples": 80, "warping_window": 8, "normalize": True},
}


#: Least and greatest value of the options that have bounds; a radius or weight without a row is any number from 0.
RANGES: dict[str, tuple[float, float]] = {"edge_samples": (2, 10_000), "curve_samples": (2, 100_000), "corridor_radius": (1e-9, 1e6), "warping_window": (1, 100_000), "densify": (1e-9, 1)}


@dataclass(frozen=True)
class OptionSpec:
    """What a form needs to ask for an option; ``kind`` is bool, int or float, bounds are of numbers only."""

    name: str
    kind: str
    default: object
    least: float | None
    most: float | None


def option_specs(name: str) -> list[OptionSpec]:
    """The options of a cost, those of registered costs included."""
    specs = []
    for option, default in cost_options(name).items():
        kind = "float" if default is None else type(default).__name__
        bounds = RANGES.get(option, (0.0, 1e6)) if kind in ("int", "float") else (None, None)
        specs.append(OptionSpec(option, kind, default, *bounds))
    return specs


@dataclass(frozen=True)
class CustomCost:
    """A guided cost of one's own: ``value`` (source line, witness, **own options) gives a number of at least 0, or infinity."""

    value: Callable[..., float]
    options: dict = field(default_factory=dict)


CUSTOM: dict[str, CustomCost] = {}


def register_cost(name: str, value: Callable[..., float], **options) -> None:
    """Adds a cost that compares curves, with its options and their defaults besides rho and edge_samples.

    The function travels to the workers with the query, so it must be known to them by import or be self-contained.
    """
    if not name or name in available_costs():
        raise ValueError(f"there is a cost {name!r} already" if name else "a cost needs a name")
    CUSTOM[name] = CustomCost(value, dict(options))


def available_costs() -> list[str]:
    return [*(c.value for c in CostName), *CUSTOM]


def cost_options(name: str) -> dict:
    """The options of a cost with their defaults."""
    return dict(create_cost(name).options)


def create_cost(name: str, **options) -> Cost:
    known = available_costs()
    if name not in known:
        raise ValueError(f"unknown cost {name!r}; there are {', '.join(known)}")
    return Cost(name, options, CUSTOM[name].value) if name in CUSTOM else Cost(CostName(name), options)


def _target_tables(pairs: DataFrame, edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Target edges once for each (pair, bucket) that has requests."""
    t = edges.select(F.col("graph").alias("target"), "edge_id", "edge_pos", "u", "v", "polyline")
    asked = keys.select(F.col("pair_id").alias("_p"), F.col("bucket").alias("_b")).distinct()
    met = asked.join(pairs.select("pair_id", "target"), F.col("_p") == F.col("pair_id")).join(t, "target")
    # new names: both sides of a cogroup may come from one table
    return met.select(F.col("_p").alias("pair_id"), F.col("_b").alias("bucket"), "edge_id", "edge_pos", "u", "v", "polyline")


class _Target:
    def __init__(self, table: pa.Table):
        table = table.sort_by("edge_pos")
        self.u, self.v = table["u"].to_numpy(), table["v"].to_numpy()
        self.lines = _lines(table["polyline"])
        self.lengths = np.array([kernels.length(x) for x in self.lines])


_WAYS = f"pair_id string, target_u long, target_v long, distance double, witness {geo.POLYLINE}"


def shortest_paths(requests: DataFrame, pairs: DataFrame, edges: DataFrame, buckets: int | None = None) -> DataFrame:
    """(pair_id, target_u, target_v, distance, witness) for distinct wanted (pair_id, target_u, target_v).

    Geometric lengths; searches start at target_u and end at the wanted vertices. Unreachable or equal ends have no row.
    """
    wanted = requests.select("pair_id", "target_u", "target_v").distinct().withColumn("bucket", F.pmod(F.xxhash64("target_u"), F.lit(buckets or buckets_of(requests))))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("pair_id", "target_u", "target_v", "distance")}
        lines: list[np.ndarray] = []
        if left.num_rows and right.num_rows:
            t = _Target(right)
            net = kernels.Network(t.u, t.v)
            weights = net.weighed(t.lengths)
            pair = left["pair_id"][0].as_py()
            for start, goals in _by_start(left["target_u"].to_numpy(), left["target_v"].to_numpy()):
                for goal, (far, arcs) in net.ways(weights, start, goals).items():
                    for c, x in zip(out, (pair, start, goal, far), strict=True):
                        out[c].append(x)
                    lines.append(kernels.route_line(arcs, t.lines))
        kinds = {"pair_id": pa.string(), "distance": pa.float64()}
        return pa.table({c: pa.array(x, kinds.get(c, pa.int64())) for c, x in out.items()} | {"witness": _packed(lines)})

    by = ["pair_id", "bucket"]
    return wanted.groupBy(*by).cogroup(_target_tables(pairs, edges, wanted).groupBy(*by)).applyInArrow(solve, _WAYS)


def _by_start(starts: np.ndarray, goals: np.ndarray) -> list[tuple[int, set[int]]]:
    grouped: dict[int, set[int]] = {}
    for a, b in zip(starts.tolist(), goals.tolist(), strict=True):
        grouped.setdefault(a, set()).add(b)
    return sorted(grouped.items())


def oriented_source(pairs: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair_id, edge_id, u, v, line, length): source edges from u to v."""
    e = pairs.select("pair_id", F.col("source").alias("graph")).join(edges, "graph")
    at = vertices.select("graph", F.col("vertex_id"), geo.point(F.col("x"), F.col("y")).alias("p"))
    e = e.join(at.select("graph", F.col("vertex_id").alias("u"), F.col("p").alias("pu")), ["graph", "u"]).join(at.select("graph", F.col("vertex_id").alias("v"), F.col("p").alias("pv")), ["graph", "v"])
    return e.select("pair_id", "edge_id", "u", "v", geo.orient(F.col("polyline"), F.col("pu"), F.col("pv")).alias("line"), geo.length(F.col("polyline")).alias("length"))


def guided_paths(requests: DataFrame, pairs: DataFrame, vertices: DataFrame, edges: DataFrame, rho: float = 10.0, edge_samples: int = 12, buckets: int | None = None) -> DataFrame:
    """(pair_id, edge_id, u, v, target_u, target_v, line, witness): the source line of each request and the path that leaves its corridor least.

    All guided costs with the same ``rho`` and ``edge_samples`` compare the same lines. Unreachable requests have no row.
    """
    source = oriented_source(pairs, vertices, edges)
    asked = requests.join(source.select("pair_id", "edge_id", "line"), ["pair_id", "edge_id"]).withColumn("bucket", F.pmod(F.xxhash64("edge_id"), F.lit(buckets or buckets_of(requests))))
    keys = ("pair_id", "edge_id", "u", "v", "target_u", "target_v")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        picked: list[int] = []
        lines: list[np.ndarray] = []
        if left.num_rows and right.num_rows:
            t = _Target(right)
            net = kernels.Network(t.u, t.v)
            samples = np.stack([kernels.resample(x, edge_samples) for x in t.lines])
            left = left.sort_by([("edge_id", "ascending"), ("target_u", "ascending"), ("target_v", "ascending")])
            ids, starts, goals = (left[c].to_numpy() for c in ("edge_id", "target_u", "target_v"))
            source_lines = _lines(left["line"])
            cuts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                weights = net.weighed(kernels.corridor_weights(t.lengths, samples, source_lines[a], rho))
                found = {(s, g): arcs for s, wanted in _by_start(starts[a:b], goals[a:b]) for g, (_, arcs) in net.ways(weights, s, wanted).items()}
                for k in range(a, b):
                    if arcs := found.get((int(starts[k]), int(goals[k]))):
                        picked.append(k)
                        lines.append(kernels.route_line(arcs, t.lines))
        kept = left.select([*keys, "line"]).take(pa.array(picked, pa.int64()))
        # points of lines that cannot be null come as another type than the schema's
        return kept.set_column(len(keys), "line", kept["line"].cast(_LINE)).append_column("witness", _packed(lines))

    by = ["pair_id", "bucket"]
    schema = f"pair_id string, edge_id long, u long, v long, target_u long, target_v long, line {geo.POLYLINE}, witness {geo.POLYLINE}"
    return asked.groupBy(*by).cogroup(_target_tables(pairs, edges, asked).groupBy(*by)).applyInArrow(solve, schema)


def valued(paths: DataFrame, cost: Cost) -> DataFrame:
    """(pair_id, edge_id, u, v, target_u, target_v, value, witness) of guided paths, without infinite values."""
    found = curve_costs(paths.withColumnsRenamed({"line": "line_a", "witness": "line_b"}), cost).withColumnRenamed("line_b", "witness")
    return found.where(~F.isnan("value") & (F.col("value") < math.inf)).select("pair_id", "edge_id", "u", "v", "target_u", "target_v", "value", "witness")


def edge_costs(requests: DataFrame, pairs: DataFrame, vertices: DataFrame, edges: DataFrame, cost: Cost, buckets: int | None = None) -> DataFrame:
    """(pair_id, edge_id, u, v, target_u, target_v, value, witness) of all requests with a finite cost."""
    if cost.guided:
        return valued(guided_paths(requests, pairs, vertices, edges, cost.options["rho"], cost.options["edge_samples"], buckets), cost)
    source = oriented_source(pairs, vertices, edges)
    paths = shortest_paths(requests, pairs, edges, buckets)
    met = requests.join(paths, ["pair_id", "target_u", "target_v"]).join(source.select("pair_id", "edge_id", "length"), ["pair_id", "edge_id"])
    ratio = F.col("distance") / F.col("length")
    value = F.abs(ratio - 1) if cost.name == CostName.RELATIVE_LENGTH else F.abs(F.log(ratio))
    good = (F.col("length") > kernels.SHORTEST) & (F.col("distance") > kernels.SHORTEST)
    return met.where(good).select("pair_id", "edge_id", "u", "v", "target_u", "target_v", value.alias("value"), "witness")


# --- dominance ------------------------------------------------------------------------------------------------------


def dominance_pairs(candidates: DataFrame, costs: DataFrame, arcs_edges: DataFrame) -> DataFrame:
    """(pair_id, s, a, b): candidate a of s is at no incident edge worse than b, whatever the other end is mapped to.

    ``arcs_edges`` is (pair_id, edge_id, u, v). Opposite candidates that do not support b put no condition. Rows of the
    cost table are the supported combinations; finite costs are compared, and where b is supported a must be too.
    """
    sides = []
    for s, o in (("u", "v"), ("v", "u")):
        sides.append(costs.select("pair_id", "edge_id", F.lit(s).alias("side"), F.col(s).alias("s"), F.col(o).alias("o"), F.col(f"target_{s}").alias("t"), F.col(f"target_{o}").alias("c"), "value"))
    local = sides[0].unionByName(sides[1])
    alive = candidates.select("pair_id", F.col("source_vertex").alias("o"), F.col("target_vertex").alias("c"))
    mine = candidates.select("pair_id", F.col("source_vertex").alias("s"), F.col("target_vertex").alias("t"))
    local = local.join(alive, ["pair_id", "o", "c"], "left_semi").join(mine, ["pair_id", "s", "t"], "left_semi")
    both = mine.withColumnRenamed("t", "a").join(mine.withColumnRenamed("t", "b"), ["pair_id", "s"]).where("a <> b")
    b_rows = both.join(local.select("pair_id", "s", F.col("t").alias("b"), "edge_id", "side", "c", F.col("value").alias("vb")), ["pair_id", "s", "b"])
    a_rows = local.select("pair_id", "s", F.col("t").alias("a"), "edge_id", "side", "c", F.col("value").alias("va"))
    worse = b_rows.join(a_rows, ["pair_id", "s", "a", "edge_id", "side", "c"], "left").where(F.col("va").isNull() | (F.col("va") > F.col("vb")))
    return both.join(worse.select("pair_id", "s", "a", "b").distinct(), ["pair_id", "s", "a", "b"], "left_anti")


def dominance_prune(candidates: DataFrame, costs: DataFrame, arcs_edges: DataFrame, comparison_limit: int | None = None) -> DataFrame:
    """Candidates without those that another dominates (of two that dominate each other the smaller id stays), to a fixpoint.

    A pass compares every ordered pair of a source vertex's candidates. With ``comparison_limit`` a graph pair whose
    comparisons would exceed it in all skips that pass and keeps the candidates it has.
    """
    now = durable(candidates.select("pair_id", "source_vertex", "target_vertex").distinct())
    n = now.count()
    used = None
    while True:
        open_ = now
        if comparison_limit is not None:
            work = now.groupBy("pair_id", "source_vertex").agg(F.count("*").alias("k")).groupBy("pair_id").agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("work"))
            used = durable(work if used is None else work.join(used.withColumnRenamed("work", "before"), "pair_id").select("pair_id", (F.col("work") + F.col("before")).alias("work")))
            open_ = now.join(used.where(F.col("work") <= comparison_limit), "pair_id", "left_semi")
        found = dominance_pairs(open_, costs, arcs_edges)
        mutual = found.select("pair_id", "s", F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("back"))
        gone = found.join(mutual, ["pair_id", "s", "a", "b"], "left").where(F.col("back").isNull() | (F.col("a") < F.col("b")))
        gone = gone.select("pair_id", F.col("s").alias("source_vertex"), F.col("b").alias("target_vertex")).distinct()
        now = durable(now.join(gone, ["pair_id", "source_vertex", "target_vertex"], "left_anti"))
        m = now.count()
        if m == n:
            return now
        n = m


# --- decomposition and preflight ------------------------------------------------------------------------------------


def decompositions(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, bag_id, parent_bag_id, depth, variables, separator, edge_ids, width, heuristic, fill_width, degree_width).

    ``bag_id`` is the place in postorder. One graph is one group: elimination is sequential.
    """

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        graph = left["graph"][0].as_py()
        rows = sorted(zip(right["edge_id"].to_pylist(), right["u"].to_pylist(), right["v"].to_pylist(), strict=True))
        tree = kernels.Decomposition(sorted(left["vertex_id"].to_pylist()), rows)
        n = len(tree.bags)
        ids = pa.list_(pa.int64())
        return pa.table({
            "graph": pa.array([graph] * n, pa.string()), "bag_id": pa.array(range(n), pa.int32()), "parent_bag_id": pa.array(tree.parent, pa.int32()), "depth": pa.array(tree.depth, pa.int32()),
            "variables": pa.array([list(b) for b in tree.bags], ids), "separator": pa.array([list(s) for s in tree.separator], ids), "edge_ids": pa.array([[e for e, _, _ in mine] for mine in tree.owned], ids),
            "width": pa.array([tree.width] * n, pa.int32()), "heuristic": pa.array([tree.heuristic] * n, pa.string()), "fill_width": pa.array([tree.fill_width] * n, pa.int32()), "degree_width": pa.array([tree.degree_width] * n, pa.int32()),
        })

    schema = "graph string, bag_id int, parent_bag_id int, depth int, variables array<long>, separator array<long>, edge_ids array<long>, width int, heuristic string, fill_width int, degree_width int"
    e = edges.select(F.concat("graph").alias("graph"), "edge_id", "u", "v")
    return vertices.select("graph", "vertex_id").groupBy("graph").cogroup(e.groupBy("graph")).applyInArrow(solve, schema)


def preflight(bags: DataFrame, pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(pair_id, bag_id, variables, states): how many combinations each bag has; exact up to 38 digits."""
    sizes = candidates.groupBy("pair_id", "source_vertex").agg(F.count("*").alias("n"))
    each = pairs.select("pair_id", F.col("source").alias("graph")).join(bags, "graph").select("pair_id", "bag_id", "variables", F.explode("variables").alias("source_vertex"))
    met = each.join(sizes, ["pair_id", "source_vertex"], "left").fillna(0, ["n"])
    lists = met.groupBy("pair_id", "bag_id", "variables").agg(F.collect_list(F.col("n").cast("decimal(38,0)")).alias("ns"))
    product = F.aggregate("ns", F.lit(1).cast("decimal(38,0)"), lambda acc, x: (acc * x).cast("decimal(38,0)"))
    return lists.select("pair_id", "bag_id", "variables", product.alias("states"))


def preflight_totals(found: DataFrame) -> DataFrame:
    return found.groupBy("pair_id").agg(F.sum("states").cast("decimal(38,0)").alias("states"), F.min("states").alias("least"), F.max("states").alias("most")).withColumn("possible", F.col("least") > 0)


def largest_bags(found: DataFrame, n: int = 10) -> DataFrame:
    order = Window.partitionBy("pair_id").orderBy(F.desc("states"), "variables")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


# --- dynamic programming --------------------------------------------------------------------------------------------


def solve(candidates: DataFrame, costs: DataFrame, pairs: DataFrame, vertices: DataFrame, edges: DataFrame, objectives: tuple[str, ...] = tuple(Objective), most_cells: int = kernels.MOST_CELLS) -> DataFrame:
    """(pair_id, objective, feasible, value, states, messages, source_vertex, target_vertex): optimal mappings of many pairs, one group each.

    ``states`` are the bag states of finite value that the program met, ``messages`` the entries that bags hand on.

    An infeasible objective has one row without value and vertices. A pair with a bag of more than ``most_cells`` states has
    one row whose ``feasible`` is null: it is left to ``solve_relational``. Bag tables are dense arrays, so the least value and
    its lexicographically smallest state come from array reductions.
    """
    lengths = edges.select(F.col("graph").alias("source"), "edge_id", "u", "v", geo.length(F.col("polyline")).alias("w"))
    e = pairs.select("pair_id", "source").join(lengths, "source").select("pair_id", F.lit("e").alias("kind"), F.col("edge_id").alias("a"), F.col("u").alias("b"), F.col("v").alias("c"), "w")
    vs = pairs.select("pair_id", F.col("source").alias("graph")).join(vertices, "graph").select("pair_id", F.lit("v").alias("kind"), F.col("vertex_id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("w"))
    d = candidates.select("pair_id", F.lit("d").alias("kind"), F.col("source_vertex").alias("a"), F.col("target_vertex").alias("b"), F.lit(0).cast("long").alias("c"), F.lit(0.0).alias("w"))
    right = e.unionByName(vs).unionByName(d).select(F.concat("pair_id").alias("pair_id"), "kind", "a", "b", "c", "w")
    left = costs.select("pair_id", "edge_id", "target_u", "target_v", "value")

    def run(rows: pa.Table, rest: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("pair_id", "objective", "feasible", "value", "states", "messages", "source_vertex", "target_vertex")}
        pair = rest["pair_id"][0].as_py()
        kind = np.array(rest["kind"].to_pylist())
        a, b, c, w = (rest[x].to_numpy() for x in "abcw")
        names = sorted(a[kind == "v"].tolist())
        domains = {v: np.unique(b[(kind == "d") & (a == v)]) for v in names}
        source = sorted(zip(a[kind == "e"].tolist(), b[kind == "e"].tolist(), c[kind == "e"].tolist(), strict=True))
        weights = dict(zip(a[kind == "e"].tolist(), w[kind == "e"].tolist(), strict=True))
        tree = kernels.Decomposition(names, source)
        ids, tu, tv, value = (rows[x].to_numpy() for x in ("edge_id", "target_u", "target_v", "value"))
        if (value < 0).any():
            raise ValueError("a local cost is negative")
        tables = {}
        order = np.argsort(ids, kind="stable")
        ids, tu, tv, value = ids[order], tu[order], tv[order], value[order]
        for k, u, v in source:
            lo, hi = np.searchsorted(ids, [k, k + 1])
            table = np.full((len(domains[u]), len(domains[v])), np.inf)
            if table.size and hi > lo:
                i, j = np.searchsorted(domains[u], tu[lo:hi]), np.searchsorted(domains[v], tv[lo:hi])
                i, j = np.minimum(i, len(domains[u]) - 1), np.minimum(j, len(domains[v]) - 1)
                on = (domains[u][i] == tu[lo:hi]) & (domains[v][j] == tv[lo:hi])
                table[i[on], j[on]] = np.where(np.isnan(value[lo:hi][on]), np.inf, value[lo:hi][on])
            tables[k] = table
        for objective in objectives:
            counts: list[tuple[int, int]] = []
            try:
                found = kernels.solve_bags(tree, domains, tables, weights, str(objective), counts, most_cells) if all(len(x) for x in domains.values()) else None
            except kernels.TooLarge:
                for col, x in zip(out, (pair, str(objective), None, None, None, None, None, None), strict=True):
                    out[col].append(x)
                continue
            states, entries = (sum(x) for x in zip(*counts, strict=True)) if counts else (0, 0)
            for s, t in found[1].items() if found else [(None, None)]:
                for col, x in zip(out, (pair, str(objective), found is not None, found[0] if found else None, states, entries, s, t), strict=True):
                    out[col].append(x)
        kinds = (pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({col: pa.array(x, t) for (col, x), t in zip(out.items(), kinds, strict=True)})

    return left.groupBy("pair_id").cogroup(right.groupBy("pair_id")).applyInArrow(run, "pair_id string, objective string, feasible boolean, value double, states long, messages long, source_vertex long, target_vertex long")


def solve_relational(candidates: DataFrame, costs: DataFrame, tree: kernels.Decomposition, objective: str, weights: dict[int, float] | None = None) -> DataFrame:
    """(pair_id, value, state) for pairs that share one source graph, as joins and aggregates over its bags.

    A bag's states are the join of its owned edges' costs, its children's messages and its free candidates; its message
    is the least (value, state) for each separator key. For tables too large for one task; each message is
    checkpointed. ``state`` is an array of (source vertex, target vertex).
    """
    worse = (lambda x, y: F.greatest(x, y)) if objective == Objective.BOTTLENECK else (lambda x, y: x + y)
    messages: dict[int, DataFrame] = {}
    for k, bag in enumerate(tree.bags):
        parts: list[tuple[tuple[int, ...], DataFrame]] = []
        for e, u, v in tree.owned[k]:
            factor = (weights or {}).get(e, 1.0) if objective == Objective.LENGTH_WEIGHTED else 1.0
            parts.append(((u, v), costs.where(F.col("edge_id") == e).select("pair_id", F.col("target_u").alias(f"v{u}"), F.col("target_v").alias(f"v{v}"), (F.col("value") * factor).alias("_x"), F.expr("cast(array() as array<struct<s: bigint, t: bigint>>)").alias("_more"))))
        parts += [(tree.separator[c], messages[c].select("pair_id", *[f"v{x}" for x in tree.separator[c]], F.col("value").alias("_x"), F.col("state").alias("_more"))) for c in tree.children[k]]
        states, have = None, set()
        for names, part in parts:
            if states is None:
                states = part.withColumnRenamed("_x", "value").withColumnRenamed("_more", "more")
            else:
                both = states.join(part, ["pair_id", *[f"v{x}" for x in names if x in have]])
                states = both.withColumn("value", worse(F.col("value"), F.col("_x"))).withColumn("more", F.concat("more", "_more")).drop("_x", "_more")
            have |= set(names)
        for v in bag:
            own = candidates.where(F.col("source_vertex") == v).select("pair_id", F.col("target_vertex").alias(f"v{v}"))
            if v not in have:
                states = own.withColumn("value", F.lit(0.0)).withColumn("more", F.expr("cast(array() as array<struct<s: bigint, t: bigint>>)")) if states is None else states.join(own, "pair_id")
            else:
                states = states.join(own, ["pair_id", f"v{v}"], "left_semi")
            have.add(v)
        state = F.array(*[F.col(f"v{v}") for v in bag])
        mine = F.array(*[F.struct(F.lit(v).cast("long").alias("s"), F.col(f"v{v}").alias("t")) for v in bag])
        key = ["pair_id", *[f"v{x}" for x in tree.separator[k]]]
        best = states.groupBy(*key).agg(F.min(F.struct("value", state.alias("state"), F.array_union(mine, F.col("more")).alias("all"))).alias("b"))
        messages[k] = durable(best.select(*key, "b.value", F.col("b.all").alias("state")))
        for c in tree.children[k]:
            del messages[c]
    return messages[len(tree.bags) - 1].select("pair_id", "value", F.array_sort("state").alias("state"))


def evaluate_mapping(mapping: DataFrame, costs_of: Callable[[DataFrame], DataFrame], pairs: DataFrame, edges: DataFrame, candidates: DataFrame, effective: DataFrame) -> DataFrame:
    """Scores of given total mappings (pair_id, source_vertex, target_vertex), without optimising.

    (pair_id, additive, bottleneck, length_weighted, invalid_edge_ids, candidate_violations, effective_violations);
    the three values are null if an edge has no finite cost. ``costs_of`` turns requests into costs.
    """
    lengths = edges.select(F.col("graph").alias("source"), "edge_id", "u", "v", geo.length(F.col("polyline")).alias("w"))
    e = pairs.select("pair_id", "source").join(lengths, "source")
    mu = mapping.select("pair_id", F.col("source_vertex").alias("u"), F.col("target_vertex").alias("target_u"))
    mv = mapping.select("pair_id", F.col("source_vertex").alias("v"), F.col("target_vertex").alias("target_v"))
    asked = e.join(mu, ["pair_id", "u"], "left").join(mv, ["pair_id", "v"], "left")
    known = costs_of(asked.where("target_u <> target_v").select("pair_id", "edge_id", "u", "v", "target_u", "target_v")).select("pair_id", "edge_id", "value")
    met = asked.join(known, ["pair_id", "edge_id"], "left")
    bad = F.count_if(F.col("value").isNull())
    scores = met.groupBy("pair_id").agg(
        F.when(bad == 0, F.sum("value")).alias("additive"), F.when(bad == 0, F.max("value")).alias("bottleneck"), F.when(bad == 0, F.sum(F.col("w") * F.col("value"))).alias("length_weighted"),
        F.array_sort(F.collect_list(F.when(F.col("value").isNull(), F.col("edge_id")))).alias("invalid_edge_ids"),
    )
    out = pairs.select("pair_id").join(mapping.select("pair_id").distinct(), "pair_id").join(scores, "pair_id", "left")
    out = out.select("pair_id", *[F.when(F.col("invalid_edge_ids").isNull(), F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in ("additive", "bottleneck", "length_weighted")], F.coalesce("invalid_edge_ids", F.expr("cast(array() as array<bigint>)")).alias("invalid_edge_ids"))
    for name, sets in (("candidate_violations", candidates), ("effective_violations", effective)):
        off = mapping.join(sets, ["pair_id", "source_vertex", "target_vertex"], "left_anti").groupBy("pair_id").agg(F.array_sort(F.collect_list("source_vertex")).alias(name))
        out = out.join(off, "pair_id", "left").withColumn(name, F.coalesce(name, F.expr("cast(array() as array<bigint>)")))
    return out


# --- relational forms of single kernels, for many rows at once --------------------------------------------------------


def corridor_weights(pairs: DataFrame, vertices: DataFrame, edges: DataFrame, rho: float = 10.0, edge_samples: int = 12) -> DataFrame:
    """(pair_id, source_edge, edge_id, weight): a target edge's length times its share of samples beyond ``rho`` of the
    source edge's line, and a millionth of its length more, so that of equal routes the shorter wins."""
    source = oriented_source(pairs, vertices, edges).select("pair_id", F.col("edge_id").alias("source_edge"), F.explode(geo.measured(F.col("line"))).alias("s"))
    points = pairs.select("pair_id", F.col("target").alias("graph")).join(edges, "graph").select("pair_id", "edge_id", geo.length(F.col("polyline")).alias("length"), F.posexplode(geo.resample(F.col("polyline"), edge_samples)).alias("i", "p"))
    s = F.col("s")
    d2 = geo.squared_distance(F.col("p.x"), F.col("p.y"), s["sx"], s["sy"], s["vx"], s["vy"], s["len"] * s["len"])
    near = points.join(source, "pair_id").groupBy("pair_id", "source_edge", "edge_id", "length", "i").agg(F.min(d2).alias("d2"))
    share = F.avg((F.sqrt("d2") > rho).cast("double"))
    return near.groupBy("pair_id", "source_edge", "edge_id", "length").agg((share * F.col("length") + F.lit(kernels.LENGTH_TIE_BREAK) * F.col("length")).alias("weight")).drop("length")


def curve_costs(curves: DataFrame, cost: Cost) -> DataFrame:
    """``curves`` (line_a, line_b and any other columns) with ``value``: a curve cost of given pairs of lines."""
    from pyspark.sql import types as T

    @F.arrow_udf(T.DoubleType())
    def compared(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(cost.of(_lines(a), _lines(b)), pa.float64())

    return curves.withColumn("value", compared(F.col("line_a"), F.col("line_b")))
