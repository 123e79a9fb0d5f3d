"""Matching many graph pairs with one configuration: candidates, pruning, costs, optimal mappings, evaluation.

A ``Matcher`` holds checkpointed tables for its pairs; stages are computed once, when first asked for.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import geometry as geo
from netloom.functions import kernels
from netloom.operators import candidates as cand
from netloom.operators import matching as m
from netloom.plans.durable import durable


@dataclass
class Solution:
    """Tables of one solve.

    ``values``: pair_id, objective, feasible, value. ``mapping``: pair_id, objective, source_vertex, target_vertex.
    ``edges``: pair_id, objective, edge_id, u, v, target_u, target_v, value, witness. ``limited``: pairs over the limit.
    ``statistics``: pair_id, objective, states, messages; null for pairs that were solved by joins.
    """

    cost: m.Cost
    values: DataFrame
    mapping: DataFrame
    edges: DataFrame
    limited: DataFrame
    statistics: DataFrame


def cost_id(cost: m.Cost) -> str:
    return f"{cost.name!s} {json.dumps(cost.options, sort_keys=True)}"


class Matcher:
    def __init__(self, pairs: DataFrame, vertices: DataFrame, edges: DataFrame, rho: float = cand.RHO, top_k: int = cand.TOP_K, mode: cand.CandidateMode = cand.CandidateMode.JUNCTIONS, candidate_sets: DataFrame | None = None, **options):
        cand.check_parameters(rho, top_k)
        self.rho, self.top_k, self.mode = rho, top_k, mode
        if candidate_sets is not None:
            self.pairs, self.vertices, self.edges = pairs, vertices, edges
            self.ranked = None
            self.candidates = durable(cand.normalise_candidates(candidate_sets, pairs, vertices))
        else:
            ranked, self.pairs, self.vertices, self.edges = cand.mode_candidates(pairs, vertices, edges, mode, rho, top_k, **options)
            self.ranked = durable(ranked)
            self.candidates = self.ranked.select("pair_id", "source_vertex", "target_vertex")
        self._costs: dict[str, DataFrame] = {}
        self._witnesses: dict[tuple[float, int], DataFrame] = {}

    def only(self, pairs: DataFrame) -> Matcher:
        """The same task for some of its pairs (pair_id), with the candidates it has."""
        held = self.pairs.join(pairs, "pair_id", "left_semi")
        return Matcher(held, self.vertices, self.edges, self.rho, self.top_k, self.mode, candidate_sets=self.candidates.join(pairs, "pair_id", "left_semi"))

    @cached_property
    def sources(self) -> tuple[DataFrame, DataFrame]:
        names = self.pairs.select(F.col("source").alias("graph")).distinct()
        return self.vertices.join(names, "graph", "left_semi"), self.edges.join(names, "graph", "left_semi")

    @cached_property
    def decomposition(self) -> DataFrame:
        return durable(m.decompositions(*self.sources))

    @cached_property
    def effective(self) -> DataFrame:
        """Candidates that arc consistency leaves."""
        return durable(m.arc_consistency(self.candidates, self.pairs, self.vertices, self.edges))

    @cached_property
    def arcs(self) -> DataFrame:
        return self.pairs.select("pair_id", F.col("source").alias("graph")).join(self.edges.select("graph", "edge_id", "u", "v"), "graph").drop("graph")

    def statistics(self, effective: bool = False) -> DataFrame:
        return cand.candidate_statistics(self.effective if effective else self.candidates, self.pairs, self.vertices)

    def preflight(self, candidates: DataFrame | None = None) -> DataFrame:
        return m.preflight(self.decomposition, self.pairs, self.candidates if candidates is None else candidates)

    def costs(self, cost: m.Cost) -> DataFrame:
        """Values and witnesses of all requests that the effective candidates allow; kept for each cost and options."""
        key = cost_id(cost)
        if key not in self._costs:
            if cost.guided:
                found = m.valued(self.witnesses(cost.options["rho"], cost.options["edge_samples"]), cost)
            else:
                found = m.edge_costs(self.requests, self.pairs, self.vertices, self.edges, cost)
            self._costs[key] = durable(found)
        return self._costs[key]

    @cached_property
    def requests(self) -> DataFrame:
        return m.all_requests(self.effective, self.pairs, self.edges)

    def witnesses(self, rho: float, edge_samples: int) -> DataFrame:
        """Guided paths of all requests; kept, since all guided costs with these two options share them."""
        key = (rho, edge_samples)
        if key not in self._witnesses:
            self._witnesses[key] = durable(m.guided_paths(self.requests, self.pairs, self.vertices, self.edges, rho, edge_samples))
        return self._witnesses[key]

    def _within(self, domains: DataFrame, limit: int | None) -> tuple[DataFrame, DataFrame]:
        """(pairs to solve, pairs over the limit); a limit of 0 or less, as None, is none."""
        if not limit or limit <= 0:
            return self.pairs, self.pairs.limit(0)
        totals = m.preflight_totals(self.preflight(domains)).select("pair_id", "states")
        over = totals.where(F.col("states") > limit)
        return self.pairs.join(over, "pair_id", "left_anti"), self.pairs.join(over, "pair_id", "left_semi")

    def match_all(self, cost: m.Cost, objectives: tuple[str, ...] = tuple(m.Objective), dominance: bool | str = False, state_limit: int | None = None, comparison_limit: int | None = None, most_cells: int = kernels.MOST_CELLS) -> Solution:
        """Optimal mappings for the objectives; ``state_limit`` keeps pairs with more bag states from being solved.

        ``dominance`` is off, on or auto, or a boolean. Pairs with a bag table too large for one task are solved by joins.
        """
        domains = self.effective
        costs = self.costs(cost)
        wanted = m.Dominance("on" if dominance is True else "off" if dominance is False else dominance)
        if wanted.applies(cost):
            domains = m.dominance_prune(domains, costs, self.arcs, comparison_limit)
        pairs, limited = self._within(domains, state_limit)
        pairs = durable(pairs)
        domains, costs = domains.join(pairs, "pair_id", "left_semi"), costs.join(pairs, "pair_id", "left_semi")
        found = durable(m.solve(domains, costs, pairs, self.vertices, self.edges, objectives, most_cells))
        wide = found.where("feasible is null").select("pair_id").distinct()
        names = [r["source"] for r in wide.join(pairs, "pair_id").select("source").distinct().collect()]
        if names:
            wide = durable(pairs.join(wide, "pair_id", "left_semi"))
            parts = [self._solve_wide(wide.where(F.col("source") == name), name, domains, costs, objectives) for name in names]
            found = durable(reduce(DataFrame.unionByName, parts, found.join(wide.select("pair_id"), "pair_id", "left_anti")))
        values = found.select("pair_id", "objective", "feasible", "value").distinct()
        mapping = found.where("source_vertex is not null").select("pair_id", "objective", "source_vertex", "target_vertex")
        return Solution(cost, values, mapping, materialise(mapping, self.arcs, costs), limited, found.select("pair_id", "objective", "states", "messages").distinct())

    def _solve_wide(self, pairs: DataFrame, source: str, domains: DataFrame, costs: DataFrame, objectives: tuple[str, ...]) -> DataFrame:
        """The rows of ``solve`` for pairs with one source graph, whose decomposition the driver holds."""
        graph = F.col("graph") == source
        lines = self.edges.where(graph).select("edge_id", "u", "v", geo.length(F.col("polyline")).alias("w")).collect()
        vertices = sorted(r["vertex_id"] for r in self.vertices.where(graph).select("vertex_id").collect())
        tree = kernels.Decomposition(vertices, sorted((r["edge_id"], r["u"], r["v"]) for r in lines))
        weights = {r["edge_id"]: r["w"] for r in lines}
        mine, known = domains.join(pairs, "pair_id", "left_semi"), costs.join(pairs, "pair_id", "left_semi")
        parts = []
        for objective in objectives:
            best = m.solve_relational(mine, known, tree, objective, weights)
            met = pairs.select("pair_id").join(best, "pair_id", "left").withColumn("p", F.explode_outer("state"))
            none = F.lit(None).cast("long")
            parts.append(met.select("pair_id", F.lit(str(objective)).alias("objective"), F.col("value").isNotNull().alias("feasible"), "value", none.alias("states"), none.alias("messages"), F.col("p.s").alias("source_vertex"), F.col("p.t").alias("target_vertex")))
        return reduce(DataFrame.unionByName, parts)

    def match(self, cost: m.Cost, objective: str = m.Objective.ADDITIVE, **options) -> Solution:
        return self.match_all(cost, (m.Objective(objective),), **options)

    def match_both(self, cost: m.Cost) -> Solution:
        return self.match_all(cost, (m.Objective.ADDITIVE, m.Objective.BOTTLENECK))

    def evaluate_mapping(self, mapping: DataFrame, cost: m.Cost) -> DataFrame:
        checked = cand.normalise_candidates(mapping, self.pairs, self.vertices)
        twice = mapping.groupBy("pair_id", "source_vertex").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
        if twice:
            raise ValueError(f"source vertex {twice[0]['source_vertex']} is mapped more than once")
        gaps = cand.source_points(self.pairs.join(checked.select("pair_id").distinct(), "pair_id", "left_semi"), self.vertices).join(checked, ["pair_id", "source_vertex"], "left_anti").limit(1).collect()
        if gaps:
            raise ValueError(f"source vertex {gaps[0]['source_vertex']} is not mapped")
        return m.evaluate_mapping(checked, lambda asked: m.edge_costs(asked, self.pairs, self.vertices, self.edges, cost), self.pairs, self.edges, self.candidates, self.effective)

    def check(self, solution: Solution, relative: float = 1e-10, absolute: float = 1e-12) -> DataFrame:
        """(pair_id, objective, value, realised, ok): objectives recomputed from the solution's edges."""
        w = self.pairs.select("pair_id", F.col("source").alias("graph")).join(self.edges.select("graph", "edge_id", geo.length(F.col("polyline")).alias("w")), "graph").drop("graph")
        sums = solution.edges.join(w, ["pair_id", "edge_id"]).groupBy("pair_id", "objective").agg(F.sum("value").alias("s"), F.max("value").alias("b"), F.sum(F.col("w") * F.col("value")).alias("l"))
        met = solution.values.where("feasible").join(sums, ["pair_id", "objective"], "left").fillna(0.0, ["s", "b", "l"])
        real = F.when(F.col("objective") == m.Objective.BOTTLENECK, F.col("b")).when(F.col("objective") == m.Objective.LENGTH_WEIGHTED, F.col("l")).otherwise(F.col("s"))
        gap = F.abs(real - F.col("value"))
        return met.select("pair_id", "objective", "value", real.alias("realised"), ((gap <= absolute) | (gap <= relative * F.greatest(F.abs(real), F.abs("value")))).alias("ok"))


def materialise(mapping: DataFrame, arcs: DataFrame, costs: DataFrame) -> DataFrame:
    """The cost and witness of every source edge under the mappings."""
    mu = mapping.select("pair_id", "objective", F.col("source_vertex").alias("u"), F.col("target_vertex").alias("target_u"))
    mv = mapping.select("pair_id", "objective", F.col("source_vertex").alias("v"), F.col("target_vertex").alias("target_v"))
    at = arcs.join(mu, ["pair_id", "u"]).join(mv, ["pair_id", "objective", "v"])
    known = costs.select("pair_id", "edge_id", "target_u", "target_v", "value", "witness")
    return at.join(known, ["pair_id", "edge_id", "target_u", "target_v"]).select("pair_id", "objective", "edge_id", "u", "v", "target_u", "target_v", "value", "witness")


def match_graphs(pairs: DataFrame, vertices: DataFrame, edges: DataFrame, cost: m.Cost, objective: str = m.Objective.ADDITIVE, **options) -> Solution:
    return Matcher(pairs, vertices, edges, **options).match(cost, objective)


def match_graphs_both(pairs: DataFrame, vertices: DataFrame, edges: DataFrame, cost: m.Cost, **options) -> Solution:
    return Matcher(pairs, vertices, edges, **options).match_both(cost)
