"""Studies over configurations: modes and radii with statuses, and what dominance pruning changes."""

from __future__ import annotations

import time
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import candidates as cand
from netloom.operators import matching as m
from netloom.plans.durable import durable
from netloom.plans.matcher import Matcher


def mode_grid(pairs: DataFrame, vertices: DataFrame, edges: DataFrame, radii: Iterable[float], modes: Iterable[str] = (cand.CandidateMode.JUNCTIONS,), cost: m.Cost | None = None, objective: str = m.Objective.ADDITIVE, state_limit: int | None = None, **options) -> DataFrame:
    """(pair_id, mode, rho, status, empty, states, value, message): what each pair comes to in each mode at each radius.

    The status is ``empty_domains`` where a source vertex has no candidate, ``state_limit`` where the bags have more states
    than allowed, ``globally_infeasible`` where no mapping has a finite cost, ``error`` with a message where a
    configuration fails, for all of its pairs, else ``ok`` with the optimal value (null without a cost). A configuration
    is one job over all pairs; the grid is a short list that the driver goes through.
    """
    parts = []
    for mode in modes:
        for rho in radii:
            try:
                part = durable(_configured(pairs, vertices, edges, cand.CandidateMode(mode), rho, cost, objective, state_limit, options))
            except Exception as error:  # noqa: BLE001 - a study goes on with the next configuration
                none = F.lit(None)
                part = pairs.select("pair_id", F.lit("error").alias("status"), none.cast("long").alias("empty"), none.cast("decimal(38,0)").alias("states"), none.cast("double").alias("value"), F.lit(str(error)[:500]).alias("message"))
            parts.append(part.select("pair_id", F.lit(str(mode)).alias("mode"), F.lit(float(rho)).alias("rho"), "status", "empty", "states", "value", "message"))
    return reduce(DataFrame.unionByName, parts)


def _configured(pairs, vertices, edges, mode, rho, cost, objective, state_limit, options) -> DataFrame:
    task = Matcher(pairs, vertices, edges, rho=rho, mode=mode, **options)
    empty = durable(task.statistics().select("pair_id", "empty"))
    states = durable(m.preflight_totals(task.preflight()).select("pair_id", "states"))
    met = pairs.select("pair_id").join(empty, "pair_id", "left").join(states, "pair_id", "left")
    over = F.lit(False) if not state_limit or state_limit <= 0 else F.col("states") > state_limit
    status = F.when(F.col("empty") > 0, "empty_domains").when(over, "state_limit")
    value = F.lit(None).cast("double")
    if cost is not None:
        fit = met.where((F.col("empty") == 0) & ~over).select("pair_id")
        solved = task.only(fit).match(cost, objective).values.select("pair_id", "feasible", F.col("value").alias("best"))
        met = met.join(solved, "pair_id", "left")
        status = status.when(~F.coalesce("feasible", F.lit(False)), "globally_infeasible")
        value = F.col("best")
    return met.select("pair_id", status.otherwise("ok").alias("status"), "empty", "states", value.alias("value"), F.lit(None).cast("string").alias("message"))


def dominance_benchmark(task: Matcher, cost: m.Cost, objective: str = m.Objective.ADDITIVE, relative: float = 1e-10, absolute: float = 1e-12) -> tuple[DataFrame, dict[str, float]]:
    """((pair_id, candidates, kept, value, pruned_value, equal), seconds with and without): pruning must not change an optimum."""
    task.costs(cost)
    seconds = {}
    found = {}
    for name in (m.Dominance.OFF, m.Dominance.ON):
        begin = time.monotonic()
        found[name] = durable(task.match(cost, objective, dominance=name).values.select("pair_id", "feasible", "value"))
        seconds[str(name)] = time.monotonic() - begin
    kept = m.dominance_prune(task.effective, task.costs(cost), task.arcs).groupBy("pair_id").agg(F.count("*").alias("kept"))
    every = task.effective.groupBy("pair_id").agg(F.count("*").alias("candidates"))
    other = found[m.Dominance.ON].select("pair_id", F.col("feasible").alias("also"), F.col("value").alias("pruned_value"))
    met = found[m.Dominance.OFF].join(other, "pair_id").join(every, "pair_id", "left").join(kept, "pair_id", "left")
    gap = F.abs(F.col("value") - F.col("pruned_value"))
    near = (gap <= absolute) | (gap <= relative * F.greatest(F.abs("value"), F.abs("pruned_value")))
    return met.select("pair_id", "candidates", "kept", "value", "pruned_value", ((F.col("feasible") == F.col("also")) & F.coalesce(near, F.lit(True))).alias("equal")), seconds
