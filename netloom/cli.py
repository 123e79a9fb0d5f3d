"""Command line: match one graph file into another and write the result as JSON.

Exit codes: 0 if a mapping was found for every objective asked for, 2 if not or if the arguments are wrong.
"""

from __future__ import annotations

import argparse
import contextlib
import json
import math
import re
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from netloom.operators import matching as m
from netloom.operators.prepare import catalogue, junction_graphs
from netloom.plans.durable import durable
from netloom.plans.matcher import Matcher
from netloom.sources import results
from netloom.sources.graph_text import raw_graphs, read_files


_OPTION = re.compile(r"(?P<name>[^=]+)=(?P<value>.*)", re.S)


def cost_option(argument: str) -> tuple[str, object]:
    """One ``name=value`` of the command line as (name, value): JSON where it is, plain text elsewhere."""
    match = _OPTION.fullmatch(argument)
    if match is None:
        raise ValueError(f"{argument!r} is no name=value")
    value: object = match["value"]
    with contextlib.suppress(ValueError):
        value = json.loads(match["value"])
    return match["name"], value


def parse_options(values: list[str]) -> dict:
    """All options of a cost; each may be given once."""
    options = dict(map(cost_option, values))
    if len(options) < len(values):
        raise ValueError("a cost option is given twice")
    return options


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="netloom", description="Match one embedded network into another.")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--cost", required=True, choices=m.available_costs())
    p.add_argument("--objective", default="both", choices=["both", "all", *(o.value for o in m.Objective)])
    p.add_argument("--rho", type=float, default=10.0)
    p.add_argument("--top-k", type=int, default=25)
    p.add_argument("--cost-option", action="append", default=[], metavar="KEY=VALUE")
    p.add_argument("--dominance", nargs="?", const="on", default="off", choices=[d.value for d in m.Dominance])
    p.add_argument("--state-limit", type=int)
    p.add_argument("--output")
    return p


def payload(task: Matcher, solution, sides: dict, parameters: dict) -> dict:
    """One document: parameters, candidates, decomposition, bag states and the solutions."""
    stats = task.statistics().first()
    bags = task.decomposition
    shape = bags.agg(F.max("width").alias("width"), F.max(F.size("variables")).alias("most"), F.count("*").alias("n"), F.first("heuristic").alias("h"), F.max("fill_width").alias("f"), F.max("degree_width").alias("d")).first()
    sets = task.candidates.groupBy("source_vertex").agg(F.array_sort(F.collect_list("target_vertex")).alias("t")).collect()
    states = m.preflight_totals(task.preflight(task.effective)).first()
    met = solution.statistics.groupBy("objective").agg(F.max("states").alias("states"), F.max("messages").alias("messages")).collect()
    documents = {r["objective"]: json.loads(r["json"]) for r in results.solution_json(solution.values, solution.mapping, solution.edges).collect()}
    return {
        "schema_version": 1, **sides, "parameters": parameters, "cost": str(solution.cost.name),
        "candidate_statistics": {"source_vertices": stats["sources"], "empty_domains": stats["empty"], "total_candidates": stats["total"], "minimum_candidates": stats["least"], "maximum_candidates": stats["most"]},
        "candidate_sets": {str(r["source_vertex"]): r["t"] for r in sets},
        "decomposition": {"width": shape["width"], "maximum_bag_size": shape["most"], "bag_count": shape["n"], "heuristic": shape["h"], "minimum_fill_width": shape["f"], "minimum_degree_width": shape["d"]},
        "dynamic_programming": {"bag_states": int(states["states"]) if states and states["states"] is not None else 0, "unique_cost_requests": task.costs(solution.cost).count(),
                                "enumerated_states": {r["objective"]: r["states"] for r in met}, "feasible_states": {r["objective"]: r["states"] for r in met}, "message_entries": {r["objective"]: r["messages"] for r in met}},
        "solutions": documents,
    }


def main(argv: list[str] | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if not math.isfinite(args.rho) or args.rho <= 0:
        p.error("--rho must be finite and above 0")
    if args.top_k <= 0:
        p.error("--top-k must be above 0")
    try:
        options = parse_options(args.cost_option)
        cost = m.create_cost(args.cost, **options)
    except ValueError as error:
        p.error(str(error))
    spark = SparkSession.builder.appName("netloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    files = {"source": Path(args.source), "target": Path(args.target)}
    # the roles are the graphs' names, so that a file can be matched into itself
    named = [raw_graphs(read_files(spark, str(path)).withColumn("graph", F.lit(role))) for role, path in files.items()]
    vertices, edges = (durable(t) for t in junction_graphs(named[0][0].unionByName(named[1][0]), named[0][1].unionByName(named[1][1])))
    pairs = spark.createDataFrame([("pair", "source", "target")], "pair_id string, source string, target string")
    task = Matcher(pairs, vertices, edges, args.rho, args.top_k)
    objectives = {"both": (m.Objective.ADDITIVE, m.Objective.BOTTLENECK), "all": tuple(m.Objective)}.get(args.objective) or (m.Objective(args.objective),)
    solution = task.match_all(cost, objectives, args.dominance, args.state_limit)
    sizes = {r["graph"]: r for r in catalogue(vertices, edges).collect()}
    sides = {role: {"name": path.stem, "path": str(path), "vertices": sizes[role]["vertices"], "edges": sizes[role]["edges"]} for role, path in files.items()}
    parameters = {"cost": str(cost.name), "objective": args.objective, "candidate_rho": args.rho, "top_k": args.top_k, "cost_options": options}
    document = payload(task, solution, sides, parameters)
    out = Path(args.output or f"match_{files['source'].stem}_to_{files['target'].stem}_{args.cost}_{args.objective}.json")
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(json.dumps(document, indent=2, sort_keys=True, allow_nan=False) + "\n", encoding="utf-8")
    return 0 if len(document["solutions"]) == len(objectives) and all(d["feasible"] for d in document["solutions"].values()) else 2


if __name__ == "__main__":
    sys.exit(main())
