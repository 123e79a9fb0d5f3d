"""Studies, registered costs, limits and digests."""

import math
import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import candidates as cand
from netloom.operators import matching as m
from netloom.operators import reports
from netloom.plans import studies
from netloom.plans.matcher import Matcher
from tests.test_matching import P, graphs, one_pair


@pytest.fixture(scope="module")
def grid(spark):
    """A path of three vertices beside a 3 by 3 grid, and the same path far away."""
    place = {10 * r + c: (10 * c, 10 * r) for r in range(3) for c in range(3)}
    edges = [(k, a, b, None) for k, (a, b) in enumerate((a, b) for a in place for b in place if b in (a + 1, a + 10))]
    v, e = graphs(spark, S=({1: (1, 1), 2: (11, 1), 3: (21, 1)}, [(0, 1, 2, None), (1, 2, 3, None)]), F=({1: (500, 0), 2: (510, 0)}, [(0, 1, 2, None)]), T=(place, edges))
    pairs = spark.createDataFrame([("near", "S", "T"), ("far", "F", "T")], P)
    return pairs, v.checkpoint() if spark.sparkContext.getCheckpointDir() else v, e


def _gap(a, b, power=1.0):
    return math.dist(a[0], b[0]) ** power


def test_grid_of_modes_and_radii(spark, grid):
    cost = m.create_cost("relative_length_error")
    rows = studies.mode_grid(*grid, [0.5, 2.0], cost=cost, state_limit=10_000).unionByName(studies.mode_grid(*grid, [2.0], ["original_target_vertices"], cost))
    found = {(r.pair_id, r["mode"], r.rho): r for r in rows.collect()}
    assert found["near", "target_junctions", 0.5].status == "empty_domains" and found["near", "target_junctions", 0.5].empty == 3
    ok = found["near", "target_junctions", 2.0]
    assert ok.status == "ok" and ok.value == 0 and found["far", "target_junctions", 2.0].status == "empty_domains"
    # the original vertices were not given
    assert {r.status for k, r in found.items() if k[1] == "original_target_vertices"} == {"error"} and "original" in found["near", "original_target_vertices", 2.0].message
    limited = studies.mode_grid(*grid, [2.0], cost=cost, state_limit=1).where("pair_id = 'near'").first()
    assert limited.status == "state_limit" and limited.states > 1


def test_wide_pairs_are_solved_by_joins(spark, grid):
    pairs, v, e = grid
    task = Matcher(pairs.where("pair_id = 'near'"), v, e, rho=2.0)
    cost = m.create_cost("relative_length_error")
    dense, wide = task.match_all(cost), task.match_all(cost, most_cells=3)
    key = ["objective", "feasible", "value"]
    assert sorted(map(tuple, dense.values.select(*key).collect())) == sorted(map(tuple, wide.values.select(*key).collect()))
    assert wide.mapping.count() == dense.mapping.count() == 9 and wide.statistics.where("states is not null").count() == 0
    first = dense.statistics.first()
    assert first.states > 0 and first.messages > 0


def test_registered_cost(spark, grid):
    pairs, v, e = grid
    with pytest.raises(ValueError, match="there is a cost"):
        m.register_cost("hausdorff_distance", _gap)
    m.register_cost("start_gap", _gap, power=1.0)
    try:
        assert "start_gap" in m.available_costs() and m.cost_options("start_gap") == {"rho": 10.0, "edge_samples": 12, "power": 1.0}
        with pytest.raises(ValueError, match="no option"):
            m.create_cost("start_gap", other=1)
        task = Matcher(pairs.where("pair_id = 'near'"), v, e, rho=2.0)
        found = {(r.edge_id, r.target_u, r.target_v): r.value for r in task.costs(m.create_cost("start_gap", power=2.0)).collect()}
        assert found[0, 0, 1] == pytest.approx(2) and found[0, 1, 0] == pytest.approx(82)
        # guided costs share their witnesses
        task.costs(m.create_cost("hausdorff_distance"))
        assert len(task._witnesses) == 1
    finally:
        del m.CUSTOM["start_gap"]
    with pytest.raises(ValueError, match="unknown cost"):
        m.create_cost("start_gap")


def test_dominance_settings(spark, grid):
    pairs, v, e = grid
    length, curve = m.create_cost("relative_length_error"), m.create_cost("discrete_frechet_distance")
    assert not m.Dominance.AUTO.applies(length) and m.Dominance.AUTO.applies(curve) and m.Dominance.ON.applies(length) and not m.Dominance.OFF.applies(curve)
    task = Matcher(pairs.where("pair_id = 'near'"), v, e, rho=2.0)
    every, pruned = task.effective.count(), m.dominance_prune(task.effective, task.costs(curve), task.arcs).count()
    assert pruned < every
    assert m.dominance_prune(task.effective, task.costs(curve), task.arcs, comparison_limit=1).count() == every
    assert m.dominance_prune(task.effective, task.costs(curve), task.arcs, comparison_limit=10**6).count() == pruned
    result, seconds = studies.dominance_benchmark(task, curve)
    row = result.first()
    assert row.equal and row.kept == pruned and row.candidates == every and set(seconds) == {"off", "on"}


def test_digests_and_diagnostics(spark, grid):
    pairs, v, e = grid
    near = pairs.where("pair_id = 'near'")
    runs = [Matcher(near, v, e, rho=2.0) for _ in range(2)]
    cost = m.create_cost("relative_length_error")
    solved = [r.match(cost) for r in runs]
    assert len({tuple(reports.solution_digest(s.values, s.edges).first()) for s in solved}) == 1
    assert len({reports.candidate_digest(r.candidates).first().candidates for r in runs}) == 1
    assert {r.graph: len(r.bags) for r in reports.decomposition_digest(runs[0].decomposition).collect()} == {"S": 64}
    asked = spark.createDataFrame([("near", 0, 0, 0), ("near", 0, 0, 1), ("near", 0, 0, 99), ("near", 0, 5, 6), ("near", 0, 7, 8)], "pair_id string, edge_id long, target_u long, target_v long")
    paths = spark.createDataFrame([("near", 0, 1, 10.0), ("near", 5, 6, 0.0), ("near", 7, 8, 3.0)], "pair_id string, target_u long, target_v long, distance double")
    known = spark.createDataFrame([("near", 0, 0, 1)], "pair_id string, edge_id long, target_u long, target_v long")
    found = {r.category: r.requests for r in reports.request_diagnostics(asked, known, paths).collect()}
    assert found == {"same target": 1, "cost": 1, "no witness": 1, "zero length": 1, "no finite cost": 1}


def test_least_radius_of_all_pairs(spark, grid):
    pairs, v, e = grid
    bare = v.unionByName(spark.createDataFrame([("B", 1, 0.0, 0.0)], "graph string, vertex_id long, x double, y double"))
    every = pairs.unionByName(spark.createDataFrame([("none", "S", "B")], P))
    found = {r.pair_id: r.radius for r in cand.minimum_radius(every, bare, e, mode="adaptive_closest_points").collect()}
    assert found == {"near": 1.0, "far": 490.0, "none": None}


def test_edge_without_a_segment_is_an_error(spark):
    v, e = graphs(spark, S=({1: (0, 0)}, []), T=({10: (0, 0), 20: (1, 0)}, [(0, 10, 20, [(0, 0), (0, 0)])]))
    with pytest.raises(Exception, match="no usable segment"):
        cand.edge_radius_candidates(one_pair(spark), v, e, 1.0, 5).collect()
    assert cand.segments(e, strict=False).where(F.col("graph") == "T").count() == 0


def test_option_specs():
    specs = {s.name: s for s in m.option_specs("dynamic_time_warping_distance")}
    assert (specs["warping_window"].kind, specs["warping_window"].default, specs["warping_window"].least) == ("int", 8, 1)
    assert specs["normalize"].kind == "bool" and specs["normalize"].least is None and specs["rho"].kind == "float"
    assert m.option_specs("relative_length_error") == []


def test_cost_agreement_in_blocks(spark, monkeypatch):
    """Many blocks and stretches give what pairing row by row gives; no pair of costs is shuffled."""
    for name, value in (("COSTS_AT_ONCE", 3), ("CODES_AT_ONCE", 4), ("COSTS_A_BATCH", 2)):
        monkeypatch.setattr(reports, name, value)
    rng = random.Random(3)
    # two runs of a pair may have the same cost; null targets agree with nothing, rows without a key meet nothing
    runs = [(k, f"p{k % 2}", f"c{k % 14}" if k else None) for k in range(40)]
    maps = [(k, o, rng.choice([None, *range(9)]), rng.choice([None, "a", "b", "c"])) for k in range(40) for o in ("additive", "bottleneck", None) for _ in range(6)]
    got = reports.cost_agreement(spark.createDataFrame(runs, "run_id long, pair_id string, cost string"), spark.createDataFrame(maps, "run_id long, objective string, source_vertex long, target_vertex string"))
    place = {r: (p, c) for r, p, c in runs}
    want = {}
    for ra, oa, sa, ta in maps:
        for rb, ob, sb, tb in maps:
            (pa, ca), (pb, cb) = place[ra], place[rb]
            if None not in (oa, sa, ca, cb) and (pa, oa, sa) == (pb, ob, sb) and ca < cb:
                n = want.setdefault((pa, oa, ca, cb), [0, 0])
                n[0] += 1
                n[1] += ta is not None and ta == tb
    rows = got.collect()
    assert {tuple(r)[:4]: list(tuple(r)[4:6]) for r in rows} == want and len(rows) == len(want)
    assert all(r.agreement == r.agreeing / r.common for r in rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "cost_a" in x]
    nothing = spark.createDataFrame([], "run_id long, objective string, source_vertex long, target_vertex string")
    assert reports.cost_agreement(spark.createDataFrame(runs, "run_id long, pair_id string, cost string"), nothing).count() == 0
