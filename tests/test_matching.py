"""Candidates, pruning, costs and optimal mappings, against brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import geometry as geo
from netloom.functions import kernels
from netloom.operators import candidates as cand
from netloom.operators import matching as m
from netloom.operators import reports
from netloom.plans.matcher import Matcher
from netloom.sources import results

V = "graph string, vertex_id long, x double, y double"
E = f"graph string, edge_id long, edge_pos int, u long, v long, polyline {geo.POLYLINE}"
P = "pair_id string, source string, target string"


def graphs(spark, **given):
    """name=(vertices {id: (x, y)}, edges [(id, u, v, line or None)])"""
    v = [(g, i, float(x), float(y)) for g, (vs, _) in given.items() for i, (x, y) in vs.items()]
    e = [(g, i, k, a, b, [(float(x), float(y)) for x, y in (line or [vs[a], vs[b]])]) for g, (vs, es) in given.items() for k, (i, a, b, line) in enumerate(es)]
    return spark.createDataFrame(v, V).coalesce(1), spark.createDataFrame(e, E).coalesce(1)


def one_pair(spark, source="S", target="T"):
    return spark.createDataFrame([("p", source, target)], P)


def sets(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.source_vertex, r["rank"] if "rank" in df.columns else r.target_vertex)):
        out.setdefault(r.source_vertex, []).append(r.target_vertex)
    return out


# --- candidates -------------------------------------------------------------------------------------------------------


def test_two_corridors(spark):
    S = ({1: (1, 0), 2: (9, 5), 3: (100, 100)}, [])
    T = ({10: (0, 0), 20: (10, 0), 30: (0, 5), 40: (10, 5), 50: (1, 1)}, [(0, 10, 20, None), (1, 30, 40, None)])
    v, e = graphs(spark, S=S, T=T)
    assert sets(cand.edge_radius_candidates(one_pair(spark), v, e, 0.5, 25)) == {1: [10, 20], 2: [30, 40]}
    stats = cand.candidate_statistics(cand.edge_radius_candidates(one_pair(spark), v, e, 0.5, 25), one_pair(spark), v).first()
    assert (stats.sources, stats.empty, stats.total, stats.least, stats.most) == (3, 1, 4, 0, 2)


def brute_candidates(S, T, rho, k):
    out = {}
    for s, p in S[0].items():
        best = {}
        for pos, (i, a, b, line) in enumerate(T[1]):
            d = kernels.distances(np.array([p], float), kernels.prepared(np.array(line or [T[0][a], T[0][b]], float)))[0]
            if d <= rho:
                for n, t in enumerate((a, b)):
                    best[t] = min(best.get(t, (math.inf,)), (d, pos, n))
        if best:
            out[s] = [t for t, _ in sorted(best.items(), key=lambda x: x[1])][:k]
    return out


@pytest.mark.parametrize("rho", [0.0, 1.25, 6.0])
def test_random_candidates(spark, rho):
    rng = random.Random(7)
    S = ({k: (rng.randint(0, 12), rng.randint(0, 12)) for k in range(15)}, [])
    tv = {k: (rng.randint(0, 12), rng.randint(0, 12)) for k in range(100, 120)}
    te = [(k, *(ab := rng.sample(sorted(tv), 2)), [tv[ab[0]], (rng.randint(0, 12), rng.randint(0, 12) + 0.5), tv[ab[1]]]) for k in range(25)]
    v, e = graphs(spark, S=S, T=(tv, te))
    assert sets(cand.edge_radius_candidates(one_pair(spark), v, e, rho, 4)) == brute_candidates(S, (tv, te), rho, 4)
    near = {s: [t for d, t in sorted((math.dist(p, q), t) for t, q in tv.items()) if d <= rho][:4] for s, p in S[0].items()}
    assert sets(cand.vertex_radius_candidates(one_pair(spark), v, rho, 4)) == {s: x for s, x in near.items() if x}
    want = max(min(kernels.distances(np.array([p], float), kernels.prepared(np.array(line, float)))[0] for _, _, _, line in te) for p in S[0].values())
    assert cand.minimum_radius(one_pair(spark), v, e).first().radius == pytest.approx(want)
    assert cand.minimum_radius(one_pair(spark), v, e, 0.25).first().radius == math.ceil(want / 0.25) * 0.25


@pytest.mark.parametrize(("rho", "k"), [(-1, 5), (math.inf, 5), (math.nan, 5), (1, 0), (1, -2)])
def test_bad_parameters(spark, rho, k):
    v, e = graphs(spark, S=({1: (0, 0)}, []), T=({2: (0, 0), 3: (1, 0)}, [(0, 2, 3, None)]))
    with pytest.raises(ValueError):
        cand.edge_radius_candidates(one_pair(spark), v, e, rho, k)


def test_merge_and_eligible(spark):
    c = "pair_id string, source_vertex long, rank int, target_vertex long, distance double"
    a = spark.createDataFrame([("p", 1, 1, 20, 0.5), ("p", 1, 2, 10, 0.6)], c)
    b = spark.createDataFrame([("p", 1, 1, 10, 0.1), ("p", 1, 2, 30, 0.2), ("p", 2, 1, 40, 0.0)], c)
    assert sets(cand.merge_candidates(a, b)) == {1: [20, 10, 30], 2: [40]}
    v, e = graphs(spark, S=({1: (0, 0)}, []), T=({2: (0, 0), 3: (1, 0)}, [(0, 2, 3, None)]))
    only = spark.createDataFrame([("T", 3)], "graph string, vertex_id long")
    assert sets(cand.vertex_radius_candidates(one_pair(spark), v, 5, 5, only)) == {1: [3]}
    with pytest.raises(ValueError, match="unknown eligible"):
        cand.vertex_radius_candidates(one_pair(spark), v, 5, 5, spark.createDataFrame([("T", 9)], "graph string, vertex_id long"))
    with pytest.raises(ValueError, match="unknown target"):
        cand.normalise_candidates(spark.createDataFrame([("p", 1, 99)], "pair_id string, source_vertex long, target_vertex long"), one_pair(spark), v)


def test_uniform_subdivision(spark):
    v, e = graphs(spark, T=({4: (0, 0), 9: (2, 2)}, [(0, 4, 9, [(0, 0), (2, 0), (2, 2)])]))
    nv, ne = cand.subdivide_uniform(v, e, 2)
    assert sorted(r.vertex_id for r in nv.collect()) == [4, 9, 10, 11]
    assert sorted((r.edge_id, r.u, r.v, len(r.polyline)) for r in ne.collect()) == [(0, 4, 10, 2), (1, 10, 11, 3), (2, 11, 9, 2)]
    assert cand.subdivide_uniform(v, e, 0) == (v, e)
    with pytest.raises(ValueError):
        cand.subdivide_uniform(v, e, -1)


def test_adaptive_subdivision(spark):
    v, e = graphs(spark, S=({1: (3, 2), 2: (3, 2)}, []), T=({10: (0, 0), 20: (10, 0)}, [(0, 10, 20, None)]))
    pairs, nv, ne = cand.subdivide_adaptive(one_pair(spark), v, e, 2.0, 8, 0.0)
    name = pairs.first().target
    assert [(r.vertex_id, r.x, r.y) for r in nv.where(F.col("graph") == name).orderBy("vertex_id").collect()] == [(10, 0, 0), (20, 10, 0), (21, 3, 0)]
    assert sorted((r.u, r.v) for r in ne.where(F.col("graph") == name).collect()) == [(10, 21), (21, 20)]
    assert cand.adaptive_fractions(one_pair(spark), v, e, 2.0, 8, 4.0).count() == 0
    with pytest.raises(ValueError):
        cand.adaptive_fractions(one_pair(spark), v, e, 2.0, 0)


@pytest.mark.parametrize("mode", list(cand.CandidateMode))
def test_modes_add_to_the_baseline(spark, mode):
    S = ({1: (3, 1), 2: (7, 1)}, [(0, 1, 2, None)])
    T = ({10: (0, 0), 20: (10, 0), 30: (20, 0)}, [(0, 10, 20, None), (1, 20, 30, None)])
    v, e = graphs(spark, S=S, T=T)
    original = graphs(spark, T=({10: (0, 0), 15: (4, 0), 20: (10, 0), 30: (20, 0)}, [(0, 10, 15, None), (1, 15, 20, None), (2, 20, 30, None)]))
    got, pairs, nv, ne = cand.mode_candidates(one_pair(spark), v, e, mode, 2.0, 25, original=original)
    found = sets(got)
    extra = {cand.CandidateMode.JUNCTIONS: 0, cand.CandidateMode.ORIGINAL: 1}.get(mode)
    assert all(x[:2] == [10, 20] for x in found.values())
    assert all(len(x) >= 2 for x in found.values()) and (extra is None or len(found[1]) == 2 + extra)
    result = Matcher(one_pair(spark), v, e, 2.0, 25, mode, **({"original": original} if mode is cand.CandidateMode.ORIGINAL else {})).match(m.create_cost("relative_length_error"))
    assert result.values.first().feasible


# --- pruning -----------------------------------------------------------------------------------------------------------


def random_problem(seed, parallel=True):
    rng = random.Random(seed)
    n = rng.randint(2, 4)
    edges = [(k, *sorted(rng.sample(range(n), 2))) for k in range(rng.randint(1, 4))]
    if parallel:
        edges.append((len(edges), edges[0][1], edges[0][2]))
    domains = {v: sorted(rng.sample(range(10, 18), rng.randint(1, 4))) for v in range(n)}
    comp = {t: 10 if t < 14 else 14 for t in range(10, 18)}
    costs = {(e, a, b): rng.randint(0, 12) / 2 for e, u, v in edges for a in domains[u] for b in domains[v] if a != b and comp[a] == comp[b] and rng.random() > 0.12}
    return n, edges, domains, comp, costs


def brute(n, edges, domains, costs, objective, weights):
    best = None
    for state in itertools.product(*(domains[v] for v in range(n))):
        values = [costs.get((e, state[u], state[v])) for e, u, v in edges]
        if any(x is None for x in values):
            continue
        value = max(values, default=0) if objective == "bottleneck" else sum(x * (weights[e] if objective != "additive" else 1) for x, (e, _, _) in zip(values, edges))
        best = value if best is None else min(best, value)
    return best


def tables(spark, problems):
    rows = {"v": [], "e": [], "c": [], "k": [], "p": []}
    for k, (n, edges, domains, comp, costs) in enumerate(problems):
        s, t, p = f"S{k}", f"T{k}", f"p{k}"
        rows["p"].append((p, s, t))
        rows["v"] += [(s, x, float(x), 0.0) for x in range(n)] + [(t, x, float(x), 1.0) for x in range(10, 18)]
        # a source edge's length is its id + 1
        rows["e"] += [(s, e, e, u, v, [(0.0, 0.0), (float(e + 1), 0.0)]) for e, u, v in edges]
        rows["e"] += [(t, i, i, a, a + 1, [(float(a), 1.0), (float(a + 1), 1.0)]) for i, a in enumerate(x for x in range(10, 17) if x != 13)]
        rows["c"] += [(p, v, x) for v, xs in domains.items() for x in xs]
        rows["k"] += [(p, e, next(u for i, u, _ in edges if i == e), next(v for i, _, v in edges if i == e), a, b, float(x)) for (e, a, b), x in costs.items()]
    return (spark.createDataFrame(rows["p"], P), spark.createDataFrame(rows["v"], V), spark.createDataFrame(rows["e"], E), spark.createDataFrame(rows["c"], "pair_id string, source_vertex long, target_vertex long"),
            spark.createDataFrame(rows["k"], "pair_id string, edge_id long, u long, v long, target_u long, target_v long, value double"))


PROBLEMS = [random_problem(seed) for seed in range(60)]


def test_random_optima_with_and_without_dominance(spark):
    pairs, v, e, c, k = tables(spark, PROBLEMS)
    arcs = pairs.select("pair_id", F.col("source").alias("graph")).join(e.select("graph", "edge_id", "u", "v"), "graph").drop("graph")
    left = m.dominance_prune(c, k, arcs)
    assert left.count() < c.count()
    assert left.select("pair_id", "source_vertex").distinct().count() == c.select("pair_id", "source_vertex").distinct().count()
    for domains in (c, left):
        got = {(r.pair_id, r.objective): r.value for r in m.solve(domains, k, pairs, v, e).select("pair_id", "objective", "value").distinct().collect()}
        assert len(got) == 3 * len(PROBLEMS)
        for i, (n, edges, dom, _, costs) in enumerate(PROBLEMS):
            for objective in m.Objective:
                assert got[f"p{i}", objective] == pytest.approx(brute(n, edges, dom, costs, objective, {x[0]: x[0] + 1 for x in edges})), (i, objective)


def test_relational_program_equals_the_kernel(spark):
    for i in (0, 1, 2):
        n, edges, dom, comp, costs = PROBLEMS[i]
        pairs, v, e, c, k = tables(spark, [PROBLEMS[i]])
        tree = kernels.Decomposition(list(range(n)), edges)
        for objective in m.Objective:
            found = m.solve_relational(c, k, tree, objective, {x[0]: x[0] + 1 for x in edges}).collect()
            want = brute(n, edges, dom, costs, objective, {x[0]: x[0] + 1 for x in edges})
            assert (found[0].value if found else None) == pytest.approx(want)
            if found:
                kernel = {r.source_vertex: r.target_vertex for r in m.solve(c, k, pairs, v, e, (objective,)).collect()}
                assert {s.s: s.t for s in found[0].state} == kernel


def brute_arc_consistency(n, edges, domains, comp):
    now = {v: set(x) for v, x in domains.items()}
    while True:
        new = {v: {a for a in xs if all(any(b != a and comp[a] == comp[b] for b in now[o]) for _, p, q in edges for s, o in ((p, q), (q, p)) if s == v)} for v, xs in now.items()}
        if new == now:
            return now
        now = new


def test_arc_consistency(spark):
    pairs, v, e, c, _ = tables(spark, PROBLEMS)
    got = {}
    for r in m.arc_consistency(c, pairs, v, e).collect():
        got.setdefault((r.pair_id, r.source_vertex), set()).add(r.target_vertex)
    for i, (n, edges, dom, comp, _) in enumerate(PROBLEMS):
        want = brute_arc_consistency(n, edges, dom, comp)
        assert all(got.get((f"p{i}", s), set()) == want[s] for s in range(n)), i


def test_preflight(spark):
    pairs, v, e, c, _ = tables(spark, PROBLEMS)
    sources = v.where("graph like 'S%'"), e.where("graph like 'S%'")
    found = m.preflight_totals(m.preflight(m.decompositions(*sources), pairs, c))
    got = {r.pair_id: int(r.states) for r in found.collect()}
    for i, (n, edges, dom, _, _) in enumerate(PROBLEMS):
        tree = kernels.Decomposition(list(range(n)), edges)
        assert got[f"p{i}"] == sum(math.prod(len(dom[x]) for x in b) for b in tree.bags)
    assert m.largest_bags(m.preflight(m.decompositions(*sources), pairs, c), 1).count() == len(PROBLEMS)


def test_infeasible_and_trivial(spark):
    pairs = spark.createDataFrame([("a", "S", "T"), ("b", "Q", "T")], P)
    v = spark.createDataFrame([("S", 0, 0.0, 0.0), ("S", 1, 1.0, 0.0), ("Q", 0, 0.0, 0.0), ("T", 10, 0.0, 0.0)], V)
    e = spark.createDataFrame([("S", 0, 0, 0, 1, [(0.0, 0.0), (1.0, 0.0)])], E)
    c = spark.createDataFrame([("a", 0, 10), ("a", 1, 10), ("b", 0, 10)], "pair_id string, source_vertex long, target_vertex long")
    k = spark.createDataFrame([], "pair_id string, edge_id long, target_u long, target_v long, value double")
    got = {(r.pair_id, r.objective): r for r in m.solve(c, k, pairs, v, e).collect()}
    assert not got["a", "additive"].feasible and got["a", "additive"].value is None
    # no edges: 0 for every objective
    assert all(got["b", o].feasible and got["b", o].value == 0 for o in m.Objective)
    bad = spark.createDataFrame([("a", 0, 10, 11, -1.0)], "pair_id string, edge_id long, target_u long, target_v long, value double")
    with pytest.raises(Exception, match="negative"):
        m.solve(c, bad, pairs, v, e).collect()


# --- costs and witnesses ------------------------------------------------------------------------------------------------


def requests(spark, rows):
    return spark.createDataFrame([("p", *r) for r in rows], "pair_id string, edge_id long, u long, v long, target_u long, target_v long")


def values(spark, v, e, rows, name, **options):
    got = m.edge_costs(requests(spark, rows), one_pair(spark), v, e, m.create_cost(name, **options)).collect()
    return {(r.edge_id, r.target_u, r.target_v): (r.value, [tuple(p) for p in r.witness]) for r in got}


def test_length_costs(spark):
    S = ({1: (0, 0), 2: (2, 0)}, [(0, 1, 2, None), (1, 1, 2, [(0, 0), (1, 1), (2, 0)])])
    T = ({10: (0, 0), 20: (3, 0), 30: (9, 9), 40: (12, 9)}, [(0, 10, 20, None), (1, 30, 40, None)])
    v, e = graphs(spark, S=S, T=T)
    rows = [(0, 1, 2, 10, 20), (1, 1, 2, 20, 10), (0, 1, 2, 10, 30), (0, 1, 2, 10, 10), (0, 1, 2, 10, 77)]
    got = values(spark, v, e, rows, "relative_length_error")
    assert got[0, 10, 20] == (0.5, [(0, 0), (3, 0)]) and set(got) == {(0, 10, 20), (1, 20, 10)}
    assert got[1, 20, 10][0] == pytest.approx(abs(3 / (2 * math.sqrt(2)) - 1)) and got[1, 20, 10][1] == [(3, 0), (0, 0)]
    assert values(spark, v, e, rows, "log_length_distortion")[0, 10, 20][0] == pytest.approx(math.log(1.5))


def test_corridor_is_preferred_to_a_shorter_way(spark):
    S = ({1: (0, 0), 2: (4, 0)}, [(7, 1, 2, [(0, 0), (1, 2), (3, 2), (4, 0)])])
    T = ({10: (0, 0), 20: (1, 2), 30: (3, 2), 40: (4, 0)}, [(0, 10, 40, None), (1, 10, 20, None), (2, 20, 30, None), (3, 30, 40, None)])
    v, e = graphs(spark, S=S, T=T)
    rows = [(7, 1, 2, 10, 40)]
    arch = [(0, 0), (1, 2), (3, 2), (4, 0)]
    for name in ("hausdorff_distance", "discrete_frechet_distance", "dynamic_time_warping_distance", "mean_distance_tangent", "symmetric_corridor_exceedance"):
        value, witness = values(spark, v, e, rows, name, rho=0.5)[7, 10, 40]
        assert witness == arch and value == pytest.approx(0, abs=1e-9), name
    assert values(spark, v, e, rows, "hausdorff_distance", rho=50.0)[7, 10, 40][1] == [(0, 0), (4, 0)]
    assert values(spark, v, e, rows, "relative_length_error")[7, 10, 40][1] == [(0, 0), (4, 0)]
    paths = m.shortest_paths(requests(spark, rows), one_pair(spark), e).first()
    assert paths.distance == 4


def test_guided_costs_of_lines_that_cannot_be_null(spark):
    """Lines made by expressions have points that cannot be null, as in the catalogue; the costs are those by brute force."""
    rng = random.Random(5)
    at = {i: (4.0 * (i % 3) + rng.random(), 4.0 * (i // 3) + rng.random()) for i in range(9)}
    ends = [(a, b) for a in range(9) for b in (a + 1, a + 3) if b < 9 and (b - a == 3 or a % 3 < 2)]
    S = ({1: (0, 0), 2: (8, 1)}, [(7, 1, 2, None)])
    v, e = graphs(spark, S=S, T=(at, [(k, a, b, None) for k, (a, b) in enumerate(ends)]))
    made = e.withColumn("polyline", F.array(*[geo.point(F.col("polyline")[i]["x"], F.col("polyline")[i]["y"]) for i in (0, 1)]))
    assert not made.schema["polyline"].dataType.containsNull
    rows = [(7, 1, 2, a, b) for a in (0, 3, 8) for b in (2, 5)]
    got = values(spark, v, made, rows, "hausdorff_distance", rho=2.0)

    line = np.array([S[0][1], S[0][2]], float)
    lengths = [math.dist(at[a], at[b]) for a, b in ends]
    dense = np.array([[np.array(at[a]) + (np.array(at[b]) - np.array(at[a])) * k / 11 for k in range(12)] for a, b in ends])
    weight = kernels.corridor_weights(np.array(lengths), dense, line, 2.0)

    def ways(path, goal, sofar):
        if path[-1] == goal:
            yield sofar, path
        else:
            for k, (a, b) in enumerate(ends):
                if path[-1] in (a, b) and (o := a + b - path[-1]) not in path:
                    yield from ways([*path, o], goal, sofar + weight[k])

    def gap(p, q):
        """Of p's points from the segments of q."""
        def one(x, a, b):
            t = min(max(np.dot(x - a, b - a) / np.dot(b - a, b - a), 0), 1)
            return float(np.hypot(*(x - a - t * (b - a))))

        return max(min(one(x, a, b) for a, b in zip(q[:-1], q[1:], strict=True)) for x in p)

    assert set(got) == {(7, a, b) for _, _, _, a, b in rows}
    for (_, a, b), (value, witness) in got.items():
        best = min(ways([a], b, 0.0))[1]
        bent = np.array([at[i] for i in best])
        assert witness == [at[i] for i in best] and value == pytest.approx(max(gap(bent, line), gap(line, bent)))


def test_reverse_requests(spark):
    S = ({1: (0, 0), 2: (4, 0)}, [(7, 1, 2, None)])
    T = ({10: (0, 1), 20: (2, 3), 40: (4, 1)}, [(0, 10, 20, None), (1, 20, 40, None)])
    v, e = graphs(spark, S=S, T=T)
    a = values(spark, v, e, [(7, 1, 2, 10, 40)], "hausdorff_distance")[7, 10, 40]
    b = values(spark, v, e, [(7, 1, 2, 40, 10)], "hausdorff_distance")[7, 40, 10]
    assert a[0] == pytest.approx(b[0]) and a[1] == b[1][::-1]


@pytest.mark.parametrize(("name", "options"), [
    ("hausdorff_distance", {"densify": 0}), ("hausdorff_distance", {"densify": 1.5}), ("discrete_frechet_distance", {"curve_samples": 1}), ("dynamic_time_warping_distance", {"warping_window": 0}),
    ("mean_distance_tangent", {"tangent_weight": -1.0}), ("symmetric_corridor_exceedance", {"corridor_radius": 0.0}), ("hausdorff_distance", {"rho": 0.0}), ("hausdorff_distance", {"edge_samples": 1}),
    ("relative_length_error", {"rho": 1.0}), ("test", {}), ("nothing", {}),
])
def test_bad_costs(name, options):
    with pytest.raises(ValueError):
        m.create_cost(name, **options)


# --- the whole chain ----------------------------------------------------------------------------------------------------


def lw_line():
    S = ({0: (0, 0), 1: (1, 0), 2: (11, 0)}, [(0, 0, 1, None), (1, 1, 2, None)])
    T = ({10: (0, 0), 20: (2, 0), 30: (7, 0)}, [(0, 10, 20, None), (1, 20, 30, None)])
    return S, T


def test_three_objectives_and_evaluation(spark):
    S, T = lw_line()
    v, e = graphs(spark, S=S, T=T)
    exact = spark.createDataFrame([("p", 0, 10), ("p", 1, 20), ("p", 2, 30)], "pair_id string, source_vertex long, target_vertex long")
    task = Matcher(one_pair(spark), v, e, candidate_sets=exact)
    found = task.match_all(m.create_cost("relative_length_error"))
    assert {r.objective: r.value for r in found.values.collect()} == {"additive": 1.5, "bottleneck": 1.0, "length_weighted_additive": 6.0}
    assert all(r.ok for r in task.check(found).collect()) and found.edges.count() == 6
    scores = task.evaluate_mapping(exact, m.create_cost("relative_length_error")).first()
    assert (scores.additive, scores.bottleneck, scores.length_weighted) == (1.5, 1.0, 6.0) and scores.invalid_edge_ids == [] and scores.effective_violations == []
    other = exact.withColumn("target_vertex", F.when(F.col("source_vertex") == 2, F.lit(20)).otherwise(F.col("target_vertex")))
    scores = task.evaluate_mapping(other, m.create_cost("relative_length_error")).first()
    assert scores.additive is None and scores.invalid_edge_ids == [1] and scores.candidate_violations == [2]
    with pytest.raises(ValueError, match="not mapped"):
        task.evaluate_mapping(exact.where("source_vertex < 2"), m.create_cost("relative_length_error"))
    docs = {r.objective: r.json for r in results.solution_json(found.values, found.mapping, found.edges).collect()}
    assert '"value":1.5' in docs["additive"] and '{"source_vertex":0,"target_vertex":10}' in docs["additive"]


def test_state_limits_and_many_pairs(spark):
    S, T = lw_line()
    v, e = graphs(spark, S=S, T=T, Q=({0: (50, 50), 1: (60, 60)}, [(0, 0, 1, None)]))
    pairs = spark.createDataFrame([("p", "S", "T"), ("q", "Q", "T")], P)
    task = Matcher(pairs, v, e, 12.0, 25)
    found = task.match_both(m.create_cost("relative_length_error"))
    got = {(r.pair_id, r.objective): r.feasible for r in found.values.collect()}
    assert got == {("p", "additive"): True, ("p", "bottleneck"): True, ("q", "additive"): False, ("q", "bottleneck"): False}
    limited = task.match_all(m.create_cost("relative_length_error"), state_limit=1)
    assert [r.pair_id for r in limited.limited.collect()] == ["p"] and {r.pair_id for r in limited.values.collect()} == {"q"}
    assert task.match_all(m.create_cost("relative_length_error"), state_limit=0).limited.count() == 0


def test_reports(spark):
    c = spark.createDataFrame([("r", "additive", k, x) for k, x in enumerate([0.0, 1.0, 2.0, 4.0])] + [("r", "bottleneck", 0, 3.0), ("z", "additive", 1, 0.0)], "run_id string, objective string, edge_id long, value double")
    s = {(r.run_id, r.objective): r for r in reports.edge_statistics(c, ["run_id", "objective"]).collect()}
    assert s["r", "additive"].zero_edges == 1 and s["r", "additive"].positive_median == 2 and s["r", "additive"].q25 == 0.75 and s["z", "additive"].positive_median is None
    roles = {(r.run_id, r.objective, r.role): r.edge_id for r in reports.representative_edges(c, ["run_id", "objective"]).collect()}
    assert roles["r", "additive", "best"] == 0 and roles["r", "additive", "median"] == 2 and roles["r", "additive", "worst"] == 3 and roles["z", "additive", "median"] == 1
    assert sum(r.edges for r in reports.histogram(c, ["run_id", "objective"]).collect()) == 6
    runs = spark.createDataFrame([("k", 1, "a"), ("l", 2, "b"), ("k", 3, "c")], "key string, seq int, x string")
    assert sorted((r.key, r.seq, r.x) for r in reports.deduplicate(runs, ["key"]).collect()) == [("k", 1, "c"), ("l", 2, "b")]
    assert reports.farthest_points([(1, 0, 0), (2, 1, 0), (3, 5, 0), (4, 9, 0)], 3) == [1, 4, 3] and reports.farthest_points([], 2) == []
