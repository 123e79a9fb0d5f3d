"""Polyline expressions against the NumPy kernels, and the kernels against textbook definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import geometry as geo
from netloom.functions import kernels


def lines(n=30, seed=0):
    rng = random.Random(seed)
    return [[(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(rng.randint(2, 9))] for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, line {geo.POLYLINE}")


def test_clean(spark):
    nan, inf = float("nan"), float("inf")
    rows = [[(0.0, 0.0)], [(0.0, 0.0), (0.0, 0.0)], [(0.0, 0.0), (1.0, nan)], [(0.0, 0.0), (inf, 1.0)], [], [(0.0, 0.0), (0.0, 0.0), (3.0, 4.0), (3.0, 4.0), (3.0, 5.0)], [(0.0, 0.0)] + [(0.4e-12 * k, 0.0) for k in range(1, 9)] + [(1.0, 0.0)]]
    got = {r.k: r.c for r in frame(spark, rows).select("k", geo.clean(F.col("line")).alias("c")).collect()}
    assert all(got[k] is None for k in range(5))
    assert [tuple(p) for p in got[5]] == [(0, 0), (3, 4), (3, 5)]
    # many small steps add up to new points
    assert len(got[6]) == len(kernels.clean(rows[6])) > 2


def test_lengths_and_samples(spark):
    rows = lines()
    df = frame(spark, rows).select("k", geo.length(F.col("line")).alias("l"), geo.resample(F.col("line"), 7).alias("r"), geo.point_at_fraction(F.col("line"), F.lit(0.4)).alias("p"), geo.subpolyline(F.col("line"), F.lit(0.25), F.lit(0.75)).alias("s"))
    for r in df.collect():
        line = np.array(rows[r.k])
        assert math.isclose(r.l, kernels.length(line))
        assert np.allclose(np.array([tuple(p) for p in r.r]), kernels.resample(line, 7))
        assert np.allclose(tuple(r.p), kernels.resample(line, 6)[2])
        part = np.array([tuple(p) for p in r.s])
        assert math.isclose(kernels.length(part), r.l / 2) and np.allclose(part[0], kernels.resample(line, 5)[1]) and np.allclose(part[-1], kernels.resample(line, 5)[3])


def test_bad_fractions(spark):
    df = frame(spark, [[(0.0, 0.0), (1.0, 0.0)]])
    for bad in (-0.1, 1.1, float("nan")):
        with pytest.raises(Exception, match="fraction"):
            df.select(geo.point_at_fraction(F.col("line"), F.lit(bad))).collect()
    with pytest.raises(Exception, match="start"):
        df.select(geo.subpolyline(F.col("line"), F.lit(0.5), F.lit(0.5))).collect()


def test_orient_concat_distance(spark):
    df = frame(spark, [[(0.0, 0.0), (1.0, 0.0), (2.0, 2.0)]])
    p = geo.point
    row = df.select(
        geo.orient(F.col("line"), p(F.lit(2), F.lit(2)), p(F.lit(0), F.lit(0))).alias("turned"), geo.orient(F.col("line"), p(F.lit(1), F.lit(1)), p(F.lit(1), F.lit(1))).alias("kept"),
        geo.concat(F.col("line"), F.array(p(F.lit(2), F.lit(2)), p(F.lit(3), F.lit(3)))).alias("seam"), geo.concat(F.col("line"), F.array(p(F.lit(5), F.lit(2)), p(F.lit(3), F.lit(3)))).alias("gap"),
        geo.point_to_polyline(F.lit(0.5), F.lit(-3.0), F.col("line")).alias("d"), geo.box_lower_bound(F.lit(-3.0), F.lit(6.0), F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)).alias("b"),
    ).first()
    assert tuple(row.turned[0]) == (2, 2) and tuple(row.kept[0]) == (0, 0) and len(row.seam) == 4 and len(row.gap) == 5 and row.d == 3 and row.b == 5


def naive_frechet(a, b):
    @__import__("functools").cache
    def f(i, j):
        d = math.dist(a[i], b[j])
        if i == j == 0:
            return d
        return max(d, min(f(x, y) for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0))

    return f(len(a) - 1, len(b) - 1)


def naive_warping(a, b, window):
    @__import__("functools").cache
    def f(i, j):
        if i < 0 or j < 0:
            return 0.0 if i == j == -1 else math.inf
        if window is not None and abs(i - j) > window - 1:
            return math.inf
        return math.dist(a[i], b[j]) ** 2 + min(f(i - 1, j), f(i, j - 1), f(i - 1, j - 1))

    return math.sqrt(f(len(a) - 1, len(b) - 1))


@pytest.mark.parametrize("seed", range(5))
def test_curve_distances(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(12, 2)), rng.normal(size=(4, 12, 2))
    assert np.allclose(kernels.discrete_frechet(a, b), [naive_frechet(tuple(map(tuple, a)), tuple(map(tuple, x))) for x in b])
    for window in (None, 1, 3, 12):
        want = [naive_warping(tuple(map(tuple, a)), tuple(map(tuple, x)), window) for x in b]
        assert np.allclose(kernels.time_warping(a, b, window, False), want)
    assert np.allclose(kernels.time_warping(a, b, None, True) * math.sqrt(12), kernels.time_warping(a, b, None, False))
    assert np.allclose(kernels.time_warping(a, b, 1, False), np.sqrt(((a - b) ** 2).sum(axis=(1, 2))))


def test_hausdorff_and_corridor():
    a, b = np.array([(0.0, 0), (4, 0)]), np.array([(0.0, 1), (4, 1)])
    assert kernels.hausdorff(a, b) == 1 and kernels.hausdorff(a, b[::-1]) == 1
    roof = np.array([(0.0, 0), (2, 3), (4, 0)])
    # without densifying only vertices are probed
    assert kernels.hausdorff(a, roof) == 3 and kernels.hausdorff(a, roof, 0.5) >= kernels.hausdorff(a, roof)
    assert kernels.corridor_exceedance(a, b, 64, 1.0) == 0 and kernels.corridor_exceedance(a, b, 64, 0.5) == 1
    assert kernels.mean_distance_tangent(a, b, 64, 1.0) == 1
    turned = np.array([(0.0, 0), (0, 4)])
    assert kernels.mean_distance_tangent(a, turned, 16, 0.0) + 1 == pytest.approx(kernels.mean_distance_tangent(a, turned, 16, 1.0))


def test_bisector_tangents():
    line = kernels.prepared(np.array([(0.0, 0), (1, 0), (1, 1)]))
    _, tangents = kernels.sample_tangents(line, 3)
    assert np.allclose(tangents[1], [math.sqrt(0.5), math.sqrt(0.5)]) and np.allclose(tangents[0], [1, 0])
    back = kernels.prepared(np.array([(0.0, 0), (1, 0), (0, 0)]))
    assert np.allclose(np.abs(kernels.sample_tangents(back, 3)[1]), [[1, 0]] * 3)


def test_shortest_ways_and_ties():
    net = kernels.Network(np.array([10, 20, 10, 30]), np.array([20, 40, 30, 40]))
    weights = net.weighed(np.array([1.0, 1, 2, 2]))
    assert net.ways(weights, 10, {40, 10, 99}) == {40: (2.0, [0, 1])} and net.ways(weights, 99, {40}) == {} and net.ways(weights, 10, {10}) == {}
    tied = net.weighed(np.ones(4))
    assert net.ways(tied, 10, {40})[40][1] == [0, 1] and net.ways(tied, 40, {10})[10][1] == [-2, -1]
    # of parallel edges of equal weight the first counts
    double = kernels.Network(np.array([1, 2, 1]), np.array([2, 1, 2]))
    assert double.ways(double.weighed(np.ones(3)), 1, {2})[2][1] == [0] and double.ways(double.weighed(np.array([2.0, 1, 1])), 1, {2})[2][1] == [-2]


def test_shortest_ways_against_floyd_warshall():
    rng = np.random.default_rng(6)
    for _ in range(30):
        u, v = rng.integers(0, 9, 14), rng.integers(0, 9, 14)
        w = rng.integers(1, 9, 14).astype(float)
        far = np.full((9, 9), np.inf)
        np.fill_diagonal(far, 0)
        for a, b, x in zip(u, v, w):
            far[a, b] = far[b, a] = min(far[a, b], x) if a != b else 0
        for k in range(9):
            far = np.minimum(far, far[:, [k]] + far[[k]])
        net = kernels.Network(u, v)
        for s in range(9):
            found = net.ways(net.weighed(w), s, set(range(9)))
            assert {g: d for g, (d, _) in found.items()} == {g: far[s, g] for g in range(9) if g != s and np.isfinite(far[s, g])}
            for g, (d, arcs) in found.items():
                at = s
                for k in arcs:
                    a, b = (u[k], v[k]) if k >= 0 else (v[~k], u[~k])
                    assert a == at
                    at = b
                assert at == g and sum(w[k if k >= 0 else ~k] for k in arcs) == d


def test_stacked_curves_equal_single_ones():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(5, 7, 2)), rng.normal(size=(5, 9, 2))
    for kernel in (kernels.discrete_frechet, lambda x, y: kernels.time_warping(x, y, 4, True)):
        assert np.allclose(kernel(a, b), [kernel(x, y[None])[0] for x, y in zip(a, b)])


def test_equal_distances_stay_equal(spark):
    """Both segments are as near; the first is meant. The root of 37 squared again is not 37."""
    line = F.array(*[geo.point(F.lit(x), F.lit(y)) for x, y in ((39, 1), (45, 2), (51, 1))])
    found = spark.range(1).select(geo.closest(F.lit(45.0), F.lit(1.0), line).alias("c")).first().c
    assert found.ix == 0 and found.along == pytest.approx(math.sqrt(37) * 36 / 37)
