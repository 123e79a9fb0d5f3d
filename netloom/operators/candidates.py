"""Candidate generation: bucketed range joins, rankings, merges and target subdivision, for many graph pairs at once.

Tables: vertex(graph, vertex_id, x, y); edge(graph, edge_id, edge_pos, u, v, polyline); pairs(pair_id, source, target).
"""

from __future__ import annotations

import math
from enum import StrEnum
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import geometry as geo
from netloom.plans.durable import durable

RHO, TOP_K = 10.0, 25
#: Squared length up to which a segment takes no part in candidate distances.
DEGENERATE = 1e-24


class CandidateMode(StrEnum):
    JUNCTIONS = "target_junctions"
    ORIGINAL = "original_target_vertices"
    UNIFORM = "uniform_target_subdivision"
    ADAPTIVE = "adaptive_closest_points"


def check_parameters(rho: float, top_k: int | None) -> None:
    if not math.isfinite(rho) or rho < 0:
        raise ValueError(f"the candidate radius must be finite and not negative: {rho}")
    if top_k is not None and top_k < 1:
        raise ValueError(f"top_k must be at least 1: {top_k}")


def segments(edges: DataFrame, strict: bool = True) -> DataFrame:
    """(graph, edge_id, edge_pos, u, v, seg_ix, sx, sy, vx, vy, len2) of all segments with length.

    An edge without any is an error, unless ``strict`` is off.
    """
    if strict:
        longer = F.exists(geo.steps(F.col("polyline")), lambda x: x["vx"] * x["vx"] + x["vy"] * x["vy"] > DEGENERATE)
        message = F.concat(F.lit("edge "), F.col("edge_id").cast("string"), F.lit(" of graph "), F.col("graph"), F.lit(" has no usable segment"))
        edges = edges.withColumn("polyline", F.when(longer, F.col("polyline")).otherwise(F.raise_error(message).cast(geo.POLYLINE)))
    out = edges.select("graph", "edge_id", "edge_pos", "u", "v", F.posexplode(geo.steps(F.col("polyline"))).alias("seg_ix", "s"))
    out = out.select("graph", "edge_id", "edge_pos", "u", "v", "seg_ix", "s.sx", "s.sy", "s.vx", "s.vy", (F.col("s.vx") * F.col("s.vx") + F.col("s.vy") * F.col("s.vy")).alias("len2"))
    return out.where(F.col("len2") > DEGENERATE)


def source_points(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(pair_id, target, source_vertex, px, py)"""
    v = vertices.select(F.col("graph").alias("source"), F.col("vertex_id").alias("source_vertex"), F.col("x").alias("px"), F.col("y").alias("py"))
    return pairs.join(v, "source").select("pair_id", "target", "source_vertex", "px", "py")


def _cell(x: Column, g: Column) -> Column:
    return F.floor(x / g)


def near_edges(pairs: DataFrame, vertices: DataFrame, edges: DataFrame, rho: float, points: DataFrame | None = None) -> DataFrame:
    """(pair_id, source_vertex, edge_id, edge_pos, u, v, distance) for edges within ``rho`` of a source vertex, inclusive.

    ``points`` limits the source vertices; by default all take part.

    Cells as wide as the radius or the mean segment, whichever is more, turn the range join into an equi-join: a
    segment is copied to the cells that its box, widened by the radius, touches; a point lies in one cell.
    """
    check_parameters(rho, None)
    segs = segments(edges)
    width = segs.groupBy("graph").agg(F.greatest(F.avg(F.greatest(F.abs("vx"), F.abs("vy"))), F.lit(max(rho, 1e-6))).alias("g"))
    # one row for each graph and cell width
    boxed = segs.join(width, "graph")
    xs = F.sequence(_cell(F.least(F.col("sx"), F.col("sx") + F.col("vx")) - rho, F.col("g")), _cell(F.greatest(F.col("sx"), F.col("sx") + F.col("vx")) + rho, F.col("g")))
    ys = F.sequence(_cell(F.least(F.col("sy"), F.col("sy") + F.col("vy")) - rho, F.col("g")), _cell(F.greatest(F.col("sy"), F.col("sy") + F.col("vy")) + rho, F.col("g")))
    placed = boxed.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys)).withColumnRenamed("graph", "target").drop("g", "seg_ix")
    points = (source_points(pairs, vertices) if points is None else points).join(width.withColumnRenamed("graph", "target"), "target")
    points = points.withColumn("cx", _cell(F.col("px"), F.col("g"))).withColumn("cy", _cell(F.col("py"), F.col("g"))).drop("g")
    met = points.join(placed, ["target", "cx", "cy"])
    d2 = geo.squared_distance(*(F.col(c) for c in ("px", "py", "sx", "sy", "vx", "vy", "len2")))
    best = met.groupBy("pair_id", "source_vertex", "edge_id", "edge_pos", "u", "v").agg(F.sqrt(F.min(d2)).alias("distance"))
    return best.where(F.col("distance") <= rho)


def _ranked(found: DataFrame, order: list[Column], top_k: int | None) -> DataFrame:
    out = found.withColumn("rank", F.row_number().over(Window.partitionBy("pair_id", "source_vertex").orderBy(*order)))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def edge_radius_candidates(pairs: DataFrame, vertices: DataFrame, edges: DataFrame, rho: float = RHO, top_k: int = TOP_K) -> DataFrame:
    """(pair_id, source_vertex, rank, target_vertex, distance): both ends of every edge within the radius.

    Ranked by edge distance, then edge position, u before v; a target vertex keeps its best place; cut at ``top_k``.
    Vertices without near edges have no rows; isolated target vertices never appear.
    """
    check_parameters(rho, top_k)
    near = near_edges(pairs, vertices, edges, rho)
    ends = near.select("pair_id", "source_vertex", F.explode(F.array(F.struct(F.col("u").alias("t"), F.lit(0).alias("e")), F.struct(F.col("v").alias("t"), F.lit(1).alias("e")))).alias("end"), "distance", "edge_pos")
    best = ends.groupBy("pair_id", "source_vertex", F.col("end.t").alias("target_vertex")).agg(F.min(F.struct("distance", "edge_pos", F.col("end.e").alias("e"))).alias("b"))
    ranked = _ranked(best, [F.col("b")], top_k)
    return ranked.select("pair_id", "source_vertex", "rank", "target_vertex", F.col("b.distance").alias("distance"))


def vertex_radius_candidates(pairs: DataFrame, vertices: DataFrame, rho: float = RHO, top_k: int | None = TOP_K, eligible: DataFrame | None = None) -> DataFrame:
    """Target vertices within the radius by distance, then id; ``eligible`` (graph, vertex_id) limits them.

    An eligible vertex that the graph does not have is an error.
    """
    check_parameters(rho, top_k)
    g = max(rho, 1e-6)
    targets = vertices
    if eligible is not None:
        unknown = eligible.join(vertices, ["graph", "vertex_id"], "left_anti").limit(1).collect()
        if unknown:
            raise ValueError(f"unknown eligible target vertex: {unknown[0]['vertex_id']}")
        targets = vertices.join(eligible.select("graph", "vertex_id").distinct(), ["graph", "vertex_id"], "left_semi")
    t = targets.select(F.col("graph").alias("target"), F.col("vertex_id").alias("target_vertex"), "x", "y", _cell(F.col("x"), F.lit(g)).alias("tx"), _cell(F.col("y"), F.lit(g)).alias("ty"))
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    t = t.withColumn("dx", around).withColumn("dy", around).select("target", "target_vertex", "x", "y", (F.col("tx") + F.col("dx")).alias("cx"), (F.col("ty") + F.col("dy")).alias("cy"))
    p = source_points(pairs, vertices).withColumn("cx", _cell(F.col("px"), F.lit(g))).withColumn("cy", _cell(F.col("py"), F.lit(g)))
    d = F.sqrt((F.col("px") - F.col("x")) * (F.col("px") - F.col("x")) + (F.col("py") - F.col("y")) * (F.col("py") - F.col("y")))
    found = p.join(t, ["target", "cx", "cy"]).select("pair_id", "source_vertex", "target_vertex", d.alias("distance")).where(F.col("distance") <= rho)
    return _ranked(found, [F.col("distance"), F.col("target_vertex")], top_k).select("pair_id", "source_vertex", "rank", "target_vertex", "distance")


def merge_candidates(baseline: DataFrame, additions: DataFrame) -> DataFrame:
    """The baseline in its order, then additions that it lacks; nothing is cut. ``origin`` is 0 or 1."""
    both = baseline.withColumn("origin", F.lit(0)).unionByName(additions.withColumn("origin", F.lit(1)))
    first = both.groupBy("pair_id", "source_vertex", "target_vertex").agg(F.min(F.struct("origin", "rank", "distance")).alias("b"))
    return _ranked(first.select("pair_id", "source_vertex", "target_vertex", "b.origin", F.col("b.rank").alias("was"), "b.distance"), [F.col("origin"), F.col("was")], None).select(
        "pair_id", "source_vertex", "rank", "target_vertex", "distance", "origin"
    )


def normalise_candidates(candidates: DataFrame, pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Distinct (pair_id, source_vertex, target_vertex); ids that the graphs do not have are an error."""
    distinct = candidates.select("pair_id", "source_vertex", "target_vertex").distinct()
    known = pairs.select("pair_id", "source", "target")
    for side in ("source", "target"):
        have = vertices.select(F.col("graph").alias(side), F.col("vertex_id").alias(f"{side}_vertex"))
        bad = distinct.join(known, "pair_id").join(have, [side, f"{side}_vertex"], "left_anti").limit(1).collect()
        if bad:
            raise ValueError(f"unknown {side} vertex {bad[0][f'{side}_vertex']} in pair {bad[0]['pair_id']}")
    return distinct


def candidate_statistics(candidates: DataFrame, pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """For each pair: sources, empty, total, least, most, median and mean number of candidates."""
    every = source_points(pairs, vertices).select("pair_id", "source_vertex")
    n = candidates.groupBy("pair_id", "source_vertex").agg(F.count("*").alias("n"))
    counted = every.join(n, ["pair_id", "source_vertex"], "left").fillna(0, ["n"])
    return counted.groupBy("pair_id").agg(
        F.count("*").alias("sources"), F.count_if(F.col("n") == 0).alias("empty"), F.sum("n").alias("total"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.percentile("n", F.lit(0.5)).alias("median"), F.avg("n").alias("mean"),
    )


def minimum_radius(pairs: DataFrame, vertices: DataFrame, edges: DataFrame, precision: float = 0.0, mode: CandidateMode = CandidateMode.JUNCTIONS) -> DataFrame:
    """(pair_id, radius): the smallest radius at which no source vertex is without candidates, in closed form.

    It is the largest distance of a source vertex from its nearest edge, found by doubling a bounded range join for the
    vertices that have met none yet. ``precision`` rounds it up to a multiple. The other modes have the same radius: they
    add points of the target's edges, and none of these is nearer than its edge. A target without a usable edge has a
    null radius.
    """
    CandidateMode(mode)
    usable = segments(edges, strict=False).select(F.col("graph").alias("target")).distinct()
    left = durable(source_points(pairs, vertices).join(usable, "target", "left_semi"))
    settled: list[DataFrame] = []
    rho = 1.0
    while left.limit(1).count():
        best = durable(near_edges(pairs, vertices, edges, rho, left).groupBy("pair_id", "source_vertex").agg(F.min("distance").alias("d")))
        settled.append(best.groupBy("pair_id").agg(F.max("d").alias("d")))
        left = durable(left.join(best, ["pair_id", "source_vertex"], "left_anti"))
        rho *= 2
    radius = reduce(DataFrame.unionByName, settled).groupBy("pair_id").agg(F.max("d").alias("radius")) if settled else pairs.limit(0).select("pair_id", F.lit(None).cast("double").alias("radius"))
    out = pairs.select("pair_id").join(radius, "pair_id", "left")
    return out.withColumn("radius", F.ceil(F.col("radius") / precision) * precision) if precision > 0 else out


# --- subdivision of target edges -----------------------------------------------------------------------------------


def split_edges(vertices: DataFrame, edges: DataFrame, fractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) with ``fractions`` (graph, edge_id, fractions: ascending array) as new vertices.

    New vertex ids follow the largest of the graph in order of edge position and fraction; edges are numbered from 0.
    """
    held = edges.join(fractions, ["graph", "edge_id"], "left").withColumn("fractions", F.coalesce("fractions", F.expr("cast(array() as array<double>)")))
    by_pos = Window.partitionBy("graph").orderBy("edge_pos").rowsBetween(Window.unboundedPreceding, -1)
    top = vertices.groupBy("graph").agg(F.max("vertex_id").alias("top"))
    held = held.withColumn("before", F.coalesce(F.sum(F.size("fractions")).over(by_pos), F.lit(0))).withColumn("first_edge", F.coalesce(F.sum(F.size("fractions") + 1).over(by_pos), F.lit(0))).join(top, "graph")
    n = F.size("fractions")
    new_points = held.select("graph", F.posexplode(F.transform("fractions", lambda f: geo.point_at_fraction(F.col("polyline"), f))).alias("i", "p"), "before", "top")
    new_vertices = new_points.select("graph", (F.col("top") + 1 + F.col("before") + F.col("i")).alias("vertex_id"), "p.x", "p.y")
    cuts = F.concat(F.array(F.lit(0.0)), F.col("fractions"), F.array(F.lit(1.0)))
    parts = held.select("graph", F.explode(F.sequence(F.lit(0), n)).alias("i"), cuts.alias("cuts"), n.alias("n"), "u", "v", "polyline", "before", "top", "first_edge")
    node = F.col("top") + F.col("before") + F.col("i")
    new_edges = parts.select(
        "graph",
        (F.col("first_edge") + F.col("i")).alias("edge_id"),
        (F.col("first_edge") + F.col("i")).cast("int").alias("edge_pos"),
        F.when(F.col("i") == 0, F.col("u")).otherwise(node).alias("u"),
        F.when(F.col("i") == F.col("n"), F.col("v")).otherwise(node + 1).alias("v"),
        geo.subpolyline(F.col("polyline"), F.element_at("cuts", F.col("i") + 1), F.element_at("cuts", F.col("i") + 2)).alias("polyline"),
    )
    return vertices.select("graph", "vertex_id", "x", "y").unionByName(new_vertices), new_edges


def subdivide_uniform(vertices: DataFrame, edges: DataFrame, samples_per_edge: int = 2) -> tuple[DataFrame, DataFrame]:
    """Every edge gets the same number of vertices at equal steps of arc length; 0 changes nothing."""
    if samples_per_edge < 0:
        raise ValueError(f"points per edge must not be negative: {samples_per_edge}")
    if not samples_per_edge:
        return vertices, edges
    at = F.array(*[F.lit(i / (samples_per_edge + 1)) for i in range(1, samples_per_edge + 1)])
    return split_edges(vertices, edges, edges.select("graph", "edge_id", at.alias("fractions")))


def adaptive_fractions(pairs: DataFrame, vertices: DataFrame, edges: DataFrame, rho: float, max_points_per_source: int = 8, min_separation: float = 1.0) -> DataFrame:
    """(pair_id, graph, edge_id, fractions): closest points of the nearest edges of each source vertex.

    A point too near to an edge's end is no split. Along an edge points are taken in order, each at least the
    separation after the one taken last: a fold, since each choice depends on the one before.
    """
    check_parameters(rho, max_points_per_source)
    if not math.isfinite(min_separation) or min_separation < 0:
        raise ValueError(f"the separation must be finite and not negative: {min_separation}")
    near = near_edges(pairs, vertices, edges, rho).drop("distance", "u", "v", "edge_pos")
    points = source_points(pairs, vertices)
    lines = edges.select(F.col("graph").alias("target"), "edge_id", "polyline")
    met = near.join(points, ["pair_id", "source_vertex"]).join(lines, ["target", "edge_id"])
    met = met.withColumn("c", geo.closest(F.col("px"), F.col("py"), F.col("polyline"))).withColumn("len", geo.length(F.col("polyline")))
    order = Window.partitionBy("pair_id", "source_vertex").orderBy(F.sqrt("c.d2"), "edge_id", F.col("c.along") / F.col("len"))
    met = met.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max_points_per_source)
    if min_separation > 0:
        met = met.where((F.col("c.along") >= min_separation) & (F.col("len") - F.col("c.along") >= min_separation))
    tolerance = F.greatest(F.lit(1e-12), F.col("len") * 1e-12)
    met = met.where((F.col("c.along") > tolerance) & (F.col("len") - F.col("c.along") > tolerance))
    lists = met.groupBy("pair_id", "target", "edge_id").agg(F.array_sort(F.collect_list("c.along")).alias("at"), F.first("len").alias("len"))
    gap = F.greatest(F.lit(float(min_separation)), F.greatest(F.lit(1e-12), F.col("len") * 1e-12))
    taken = F.aggregate("at", F.expr("cast(array() as array<double>)"), lambda acc, d: F.when((F.size(acc) == 0) | (d - F.try_element_at(acc, F.lit(-1)) >= gap), F.concat(acc, F.array(d))).otherwise(acc))
    return lists.select("pair_id", F.col("target").alias("graph"), "edge_id", F.transform(taken, lambda d: d / F.col("len")).alias("fractions"))


def subdivide_adaptive(pairs: DataFrame, vertices: DataFrame, edges: DataFrame, rho: float, max_points_per_source: int = 8, min_separation: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, vertices, edges) in which every pair has its own split target, named after both; other graphs stay."""
    found = adaptive_fractions(pairs, vertices, edges, rho, max_points_per_source, min_separation)
    named = F.concat(F.col("target"), F.lit("@"), F.col("pair_id"))
    own = pairs.select("pair_id", "target", named.alias("graph"))
    v = vertices.withColumnRenamed("graph", "target").join(own, "target").select("graph", "vertex_id", "x", "y")
    e = edges.withColumnRenamed("graph", "target").join(own, "target").select("graph", "edge_id", "edge_pos", "u", "v", "polyline")
    f = found.join(own.select("pair_id", F.col("graph").alias("own")), "pair_id").select(F.col("own").alias("graph"), "edge_id", "fractions")
    new_v, new_e = split_edges(v, e, f)
    return pairs.withColumn("target", named), vertices.unionByName(new_v), edges.select("graph", "edge_id", "edge_pos", "u", "v", "polyline").unionByName(new_e)


def mode_candidates(pairs: DataFrame, vertices: DataFrame, edges: DataFrame, mode: CandidateMode, rho: float = RHO, top_k: int = TOP_K, *, samples_per_edge: int = 2, max_points_per_source: int = 8, min_separation: float = 1.0,
                    original: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(candidates, pairs, vertices, edges) of a mode: edge-radius candidates on the junction target, and for the other
    modes the vertices that its target has more, by vertex radius. ``original`` are vertices and edges with degree 2."""
    base = edge_radius_candidates(pairs, vertices, edges, rho, top_k)
    if mode is CandidateMode.JUNCTIONS:
        return base.withColumn("origin", F.lit(0)), pairs, vertices, edges
    limit = None
    if mode is CandidateMode.ADAPTIVE:
        new_pairs, v, e = subdivide_adaptive(pairs, vertices, edges, rho, max_points_per_source, min_separation)
        limit = max_points_per_source
    else:
        sources = pairs.select(F.col("source").alias("graph")).distinct()
        if mode is CandidateMode.UNIFORM:
            tv, te = subdivide_uniform(vertices, edges, samples_per_edge)
        elif original is not None:
            tv, te = original
        else:
            raise ValueError("the original mode needs the vertices and edges before compression")
        suffix = F.concat(F.col("graph"), F.lit("@split"))
        new_pairs = pairs.withColumn("target", F.concat("target", F.lit("@split")))
        v = vertices.join(sources, "graph", "left_semi").unionByName(tv.withColumn("graph", suffix))
        e = edges.select("graph", "edge_id", "edge_pos", "u", "v", "polyline").join(sources, "graph", "left_semi").unionByName(te.select("graph", "edge_id", "edge_pos", "u", "v", "polyline").withColumn("graph", suffix))
    old = pairs.select("pair_id", F.col("target").alias("graph")).join(vertices, "graph").select("pair_id", "vertex_id")
    new_ids = new_pairs.select("pair_id", F.col("target").alias("graph")).join(v, "graph").select("pair_id", "graph", "vertex_id")
    missing = old.join(new_ids, ["pair_id", "vertex_id"], "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"the matching target lacks junction vertex {missing[0]['vertex_id']}")
    fresh = new_ids.join(old, ["pair_id", "vertex_id"], "left_anti").select("graph", "vertex_id")
    more = vertex_radius_candidates(new_pairs, v, rho, limit, fresh)
    return merge_candidates(base, more), new_pairs, v, e
