"""From raw vertices and edges to junction multigraphs, for many graphs at once.

raw_vertex(graph, vertex_id, x, y); raw_edge(graph, edge_id, u, v, delta, path). The result has vertex(graph, vertex_id,
x, y) and edge(graph, edge_id, edge_pos, u, v, polyline).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import geometry as geo
from netloom.functions import kernels
from netloom.operators.components import connected_components
from netloom.operators.matching import _lines, _packed
from netloom.plans.durable import durable

#: Coordinates that mark a vertex as invalid; a fixed value of the data format.
INVALID_MARKER = (-1.0, -1.0)


def filter_graphs(raw_vertex: DataFrame, raw_edge: DataFrame, marker: tuple[float, float] | None = INVALID_MARKER) -> tuple[DataFrame, DataFrame]:
    """Finite vertices other than the marker; edges between two of them, no loops, with a usable line."""
    good = geo.finite(F.col("x")) & geo.finite(F.col("y"))
    if marker is not None:
        good = good & ~((F.col("x") == marker[0]) & (F.col("y") == marker[1]))
    vertices = raw_vertex.where(good)
    ids = vertices.select("graph", F.col("vertex_id").alias("_id"))
    lines = raw_edge.where("u <> v").withColumn("path", geo.clean(F.col("path"))).where("path is not null")
    for end in ("u", "v"):
        lines = lines.join(ids, (lines["graph"] == ids["graph"]) & (lines[end] == ids["_id"]), "left_semi")
    return vertices, lines


def incidence(edges: DataFrame) -> DataFrame:
    """(graph, vertex_id, neighbour, edge_id) in both directions."""
    return edges.select("graph", F.col("u").alias("vertex_id"), F.col("v").alias("neighbour"), "edge_id").unionByName(edges.select("graph", F.col("v").alias("vertex_id"), F.col("u").alias("neighbour"), "edge_id"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    from netloom.operators.matching import vertex_components

    return vertex_components(vertices, edges)


def largest_component(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each graph the component with most vertices, then most edges, then the smallest vertex."""
    comp = durable(components(vertices, edges))
    nv = comp.groupBy("graph", "component").agg(F.count("*").alias("nv"))
    ne = edges.join(comp.select("graph", F.col("vertex_id").alias("u"), "component"), ["graph", "u"]).groupBy("graph", "component").agg(F.count("*").alias("ne"))
    order = Window.partitionBy("graph").orderBy(F.desc("nv"), F.desc("ne"), "component")
    sized = nv.join(ne, ["graph", "component"], "left").fillna(0, ["ne"])
    best = sized.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("graph", "component")
    kept = comp.join(best, ["graph", "component"], "left_semi").select("graph", "vertex_id")
    return vertices.join(kept, ["graph", "vertex_id"], "left_semi"), edges.join(kept.select("graph", F.col("vertex_id").alias("u")), ["graph", "u"], "left_semi")


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    n = incidence(edges).groupBy("graph", "vertex_id").agg(F.count("*").alias("degree"))
    return vertices.select("graph", "vertex_id").join(n, ["graph", "vertex_id"], "left").fillna(0, ["degree"])


def junctions(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, vertex_id): all but degree 2; a component of degree 2 only keeps its two smallest vertices."""
    deg = durable(degrees(vertices, edges).join(components(vertices, edges), ["graph", "vertex_id"]))
    w = Window.partitionBy("graph", "component")
    marked = deg.withColumn("ring", F.every(F.col("degree") == 2).over(w)).withColumn("nth", F.row_number().over(w.orderBy("vertex_id")))
    return marked.where((F.col("degree") != 2) | (F.col("ring") & (F.col("nth") <= 2))).select("graph", "vertex_id")


def compress_chains(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(junctions, chains): chains (graph, u, v, polyline, raw_edge_ids, chain_vertices) between junctions, u <= v.

    Edges that meet in a vertex that is no junction belong to one chain: chains are the components of that relation.
    Only the walk along one chain is sequential. A chain is walked from its smaller junction; one that returns to where
    it began starts with its smallest edge.
    """
    nodes = durable(junctions(vertices, edges))
    inner = incidence(edges).join(nodes, ["graph", "vertex_id"], "left_anti")
    meet = inner.groupBy("graph", "vertex_id").agg(F.min("edge_id").alias("a"), F.max("edge_id").alias("b"))
    linked = connected_components(meet.select(F.struct("graph", F.col("a").alias("id")).alias("u"), F.struct("graph", F.col("b").alias("id")).alias("v")))
    chain = linked.select("node.graph", F.col("node.id").alias("edge_id"), F.col("component.id").alias("chain"))
    at = vertices.join(nodes.withColumn("junction", F.lit(True)), ["graph", "vertex_id"], "left").select("graph", "vertex_id", "x", "y", F.coalesce("junction", F.lit(False)).alias("junction"))
    rows = edges.select("graph", "edge_id", "u", "v", "path").join(chain, ["graph", "edge_id"], "left").withColumn("chain", F.coalesce("chain", "edge_id"))
    for end in ("u", "v"):
        rows = rows.join(at.select("graph", F.col("vertex_id").alias(end), F.col("x").alias(f"{end}x"), F.col("y").alias(f"{end}y"), F.col("junction").alias(f"{end}j")), ["graph", end])

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("edge_id")
        lines = _lines(table["path"])
        rows = table.drop_columns(["path"]).to_pylist()
        near: dict[int, list[int]] = {}
        place, stops = {}, set()
        for k, r in enumerate(rows):
            for end in ("u", "v"):
                near.setdefault(r[end], []).append(k)
                place[r[end]] = np.array([r[f"{end}x"], r[f"{end}y"]])
                if r[f"{end}j"]:
                    stops.add(r[end])
        if not stops:
            raise ValueError(f"a chain of graph {rows[0]['graph']} has no junction")
        start = min(stops)
        current, k = start, near[start][0]
        line, ids, passed = None, [], [start]
        while True:
            r = rows[k]
            to = r["v"] if r["u"] == current else r["u"]
            part = kernels.orient(lines[k], place[current], place[to])
            line = part if line is None else kernels.join(line, part)
            ids.append(r["edge_id"])
            passed.append(to)
            if to in stops:
                break
            following = [x for x in near[to] if x != k]
            if len(following) != 1:
                raise ValueError(f"vertex {to} has {len(following)} ways on")
            current, k = to, following[0]
        if len(ids) != len(rows):
            raise ValueError(f"the walk missed edges {sorted(set(r['edge_id'] for r in rows) - set(ids))}")
        if passed[0] > passed[-1]:
            line, ids, passed = line[::-1], ids[::-1], passed[::-1]
        longs = pa.list_(pa.int64())
        return pa.table({"graph": pa.array([rows[0]["graph"]], pa.string()), "u": pa.array([passed[0]], pa.int64()), "v": pa.array([passed[-1]], pa.int64()), "polyline": _packed([line]), "raw_edge_ids": pa.array([ids], longs), "chain_vertices": pa.array([passed], longs)})

    schema = f"graph string, u long, v long, polyline {geo.POLYLINE}, raw_edge_ids array<long>, chain_vertices array<long>"
    return nodes, rows.groupBy("graph", "chain").applyInArrow(walk, schema)


def junction_graphs(raw_vertex: DataFrame, raw_edge: DataFrame, keep_largest: bool = True, marker: tuple[float, float] | None = INVALID_MARKER) -> tuple[DataFrame, DataFrame]:
    """The junction multigraphs: filtered, compressed, without loops, optionally only the largest component.

    Edges are numbered from 0 by (u, v, raw edge ids, chain vertices). Graphs without a valid vertex have no rows.
    """
    vertices, edges = filter_graphs(raw_vertex, raw_edge, marker)
    nodes, chains = compress_chains(vertices, edges)
    kept_v = vertices.join(nodes, ["graph", "vertex_id"], "left_semi").select("graph", "vertex_id", "x", "y")
    kept_e = durable(chains.where("u <> v").withColumn("edge_id", F.monotonically_increasing_id()))
    if keep_largest:
        kept_v, kept_e = largest_component(kept_v, kept_e)
    return kept_v, number_edges(kept_e, [F.col("u"), F.col("v"), F.col("raw_edge_ids"), F.col("chain_vertices")])


def embedded_graphs(raw_vertex: DataFrame, raw_edge: DataFrame, keep_largest: bool = True, marker: tuple[float, float] | None = INVALID_MARKER) -> tuple[DataFrame, DataFrame]:
    """The same without compression: all valid vertices stay, edges are numbered by (raw id, u, v)."""
    vertices, edges = filter_graphs(raw_vertex, raw_edge, marker)
    if keep_largest:
        vertices, edges = largest_component(vertices, edges)
    return vertices.select("graph", "vertex_id", "x", "y"), number_edges(edges.withColumnRenamed("path", "polyline"), [F.col("edge_id"), F.col("u"), F.col("v")])


def number_edges(edges: DataFrame, order: list) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("graph").orderBy(*order)) - 1
    return edges.withColumn("edge_pos", nth).withColumn("edge_id", F.col("edge_pos").cast("long")).select("graph", "edge_id", "edge_pos", "u", "v", "polyline", *[c for c in ("raw_edge_ids", "chain_vertices") if c in edges.columns])


def problems(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, problem): repeated ids, loops, unknown ends and unusable lines; empty if the graphs are valid."""
    ids = vertices.select("graph", F.col("vertex_id").alias("_id"))
    found = [
        vertices.groupBy("graph", "vertex_id").agg(F.count("*").alias("n")).where("n > 1").select("graph", F.concat(F.lit("repeated vertex "), "vertex_id").alias("problem")),
        edges.groupBy("graph", "edge_id").agg(F.count("*").alias("n")).where("n > 1").select("graph", F.concat(F.lit("repeated edge "), "edge_id").alias("problem")),
        edges.where("u = v").select("graph", F.concat(F.lit("loop "), "edge_id").alias("problem")),
        edges.where("edge_id < 0").select("graph", F.concat(F.lit("negative edge id "), "edge_id").alias("problem")),
        edges.where(geo.clean(F.col("polyline")).isNull()).select("graph", F.concat(F.lit("unusable line of edge "), "edge_id").alias("problem")),
    ]
    for end in ("u", "v"):
        found.append(edges.join(ids, (edges["graph"] == ids["graph"]) & (edges[end] == ids["_id"]), "left_anti").select("graph", F.concat(F.lit("unknown end of edge "), "edge_id").alias("problem")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def sparse_to_dense(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair_id, source, target) of all graph pairs with different numbers of vertices; the smaller is the source."""
    n = vertices.groupBy("graph").agg(F.count("*").alias("nv"))
    a, b = n.select(F.col("graph").alias("source"), F.col("nv").alias("na")), n.select(F.col("graph").alias("target"), F.col("nv").alias("nb"))
    return a.join(b, F.col("na") < F.col("nb")).select(F.concat("source", F.lit("_to_"), "target").alias("pair_id"), "source", "target")


def catalogue(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    nv = vertices.groupBy("graph").agg(F.count("*").alias("vertices"))
    return nv.join(edges.groupBy("graph").agg(F.count("*").alias("edges")), "graph", "left").fillna(0, ["edges"])


def flipped(vertices: DataFrame) -> DataFrame:
    """For display: y points down."""
    return vertices.withColumn("y", -F.col("y"))


def flipped_bounds(vertices: DataFrame) -> DataFrame:
    return flipped(vertices).groupBy("graph").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))
