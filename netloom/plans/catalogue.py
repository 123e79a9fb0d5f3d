"""Queries over the driver's tables, one for each operator, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import geometry as geo
from netloom.functions import kernels
from netloom.operators import candidates as cand
from netloom.operators import matching as m
from netloom.operators import prepare
from netloom.operators import reports
from netloom.plans import fixtures, studies
from netloom.plans.matcher import Matcher
from netloom.sources import graph_text, results

RHO, K = 6.0, 25
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_NET = """
nv AS (SELECT s_suppkey AS v, CAST(10 * (s_suppkey % 10) + (s_nationkey % 5) - 2 AS DOUBLE) AS x,
  CAST(10 * CAST(floor(s_suppkey / 10.0) AS BIGINT) + (s_nationkey % 3) - 1 AS DOUBLE) AS y FROM supplier),
ne AS (SELECT row_number() OVER (ORDER BY a.v, b.v) - 1 AS e, a.v AS u, b.v AS v, a.x AS x1, a.y AS y1, (a.x + b.x) / 2 + (a.v % 3) - 1 AS xm, (a.y + b.y) / 2 + (b.v % 3) - 1 AS ym, b.x AS x2, b.y AS y2
  FROM nv a JOIN nv b ON (b.v = a.v + 1 AND a.v % 10 < 9) OR b.v = a.v + 10),
ns0 AS (SELECT e, u, v, 0 AS ix, x1 AS sx, y1 AS sy, xm - x1 AS vx, ym - y1 AS vy FROM ne UNION ALL SELECT e, u, v, 1, xm, ym, x2 - xm, y2 - ym FROM ne),
ns AS (SELECT *, vx * vx + vy * vy AS len2, sqrt(vx * vx + vy * vy) AS len FROM ns0 WHERE vx * vx + vy * vy > 1e-24),
nl AS (SELECT e, u, v, sum(len) AS length FROM ns GROUP BY ALL),
sp AS (SELECT CAST(r_regionkey AS BIGINT) AS s, CAST(20 * r_regionkey + 5 AS DOUBLE) AS px, 1.0::DOUBLE AS py FROM region)"""
_D2 = "power(px - (sx + {t} * vx), 2) + power(py - (sy + {t} * vy), 2)".format(t="least(greatest(((px - sx) * vx + (py - sy) * vy) / len2, 0.0), 1.0)")


def _cand_sql(rho: float = RHO, k: int = K) -> str:
    return f"""{_NET},
ed AS (SELECT s, e, u, v, sqrt(min({_D2})) AS d FROM sp, ns GROUP BY ALL),
ends AS (SELECT s, d, e, 0 AS k, u AS t FROM ed WHERE d <= {rho} UNION ALL SELECT s, d, e, 1, v FROM ed WHERE d <= {rho}),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY d, e, k) AS n FROM ends) WHERE n = 1),
cand AS (SELECT s, t, d, r FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d, e, k) AS r FROM best) WHERE r <= {k})"""


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _problem(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return fixtures.problem(spark, sf_dir)


# --- candidates -------------------------------------------------------------------------------------------------------


@query(f"WITH {_cand_sql()} SELECT s AS source_vertex, CAST(r AS INTEGER) AS rank, t AS target_vertex, round(d, 6) AS distance FROM cand")
def candidates_edge_radius(spark, sf_dir):
    found = cand.edge_radius_candidates(*_problem(spark, sf_dir), RHO, K)
    return found.select("source_vertex", "rank", "target_vertex", F.round("distance", 6).alias("distance"))


_VERTEX_CAND = f"""{_NET}, vc AS (SELECT s, v AS t, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS d FROM sp, nv WHERE sqrt((px - x) * (px - x) + (py - y) * (py - y)) <= 12),
vr AS (SELECT s, t, d, row_number() OVER (PARTITION BY s ORDER BY d, t) AS r FROM vc)"""


@query(f"WITH {_VERTEX_CAND} SELECT s AS source_vertex, CAST(r AS INTEGER) AS rank, t AS target_vertex, round(d, 6) AS distance FROM vr WHERE r <= 25")
def candidates_vertex_radius(spark, sf_dir):
    pairs, vertices, _ = _problem(spark, sf_dir)
    found = cand.vertex_radius_candidates(pairs, vertices, 12.0, K)
    return found.select("source_vertex", "rank", "target_vertex", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_cand_sql()}, vc AS (SELECT s, v AS t, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS d FROM sp, nv WHERE sqrt((px - x) * (px - x) + (py - y) * (py - y)) <= 12),
al AS (SELECT s, t, 0 AS o, r FROM cand UNION ALL SELECT s, t, 1, row_number() OVER (PARTITION BY s ORDER BY d, t) FROM vc),
fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY o, r) AS n FROM al) WHERE n = 1)
SELECT s AS source_vertex, CAST(row_number() OVER (PARTITION BY s ORDER BY o, r) AS INTEGER) AS rank, t AS target_vertex, o AS origin FROM fi""")
def candidates_merged(spark, sf_dir):
    pairs, vertices, edges = _problem(spark, sf_dir)
    merged = cand.merge_candidates(cand.edge_radius_candidates(pairs, vertices, edges, RHO, K), cand.vertex_radius_candidates(pairs, vertices, 12.0, K))
    return merged.select("source_vertex", "rank", "target_vertex", "origin")


@query(f"""WITH {_cand_sql(1.5)}, n AS (SELECT sp.s, count(t) AS n FROM sp LEFT JOIN cand USING (s) GROUP BY 1)
SELECT count(*) AS sources, CAST(count_if(n = 0) AS BIGINT) AS empty, CAST(sum(n) AS BIGINT) AS total, min(n) AS least, max(n) AS most, quantile_cont(n, 0.5) AS median, round(avg(n), 6) AS mean FROM n""")
def candidate_stats(spark, sf_dir):
    pairs, vertices, edges = _problem(spark, sf_dir)
    found = cand.candidate_statistics(cand.edge_radius_candidates(pairs, vertices, edges, 1.5, K), pairs, vertices)
    return found.drop("pair_id").withColumn("mean", F.round("mean", 6))


@query(f"WITH {_NET}, ed AS (SELECT s, sqrt(min({_D2})) AS d FROM sp, ns GROUP BY 1) SELECT round(max(d), 6) AS radius FROM ed")
def min_candidate_radius(spark, sf_dir):
    return cand.minimum_radius(*_problem(spark, sf_dir)).select(F.round("radius", 6).alias("radius"))


@query(f"""WITH RECURSIVE {_NET}, ed AS (SELECT s, e, sqrt(min({_D2})) AS d FROM sp, ns GROUP BY 1, 2),
c AS (SELECT s, e, ix, {_D2} AS d2, CASE WHEN ix = 0 THEN 0 ELSE length - len END + least(greatest(((px - sx) * vx + (py - sy) * vy) / len2, 0.0), 1.0) * len AS a, length FROM sp, ns JOIN nl USING (e, u, v)),
n AS (SELECT s, e, a, length, sqrt(d2) AS d FROM c SEMI JOIN (SELECT s, e FROM ed WHERE d <= {RHO}) q USING (s, e) QUALIFY row_number() OVER (PARTITION BY s, e ORDER BY d2, ix) = 1),
k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY s ORDER BY d, e, a / length) <= 8),
o AS (SELECT e, a, length, row_number() OVER (PARTITION BY e ORDER BY a) AS i FROM k WHERE a >= 1 AND length - a >= 1),
f AS (SELECT e, i, a AS last, true AS taken, length FROM o WHERE i = 1 UNION ALL SELECT o.e, o.i, CASE WHEN o.a - f.last >= 1 THEN o.a ELSE f.last END, o.a - f.last >= 1, o.length FROM f JOIN o ON o.e = f.e AND o.i = f.i + 1),
t AS (SELECT e, last AS d, row_number() OVER (ORDER BY e, last) AS nth FROM f WHERE taken),
p AS (SELECT t.nth, avg(sx + (d - start) / len * vx) AS x, avg(sy + (d - start) / len * vy) AS y FROM t JOIN (SELECT ns.*, CASE WHEN ix = 0 THEN 0 ELSE length - len END AS start FROM ns JOIN nl USING (e, u, v)) g ON t.e = g.e AND d >= start AND (d < start + len OR ix = 1) GROUP BY 1)
SELECT v AS vertex_id, round(x, 6) AS x, round(y, 6) AS y FROM nv UNION ALL SELECT (SELECT max(v) FROM nv) + nth, round(x, 6), round(y, 6) FROM p""")
def adaptive_subdivision(spark, sf_dir):
    pairs, vertices, edges = _problem(spark, sf_dir)
    pairs, vertices, edges = cand.subdivide_adaptive(pairs, vertices, edges, RHO)
    return vertices.join(pairs.select(F.col("target").alias("graph")), "graph").select("vertex_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_CUT = """SELECT e, f, i, sx + (d - start) / len * vx AS x, sy + (d - start) / len * vy AS y FROM (
  SELECT ns.e, f, i, sx, sy, vx, vy, len, ix, length * f AS d, CASE WHEN ix = 0 THEN 0 ELSE length - len END AS start, length FROM ns JOIN nl USING (e), (VALUES (1.0 / 3, 0), (2.0 / 3, 1)) g(f, i))
WHERE d >= start AND (d < start + len OR ix = 1)"""


@query(f"WITH {_NET}, c AS ({_CUT}) SELECT (SELECT max(v) FROM nv) + 1 + 2 * e + i AS vertex_id, round(x, 6) AS x, round(y, 6) AS y FROM c UNION ALL SELECT v, round(x, 6), round(y, 6) FROM nv")
def uniform_subdivision(spark, sf_dir):
    vertices, _ = cand.subdivide_uniform(fixtures.net_vertices(spark, sf_dir), fixtures.net_edges(spark, sf_dir), 2)
    return vertices.select("vertex_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# --- geometry ---------------------------------------------------------------------------------------------------------

_CURVES = """
tp AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS y FROM events),
ts0 AS (SELECT user_id, i, CAST(i AS DOUBLE) AS sx, y AS sy, 1.0::DOUBLE AS vx, lead(y) OVER (PARTITION BY user_id ORDER BY i) - y AS vy FROM tp),
tseg AS (SELECT *, sqrt(1 + vy * vy) AS len, 1 + vy * vy AS len2 FROM ts0 WHERE vy IS NOT NULL),
tcum AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, max(i) OVER (PARTITION BY user_id) AS last FROM tseg),
ttot AS (SELECT user_id, sum(len) AS total FROM tseg GROUP BY 1)"""


@query(f"WITH {_CURVES} SELECT user_id, round(total, 5) AS length FROM ttot")
def polyline_length(spark, sf_dir):
    return fixtures.curves(spark, sf_dir).select("user_id", F.round(geo.length(F.col("line")), 5).alias("length"))


def _at_sql(points: str) -> str:
    """Points (user_id, j, d) by arc length."""
    return f"SELECT p.user_id, p.j, sx + (d - start) / len * vx AS x, sy + (d - start) / len * vy AS y FROM ({points}) p JOIN tcum c ON p.user_id = c.user_id AND d >= start AND (d < start + len OR (i = last AND d < start + len + 1e-6))"


_SAMPLES = "SELECT user_id, j, j * total / {n} AS d FROM ttot, range(0, {m}) r(j)"


@query(f"WITH {_CURVES}, a AS ({_at_sql(_SAMPLES.format(n=15.0, m=16))}) SELECT user_id, CAST(j AS INTEGER) AS i, round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM a GROUP BY 1, 2")
def polyline_resample(spark, sf_dir):
    out = fixtures.curves(spark, sf_dir).select("user_id", F.posexplode(geo.resample(F.col("line"), 16)).alias("i", "p"))
    return out.select("user_id", "i", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query(f"WITH {_CURVES}, a AS ({_at_sql('SELECT user_id, 0 AS j, total * 0.3 AS d FROM ttot')}) SELECT user_id, round(avg(x), 4) AS x, round(avg(y), 4) AS y FROM a GROUP BY 1")
def point_at_fraction(spark, sf_dir):
    out = fixtures.curves(spark, sf_dir).select("user_id", geo.point_at_fraction(F.col("line"), F.lit(0.3)).alias("p"))
    return out.select("user_id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query(f"WITH {_CURVES} SELECT user_id, CAST(2 + CAST(count_if(start > 0.2 * total AND start < 0.7 * total) AS BIGINT) AS INTEGER) AS points, round(any_value(total) * 0.5, 4) AS length FROM tcum JOIN ttot USING (user_id) GROUP BY 1")
def subpolyline(spark, sf_dir):
    out = fixtures.curves(spark, sf_dir).select("user_id", geo.subpolyline(F.col("line"), F.lit(0.2), F.lit(0.7)).alias("p"))
    return out.select("user_id", F.size("p").alias("points"), F.round(geo.length(F.col("p")), 4).alias("length"))


@query(f"""WITH {_NET}, c AS (SELECT s, e, ix, {_D2} AS d2, (CASE WHEN ix = 0 THEN 0 ELSE length - len END + least(greatest(((px - sx) * vx + (py - sy) * vy) / len2, 0.0), 1.0) * len) / length AS f FROM sp, ns JOIN nl USING (e, u, v)),
b AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY d2, e, ix) AS n FROM c) SELECT s AS source_vertex, e AS edge_id, round(f, 6) AS fraction, round(sqrt(d2), 6) AS distance FROM b WHERE n = 1""")
def nearest_segment(spark, sf_dir):
    pairs, vertices, edges = _problem(spark, sf_dir)
    near = cand.near_edges(pairs, vertices, edges, RHO).groupBy("pair_id", "source_vertex").agg(F.min(F.struct("distance", "edge_pos", "edge_id")).alias("b"))
    points = cand.source_points(pairs, vertices)
    met = near.join(points, ["pair_id", "source_vertex"]).select("source_vertex", "target", "px", "py", F.col("b.edge_id").alias("edge_id"), F.col("b.distance").alias("distance"))
    line = edges.select(F.col("graph").alias("target"), "edge_id", "polyline")
    found = met.join(line, ["target", "edge_id"]).withColumn("c", geo.closest(F.col("px"), F.col("py"), F.col("polyline")))
    return found.select("source_vertex", "edge_id", F.round(F.col("c.along") / geo.length(F.col("polyline")), 6).alias("fraction"), F.round("distance", 6).alias("distance"))


# --- graphs -----------------------------------------------------------------------------------------------------------

_THIN = "te AS (SELECT * FROM ne WHERE v = u + 1 AND u % 7 <> 3 OR v = u + 10 AND u % 10 IN (0, 5))"


def _thin(spark, sf_dir):
    """The network with few edges: components, leaves and chains."""
    v, e = fixtures.net_vertices(spark, sf_dir), fixtures.net_edges(spark, sf_dir)
    return v, e.where("(v = u + 1 and u % 7 <> 3) or (v = u + 10 and u % 10 in (0, 5))")


@query(f"WITH {_NET}, {_THIN}, b AS (SELECT u AS a FROM te UNION ALL SELECT v FROM te) SELECT v AS vertex_id, count(a) AS degree FROM nv LEFT JOIN b ON a = v GROUP BY 1")
def graph_degree(spark, sf_dir):
    return prepare.degrees(*_thin(spark, sf_dir)).select("vertex_id", "degree")


_LOOPED = "le AS (SELECT * FROM ne WHERE v = u + 1 OR v = u + 10 AND u % 10 IN (0, 1) AND (u // 10) % 2 = 0 OR v = u + 10 AND u % 10 = 9 AND (u // 10) % 2 = 1)"


def _looped(spark, sf_dir):
    """Rows of the network joined to a strip with one cycle of four edges for every two rows."""
    v, e = fixtures.net_vertices(spark, sf_dir), fixtures.net_edges(spark, sf_dir)
    return v, e.where("v = u + 1 or (v = u + 10 and u % 10 in (0, 1) and u div 10 % 2 = 0) or (v = u + 10 and u % 10 = 9 and u div 10 % 2 = 1)")


_REACH = f"""WITH RECURSIVE {_NET}, {_THIN}, bo AS (SELECT u AS a, v AS b FROM te UNION ALL SELECT v, u FROM te),
re AS (SELECT v AS a, v AS b FROM nv UNION SELECT re.a, bo.b FROM re JOIN bo ON re.b = bo.a),
co AS (SELECT a AS v, min(b) AS c FROM re GROUP BY 1), de AS (SELECT nv.v, count(a) AS d FROM nv LEFT JOIN bo ON a = nv.v GROUP BY 1)"""


@query(f"{_REACH} SELECT v AS vertex_id, c AS component FROM co")
def connected_components(spark, sf_dir):
    return m.vertex_components(*_thin(spark, sf_dir)).select("vertex_id", "component")


@query(f"""{_REACH}, ce AS (SELECT c, count(*) AS n FROM te JOIN co ON co.v = u GROUP BY 1), cv AS (SELECT c, count(*) AS n FROM co GROUP BY 1),
b AS (SELECT cv.c FROM cv LEFT JOIN ce USING (c) ORDER BY cv.n DESC, coalesce(ce.n, 0) DESC, c LIMIT 1) SELECT v AS vertex_id FROM co JOIN b USING (c)""")
def largest_component(spark, sf_dir):
    return prepare.largest_component(*_thin(spark, sf_dir))[0].select("vertex_id")


@query(f"""{_REACH}, r AS (SELECT v, d, c, bool_and(d = 2) OVER (PARTITION BY c) AS ring, row_number() OVER (PARTITION BY c ORDER BY v) AS n FROM co JOIN de USING (v))
SELECT v AS vertex_id FROM r WHERE d <> 2 OR (ring AND n <= 2)""")
def junctions(spark, sf_dir):
    return prepare.junctions(*_thin(spark, sf_dir)).select("vertex_id")


@query(f"""{_REACH}, j AS (SELECT v FROM de WHERE d <> 2),
pa AS (SELECT a AS f, a AS p, b AS t, 1 AS n, greatest(a, b) * 100000 + least(a, b) AS first, greatest(a, b) * 100000 + least(a, b) AS last, length AS l FROM bo JOIN nl ON least(a, b) = u AND greatest(a, b) = nl.v WHERE a IN (SELECT v FROM j)
  UNION ALL SELECT f, pa.t, bo.b, n + 1, first, greatest(bo.a, bo.b) * 100000 + least(bo.a, bo.b), l + length FROM pa JOIN bo ON bo.a = pa.t AND bo.b <> pa.p JOIN nl ON least(bo.a, bo.b) = u AND greatest(bo.a, bo.b) = nl.v WHERE pa.t NOT IN (SELECT v FROM j)),
en AS (SELECT * FROM pa WHERE t IN (SELECT v FROM j) AND (f < t OR f = t AND first <= last))
SELECT f AS u, t AS v, n AS edges, round(l, 5) AS length FROM en""")
def chain_compression(spark, sf_dir):
    v, e = _thin(spark, sf_dir)
    nodes, chains = prepare.compress_chains(v, e.withColumnRenamed("polyline", "path"))
    return chains.select("u", "v", F.size("raw_edge_ids").alias("edges"), F.round(geo.length(F.col("polyline")), 5).alias("length"))


@query(f"WITH {_NET} SELECT v AS vertex_id, round(x, 6) AS x, round(y, 6) AS y FROM nv")
def graph_text_vertices(spark, sf_dir):
    text = graph_text.to_text(fixtures.net_vertices(spark, sf_dir), fixtures.net_edges(spark, sf_dir))
    return graph_text.raw_graphs(text)[0].select("vertex_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH {_NET} SELECT e AS edge_id, u, v, 3 AS points, round(length, 6) AS length FROM nl")
def graph_text_edges(spark, sf_dir):
    text = graph_text.to_text(fixtures.net_vertices(spark, sf_dir), fixtures.net_edges(spark, sf_dir))
    return graph_text.raw_graphs(text)[1].select("edge_id", "u", "v", F.size("path").alias("points"), F.round(geo.length(F.col("path")), 6).alias("length"))


@query("""WITH n AS (SELECT 'n' || c_nationkey AS g, count(*) AS nv FROM customer GROUP BY 1)
SELECT a.g || '_to_' || b.g AS pair_id, a.g AS source, b.g AS target FROM n a JOIN n b ON a.nv < b.nv""")
def sparse_to_dense_pairs(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("n"), "c_nationkey").alias("graph"), F.col("c_custkey").alias("vertex_id"))
    return prepare.sparse_to_dense(c, c)


# --- pruning and preflight ---------------------------------------------------------------------------------------------

_SUP = """SELECT c.s, c.t FROM {p} c WHERE NOT EXISTS (SELECT 1 FROM arcs WHERE arcs.s = c.s AND NOT EXISTS
  (SELECT 1 FROM {p} o WHERE o.s = arcs.o AND o.t <> c.t AND o.t // 10 = c.t // 10))"""


@query(f"""WITH {_cand_sql(9.0)}, arcs AS (SELECT a.s, b.s AS o FROM sp a JOIN sp b ON abs(a.s - b.s) = 1), r0 AS (SELECT s, t FROM cand),
{', '.join(f"r{k + 1} AS ({_SUP.format(p=f'r{k}')})" for k in range(8))}
SELECT s AS source_vertex, t AS target_vertex FROM r8""")
def arc_consistency(spark, sf_dir):
    """In the network without edges between rows, so that components differ."""
    pairs, vertices, edges = _problem(spark, sf_dir)
    found = cand.edge_radius_candidates(pairs, vertices, edges, 9.0, K)
    rows = edges.where("graph = 'src' or v = u + 1")
    return m.arc_consistency(found, pairs, vertices, rows).select("source_vertex", "target_vertex")


@query(f"WITH {_cand_sql()}, n AS (SELECT s, count(*) AS n FROM cand GROUP BY 1) SELECT CAST(sum(a.n * b.n) AS DOUBLE) AS states, CAST(max(a.n * b.n) AS DOUBLE) AS most, min(a.n * b.n) > 0 AS possible FROM n a JOIN n b ON b.s = a.s + 1")
def preflight_estimate(spark, sf_dir):
    pairs, vertices, edges = _problem(spark, sf_dir)
    bags = m.decompositions(fixtures.path_vertices(spark, sf_dir), fixtures.path_edges(spark, sf_dir))
    found = m.preflight_totals(m.preflight(bags, pairs, cand.edge_radius_candidates(pairs, vertices, edges, RHO, K)))
    return found.select(F.col("states").cast("double").alias("states"), F.col("most").cast("double").alias("most"), "possible")


@query(f"WITH {_NET}, {_THIN}, {_LOOPED} SELECT 'vertex' AS kind, v AS id, 1 AS times FROM nv UNION ALL SELECT 'edge', e, 1 FROM le UNION ALL SELECT 'root', 0, 1")
def tree_decomposition(spark, sf_dir):
    """Of the emitted bags of a network with cycles: a vertex's bags less those whose parent bag has it too, the bags that own an edge with both ends in them, and the roots."""
    v, e = _looped(spark, sf_dir)
    bags = m.decompositions(v, e)
    held = bags.select("bag_id", "parent_bag_id", F.explode("variables").alias("id"))
    parent = bags.select(F.col("bag_id").alias("parent_bag_id"), F.col("variables").alias("above"))
    apart = held.join(parent, "parent_bag_id", "left").groupBy("id").agg((F.count("*") - F.count_if(F.coalesce(F.array_contains("above", F.col("id")), F.lit(False)))).alias("times"))
    owned = bags.select("variables", F.explode("edge_ids").alias("edge_id")).join(e.select("edge_id", "u", "v"), "edge_id").where(F.array_contains("variables", F.col("u")) & F.array_contains("variables", F.col("v")))
    out = apart.select(F.lit("vertex").alias("kind"), "id", F.col("times").cast("int").alias("times"))
    out = out.unionByName(owned.groupBy(F.lit("edge").alias("kind"), F.col("edge_id").alias("id")).agg(F.count("*").cast("int").alias("times")))
    return out.unionByName(bags.agg(F.lit("root").alias("kind"), F.lit(0).cast("long").alias("id"), F.count_if(F.col("parent_bag_id").isNull()).cast("int").alias("times")))


@query(f"WITH {_NET}, {_THIN}, {_LOOPED} SELECT 2 AS width FROM le GROUP BY ALL HAVING count(*) > 0")
def decomposition_width(spark, sf_dir):
    """The network's cycles share no edge, so its treewidth is 2 and min-fill finds it."""
    return m.decompositions(*_looped(spark, sf_dir)).select("width").distinct()


# --- paths and costs ----------------------------------------------------------------------------------------------------

_HOPS = 12
_PATHS = f"""{_cand_sql()}, rq AS (SELECT a.s AS e, a.t AS tu, b.t AS tv FROM cand a JOIN cand b ON b.s = a.s + 1 AND a.t <> b.t),
bo AS (SELECT u AS a, v AS b, length AS l FROM nl UNION ALL SELECT v, u, length FROM nl), d0 AS (SELECT DISTINCT tu AS f, tu AS t, 0.0::DOUBLE AS d FROM rq),
{', '.join(f"d{k + 1} AS MATERIALIZED (SELECT f, t, min(d) AS d FROM (SELECT * FROM d{k} UNION ALL SELECT f, b, d + l FROM d{k} JOIN bo ON a = t) GROUP BY 1, 2)" for k in range(_HOPS))},
ds AS (SELECT DISTINCT tu, tv, d FROM rq JOIN d{_HOPS} ON f = tu AND t = tv)"""


@query(f"WITH {_PATHS} SELECT tu AS target_u, tv AS target_v, round(d, 6) AS distance FROM ds")
def shortest_path_distance(spark, sf_dir):
    pairs, vertices, edges = _problem(spark, sf_dir)
    asked = m.all_requests(cand.edge_radius_candidates(pairs, vertices, edges, RHO, K), pairs, edges)
    return m.shortest_paths(asked, pairs, edges).select("target_u", "target_v", F.round("distance", 6).alias("distance"))


def _costs(spark, sf_dir, name: str, **options) -> DataFrame:
    pairs, vertices, edges = _problem(spark, sf_dir)
    asked = m.all_requests(cand.edge_radius_candidates(pairs, vertices, edges, RHO, K), pairs, edges)
    found = m.edge_costs(asked, pairs, vertices, edges, m.create_cost(name, **options))
    return found.select("edge_id", "target_u", "target_v", F.round("value", 6).alias("value"))


@query(f"WITH {_PATHS} SELECT e AS edge_id, tu AS target_u, tv AS target_v, round(abs(d / 20.0 - 1), 6) AS value FROM rq JOIN ds USING (tu, tv)")
def cost_relative_length(spark, sf_dir):
    return _costs(spark, sf_dir, "relative_length_error")


@query(f"WITH {_PATHS} SELECT e AS edge_id, tu AS target_u, tv AS target_v, round(abs(ln(d / 20.0)), 6) AS value FROM rq JOIN ds USING (tu, tv)")
def cost_log_length(spark, sf_dir):
    return _costs(spark, sf_dir, "log_length_distortion")


@query()
def cost_guided_hausdorff(spark, sf_dir):
    return _costs(spark, sf_dir, "hausdorff_distance")


@query(f"""WITH {_NET}, sm AS (SELECT e, j, avg(sx + (d - start) / len * vx) AS px, avg(sy + (d - start) / len * vy) AS py FROM (
  SELECT ns.e, j, sx, sy, vx, vy, len, ix, j * length / 11.0 AS d, CASE WHEN ix = 0 THEN 0 ELSE length - len END AS start FROM ns JOIN nl USING (e), range(0, 12) r(j))
  WHERE d >= start AND (d < start + len OR ix = 1) GROUP BY 1, 2),
sd AS (SELECT a.s AS g, sm.e, j, sqrt(power(sm.px - least(greatest(sm.px, a.px), a.px + 20), 2) + power(sm.py - 1, 2)) AS d FROM sm, sp a WHERE a.s < 4)
SELECT g AS source_edge, e AS edge_id, round(avg(CASE WHEN d > 10 THEN 1.0 ELSE 0.0 END) * any_value(length) + 1e-6 * any_value(length), 6) AS weight FROM sd JOIN nl USING (e) GROUP BY 1, 2""")
def corridor_weights(spark, sf_dir):
    found = m.corridor_weights(*_problem(spark, sf_dir))
    return found.select("source_edge", "edge_id", F.round("weight", 6).alias("weight"))


def _curve_pairs(spark, sf_dir) -> DataFrame:
    c = fixtures.curves(spark, sf_dir)
    return c.select("user_id", F.col("line").alias("line_a")).join(c.select((F.col("user_id") - 1).alias("user_id"), F.col("line").alias("line_b")), "user_id")


def _curve_cost(spark, sf_dir, name: str, **options) -> DataFrame:
    found = m.curve_costs(_curve_pairs(spark, sf_dir), m.create_cost(name, **options))
    return found.select("user_id", F.round("value", 4).alias("value"))


_TO_CURVE = "sqrt(min(" + _D2 + "))"


@query(f"""WITH {_CURVES}, q AS (SELECT p.user_id AS k, o AS w, p.i, CAST(p.i AS DOUBLE) AS px, p.y AS py FROM tp p, (VALUES (0), (1)) g(o)),
h AS (SELECT k, w, q.i, {_TO_CURVE} AS d FROM q JOIN tseg c ON c.user_id = CASE WHEN w = 0 THEN k + 1 ELSE k - 1 END GROUP BY 1, 2, 3)
SELECT CASE WHEN w = 0 THEN k ELSE k - 1 END AS user_id, round(max(d), 4) AS value FROM h GROUP BY 1""")
def cost_hausdorff(spark, sf_dir):
    return _curve_cost(spark, sf_dir, "hausdorff_distance")


@query(f"""WITH {_CURVES}, a AS ({_at_sql(_SAMPLES.format(n=63.0, m=64))}), s AS (SELECT user_id AS k, j, avg(x) AS px, avg(y) AS py FROM a GROUP BY 1, 2), q AS (SELECT *, o AS w FROM s, (VALUES (0), (1)) g(o)),
h AS (SELECT k, w, j, {_TO_CURVE} AS d FROM q JOIN tseg c ON c.user_id = CASE WHEN w = 0 THEN k + 1 ELSE k - 1 END GROUP BY 1, 2, 3),
m AS (SELECT k, w, avg(greatest(d / 10.0 - 1, 0)) AS v FROM h GROUP BY 1, 2)
SELECT CASE WHEN w = 0 THEN k ELSE k - 1 END AS user_id, round(avg(v), 4) AS value FROM m GROUP BY 1""")
def cost_corridor(spark, sf_dir):
    return _curve_cost(spark, sf_dir, "symmetric_corridor_exceedance")


_SIDES = "(VALUES (0), (1)) g(w)"
_UNIT = "tu AS (SELECT user_id, i, sx, sy, vx, vy, len, len2, start, last, vx / len AS ux, vy / len AS uy FROM tcum)"
_BEND = """CASE WHEN {t} <= 1e-12 AND {s}.i > 0 AND sqrt(power({s}.ux + {p}.ux, 2) + power({s}.uy + {p}.uy, 2)) > 1e-12 THEN ({s}.{c} + {p}.{c}) / sqrt(power({s}.ux + {p}.ux, 2) + power({s}.uy + {p}.uy, 2))
  WHEN {t} >= 1 - 1e-12 AND {s}.i < {s}.last AND sqrt(power({s}.ux + {n}.ux, 2) + power({s}.uy + {n}.uy, 2)) > 1e-12 THEN ({s}.{c} + {n}.{c}) / sqrt(power({s}.ux + {n}.ux, 2) + power({s}.uy + {n}.uy, 2)) ELSE {s}.{c} END"""


def _bent(c: str) -> str:
    return _BEND.format(t="b.t", s="s", p="p", n="n", c=c)


@query(f"""WITH {_CURVES}, {_UNIT}, sm AS (SELECT user_id AS k, j, first(sx + (d - start) / len * vx ORDER BY i DESC) AS px, first(sy + (d - start) / len * vy ORDER BY i DESC) AS py, first(i ORDER BY i DESC) AS i, first(least(greatest((d - start) / len, 0), 1) ORDER BY i DESC) AS t
  FROM (SELECT p.user_id, j, d, u.* EXCLUDE (user_id) FROM ({_SAMPLES.format(n=63.0, m=64)}) p JOIN tu u ON p.user_id = u.user_id AND d >= start AND (d < start + len OR (i = last AND d < start + len + 1e-6))) GROUP BY 1, 2),
sa AS (SELECT b.k, b.j, b.px, b.py, {_bent('ux')} AS ax, {_bent('uy')} AS ay FROM sm b JOIN tu s ON s.user_id = b.k AND s.i = b.i LEFT JOIN tu p ON p.user_id = b.k AND p.i = b.i - 1 LEFT JOIN tu n ON n.user_id = b.k AND n.i = b.i + 1),
q AS (SELECT sa.*, w, CASE WHEN w = 0 THEN k + 1 ELSE k - 1 END AS o FROM sa, {_SIDES}),
h AS (SELECT k, w, j, o, px, py, ax, ay, c.i, {_D2} AS d2, least(greatest(((px - sx) * vx + (py - sy) * vy) / len2, 0.0), 1.0) AS t FROM q JOIN tu c ON c.user_id = o),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY k, w, j ORDER BY d2, i) = 1),
r AS (SELECT b.k, b.w, sqrt(b.d2) AS d, abs(b.ax * ({_bent('ux')}) + b.ay * ({_bent('uy')})) AS dot FROM b JOIN tu s ON s.user_id = b.o AND s.i = b.i LEFT JOIN tu p ON p.user_id = b.o AND p.i = b.i - 1 LEFT JOIN tu n ON n.user_id = b.o AND n.i = b.i + 1),
v AS (SELECT k, w, avg(d + CASE WHEN dot >= 1 - 1e-12 THEN 0 ELSE acos(least(dot, 1)) / (pi() / 2) END) AS x FROM r GROUP BY 1, 2)
SELECT CASE WHEN w = 0 THEN k ELSE k - 1 END AS user_id, round(avg(x), 4) AS value FROM v GROUP BY 1""")
def cost_mean_distance_tangent(spark, sf_dir):
    return _curve_cost(spark, sf_dir, "mean_distance_tangent")


def _diagonals(n: int, d: str, worse: str, near: str = "true") -> str:
    """A program over an n by n table as one step for each antidiagonal: f0, f1, ... (p, i, f); ``g`` has the distances."""
    steps = [f"f0 AS MATERIALIZED (SELECT p, 0 AS i, {d} AS f FROM g WHERE i = 0 AND j = 0)"]
    for k in range(1, 2 * n - 1):
        slant = f"LEFT JOIN f{k - 2} c ON c.p = g.p AND c.i = g.i - 1" if k > 1 else ""
        least = "least(a.f, b.f, c.f)" if k > 1 else "least(a.f, b.f)"
        steps.append(f"f{k} AS MATERIALIZED (SELECT g.p, g.i, {worse.format(d=d, f=least)} AS f FROM g LEFT JOIN f{k - 1} a ON a.p = g.p AND a.i = g.i - 1 LEFT JOIN f{k - 1} b ON b.p = g.p AND b.i = g.i {slant} WHERE g.k = {k} AND {near})")
    return ", ".join(steps)


def _sampled(n: int, near: str = "true") -> str:
    """Squared distances g (p, i, j, k, d2) of the samples of each user's curve and the next one's."""
    return f"""sa AS MATERIALIZED (SELECT user_id AS k, j, avg(x) AS x, avg(y) AS y FROM ({_at_sql(_SAMPLES.format(n=float(n - 1), m=n))}) GROUP BY 1, 2),
g AS MATERIALIZED (SELECT a.k AS p, a.j AS i, b.j AS j, a.j + b.j AS k, power(a.x - b.x, 2) + power(a.y - b.y, 2) AS d2 FROM sa a JOIN sa b ON b.k = a.k + 1 WHERE {near})"""


@query(f"WITH {_CURVES}, {_sampled(64)}, {_diagonals(64, 'sqrt(d2)', 'greatest({d}, {f})')} SELECT p AS user_id, round(f, 4) AS value FROM f126")
def cost_discrete_frechet(spark, sf_dir):
    return _curve_cost(spark, sf_dir, "discrete_frechet_distance")


@query(f"WITH {_CURVES}, {_sampled(80, 'abs(a.j - b.j) < 8')}, {_diagonals(80, 'd2', '{d} + {f}')} SELECT p AS user_id, round(sqrt(f) / sqrt(80.0), 4) AS value FROM f158")
def cost_dtw(spark, sf_dir):
    return _curve_cost(spark, sf_dir, "dynamic_time_warping_distance")


# --- matching -----------------------------------------------------------------------------------------------------------

_BRUTE = f"""{_PATHS}, fc AS (SELECT e, tu, tv, abs(d / 20.0 - 1) AS f FROM rq JOIN ds USING (tu, tv)),
al AS (SELECT a.tu AS t0, b.tu AS t1, c.tu AS t2, d.tu AS t3, d.tv AS t4, a.f + b.f + c.f + d.f AS total, greatest(a.f, b.f, c.f, d.f) AS worst
  FROM fc a JOIN fc b ON a.e = 0 AND b.e = 1 AND b.tu = a.tv JOIN fc c ON c.e = 2 AND c.tu = b.tv JOIN fc d ON d.e = 3 AND d.tu = c.tv)"""


def _match(spark, sf_dir, objective: str) -> DataFrame:
    found = Matcher(*_problem(spark, sf_dir), rho=RHO, top_k=K).match(m.create_cost("relative_length_error"), objective)
    return found.values.select("feasible", F.round("value", 6).alias("value"))


@query(f"WITH {_BRUTE} SELECT true AS feasible, round(min(total), 6) AS value FROM al")
def match_additive(spark, sf_dir):
    return _match(spark, sf_dir, "additive")


@query(f"WITH {_BRUTE} SELECT true AS feasible, round(min(worst), 6) AS value FROM al")
def match_bottleneck(spark, sf_dir):
    return _match(spark, sf_dir, "bottleneck")


@query(f"WITH {_BRUTE} SELECT true AS feasible, round(min(total) * 20, 6) AS value FROM al")
def match_length_weighted(spark, sf_dir):
    return _match(spark, sf_dir, "length_weighted_additive")


@query(f"WITH {_BRUTE} SELECT round(min(total), 6) AS value FROM al")
def match_relational(spark, sf_dir):
    """The dynamic program as joins and aggregates over the bags."""
    pairs, vertices, edges = _problem(spark, sf_dir)
    task = Matcher(pairs, vertices, edges, rho=RHO, top_k=K)
    source = fixtures.path_edges(spark, sf_dir).select("edge_id", "u", "v").collect()
    rows = [(r["edge_id"], r["u"], r["v"]) for r in source]
    tree = kernels.Decomposition(sorted({x for _, u, v in rows for x in (u, v)}), rows)
    return m.solve_relational(task.effective, task.costs(m.create_cost("relative_length_error")), tree, "additive").select(F.round("value", 6).alias("value"))


@query(f"WITH {_BRUTE} SELECT * FROM (SELECT unnest([0, 1, 2, 3, 4]) AS source_vertex, unnest([t0, t1, t2, t3, t4]) AS target_vertex FROM (SELECT * FROM al ORDER BY total LIMIT 1)) WHERE true")
def match_mapping(spark, sf_dir):
    found = Matcher(*_problem(spark, sf_dir), rho=RHO, top_k=K).match(m.create_cost("relative_length_error"))
    return found.mapping.select(F.col("source_vertex").cast("int").alias("source_vertex"), "target_vertex")


_DOM = f"""{_PATHS}, fc AS (SELECT e, tu, tv, abs(d / 20.0 - 1) AS f FROM rq JOIN ds USING (tu, tv)),
lo AS (SELECT e AS s, e, 0 AS side, tu AS t, tv AS c, f FROM fc UNION ALL SELECT e + 1, e, 1, tv, tu, f FROM fc),
pr AS (SELECT x.s, x.t AS a, y.t AS b FROM cand x JOIN cand y ON x.s = y.s AND x.t <> y.t)"""


@query(f"""WITH {_DOM} SELECT s, a, b FROM pr WHERE NOT EXISTS (SELECT 1 FROM lo y WHERE y.s = pr.s AND y.t = pr.b AND NOT EXISTS
  (SELECT 1 FROM lo x WHERE x.s = pr.s AND x.t = pr.a AND x.e = y.e AND x.side = y.side AND x.c = y.c AND x.f <= y.f))""")
def dominance_pairs(spark, sf_dir):
    task = Matcher(*_problem(spark, sf_dir), rho=RHO, top_k=K)
    return m.dominance_pairs(task.effective, task.costs(m.create_cost("relative_length_error")), task.arcs).select("s", "a", "b")


def _pruned(k: int) -> str:
    """One pass of pruning, over the candidates c{k}: those that another dominates go, of two that dominate each other the larger."""
    return f"""p{k} AS MATERIALIZED (SELECT x.s, x.t AS a, y.t AS b FROM c{k} x JOIN c{k} y ON x.s = y.s AND x.t <> y.t), l{k} AS MATERIALIZED (SELECT lo.* FROM lo SEMI JOIN c{k} x ON x.s = lo.s AND x.t = lo.t SEMI JOIN c{k} y ON y.s = CASE side WHEN 0 THEN lo.e + 1 ELSE lo.e END AND y.t = lo.c),
w{k} AS (SELECT DISTINCT p.s, p.a, p.b FROM p{k} p JOIN l{k} y ON y.s = p.s AND y.t = p.b LEFT JOIN l{k} x ON x.s = p.s AND x.t = p.a AND x.e = y.e AND x.side = y.side AND x.c = y.c WHERE x.f IS NULL OR x.f > y.f),
m{k} AS MATERIALIZED (SELECT * FROM p{k} ANTI JOIN w{k} USING (s, a, b)), c{k + 1} AS MATERIALIZED (SELECT s, t FROM c{k} WHERE NOT EXISTS (SELECT 1 FROM m{k} q LEFT JOIN m{k} r ON r.s = q.s AND r.a = q.b AND r.b = q.a WHERE q.s = c{k}.s AND q.b = c{k}.t AND (r.s IS NULL OR q.a < q.b)))"""


@query(f"WITH {_DOM}, c0 AS (SELECT s, t FROM cand), {', '.join(_pruned(k) for k in range(5))} SELECT s AS source_vertex, t AS target_vertex FROM c5")
def dominance_prune(spark, sf_dir):
    """The candidates that no other one dominates, after all passes."""
    task = Matcher(*_problem(spark, sf_dir), rho=RHO, top_k=K)
    return m.dominance_prune(task.candidates, task.costs(m.create_cost("relative_length_error")), task.arcs).select("source_vertex", "target_vertex")


@query(f"WITH {_BRUTE} SELECT round(min(total), 6) AS value, round(min(total), 6) AS pruned_value, true AS equal FROM al")
def dominance_benchmark(spark, sf_dir):
    task = Matcher(*_problem(spark, sf_dir), rho=RHO, top_k=K)
    found, _ = studies.dominance_benchmark(task, m.create_cost("relative_length_error"))
    return found.select(F.round("value", 6).alias("value"), F.round("pruned_value", 6).alias("pruned_value"), "equal")


_RING = f"""{_NET}, sq AS (SELECT * FROM (VALUES (0, 5.0, 1.0), (1, 25.0, 1.0), (2, 25.0, 21.0), (3, 5.0, 21.0), (4, 45.0, 21.0)) t(s, px, py)), sx AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 0, 3), (4, 2, 4)) t(e, a, b)),
ed AS (SELECT s, e, u, v, sqrt(min({_D2})) AS d FROM sq, ns GROUP BY ALL), ends AS (SELECT s, d, e, 0 AS k, u AS t FROM ed WHERE d <= 4 UNION ALL SELECT s, d, e, 1, v FROM ed WHERE d <= 4),
best AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY s, t ORDER BY d, e, k) = 1), cand AS (SELECT s, t FROM best QUALIFY row_number() OVER (PARTITION BY s ORDER BY d, e, k) <= 6),
rq AS (SELECT x.e, p.t AS tu, q.t AS tv FROM sx x JOIN cand p ON p.s = x.a JOIN cand q ON q.s = x.b AND q.t <> p.t), bo AS (SELECT u AS a, v AS b, length AS l FROM nl UNION ALL SELECT v, u, length FROM nl), d0 AS (SELECT DISTINCT tu AS f, tu AS t, 0.0::DOUBLE AS d FROM rq),
{', '.join(f"d{k + 1} AS MATERIALIZED (SELECT f, t, min(d) AS d FROM (SELECT * FROM d{k} UNION ALL SELECT f, b, d + l FROM d{k} JOIN bo ON a = t) GROUP BY 1, 2)" for k in range(_HOPS))},
fc AS MATERIALIZED (SELECT e, tu, tv, abs(d / 20.0 - 1) AS f FROM rq JOIN d{_HOPS} ON f = tu AND t = tv),
al AS (SELECT a.tu AS t0, a.tv AS t1, b.tv AS t2, c.tv AS t3, z.tv AS t4, a.f + b.f + c.f + y.f + z.f AS total, greatest(a.f, b.f, c.f, y.f, z.f) AS worst FROM fc a JOIN fc b ON a.e = 0 AND b.e = 1 AND b.tu = a.tv JOIN fc c ON c.e = 2 AND c.tu = b.tv
  JOIN fc y ON y.e = 3 AND y.tu = a.tu AND y.tv = c.tv JOIN fc z ON z.e = 4 AND z.tu = b.tv)"""


def _ring_task(spark, sf_dir) -> Matcher:
    """A source with a cycle of four edges and a branch: width 2, several children."""
    at = [(0, 5.0, 1.0), (1, 25.0, 1.0), (2, 25.0, 21.0), (3, 5.0, 21.0), (4, 45.0, 21.0)]
    place = {i: (x, y) for i, x, y in at}
    ends = [(0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 0, 3), (4, 2, 4)]
    v = spark.createDataFrame([("ring", i, x, y) for i, x, y in at], "graph string, vertex_id long, x double, y double")
    e = spark.createDataFrame([("ring", k, k, a, b, [place[a], place[b]]) for k, a, b in ends], f"graph string, edge_id long, edge_pos int, u long, v long, polyline {geo.POLYLINE}")
    pairs = spark.createDataFrame([("ring_to_net", "ring", "net")], "pair_id string, source string, target string")
    return Matcher(pairs, fixtures.net_vertices(spark, sf_dir).unionByName(v), fixtures.net_edges(spark, sf_dir).unionByName(e), rho=4.0, top_k=6)


@query(f"""WITH {_RING} SELECT 'additive' AS objective, round(min(total), 6) AS value FROM al UNION ALL SELECT 'bottleneck', round(min(worst), 6) FROM al UNION ALL SELECT 'length_weighted_additive', round(min(total) * 20, 6) FROM al""")
def match_ring(spark, sf_dir):
    """All objectives over a source with a cycle and a branch."""
    return _ring_task(spark, sf_dir).match_all(m.create_cost("relative_length_error")).values.select("objective", F.round("value", 6).alias("value"))


@query(f"WITH {_RING} SELECT unnest([0, 1, 2, 3, 4]) AS source_vertex, unnest([t0, t1, t2, t3, t4]) AS target_vertex FROM (SELECT * FROM al ORDER BY total, t0, t1, t2, t3, t4 LIMIT 1)")
def match_ring_mapping(spark, sf_dir):
    found = _ring_task(spark, sf_dir).match(m.create_cost("relative_length_error"))
    return found.mapping.select(F.col("source_vertex").cast("int").alias("source_vertex"), "target_vertex")


@query(f"WITH {_RING} SELECT a.e AS edge_id, a.tu AS target_u, a.tv AS target_v, round(a.f, 6) AS value FROM fc a")
def ring_costs(spark, sf_dir):
    """The local costs of all requests that arc consistency leaves; here it leaves all."""
    return _ring_task(spark, sf_dir).costs(m.create_cost("relative_length_error")).select("edge_id", "target_u", "target_v", F.round("value", 6).alias("value"))


@query(f"""WITH {_DOM}, b3 AS (SELECT * FROM fc WHERE e = 3), b2 AS (SELECT * FROM fc WHERE e = 2 AND tv IN (SELECT tu FROM b3)), b0 AS (SELECT * FROM fc WHERE e = 0), b1 AS (SELECT * FROM fc WHERE e = 1 AND tu IN (SELECT tv FROM b0) AND tv IN (SELECT tu FROM b2))
SELECT (SELECT count(*) FROM b0) + (SELECT count(*) FROM b1) + (SELECT count(*) FROM b2) + (SELECT count(*) FROM b3) AS states, (SELECT count(DISTINCT tv) FROM b0) + (SELECT count(DISTINCT tu) FROM b2) + (SELECT count(DISTINCT tu) FROM b3) + 1 AS messages""")
def program_statistics(spark, sf_dir):
    """States of finite value in all bags of the path's decomposition (root 1-2), and entries of their messages."""
    found = Matcher(*_problem(spark, sf_dir), rho=RHO, top_k=K).match(m.create_cost("relative_length_error"))
    return found.statistics.select("states", "messages")


@query(f"""WITH {_PATHS}, g AS (SELECT 6.0::DOUBLE AS rho, s, count(t) AS n FROM sp LEFT JOIN cand USING (s) GROUP BY 2 UNION ALL SELECT 0.5, s, count(e) FROM sp LEFT JOIN (SELECT s, e FROM (SELECT s, e, sqrt(min({_D2})) AS d FROM sp, ns GROUP BY 1, 2) WHERE d <= 0.5) q USING (s) GROUP BY 2),
fc AS (SELECT e, tu, tv, abs(d / 20.0 - 1) AS f FROM rq JOIN ds USING (tu, tv)), al AS (SELECT min(a.f + b.f + c.f + d.f) AS v FROM fc a JOIN fc b ON a.e = 0 AND b.e = 1 AND b.tu = a.tv JOIN fc c ON c.e = 2 AND c.tu = b.tv JOIN fc d ON d.e = 3 AND d.tu = c.tv)
SELECT 'target_junctions' AS mode, rho, CASE WHEN count_if(n = 0) > 0 THEN 'empty_domains' WHEN rho = 6 AND (SELECT v FROM al) IS NOT NULL THEN 'ok' ELSE 'globally_infeasible' END AS status, CAST(count_if(n = 0) AS BIGINT) AS empty,
  CASE WHEN count_if(n = 0) = 0 AND rho = 6 THEN round((SELECT v FROM al), 6) END AS value FROM g GROUP BY rho""")
def mode_grid(spark, sf_dir):
    found = studies.mode_grid(*_problem(spark, sf_dir), [0.5, RHO], cost=m.create_cost("relative_length_error"), top_k=K)
    return found.select("mode", "rho", "status", "empty", F.round("value", 6).alias("value"))


@query(f"""WITH {_PATHS}, al AS (SELECT a.s AS e, a.t AS tu, b.t AS tv FROM cand a JOIN cand b ON b.s = a.s + 1)
SELECT CASE WHEN al.tu = al.tv THEN 'same target' WHEN d IS NULL THEN 'no witness' ELSE 'cost' END AS category, count(*) AS requests FROM al LEFT JOIN ds USING (tu, tv) GROUP BY 1""")
def request_diagnostics(spark, sf_dir):
    task = Matcher(*_problem(spark, sf_dir), rho=RHO, top_k=K)
    c = task.candidates
    every = task.arcs.join(c.select("pair_id", F.col("source_vertex").alias("u"), F.col("target_vertex").alias("target_u")), ["pair_id", "u"]).join(c.select("pair_id", F.col("source_vertex").alias("v"), F.col("target_vertex").alias("target_v")), ["pair_id", "v"])
    paths = m.shortest_paths(every.where("target_u <> target_v"), task.pairs, task.edges)
    return reports.request_diagnostics(every, task.costs(m.create_cost("relative_length_error")), paths).drop("pair_id")


@query(f"WITH {_cand_sql()} SELECT sha256(string_agg(s || ':' || t, chr(10) ORDER BY s, t)) AS candidates FROM cand")
def candidate_digest(spark, sf_dir):
    return reports.candidate_digest(cand.edge_radius_candidates(*_problem(spark, sf_dir), RHO, K)).select("candidates")


@query("WITH n AS (SELECT c_custkey AS a, c_acctbal AS x, c_nationkey AS y FROM customer) SELECT a AS vertex_id, x, CAST(y AS DOUBLE) AS y FROM n WHERE NOT (x = -1 AND y = -1) AND x >= 0")
def graph_filter(spark, sf_dir):
    """Finite vertices other than the marker: negative balances are made infinite here."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    x = F.when(F.col("c_acctbal") < 0, F.lit(float("inf"))).otherwise(F.col("c_acctbal").cast("double"))
    v = c.select(F.lit("g").alias("graph"), F.col("c_custkey").alias("vertex_id"), x.alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    e = fixtures.net_edges(spark, sf_dir).withColumnRenamed("polyline", "path")
    return prepare.filter_graphs(v, e.limit(0))[0].select("vertex_id", "x", "y")


@query(f"WITH {_NET} SELECT e AS edge_id, u, v, round(length, 6) AS length FROM nl WHERE u % 5 <> 1 AND v % 5 <> 1")
def edge_filter(spark, sf_dir):
    """Edges with a usable line between two valid vertices: every fifth vertex gets the marker's place; loops and empty lines are put in and must go."""
    v, e = fixtures.net_vertices(spark, sf_dir), fixtures.net_edges(spark, sf_dir).withColumnRenamed("polyline", "path")
    mark = prepare.INVALID_MARKER
    v = v.withColumn("x", F.when(F.col("vertex_id") % 5 == 1, mark[0]).otherwise(F.col("x"))).withColumn("y", F.when(F.col("vertex_id") % 5 == 1, mark[1]).otherwise(F.col("y")))
    worse = e.withColumn("edge_id", F.col("edge_id") + 100000).withColumn("v", F.col("u")).unionByName(e.withColumn("edge_id", F.col("edge_id") + 200000).withColumn("path", F.array_repeat(F.element_at("path", 1), 3)))
    found = prepare.filter_graphs(v, e.unionByName(worse))[1]
    return found.select("edge_id", "u", "v", F.round(geo.length(F.col("path")), 6).alias("length"))


@query(f"WITH {_CURVES} SELECT user_id, count(*) AS points, round(any_value(total), 4) AS length FROM tp JOIN ttot USING (user_id) GROUP BY 1")
def polyline_clean(spark, sf_dir):
    """Every point is given twice; the repeats go."""
    line = F.flatten(F.transform("line", lambda p: F.array(p, p)))
    return fixtures.curves(spark, sf_dir).select("user_id", geo.clean(line).alias("p")).select("user_id", F.size("p").cast("long").alias("points"), F.round(geo.length(F.col("p")), 4).alias("length"))


@query(f"WITH {_NET} SELECT e AS edge_id, x1 AS x, y1 AS y FROM ne")
def polyline_orient(spark, sf_dir):
    """Lines of odd edges are given backwards; oriented from u to v all begin at u."""
    e = fixtures.net_edges(spark, sf_dir)
    given = F.when(F.col("edge_id") % 2 == 1, geo.reverse(F.col("polyline"))).otherwise(F.col("polyline"))
    return e.select("edge_id", geo.orient(given, F.element_at("polyline", 1), F.element_at("polyline", -1)).alias("p")).select("edge_id", F.col("p")[0]["x"].alias("x"), F.col("p")[0]["y"].alias("y"))


@query(f"WITH {_NET} SELECT v AS vertex_id, x, -y AS y FROM nv")
def flip(spark, sf_dir):
    return prepare.flipped(fixtures.net_vertices(spark, sf_dir)).select("vertex_id", "x", "y")


@query(f"WITH {_NET} SELECT row_number() OVER (ORDER BY v, u) - 1 AS edge_id, u, v FROM ne")
def edge_numbers(spark, sf_dir):
    return prepare.number_edges(fixtures.net_edges(spark, sf_dir), [F.col("v"), F.col("u")]).select("edge_id", "u", "v")


@query(f"""WITH {_NET} SELECT 'unknown end of edge ' || e AS problem FROM ne WHERE u % 7 = 0 OR v % 7 = 0 UNION ALL SELECT 'loop ' || (e + 100000) FROM ne WHERE e % 9 = 0 AND u % 7 <> 0
UNION ALL SELECT 'unknown end of edge ' || (e + 100000) FROM ne, range(2) WHERE e % 9 = 0 AND u % 7 = 0 UNION ALL SELECT 'loop ' || (e + 100000) FROM ne WHERE e % 9 = 0 AND u % 7 = 0""")
def graph_problems(spark, sf_dir):
    """Every seventh vertex is missing, every ninth edge comes again as a loop. An edge with two unknown ends is listed for each.

    The loops are in a graph of their own: in one with more than 100,000 edges their ids would be taken.
    """
    v, e = fixtures.net_vertices(spark, sf_dir).where("vertex_id % 7 <> 0"), fixtures.net_edges(spark, sf_dir)
    apart = F.lit("loops").alias("graph")
    loops = e.where("edge_id % 9 = 0").select(apart, (F.col("edge_id") + 100000).alias("edge_id"), "edge_pos", "u", F.col("u").alias("v"), "polyline")
    both = v.unionByName(v.withColumn("graph", apart))
    return prepare.problems(both, e.unionByName(loops)).select("problem")


@query(f"WITH {_cand_sql()}, o AS (SELECT s, t FROM cand UNION ALL SELECT s, t FROM cand WHERE t % 2 = 0) SELECT DISTINCT s AS source_vertex, t AS target_vertex FROM o")
def candidates_normalised(spark, sf_dir):
    pairs, vertices, edges = _problem(spark, sf_dir)
    found = cand.edge_radius_candidates(pairs, vertices, edges, RHO, K).select("pair_id", "source_vertex", "target_vertex")
    return cand.normalise_candidates(found.unionByName(found.where("target_vertex % 2 = 0")), pairs, vertices).select("source_vertex", "target_vertex")


@query(f"WITH {_cand_sql()}, n AS (SELECT s, count(*) AS n FROM cand GROUP BY 1), b AS (SELECT a.n * b.n AS states FROM n a JOIN n b ON b.s = a.s + 1) SELECT sum(states) > 100 AS limited, sum(states) > 1000000 AS limited_high FROM b")
def state_limit(spark, sf_dir):
    task = Matcher(*_problem(spark, sf_dir), rho=RHO, top_k=K)
    low, high = (task._within(task.candidates, n)[1].count() == 1 for n in (100, 1000000))
    return spark.createDataFrame([(low, high)], "limited boolean, limited_high boolean")


@query(f"""WITH {_PATHS}, one AS (SELECT s, t FROM cand WHERE r = 2), v AS (SELECT a.s AS e, d FROM one a JOIN one b ON b.s = a.s + 1 LEFT JOIN ds ON tu = a.t AND tv = b.t AND a.t <> b.t)
SELECT CASE WHEN count_if(d IS NULL) = 0 THEN round(sum(abs(d / 20.0 - 1)), 6) END AS additive, CASE WHEN count_if(d IS NULL) = 0 THEN round(max(abs(d / 20.0 - 1)), 6) END AS bottleneck,
  CASE WHEN count_if(d IS NULL) = 0 THEN round(sum(20 * abs(d / 20.0 - 1)), 6) END AS length_weighted, CAST(count_if(d IS NULL) AS INTEGER) AS invalid FROM v""")
def evaluate_mapping(spark, sf_dir):
    task = Matcher(*_problem(spark, sf_dir), rho=RHO, top_k=K)
    mapping = task.ranked.where("rank = 2").select("pair_id", "source_vertex", "target_vertex")
    found = task.evaluate_mapping(mapping, m.create_cost("relative_length_error"))
    return found.select(*[F.round(c, 6).alias(c) for c in ("additive", "bottleneck", "length_weighted")], F.size("invalid_edge_ids").alias("invalid"))


@query(f"""WITH {_RING}, b AS (SELECT * FROM al ORDER BY total, t0, t1, t2, t3, t4 LIMIT 1), m AS (SELECT unnest([0, 1, 2, 3, 4]) AS e, unnest([t0, t1, t2, t0, t2]) AS tu, unnest([t1, t2, t3, t3, t4]) AS tv FROM b)
SELECT e AS edge_id, tu AS target_u, tv AS target_v, round(f, 6) AS value, round(d, 6) AS length FROM m JOIN fc USING (e, tu, tv) JOIN d{_HOPS} ON d{_HOPS}.f = tu AND d{_HOPS}.t = tv""".replace("round(f, 6)", "round(fc.f, 6)"))
def solution_edges(spark, sf_dir):
    """Edges of the optimum with their values and the lengths of their witnesses."""
    found = _ring_task(spark, sf_dir).match(m.create_cost("relative_length_error")).edges
    return found.select("edge_id", "target_u", "target_v", F.round("value", 6).alias("value"), F.round(geo.length(F.col("witness")), 6).alias("length"))


@query(f"WITH {_RING} SELECT 'additive' AS objective, round(min(total), 6) AS value, true AS ok FROM al UNION ALL SELECT 'bottleneck', round(min(worst), 6), true FROM al")
def match_both(spark, sf_dir):
    """Two objectives in one traversal, recomputed from the edges of their solutions."""
    task = _ring_task(spark, sf_dir)
    return task.check(task.match_both(m.create_cost("relative_length_error"))).select("objective", F.round("realised", 6).alias("value"), "ok")


@query(f"""WITH {_RING}, b AS (SELECT * FROM al ORDER BY total LIMIT 1), m AS (SELECT unnest([0, 1, 2, 3, 4]) AS e, unnest([t0, t1, t2, t0, t2]) AS tu, unnest([t1, t2, t3, t3, t4]) AS tv FROM b), c AS (SELECT fc.f FROM m JOIN fc USING (e, tu, tv))
SELECT 'additive' AS objective, true AS feasible, round(sum(f), 6) AS value, CAST(5 AS BIGINT) AS mapped_vertices, count(*) AS edges, round(min(f), 6) AS least, round(quantile_cont(f, 0.5), 6) AS median, round(max(f), 6) AS most, CAST(count_if(f > 1e-12) AS BIGINT) AS positive_edges FROM c""")
def solution_rows(spark, sf_dir):
    found = _ring_task(spark, sf_dir).match(m.create_cost("relative_length_error"))
    rows = reports.solution_rows(found.values, found.mapping, found.edges)
    return rows.select("objective", "feasible", *[F.round(c, 6).alias(c) for c in ("value", "least", "median", "most")], "mapped_vertices", "edges", "positive_edges")


@query("""SELECT 'n' || n_nationkey AS graph, CASE n_nationkey % 8 WHEN 1 THEN 'Line 1: the vertex count must be an integer' WHEN 2 THEN 'Line 1: the vertex count must not be negative' WHEN 3 THEN 'a vertex id is repeated' WHEN 4 THEN 'an edge id is repeated'
  WHEN 5 THEN 'the file ends among its edges' WHEN 6 THEN 'Line 7: content after the last edge' WHEN 7 THEN 'Line 5: coordinates come in pairs' END AS error FROM nation""")
def graph_text_errors(spark, sf_dir):
    """A graph for each nation, most with one of seven faults."""
    kind = F.col("n_nationkey") % 8
    count = F.when(kind == 1, "two").when(kind == 2, "-2").otherwise("2")
    second = F.when(kind == 3, "1 5 5").otherwise("2 5 5")
    last = F.when(kind == 4, "10 2 1 0\n").when(kind == 5, "").when(kind == 6, "11 2 1 0\nmore\n").otherwise("11 2 1 0\n")
    first = F.when(kind == 7, "10 1 2 0 1 1 2").otherwise("10 1 2 0 1 1")
    text = F.concat(count, F.lit("\n1 0 0\n"), second, F.lit("\n2\n"), first, F.lit("\n"), last)
    files = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), "n_nationkey").alias("graph"), text.alias("text"))
    return graph_text.parse(files).select("graph", "error")


@query(f"""{_REACH}, ce AS (SELECT c, count(*) AS n FROM te JOIN co ON co.v = u GROUP BY 1), cv AS (SELECT c, count(*) AS n FROM co GROUP BY 1),
b AS (SELECT cv.c FROM cv LEFT JOIN ce USING (c) ORDER BY cv.n DESC, coalesce(ce.n, 0) DESC, c LIMIT 1)
SELECT row_number() OVER (ORDER BY te.e, te.u, te.v) - 1 AS edge_id, te.u, te.v, round(length, 6) AS length FROM te JOIN nl USING (e) JOIN co ON co.v = te.u JOIN b USING (c)""")
def embedded_graph(spark, sf_dir):
    """The largest raw component, uncompressed, its edges numbered anew."""
    v, e = _thin(spark, sf_dir)
    found = prepare.embedded_graphs(v, e.withColumnRenamed("polyline", "path"))[1]
    return found.select("edge_id", "u", "v", F.round(geo.length(F.col("polyline")), 6).alias("length"))


@query(f"WITH {_NET} SELECT s AS source_vertex, e AS edge_id, round(sqrt(min({_D2})), 6) AS distance, round(sqrt(power(greatest(min(least(sx, sx + vx)) - px, 0, px - max(greatest(sx, sx + vx))), 2) + power(greatest(min(least(sy, sy + vy)) - py, 0, py - max(greatest(sy, sy + vy))), 2)), 6) AS bound FROM sp, ns GROUP BY s, e, px, py")
def point_distances(spark, sf_dir):
    """Of five points from all lines of the network, with the lower bounds of the lines' boxes."""
    e = fixtures.net_edges(spark, sf_dir).select("edge_id", "polyline", *[f("polyline." + c).alias(n) for f, c, n in ((F.array_min, "x", "x0"), (F.array_min, "y", "y0"), (F.array_max, "x", "x1"), (F.array_max, "y", "y1"))])
    p = fixtures.path_vertices(spark, sf_dir).select(F.col("vertex_id").alias("source_vertex"), F.col("x").alias("px"), F.col("y").alias("py"))
    met = e.join(F.broadcast(p))  # five points
    at = (F.col("px"), F.col("py"))
    return met.select("source_vertex", "edge_id", F.round(geo.point_to_polyline(*at, F.col("polyline")), 6).alias("distance"), F.round(geo.box_lower_bound(*at, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), 6).alias("bound"))


@query(f"WITH {_NET} SELECT min(x) AS min_x, min(-y) AS min_y, max(x) AS max_x, max(-y) AS max_y FROM nv")
def flipped_bounds(spark, sf_dir):
    return prepare.flipped_bounds(fixtures.net_vertices(spark, sf_dir)).drop("graph")


@query(f"WITH {_CURVES} SELECT user_id, 2 * count(*) - 1 AS points, round(2 * any_value(total), 4) AS length FROM tp JOIN ttot USING (user_id) GROUP BY 1")
def polyline_concat(spark, sf_dir):
    """Each line and its way back, the seam once."""
    line = geo.concat(F.col("line"), geo.reverse(F.col("line")))
    return fixtures.curves(spark, sf_dir).select("user_id", line.alias("p")).select("user_id", F.size("p").cast("long").alias("points"), F.round(geo.length(F.col("p")), 4).alias("length"))


# --- reports ------------------------------------------------------------------------------------------------------------


def _items(spark, sf_dir) -> DataFrame:
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return l.select(F.col("l_suppkey").alias("run_id"), F.when(F.col("l_linestatus") == "O", "additive").otherwise("bottleneck").alias("objective"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_discount").alias("value"), F.col("l_linenumber").cast("long").alias("source_vertex"), (F.col("l_partkey") % 5).alias("target_vertex"))


_ITEMS = "it AS (SELECT l_suppkey AS run_id, CASE WHEN l_linestatus = 'O' THEN 'additive' ELSE 'bottleneck' END AS objective, l_orderkey * 10 + l_linenumber AS edge_id, l_discount AS value, CAST(l_linenumber AS BIGINT) AS source_vertex, l_partkey % 5 AS target_vertex FROM lineitem)"


@query(f"""WITH {_ITEMS} SELECT run_id, objective, count(*) AS edges, min(value) AS least, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.75), 6) AS q75,
  max(value) AS most, round(stddev_pop(value), 6) AS deviation, CAST(count_if(abs(value) <= 1e-12) AS BIGINT) AS zero_edges, round(count_if(abs(value) <= 1e-12) / count(*), 6) AS zero_fraction, CAST(count_if(abs(value) > 1e-12) AS BIGINT) AS positive_edges,
  round(quantile_cont(value, 0.5) FILTER (abs(value) > 1e-12), 6) AS positive_median FROM it GROUP BY 1, 2""")
def edge_cost_stats(spark, sf_dir):
    found = reports.edge_statistics(_items(spark, sf_dir), ["run_id", "objective"])
    return found.select(*[F.round(c, 6).alias(c) if c in ("q25", "median", "mean", "q75", "deviation", "zero_fraction", "positive_median") else F.col(c) for c in found.columns])


@query(f"""WITH {_ITEMS}, n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY run_id, objective) AS c, count_if(value > 1e-12) OVER (PARTITION BY run_id, objective) AS p FROM it WINDOW w AS (PARTITION BY run_id, objective ORDER BY value, edge_id))
SELECT run_id, objective, 'best' AS role, edge_id, value FROM n WHERE i = 1 UNION ALL SELECT run_id, objective, 'worst', edge_id, value FROM n WHERE i = c
UNION ALL SELECT run_id, objective, 'median', edge_id, value FROM n WHERE CASE WHEN p > 0 THEN i = c - p + (p - 1) // 2 + 1 ELSE i = (c - 1) // 2 + 1 END""")
def representative_edges(spark, sf_dir):
    return reports.representative_edges(_items(spark, sf_dir).select("run_id", "objective", "edge_id", "value"), ["run_id", "objective"])


@query("""SELECT k1, k2, min(o_orderkey) OVER (PARTITION BY k1, k2) AS seq, o_totalprice FROM (SELECT o_custkey AS k1, o_orderstatus AS k2, o_orderkey, o_totalprice FROM orders)
QUALIFY row_number() OVER (PARTITION BY k1, k2 ORDER BY o_orderkey DESC) = 1""")
def run_dedupe(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("k1"), F.col("o_orderstatus").alias("k2"), F.col("o_orderkey").alias("seq"), "o_totalprice")
    return reports.deduplicate(o, ["k1", "k2"])


def _mappings(spark, sf_dir) -> DataFrame:
    return _items(spark, sf_dir).groupBy("run_id", "objective", "source_vertex").agg(F.min("target_vertex").alias("target_vertex"))


@query(f"""WITH {_ITEMS}, mp AS (SELECT run_id, objective, source_vertex, min(target_vertex) AS t FROM it GROUP BY 1, 2, 3),
w AS (SELECT run_id, max(value) FILTER (objective = 'additive') AS a, max(value) FILTER (objective = 'bottleneck') AS b FROM it GROUP BY 1),
g AS (SELECT x.run_id, avg(CASE WHEN x.t = y.t THEN 1.0 ELSE 0.0 END) AS agreement FROM mp x JOIN mp y ON x.run_id = y.run_id AND x.source_vertex = y.source_vertex AND x.objective = 'additive' AND y.objective = 'bottleneck' GROUP BY 1)
SELECT run_id, a AS additive_worst, b AS bottleneck_worst, round(a - b, 6) AS reduction, CASE WHEN a > 1e-12 THEN round((a - b) / a, 6) END AS reduction_fraction, round(agreement, 6) AS agreement FROM w LEFT JOIN g USING (run_id) WHERE a IS NOT NULL AND b IS NOT NULL""")
def objective_tradeoff(spark, sf_dir):
    found = reports.objective_tradeoff(_items(spark, sf_dir), _mappings(spark, sf_dir))
    return found.select(*[F.round(c, 6).alias(c) if c in ("reduction", "reduction_fraction", "agreement") else F.col(c) for c in found.columns])


@query(f"WITH {_ITEMS} SELECT run_id, objective, count(*) AS edges, CAST(count_if(abs(value) <= 1e-12) AS BIGINT) AS zero_edges, round(count_if(abs(value) <= 1e-12) / count(*), 6) AS zero_fraction FROM it GROUP BY 1, 2")
def zero_cost(spark, sf_dir):
    return reports.zero_cost(_items(spark, sf_dir)).withColumn("zero_fraction", F.round("zero_fraction", 6))


@query(f"""WITH {_ITEMS}, mp AS (SELECT run_id % 7 AS pair_id, objective, 'c' || run_id AS cost, source_vertex, min(target_vertex) AS t FROM it GROUP BY ALL)
SELECT a.pair_id, a.objective, a.cost AS cost_a, b.cost AS cost_b, count(*) AS common, CAST(count_if(a.t = b.t) AS BIGINT) AS agreeing, round(count_if(a.t = b.t) / count(*), 6) AS agreement
FROM mp a JOIN mp b ON a.pair_id = b.pair_id AND a.objective = b.objective AND a.source_vertex = b.source_vertex AND a.cost < b.cost GROUP BY ALL""")
def cost_agreement(spark, sf_dir):
    mappings = _mappings(spark, sf_dir)
    runs = mappings.select("run_id").distinct().select("run_id", (F.col("run_id") % 7).alias("pair_id"), F.concat(F.lit("c"), "run_id").alias("cost"))
    return reports.cost_agreement(runs, mappings).withColumn("agreement", F.round("agreement", 6))


@query(f"""WITH {_ITEMS}, mp AS (SELECT run_id, objective, source_vertex, min(target_vertex) AS t FROM it GROUP BY 1, 2, 3)
SELECT run_id, objective, sha256(string_agg(source_vertex || ':' || t, ',' ORDER BY source_vertex)) AS mapping_hash FROM mp GROUP BY 1, 2""")
def mapping_hash(spark, sf_dir):
    return reports.mapping_hash(_mappings(spark, sf_dir), ["run_id", "objective"])


@query(f"""WITH {_NET}, n AS (SELECT count(*) AS n FROM nv), b AS (SELECT a.v AS s, a.x AS xa, a.y AS ya, o.x AS xb, o.y AS yb FROM nv a JOIN supplier ON s_suppkey = a.v, n JOIN nv o ON o.v = CASE WHEN a.v % 3 = 0 AND a.v + s_nationkey <= n THEN a.v + s_nationkey ELSE a.v END)
SELECT count(*) AS common, CAST(count_if(sqrt(power(xa - xb, 2) + power(ya - yb, 2)) > 1e-9) AS BIGINT) AS changed, round(count_if(sqrt(power(xa - xb, 2) + power(ya - yb, 2)) > 1e-9) / count(*), 6) AS changed_fraction,
  round(avg(sqrt(power(xa - xb, 2) + power(ya - yb, 2))), 6) AS mean, round(max(sqrt(power(xa - xb, 2) + power(ya - yb, 2))), 6) AS most FROM b""")
def displacement(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    n = s.count()
    base = s.select(F.lit("p").alias("pair_id"), F.col("s_suppkey").alias("source_vertex"), F.col("s_suppkey").alias("target_vertex"))
    to = F.when((F.col("s_suppkey") % 3 == 0) & (F.col("s_suppkey") + F.col("s_nationkey") <= n), F.col("s_suppkey") + F.col("s_nationkey")).otherwise(F.col("s_suppkey"))
    other = s.select(F.lit("p").alias("pair_id"), F.col("s_suppkey").alias("source_vertex"), to.alias("target_vertex"))
    at = fixtures.net_vertices(spark, sf_dir).select(F.col("vertex_id").alias("target_vertex"), "x", "y")
    found = reports.displacement(base, other, at, at)
    return found.drop("pair_id").select("common", "changed", *[F.round(c, 6).alias(c) for c in ("changed_fraction", "mean", "most")])


@query("""SELECT event_type, count(*) AS trials, min(value) AS least, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS most, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY 1""")
def timing_summary(spark, sf_dir):
    found = reports.timing_summary(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"], "value")
    return found.select(*[F.round(c, 6).alias(c) if c in ("q25", "median", "mean", "q75", "deviation") else F.col(c) for c in found.columns])




@query("SELECT o_custkey AS pair_id, o_orderpriority AS cost, o_orderkey AS rho FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) = 1")
def graph_pairs(spark, sf_dir):
    """The first run of each pair by cost and radius."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return reports.graph_pairs(o.select(F.col("o_custkey").alias("pair_id"), F.col("o_orderpriority").alias("cost"), F.col("o_orderkey").alias("rho")))


@query(f"""WITH {_ITEMS}, w AS (SELECT run_id, objective, value * 100 AS value FROM it), g AS (SELECT run_id, objective, min(value) AS lo, max(value) AS hi, least(greatest(floor(sqrt(count(*))), 5), 30) AS n FROM w GROUP BY 1, 2)
SELECT run_id, objective, CAST(CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * n), n - 1) ELSE 0 END AS BIGINT) AS bin, count(*) AS edges FROM w JOIN g USING (run_id, objective) GROUP BY ALL""")
def histogram(spark, sf_dir):
    return reports.histogram(_items(spark, sf_dir).withColumn("value", F.col("value") * 100), ["run_id", "objective"]).withColumn("bin", F.col("bin").cast("long"))


@query("SELECT 'p' || o_custkey % 9 AS pair_id, o_orderkey AS source_vertex, o_custkey AS was, o_custkey + o_orderkey % 3 AS becomes FROM orders WHERE o_orderkey % 3 <> 0")
def changed_vertices(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    base = o.select(F.concat(F.lit("p"), F.col("o_custkey") % 9).alias("pair_id"), F.col("o_orderkey").alias("source_vertex"), F.col("o_custkey").alias("target_vertex"))
    return reports.changed_vertices(base, base.withColumn("target_vertex", F.col("target_vertex") + F.col("source_vertex") % 3)).withColumnRenamed("to", "becomes")


@query(f"""WITH {_NET}, ae AS (SELECT v AS i, e FROM ne UNION ALL SELECT u, e FROM ne), p AS (SELECT i, x1 AS x, y1 AS y FROM ae JOIN ne USING (e) UNION ALL SELECT i, xm, ym FROM ae JOIN ne USING (e) UNION ALL SELECT i, x2, y2 FROM ae JOIN ne USING (e)
  UNION ALL SELECT i, x1 + 3 * e, y1 FROM ae JOIN ne USING (e) UNION ALL SELECT v, x, y FROM nv), b AS (SELECT i, min(x) AS x0, max(x) AS x1, min(-y) AS y0, max(-y) AS y1 FROM p WHERE i % 3 = 0 GROUP BY 1), h AS (SELECT *, greatest(40, x1 - x0 + 28, y1 - y0 + 28) / 2 AS h FROM b)
SELECT i AS source_vertex, round((x0 + x1) / 2 - h, 6) AS min_x, round((x0 + x1) / 2 + h, 6) AS max_x, round((y0 + y1) / 2 - h, 6) AS min_y, round((y0 + y1) / 2 + h, 6) AS max_y FROM h""")
def region_bounds(spark, sf_dir):
    """Squares around every third vertex; the witnesses are one point of each edge moved by three times its number."""
    v, e = fixtures.net_vertices(spark, sf_dir), fixtures.net_edges(spark, sf_dir)
    first = F.element_at("polyline", 1)
    moved = e.select("edge_id", F.array(geo.point(first["x"] + F.col("edge_id") * 3, first["y"])).alias("witness"))
    found = reports.region_bounds(v.where("vertex_id % 3 = 0").select(F.col("vertex_id").alias("source_vertex"), "x", "y"), e, moved, 40.0)
    return found.select("source_vertex", *[F.round(c, 6).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])


@query(f"WITH {_ITEMS} SELECT run_id || objective AS name, source_vertex, min(target_vertex) AS target_vertex FROM it GROUP BY 1, 2")
def saved_mappings(spark, sf_dir):
    """Mappings written as JSON documents, every other one as an object, and read again."""
    both = _mappings(spark, sf_dir).select(F.concat("run_id", "objective").alias("name"), "run_id", F.struct("source_vertex", "target_vertex").alias("p")).groupBy("name", "run_id").agg(F.collect_list("p").alias("mapping"))
    as_object = F.to_json(F.struct(F.map_from_entries(F.transform("mapping", lambda p: F.struct(p["source_vertex"].cast("string").alias("key"), p["target_vertex"].alias("value")))).alias("mapping")))
    texts = both.select("name", F.when(F.col("run_id") % 2 == 0, as_object).otherwise(F.to_json(F.struct("mapping"))).alias("json"))
    return results.read_mappings(texts)


@query("SELECT 'd' || n_nationkey AS name, n_nationkey AS edge_id, n_regionkey AS cost, 2 AS points FROM nation UNION ALL SELECT 'd' || n_nationkey, n_nationkey + 1000, n_regionkey, 3 FROM nation WHERE n_nationkey % 2 = 0")
def saved_edges(spark, sf_dir):
    """Two edges a document, the second with an unusable witness in every other one."""
    n = F.col("n_nationkey").cast("string")
    one = F.concat(F.lit('{"edge_id":'), n, F.lit(',"source_u":0,"source_v":1,"target_u":2,"target_v":3,"cost":'), F.col("n_regionkey").cast("string"), F.lit(',"witness":[[0,0],[1,1]]}'))
    other = F.concat(F.lit('{"edge_id":'), (F.col("n_nationkey") + 1000).cast("string"), F.lit(',"cost":'), F.col("n_regionkey").cast("string"), F.lit(',"witness":'), F.when(F.col("n_nationkey") % 2 == 0, "[[0,0],[1,1],[2,0]]").otherwise("[[0,0]]"), F.lit("}"))
    texts = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("d"), n).alias("name"), F.concat(F.lit('{"edges":['), one, F.lit(',7,'), other, F.lit("]}")).alias("json"))
    return results.read_saved_edges(texts).select("name", "edge_id", F.col("cost").cast("long").alias("cost"), F.size("witness").alias("points"))


@query("SELECT 'd' || n_nationkey AS name, unnest(['source', 'target']) AS role, unnest(['g' || n_nationkey, 'g' || n_regionkey]) AS graph FROM nation")
def resolved_graphs(spark, sf_dir):
    """Documents that know their source by path and their target by name and counts."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    known = n.select(F.concat(F.lit("g"), "n_nationkey").alias("graph"), F.concat(F.lit("/in/g"), "n_nationkey", F.lit(".txt")).alias("path"), F.col("n_nationkey").cast("long").alias("vertices"), F.lit(1).cast("long").alias("edges"))
    source = F.struct(F.concat(F.lit("/in/g"), "n_nationkey", F.lit(".txt")).alias("path"))
    target = F.struct(F.concat(F.lit("g"), "n_regionkey").alias("name"), F.col("n_regionkey").alias("vertices"), F.lit(1).alias("edges"))
    return results.resolve_graphs(n.select(F.concat(F.lit("d"), "n_nationkey").alias("name"), F.to_json(F.struct(source.alias("source"), target.alias("target"))).alias("json")), known)
