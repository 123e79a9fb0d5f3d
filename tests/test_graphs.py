"""Reader, filters, components, chains, decomposition."""

import random

import pytest
from pyspark.sql import functions as F

from netloom.functions import geometry as geo
from netloom.functions import kernels
from netloom.operators import prepare
from netloom.operators.components import AT_ONCE, connected_components
from netloom.plans.repository import Repository
from netloom.sources import graph_text, results

V = "graph string, vertex_id long, x double, y double"
E = f"graph string, edge_id long, u long, v long, delta double, path {geo.POLYLINE}"
GOOD = "2\n\n1 0 0\n  2 3 4  \n2\n10 1 2 0.5 0 0 1 1 3 4\n\n11 1 2 1.25 0 0 3 4\n"


def raw(spark, vertices, edges, graph="g"):
    at = dict((i, (float(x), float(y))) for i, x, y in vertices)
    v = spark.createDataFrame([(graph, i, float(x), float(y)) for i, x, y in vertices], V)
    e = spark.createDataFrame([(graph, i, a, b, 0.0, p if p is not None else [at[a], at[b]]) for i, a, b, p in edges], E)
    return v, e


def test_reader(spark, tmp_path):
    (tmp_path / "one.txt").write_text(GOOD)
    (tmp_path / "tüo two.txt").write_text("1\n5 nan -inf\n1\n7 5 5 inf\n")
    v, e = graph_text.raw_graphs(graph_text.read_files(spark, str(tmp_path)))
    got = {(r.graph, r.vertex_id): (r.x, r.y) for r in v.collect()}
    assert got["one", 2] == (3, 4) and {g for g, _ in got} == {"one", "tüo two"} and got["tüo two", 5][0] != got["tüo two", 5][0]
    lines = {r.edge_id: r for r in e.collect()}
    assert [tuple(p) for p in lines[10].path] == [(0, 0), (1, 1), (3, 4)] and lines[11].delta == 1.25 and lines[7].path == []


@pytest.mark.parametrize(("text", "message"), [
    ("", "empty"), ("x\n", "Line 1: the vertex count"), ("-1\n", "Line 1: the vertex count must not be negative"), ("2\n1 0 0\n", "ends among its vertices"), ("1\n1 0\n0\n", "Line 2: a vertex has"),
    ("1\n1 0 z\n0\n", "Line 2: invalid vertex"), ("1\n1 0 0\n", "before its edge count"), ("1\n1 0 0\nq\n", "Line 3: the edge count"), ("1\n1 0 0\n2\n1 1 1 0\n", "ends among its edges"),
    ("1\n\n1 0 0\n1\n1 1 1\n", "Line 5: an edge has"), ("1\n1 0 0\n1\n1 1 1 0 5\n", "Line 4: coordinates come in pairs"), ("1\n1 0 0\n1\n1 1 1 0 5 w\n", "Line 4: invalid edge"),
    ("2\n1 0 0\n1 1 1\n0\n", "vertex id is repeated"), ("1\n1 0 0\n2\n1 1 1 0\n1 1 1 0\n", "edge id is repeated"), ("1\n1 0 0\n0\nmore\n", "Line 4: content after"),
])
def test_reader_problems(spark, text, message):
    files = spark.createDataFrame([("f", text)], "graph string, text string")
    assert message in graph_text.parse(files).first().error
    with pytest.raises(Exception, match="f: "):
        graph_text.raw_graphs(files)[0].collect()


def test_text_round_trip(spark):
    v, e = raw(spark, [(1, 0.25, 1), (2, 3, 4), (3, 9, 9)], [(10, 1, 2, None), (11, 2, 1, [(3.0, 4.0), (1.0, 2.0), (0.25, 1.0)])])
    text = graph_text.to_text(v, e.withColumnRenamed("path", "polyline"))
    v2, e2 = graph_text.raw_graphs(text)
    assert sorted(map(tuple, v2.collect())) == sorted(map(tuple, v.collect()))
    assert sorted((r.edge_id, [tuple(p) for p in r.path]) for r in e2.collect()) == sorted((r.edge_id, [tuple(p) for p in r.path]) for r in e.collect())


def test_filter(spark):
    nan = float("nan")
    v, e = raw(spark, [(1, 0, 0), (2, 3, 4), (3, -1, -1), (4, nan, 0), (5, float("inf"), 0)], [])
    p = [(0.0, 0.0), (3.0, 4.0)]
    rows = [(10, 1, 2, [(0.0, 0.0), (0.0, 0.0), (3.0, 4.0)]), (11, 1, 1, p), (12, 1, 3, p), (13, 4, 2, p), (14, 1, 99, p), (15, 1, 2, [(0.0, 0.0)])]
    e = spark.createDataFrame([("g", i, a, b, nan, x) for i, a, b, x in rows], E)
    fv, fe = prepare.filter_graphs(v, e)
    assert {r.vertex_id for r in fv.collect()} == {1, 2} and [(r.edge_id, len(r.path)) for r in fe.collect()] == [(10, 2)]


def chains(spark, vertices, edges):
    v, e = raw(spark, vertices, edges)
    nodes, found = prepare.compress_chains(v, e)
    return {r.vertex_id for r in nodes.collect()}, sorted((r.u, r.v, tuple(r.raw_edge_ids), tuple(r.chain_vertices), [tuple(p) for p in r.polyline]) for r in found.collect())


def test_chain(spark):
    nodes, found = chains(spark, [(1, 0, 0), (2, 1, 0), (3, 2, 0)], [(10, 1, 2, None), (11, 3, 2, [(2.0, 0.0), (1.0, 0.0)])])
    assert nodes == {1, 3} and found == [(1, 3, (10, 11), (1, 2, 3), [(0, 0), (1, 0), (2, 0)])]


def test_star_and_ring(spark):
    nodes, found = chains(spark, [(1, 0, 0), (2, 1, 0), (3, 0, 1), (4, -1, -2)], [(10, 1, 2, None), (11, 1, 3, None), (12, 1, 4, None)])
    assert nodes == {1, 2, 3, 4} and len(found) == 3
    nodes, found = chains(spark, [(1, 0, 0), (2, 2, 0), (3, 1, 1)], [(10, 1, 2, None), (11, 2, 3, None), (12, 3, 1, None)])
    assert nodes == {1, 2} and [x[:4] for x in found] == [(1, 2, (10,), (1, 2)), (1, 2, (12, 11), (1, 3, 2))]


def test_junction_graphs(spark):
    # a loop at 1 goes, parallel chains stay, the small component goes
    vertices = [(1, 0, 0), (2, 4, 0), (3, 2, 2), (4, -1, 1), (5, -1, -1.5), (6, 4, 4), (7, 90, 90), (8, 91, 90)]
    edges = [(1, 1, 2, None), (2, 1, 3, None), (3, 3, 2, None), (4, 1, 4, None), (5, 4, 5, None), (6, 5, 1, None), (7, 2, 6, None), (8, 7, 8, None)]
    v, e = prepare.junction_graphs(*raw(spark, vertices, edges))
    assert sorted(r.vertex_id for r in v.collect()) == [1, 2, 6]
    assert sorted((r.edge_id, r.u, r.v, tuple(r.raw_edge_ids)) for r in e.collect()) == [(0, 1, 2, (1,)), (1, 1, 2, (2, 3)), (2, 2, 6, (7,))]
    v2, e2 = prepare.embedded_graphs(*raw(spark, vertices, edges))
    assert v2.count() == 6 and e2.count() == 7
    assert prepare.problems(v, e).count() == 0
    bad = e.withColumn("v", F.lit(99).cast("long")).unionByName(e)
    assert {r.problem.split(" ")[0] for r in prepare.problems(v, bad).collect()} == {"repeated", "unknown"}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(500 + k, 501 + k) for k in range(60)] + [(5, None), (7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(pairs, "u long, v long")
    for at_once in (AT_ONCE, 0):
        assert {r.node: r.component for r in connected_components(df, at_once=at_once).collect()} == {x: find(x) for x in root}
    named = df.select(F.struct(F.lit("g").alias("g"), F.col("u").alias("i")).alias("u"), F.struct(F.lit("g").alias("g"), F.col("v").alias("i")).alias("v")).where("v.i is not null")
    assert {r.node.i: r.component.i for r in connected_components(named).collect()} == {x: find(x) for x in root}


def test_local_contraction_in_runs(monkeypatch):
    import pyarrow as pa

    from netloom.operators import components

    monkeypatch.setattr(components, "AT_ONCE", 3)
    batches = [pa.RecordBatch.from_pydict({"u": [k + 1], "v": [k]}) for k in range(10)]
    out = [r for b in components._forest(iter(batches)) for r in b.to_pylist()]
    assert {(r["u"], r["v"]) for r in out} == {(k + 1, 3 * (k // 3)) for k in range(10)}


def test_no_components(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pairs_and_display(spark):
    v = spark.createDataFrame([("a", 1, 0.0, 1.0), ("b", 1, 0.0, 2.0), ("b", 2, 3.0, -5.0), ("c", 1, 0.0, 0.0)], V)
    assert sorted(r.pair_id for r in prepare.sparse_to_dense(v, v).collect()) == ["a_to_b", "c_to_b"]
    assert tuple(prepare.flipped_bounds(v).where("graph = 'b'").first()) == ("b", 0, -2, 3, 5)


def tree_of(n, edges):
    return kernels.Decomposition(list(range(n)), [(k, u, v) for k, (u, v) in enumerate(edges)])


@pytest.mark.parametrize(("n", "edges", "width", "bags"), [(4, [(0, 1), (1, 2), (2, 3)], 1, 3), (4, [(0, 1), (1, 2), (2, 3), (3, 0)], 2, 2), (1, [], 0, 1), (5, [(a, b) for a in range(5) for b in range(a)], 4, 1), (4, [(0, 1), (0, 1)], 1, 3)])
def test_decomposition(n, edges, width, bags):
    tree = tree_of(n, edges)
    assert tree.width == width and len(tree.bags) == bags and not tree.problems(list(range(n)), [(k, u, v) for k, (u, v) in enumerate(edges)])


def test_random_decompositions():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 14)
        edges = [(a, b) for a in range(n) for b in range(a) if rng.random() < 0.3]
        tree = tree_of(n, edges)
        assert tree.problems(list(range(n)), [(k, u, v) for k, (u, v) in enumerate(edges)]) == []


def test_corrupt_decompositions_are_found():
    edges = [(0, 0, 1), (1, 1, 2), (2, 2, 3)]
    def broken(change):
        tree = kernels.Decomposition([0, 1, 2, 3], edges)
        change(tree)
        return tree.problems([0, 1, 2, 3], edges)

    assert broken(lambda t: setattr(t, "width", 5)) and broken(lambda t: t.bags.__setitem__(0, (0,))) and broken(lambda t: t.owned[0].append(edges[1])) and broken(lambda t: t.parent.__setitem__(0, None))


def test_saved_mappings(spark):
    good = spark.createDataFrame([("a", '{"mapping": {"1": 10, "2": 20}}'), ("b", '{"mapping": [{"source_vertex": 3, "target_vertex": 30}]}')], "name string, json string")
    assert sorted(map(tuple, results.read_mappings(good).collect())) == [("a", 1, 10), ("a", 2, 20), ("b", 3, 30)]
    for bad in ('{"mapping": {}}', '{"mapping": [{"source_vertex": 3, "target_vertex": 30}, {"source_vertex": 3, "target_vertex": 31}]}', "{}", '{"mapping": 5}'):
        with pytest.raises(Exception, match="a: "):
            results.read_mappings(spark.createDataFrame([("a", bad)], "name string, json string")).collect()


def test_saved_edges_and_graphs(spark):
    docs = spark.createDataFrame([("a", '{"source": {"name": "s", "vertices": 3}, "target": {"path": "/x/t.txt"}, "edges": [{"edge_id": 1, "witness": [[0, 0], [1, 2]]}, {"edge_id": 2, "witness": [[0, 0]]}, "x", {"edge_id": 3}]}'), ("b", '{"edges": 5}')], "name string, json string")
    assert [(r.name, r.edge_id) for r in results.read_saved_edges(docs).collect()] == [("a", 1)]
    one = docs.where("name = 'a'")
    known = [("s", "/y/s.txt", 3, 2), ("t", "/x/t.txt", 9, 9), ("t2", "/z/t.txt", 9, 9)]
    have = "graph string, path string, vertices long, edges long"
    found = results.resolve_graphs(one, spark.createDataFrame(known, have)).collect()
    assert {(r.role, r.graph) for r in found} == {("source", "s"), ("target", "t")}
    for bad in ([k for k in known if k[0] != "s"], [("s", "/y/s.txt", 4, 2), *known[1:]], [known[0], ("t2", "/z/t.txt", 9, 9), ("t3", "/w/t.txt", 9, 9)]):
        with pytest.raises(Exception, match="graph is not known"):
            results.resolve_graphs(one, spark.createDataFrame(bad, have)).collect()


def test_repository(spark, tmp_path):
    (tmp_path / "one.txt").write_text(GOOD)
    with pytest.raises(ValueError, match="1 graph files"):
        graph_text.read_directory(spark, str(tmp_path))
    held = Repository(spark)
    first = held.load(str(tmp_path), "original")
    assert held.load(str(tmp_path), "original") is first and first[1].count() == 2
    (tmp_path / "two.txt").write_text(GOOD)
    assert graph_text.read_directory(spark, str(tmp_path)).count() == 2
    second = held.load(str(tmp_path), "original")
    assert second is not first and {r.graph for r in second[0].collect()} == {"one", "two"}
    assert held.load(str(tmp_path))[1].count() == 4
    with pytest.raises(ValueError, match="variant"):
        held.load(str(tmp_path), "other")
    held.clear()
    assert held.load(str(tmp_path), "original") is not second


def test_csv_and_suites(spark, tmp_path):
    df = spark.createDataFrame([("Ä b--C", [1, 2], {"k": 1})], "n string, l array<int>, m map<string, int>")
    results.write_csv(df, str(tmp_path / "csv"))
    assert results.read_csv(spark, str(tmp_path / "csv"), "n string, l string, m string").first().l == "[1,2]"
    assert df.select(results.slug(F.col("n"))).first()[0] == "b_c"
    (tmp_path / "s.json").write_text('{"schema_version": 2,\n"runs": [{"pair_id": "p", "report": "a\\\\b.json"}, {"pair_id": "q", "report": "c"}]}')
    runs = results.read_suite(spark, str(tmp_path / "s.json"), exclude=["q"], rename={"p": "r"}).collect()
    assert [(r.pair_id, r.report) for r in runs] == [("r", "a/b.json")]
    (tmp_path / "t.json").write_text('{"schema_version": 1, "runs": [{"pair_id": "p"}]}')
    with pytest.raises(Exception, match="version"):
        results.read_suite(spark, str(tmp_path / "t.json")).collect()


def test_arrivals(spark, tmp_path):
    from netloom.streaming.arrivals import ingest

    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "one.txt").write_text(GOOD)
    (inbox / "bad.txt").write_text("x")
    ingest(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (inbox / "two.txt").write_text(GOOD)
    ingest(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.graph for r in spark.read.parquet(str(tmp_path / "out/vertex")).collect()} == {"one", "two"}
    assert spark.read.parquet(str(tmp_path / "out/edge")).count() == 4
    assert [r.graph for r in spark.read.parquet(str(tmp_path / "out/rejected")).collect()] == ["bad"]
