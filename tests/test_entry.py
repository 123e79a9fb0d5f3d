"""The driver's entry points, the command line, and every catalogue query against its SQL."""

import glob
import json
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from netloom import cli

SMALL = "/root/testdata/sf0.001"
CORE = [n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"]


def rows(found):
    return Counter(tuple(None if x is None else round(float(x), 5) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["source_vertex", "rank", "target_vertex", "distance"]


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = rows(df.select(*cols).collect())
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        want = rows(duck.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall())
        assert sorted(duck.sql(sql).columns) == cols and got == want
    else:
        assert got


def test_graph_problems_of_more_edges_than_loop_ids(spark, tmp_path):
    """Loops are numbered from 100,000, here also the number of an edge."""
    keys = spark.range(53_000).selectExpr("id as s_suppkey", "cast(id % 25 as int) as s_nationkey")
    keys.write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = rows(con.sql(__spark_entry__.oracle_sql()["graph_problems"]).fetchall())
    assert rows(__spark_entry__.queries()["graph_problems"](spark, str(tmp_path)).collect()) == want


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


SOURCE = "3\n0 0 0\n1 1 0\n2 11 0\n2\n0 0 1 0 0 0 1 0\n1 1 2 0 1 0 11 0\n"
STAR = "5\n0 0 0\n1 1 0\n2 11 0\n3 0 2\n4 11 2\n4\n0 0 1 0 0 0 1 0\n1 1 2 0 1 0 11 0\n2 0 3 0 0 0 0 2\n3 2 4 0 11 0 11 2\n"


def test_command_line(spark, tmp_path):
    (tmp_path / "s.txt").write_text(SOURCE)
    (tmp_path / "t.txt").write_text(STAR)
    out = tmp_path / "out.json"
    assert cli.main([str(tmp_path / "s.txt"), str(tmp_path / "t.txt"), "--cost", "relative_length_error", "--objective", "all", "--rho", "3", "--output", str(out)]) == 0
    found = json.loads(out.read_text())
    assert found["source"]["vertices"] == 2 and set(found["solutions"]) == {"additive", "bottleneck", "length_weighted_additive"}
    assert found["solutions"]["additive"]["edges"][0]["witness"] and found["decomposition"]["width"] == 1
    (tmp_path / "far.txt").write_text(SOURCE.replace("0 0 0\n", "0 500 500\n").replace("2 11 0\n", "2 511 500\n"))
    assert cli.main([str(tmp_path / "far.txt"), str(tmp_path / "t.txt"), "--cost", "hausdorff_distance", "--cost-option", "densify=0.5", "--rho", "3", "--output", str(out)]) == 2


@pytest.mark.parametrize("args", [[], ["a", "b"], ["a", "b", "--cost", "nothing"], ["a", "b", "--cost", "hausdorff_distance", "--rho", "0"], ["a", "b", "--cost", "hausdorff_distance", "--top-k", "0"], ["a", "b", "--cost", "hausdorff_distance", "--cost-option", "x"], ["a", "b", "--cost", "hausdorff_distance", "--cost-option", "densify=9"]])
def test_wrong_arguments(args):
    with pytest.raises(SystemExit) as stop:
        cli.main(args)
    assert stop.value.code == 2


def test_options():
    assert cli.parse_options(["a=1", "b=x", "c=null", "d=[1]"]) == {"a": 1, "b": "x", "c": None, "d": [1]}
    with pytest.raises(ValueError, match="twice"):
        cli.parse_options(["a=1", "a=2"])
