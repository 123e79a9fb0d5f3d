"""Reader of graph text exports: a vertex count, vertices ``id x y``, an edge count, edges ``id u v delta x0 y0 ...``.

Each file is one row until its lines are taken apart, so a directory of many files is read in parallel. Blank lines are
skipped, but errors name the line as counted in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import geometry as geo

_VERTEX = "struct<vertex_id: bigint, x: double, y: double>"
_EDGE = f"struct<edge_id: bigint, u: bigint, v: bigint, delta: double, path: {geo.POLYLINE}>"


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(graph, text): the file's stem and its whole text."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*?)(?:\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(F.url_decode(name).alias("graph"), F.col("value").alias("text"))


def read_directory(spark: SparkSession, path: str, least: int = 2) -> DataFrame:
    """(graph, text) of a folder's ``.txt`` files; fewer than ``least``, or two of one name, is an error."""
    files = read_files(spark, f"{path.rstrip('/')}/*.txt")
    n = files.agg(F.count("*").alias("files"), F.countDistinct("graph").alias("names")).first()
    if n["files"] < least:
        raise ValueError(f"{path} has {n['files']} graph files, {least} are needed")
    if n["names"] < n["files"]:
        raise ValueError(f"{path} has graph files of one name")
    return files


def _message(line: Column, text: str) -> Column:
    return F.concat(F.lit("Line "), line["no"].cast("string"), F.lit(f": {text}"))


def parse(files: DataFrame) -> DataFrame:
    """(graph, vertices, edges, error): arrays of what was read; ``error`` is the first problem or null."""
    raw = F.split("text", "\n")
    numbered = F.filter(F.transform(raw, lambda x, i: F.struct((i + 1).alias("no"), F.split(F.trim(F.regexp_replace(x, r"\s+", " ")), " ").alias("f"))), lambda s: (F.size(s["f"]) > 1) | (F.element_at(s["f"], 1) != ""))
    df = files.select("graph", numbered.alias("lines"))
    total = F.size("lines")

    def count(line: Column) -> Column:
        return F.when(F.size(line["f"]) == 1, F.element_at(line["f"], 1).try_cast("bigint"))

    head = F.try_element_at("lines", F.lit(1))
    nv = count(head)
    df = df.withColumn("total", total).withColumn("nv", nv)
    df = df.withColumn("mid", F.try_element_at("lines", (F.coalesce(F.when(F.col("nv") >= 0, F.col("nv")), F.lit(0)) + 2).cast("int"))).withColumn("ne", count(F.col("mid")))
    n_v, n_e = F.coalesce(F.when(F.col("nv") >= 0, F.col("nv")), F.lit(0)).cast("int"), F.coalesce(F.when(F.col("ne") >= 0, F.col("ne")), F.lit(0)).cast("int")
    df = df.withColumn("vl", F.slice("lines", F.lit(2), n_v)).withColumn("el", F.slice("lines", n_v + 3, n_e))

    def field(line: Column, i: int, kind: str) -> Column:
        return F.try_element_at(line["f"], F.lit(i)).try_cast(kind)

    vertex_error = F.try_element_at(
        F.array_compact(F.transform("vl", lambda s: F.when(F.size(s["f"]) != 3, _message(s, "a vertex has just an id, x and y")).when(field(s, 1, "bigint").isNull() | field(s, 2, "double").isNull() | field(s, 3, "double").isNull(), _message(s, "invalid vertex")))), F.lit(1)
    )

    def edge_problem(s: Column) -> Column:
        rest = F.slice(s["f"], F.lit(5), F.greatest(F.size(s["f"]) - 4, F.lit(0)))
        bad = field(s, 1, "bigint").isNull() | field(s, 2, "bigint").isNull() | field(s, 3, "bigint").isNull() | field(s, 4, "double").isNull() | F.exists(rest, lambda x: x.try_cast("double").isNull())
        return F.when(F.size(s["f"]) < 4, _message(s, "an edge has at least an id, u, v and delta")).when(F.size(s["f"]) % 2 != 0, _message(s, "coordinates come in pairs")).when(bad, _message(s, "invalid edge"))

    edge_error = F.try_element_at(F.array_compact(F.transform("el", edge_problem)), F.lit(1))
    vertices = F.transform("vl", lambda s: F.struct(field(s, 1, "bigint").alias("vertex_id"), field(s, 2, "double").alias("x"), field(s, 3, "double").alias("y"))).cast(f"array<{_VERTEX}>")

    def path(s: Column) -> Column:
        n = F.floor((F.size(s["f"]) - 4) / 2).cast("int")
        pair = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(pair, lambda i: geo.point(F.try_element_at(s["f"], i * 2 + 5).try_cast("double"), F.try_element_at(s["f"], i * 2 + 6).try_cast("double")))

    edges = F.transform("el", lambda s: F.struct(field(s, 1, "bigint").alias("edge_id"), field(s, 2, "bigint").alias("u"), field(s, 3, "bigint").alias("v"), field(s, 4, "double").alias("delta"), path(s).alias("path"))).cast(f"array<{_EDGE}>")
    df = df.withColumn("vertices", vertices).withColumn("edges", edges)
    twice_v = F.size(F.array_distinct(F.transform("vertices", lambda v: v["vertex_id"]))) < F.size("vertices")
    twice_e = F.size(F.array_distinct(F.transform("edges", lambda e: e["edge_id"]))) < F.size("edges")
    need = n_v + n_e + 2
    error = (
        F.when(F.col("total") == 0, F.lit("the file is empty"))
        .when(F.col("nv").isNull(), _message(head, "the vertex count must be an integer"))
        .when(F.col("nv") < 0, _message(head, "the vertex count must not be negative"))
        .when(F.col("total") < n_v + 1, F.lit("the file ends among its vertices"))
        .when(vertex_error.isNotNull(), vertex_error)
        .when(twice_v, F.lit("a vertex id is repeated"))
        .when(F.col("total") < n_v + 2, F.lit("the file ends before its edge count"))
        .when(F.col("ne").isNull(), _message(F.col("mid"), "the edge count must be an integer"))
        .when(F.col("ne") < 0, _message(F.col("mid"), "the edge count must not be negative"))
        .when(F.col("total") < need, F.lit("the file ends among its edges"))
        .when(edge_error.isNotNull(), edge_error)
        .when(twice_e, F.lit("an edge id is repeated"))
        .when(F.col("total") > need, _message(F.try_element_at("lines", need + 1), "content after the last edge"))
    )
    return df.select("graph", "vertices", "edges", error.alias("error"))


def raw_graphs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw_vertex, raw_edge) of all files; a file with a problem is an error that names it."""
    read = parse(files)

    def checked(name: str, kind: str) -> Column:
        # each column is named once, so that the optimizer does not copy its long expression
        both = F.struct(F.col("graph").alias("g"), F.col(name).alias("found"), F.col("error").alias("e"))
        return geo.let(both, lambda r: F.when(r["e"].isNull(), r["found"]).otherwise(F.raise_error(F.concat(r["g"], F.lit(": "), r["e"])).cast(f"array<{kind}>")))

    return read.select("graph", F.inline(checked("vertices", _VERTEX))), read.select("graph", F.inline(checked("edges", _EDGE)))


def to_text(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph, text): the export of graphs, the inverse of ``parse``. A graph's text is one row."""
    v = vertices.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("vertex_id", F.concat_ws(" ", "vertex_id", "x", "y").alias("line")))).alias("vs"))
    line = F.concat_ws(" ", "edge_id", "u", "v", F.lit("0"), F.concat_ws(" ", F.transform("polyline", lambda p: F.concat_ws(" ", p["x"], p["y"]))))
    e = edges.groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("edge_id", line.alias("line")))).alias("es"))
    both = v.join(e, "graph", "left").withColumn("es", F.coalesce("es", F.expr("cast(array() as array<struct<edge_id: bigint, line: string>>)")))
    text = F.concat_ws("\n", F.concat(F.array(F.size("vs").cast("string")), F.col("vs.line"), F.array(F.size("es").cast("string")), F.col("es.line")))
    return both.select("graph", F.concat(text, F.lit("\n")).alias("text"))
