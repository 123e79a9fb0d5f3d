"""Results out and in: JSON documents, CSV tables, saved mappings, suite summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PAIR = T.StructType([T.StructField("source_vertex", T.LongType()), T.StructField("target_vertex", T.LongType())])
_EDGE = "struct<edge_id: bigint, source_u: bigint, source_v: bigint, target_u: bigint, target_v: bigint, cost: double, witness: array<array<double>>>"
SUITE_VERSION = 2


def solution_json(values: DataFrame, mapping: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair_id, objective, json): one document for each solution, with mapping and edges in order of their ids."""
    keys = ["pair_id", "objective"]
    maps = mapping.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("source_vertex", "target_vertex"))).alias("mapping"))
    one = F.struct("edge_id", F.col("u").alias("source_u"), F.col("v").alias("source_v"), "target_u", "target_v", F.col("value").alias("cost"), F.transform("witness", lambda p: F.array(p["x"], p["y"])).alias("witness"))
    lists = edges.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("edges"))
    met = values.join(maps, keys, "left").join(lists, keys, "left")
    full = F.to_json(F.struct("feasible", "objective", "value", F.coalesce("mapping", F.expr("cast(array() as array<struct<source_vertex: bigint, target_vertex: bigint>>)")).alias("mapping"), F.coalesce("edges", F.expr(f"cast(array() as array<{_EDGE}>)")).alias("edges")))
    return met.select(*keys, F.when(F.col("feasible"), full).otherwise(F.lit('{"feasible":false}')).alias("json"))


def read_mappings(texts: DataFrame, key: str = "name", json_col: str = "json") -> DataFrame:
    """(key, source_vertex, target_vertex) from JSON whose ``mapping`` is an object or a list of vertex pairs.

    An empty mapping, one that cannot be read, or one that maps a source vertex twice is an error.
    """
    raw = F.get_json_object(json_col, "$.mapping")
    listed = F.from_json(raw, T.ArrayType(_PAIR))
    object_ = F.from_json(raw, T.MapType(T.StringType(), T.LongType()))
    entries = F.transform(F.map_entries(object_), lambda e: F.struct(e["key"].cast("bigint").alias("source_vertex"), e["value"].alias("target_vertex")))
    found = F.when(F.startswith(F.ltrim(raw), F.lit("[")), listed).otherwise(entries)
    bad = found.isNull() | (F.size(found) == 0) | F.exists(found, lambda p: p["source_vertex"].isNull() | p["target_vertex"].isNull())
    twice = F.size(F.array_distinct(F.transform(found, lambda p: p["source_vertex"]))) < F.size(found)
    kind = "array<struct<source_vertex: bigint, target_vertex: bigint>>"
    checked = F.when(bad, F.raise_error(F.concat(key, F.lit(": no usable mapping"))).cast(kind)).when(twice, F.raise_error(F.concat(key, F.lit(": a source vertex is mapped twice"))).cast(kind)).otherwise(found)
    return texts.select(key, F.inline(checked))


def read_suite(spark: SparkSession, path: str | list[str], include: list[str] | None = None, exclude: list[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """Runs of suite summaries (schema version 2), with pairs chosen and renamed and report paths with slashes."""
    suites = spark.read.option("multiLine", True).json(path)
    checked = suites.where(F.when(F.col("schema_version") == SUITE_VERSION, F.lit(True)).otherwise(F.raise_error(F.lit("a suite summary of another version")).cast("boolean")))
    runs = checked.select(F.explode("runs").alias("r")).select("r.*")
    if include is not None:
        runs = runs.where(F.col("pair_id").isin(include))
    if exclude:
        runs = runs.where(~F.col("pair_id").isin(list(exclude)))
    if rename:
        names = F.create_map(*[F.lit(x) for item in rename.items() for x in item])
        runs = runs.withColumn("pair_id", F.coalesce(names[F.col("pair_id")], F.col("pair_id")))
    return runs.withColumn("report", F.translate("report", "\\", "/")) if "report" in runs.columns else runs


def flat(df: DataFrame) -> DataFrame:
    """For CSV: arrays, maps and structs as JSON text."""
    return df.select(*[F.to_json(c).alias(c) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(c) for c, f in ((f.name, f) for f in df.schema.fields)])


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def slug(name):
    """Lower-case letters and digits, all else as single underscores."""
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))


def read_saved_edges(texts: DataFrame, key: str = "name", json_col: str = "json") -> DataFrame:
    """(key, edge_id, source_u, source_v, target_u, target_v, cost, witness) from JSON with a list ``edges``.

    Each entry is read by itself: one without a witness of at least two points is left out, and so is a list that is none.
    """
    listed = F.from_json(F.get_json_object(json_col, "$.edges"), T.ArrayType(T.StringType()))
    one = texts.select(key, F.explode(listed).alias("_entry")).select(key, F.from_json("_entry", _EDGE).alias("_edge")).select(key, "_edge.*")
    drawn = (F.size("witness") >= 2) & F.forall("witness", lambda p: (F.size(p) == 2) & F.forall(p, lambda x: x.isNotNull()))
    return one.where(F.col("edge_id").isNotNull() & F.coalesce(drawn, F.lit(False)))


def resolve_graphs(texts: DataFrame, known: DataFrame, key: str = "name", json_col: str = "json") -> DataFrame:
    """(key, role, graph): which of the ``known`` graphs (graph, path, vertices, edges) a document's source and target are.

    The one of the document's path, else the only one of its name or file name whose counts are those given. None, or
    several of that kind, is an error.
    """
    def side(role: str):
        at = {c: F.get_json_object(json_col, f"$.{role}.{c}") for c in ("name", "path", "vertices", "edges")}
        return F.struct(F.lit(role).alias("role"), at["name"].alias("g"), at["path"].alias("p"), at["vertices"].cast("long").alias("nv"), at["edges"].cast("long").alias("ne"))

    def file(path):
        return F.substring_index(F.translate(path, "\\", "/"), "/", -1)

    asked = texts.select(key, F.inline(F.array(side("source"), side("target"))))
    have = known.select("graph", F.col("path").alias("kp"), F.col("vertices").alias("kv"), F.col("edges").alias("ke"))
    counted = (F.col("nv").isNull() | (F.col("nv") == F.col("kv"))) & (F.col("ne").isNull() | (F.col("ne") == F.col("ke")))
    by_path = asked.join(have, F.col("p") == F.col("kp")).select(key, "role", "graph", F.lit(True).alias("exact"))
    by_name = asked.join(have, F.col("g") == F.col("graph")).where(counted).select(key, "role", "graph", F.lit(False).alias("exact"))
    by_file = asked.join(have, file(F.col("p")) == file(F.col("kp"))).where(counted).select(key, "role", "graph", F.lit(False).alias("exact"))
    other = F.when(~F.col("exact"), F.col("graph"))
    best = by_path.unionByName(by_name).unionByName(by_file).groupBy(key, "role").agg(F.min(F.when(F.col("exact"), F.col("graph"))).alias("sure"), F.min(other).alias("least"), F.max(other).alias("most"))
    met = asked.select(key, "role").join(best, [key, "role"], "left")
    found = F.coalesce("sure", F.when(F.col("least") == F.col("most"), F.col("least")), F.raise_error(F.concat(key, F.lit(": its "), F.col("role"), F.lit(" graph is not known"))).cast("string"))
    return met.select(key, "role", found.alias("graph"))
