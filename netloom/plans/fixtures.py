"""Networks derived from the driver's tables; small exact coordinates, so that any engine gives the same values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.functions import geometry as geo


def net_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier network: one row of its grid for ten suppliers."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    x = F.lit(10.0) * (F.col("s_suppkey") % 10) + (F.col("s_nationkey") % 5) - 2
    y = F.lit(10.0) * F.floor(F.col("s_suppkey") / 10) + (F.col("s_nationkey") % 3) - 1
    return s.select(F.lit("net").alias("graph"), F.col("s_suppkey").cast("long").alias("vertex_id"), x.cast("double").alias("x"), y.cast("double").alias("y"))


def net_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = net_vertices(spark, sf_dir)
    a = v.select(F.col("vertex_id").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = v.select(F.col("vertex_id").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"))
    right = a.where("u % 10 < 9").join(b, F.col("u") + 1 == F.col("v"))
    up = a.join(b, F.col("u") + 10 == F.col("v"))
    mid = geo.point((F.col("ax") + F.col("bx")) / 2 + F.col("u") % 3 - 1, (F.col("ay") + F.col("by")) / 2 + F.col("v") % 3 - 1)
    line = F.array(geo.point(F.col("ax"), F.col("ay")), mid, geo.point(F.col("bx"), F.col("by")))
    pos = F.row_number().over(Window.orderBy("u", "v")) - 1
    return right.unionByName(up).select(F.lit("net").alias("graph"), pos.cast("long").alias("edge_id"), pos.alias("edge_pos"), "u", "v", line.alias("polyline"))


def path_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    return r.select(F.lit("src").alias("graph"), F.col("r_regionkey").cast("long").alias("vertex_id"), (F.lit(20.0) * F.col("r_regionkey") + 5).alias("x"), F.lit(1.0).alias("y"))


def path_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = path_vertices(spark, sf_dir)
    a = v.select(F.col("vertex_id").alias("u"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = v.select(F.col("vertex_id").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"))
    e = a.join(b, F.col("u") + 1 == F.col("v"))
    return e.select(F.lit("src").alias("graph"), F.col("u").alias("edge_id"), F.col("u").cast("int").alias("edge_pos"), "u", "v", F.array(geo.point(F.col("ax"), F.col("ay")), geo.point(F.col("bx"), F.col("by"))).alias("polyline"))


def problem(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, vertices, edges) of the region path matched into the supplier network."""
    pairs = spark.createDataFrame([("src_to_net", "src", "net")], "pair_id string, source string, target string")
    return pairs, net_vertices(spark, sf_dir).unionByName(path_vertices(spark, sf_dir)), net_edges(spark, sf_dir).unionByName(path_edges(spark, sf_dir))


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, line): for each user the values of events in order, as a polyline over 0, 1, 2 ..."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = e.select("user_id", i.alias("i"), F.col("value").alias("y"))
    lists = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("i", "y"))).alias("p"))
    return lists.select("user_id", F.transform("p", lambda p: geo.point(p["i"], p["y"])).alias("line")).where(F.size("line") >= 2)
