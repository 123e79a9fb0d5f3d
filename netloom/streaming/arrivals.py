"""Graph files that arrive in a folder, taken in as a stream.

The parser is row-local, so a stream of whole files passes through it unchanged; each micro-batch is appended as Parquet
tables. Matching needs all rows of a graph together and is run on the tables afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netloom.operators.prepare import junction_graphs
from netloom.sources.graph_text import parse


def graph_stream(spark: SparkSession, folder: str) -> DataFrame:
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*?)(?:\.[^./]*)?$", 1)
    files = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.url_decode(name).alias("graph"), F.col("value").alias("text"))
    return parse(files)


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, keep_largest: bool = True) -> StreamingQuery:
    """Starts the query: ``out``/vertex, ``out``/edge and, for files with a problem, ``out``/rejected.

    Each batch has its own folder ``batch=N``, written over if the batch is run again, so a restart repeats nothing.
    """

    def take(batch: DataFrame, n: int) -> None:
        good = batch.where("error is null")
        vertices, edges = junction_graphs(good.select("graph", F.inline("vertices")), good.select("graph", F.inline("edges")), keep_largest)
        vertices.write.mode("overwrite").parquet(f"{out}/vertex/batch={n}")
        edges.write.mode("overwrite").parquet(f"{out}/edge/batch={n}")
        batch.where("error is not null").select("graph", "error").write.mode("overwrite").parquet(f"{out}/rejected/batch={n}")

    return graph_stream(spark, folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
