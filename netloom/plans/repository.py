"""Graphs from files, prepared once for each version of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.operators import prepare
from netloom.plans.durable import durable
from netloom.sources.graph_text import raw_graphs, read_files

VARIANTS = {"junction": prepare.junction_graphs, "original": prepare.embedded_graphs}


class Repository:
    """Prepared graphs by path and variant; a file of another size or time of change is prepared again, the old one forgotten.

    A path may be a file, a folder or a pattern: its version is that of all its files. The tables are checkpointed, so what
    is held here is small.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._held: dict[tuple[str, str], tuple[tuple, tuple[DataFrame, DataFrame]]] = {}

    def version(self, path: str) -> tuple:
        """Name, size and time of change of each file; contents are not read."""
        files = self.spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
        return tuple(sorted(tuple(r) for r in files.collect()))

    def load(self, path: str, variant: str = "junction") -> tuple[DataFrame, DataFrame]:
        """(vertices, edges)"""
        if variant not in VARIANTS:
            raise ValueError(f"unknown variant {variant!r}; there are {', '.join(VARIANTS)}")
        now = self.version(path)
        held = self._held.get((path, variant))
        if held is None or held[0] != now:
            vertices, edges = VARIANTS[variant](*raw_graphs(read_files(self.spark, path)))
            held = self._held[path, variant] = (now, (durable(vertices), durable(edges)))
        return held[1]

    def clear(self) -> None:
        self._held.clear()
