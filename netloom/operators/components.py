"""Connected components of edge tables.

Tasks first contract their own edges to stars in array passes (``_forest``), which takes most edges away. Few edges, by
count, are contracted in one task and are done. More edges go through alternating large-star and small-star rounds:
each is two joins of the edges with a minimum for each node, never a list of neighbours, so a hub with a third of all
edges costs one aggregated row and a join side that Spark may split. Rounds grow with the logarithm of the component
size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.plans.durable import durable

#: Edges that a task contracts at once; up to this many in all are contracted in one task.
AT_ONCE = 200_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _ranked(both: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each distinct node, the place of each node among the sorted distinct ones); numbers or structs of such and texts."""
    columns = []
    for field in both.flatten() if pa.types.is_struct(both.type) else [both]:
        values = field.to_numpy(zero_copy_only=False)
        columns.append(np.unique(values, return_inverse=True)[1] if values.dtype == object else values)
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for values in columns:
        new[1:] |= values[order][1:] != values[order][:-1]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars (node, smallest node) with the same components, for each run of at most AT_ONCE edges."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        both = pa.concat_arrays([table[c].combine_chunks() if table[c].num_chunks != 1 else table[c].chunk(0) for c in ("u", "v")])
        rows, place = _ranked(both)
        a, b = place[: table.num_rows], place[table.num_rows :]
        root = np.arange(len(rows))
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            # the roots of both ends move, so whole trees are joined
            np.minimum.at(root, before[a], low)
            np.minimum.at(root, before[b], low)
            root = root[root]
            if np.array_equal(root, before):
                break
        on = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([both.take(pa.array(rows[on])), both.take(pa.array(rows[root[on]]))], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        if n + batch.num_rows > AT_ONCE and held:
            yield stars(held)
            held, n = [], 0
        held.append(batch)
        n += batch.num_rows
    if n:
        yield stars(held)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    far = both.where("v > u").join(low, F.col("u") == F.col("c"))
    return far.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller end already."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    near = edges.join(low.select(F.col("u").alias("c"), "m"), F.col("u") == F.col("c"))
    moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 200, at_once: int = AT_ONCE) -> DataFrame:
    """(node, component) for every node with an edge to another node; ``component`` is its smallest node.

    Nodes are numbers, texts, or structs of them. Loops and nulls are no edges; repeated edges count once. Nodes without
    edges are not listed: a left join with ``coalesce(component, node)`` gives them their own. No edges: no rows.
    """
    a, b = F.col(u), F.col(v)
    state = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    schema = state.schema
    state = durable(state.mapInArrow(_forest, schema).distinct())
    n = state.count()
    if n <= at_once:
        state = durable(state.coalesce(1).mapInArrow(_forest, schema))
    else:
        seen = _state(state)
        for _ in range(max_rounds):
            state = durable(_small_star(_large_star(state)))
            now = _state(state)
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = state.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
