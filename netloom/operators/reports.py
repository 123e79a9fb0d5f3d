"""Reports over runs and solutions: aggregates, windows and joins; pairs of costs as products of matrices.

edges of solutions: (run_id, objective, edge_id, value); runs: (run_id, pair_id, cost, ...); mappings: (run_id,
objective, source_vertex, target_vertex).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.plans.durable import durable

#: Costs up to this count as zero.
ZERO = 1e-12
#: Costs and rows of mappings in a block, two of which meet in a task; columns of a matrix; costs whose rows leave a task together.
COSTS_AT_ONCE, ROWS_AT_ONCE, CODES_AT_ONCE, COSTS_A_BATCH = 1000, 1_000_000, 2048, 32


def spread(value: Column) -> list[Column]:
    """Least, quartiles, mean, most and population deviation."""
    p = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [F.min(value).alias("least"), p[0].alias("q25"), p[1].alias("median"), F.avg(value).alias("mean"), p[2].alias("q75"), F.max(value).alias("most"), F.stddev_pop(value).alias("deviation")]


def edge_statistics(edges: DataFrame, keys: list[str]) -> DataFrame:
    zero = F.abs("value") <= ZERO
    return edges.groupBy(*keys).agg(
        F.count("*").alias("edges"), *spread(F.col("value")), F.count_if(zero).alias("zero_edges"), (F.count_if(zero) / F.count("*")).alias("zero_fraction"),
        F.count_if(~zero).alias("positive_edges"), F.percentile(F.when(~zero, F.col("value")), F.lit(0.5)).alias("positive_median"),
    )


def solution_rows(values: DataFrame, mapping: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each (pair_id, objective): feasible, value, numbers of mapped vertices and edges, and their cost statistics.

    A pair without a solution has zero counts and null statistics.
    """
    keys = ["pair_id", "objective"]
    mapped = mapping.groupBy(*keys).agg(F.count("*").alias("mapped_vertices"))
    met = values.select(*keys, "feasible", "value").join(mapped, keys, "left").join(edge_statistics(edges, keys), keys, "left")
    return met.fillna(0, ["mapped_vertices", "edges", "zero_edges", "positive_edges"])


def representative_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """For each group its best, lower-median positive and worst edge by (value, edge_id): (keys, role, edge_id, value)."""
    order = Window.partitionBy(*keys).orderBy("value", "edge_id")
    every = Window.partitionBy(*keys)
    # without a positive edge the median is taken of all
    some = edges.withColumn("_positive", F.col("value") > ZERO).withColumn("_any", F.max(F.col("_positive")).over(every))
    pool = some.withColumn("_in", F.col("_positive") | ~F.col("_any"))
    in_pool = Window.partitionBy(*keys, "_in").orderBy("value", "edge_id")
    marked = pool.withColumn("_n", F.count("*").over(every)).withColumn("_i", F.row_number().over(order)).withColumn("_j", F.row_number().over(in_pool)).withColumn("_m", F.count("*").over(Window.partitionBy(*keys, "_in")))
    best = marked.where("_i = 1").select(*keys, F.lit("best").alias("role"), "edge_id", "value")
    median = marked.where(F.col("_in") & (F.col("_j") == F.floor((F.col("_m") - 1) / 2) + 1)).select(*keys, F.lit("median").alias("role"), "edge_id", "value")
    worst = marked.where("_i = _n").select(*keys, F.lit("worst").alias("role"), "edge_id", "value")
    return best.unionByName(median).unionByName(worst)


def deduplicate(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each key, at the place of the first: ``seq`` is replaced by that place."""
    w = Window.partitionBy(*keys)
    marked = rows.withColumn("_nth", F.row_number().over(w.orderBy(F.desc(seq)))).withColumn("_first", F.min(seq).over(w))
    return marked.where("_nth = 1").withColumn(seq, F.col("_first")).drop("_nth", "_first")


def graph_pairs(runs: DataFrame) -> DataFrame:
    """The first run of each pair by (cost, rho)."""
    w = Window.partitionBy("pair_id").orderBy("cost", "rho")
    return runs.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def objective_tradeoff(edges: DataFrame, mappings: DataFrame) -> DataFrame:
    """(run_id, additive_worst, bottleneck_worst, reduction, reduction_fraction, agreement).

    How much the worst edge gains under the bottleneck objective, and on which share of the common source vertices both
    mappings agree; the fraction is null where the additive worst edge is about zero.
    """
    def worst(objective: str, name: str) -> Column:
        return F.max(F.when(F.col("objective") == objective, F.col("value"))).alias(name)

    w = edges.groupBy("run_id").agg(worst("additive", "additive_worst"), worst("bottleneck", "bottleneck_worst")).where("additive_worst is not null and bottleneck_worst is not null")
    a = mappings.where("objective = 'additive'").select("run_id", "source_vertex", F.col("target_vertex").alias("ta"))
    b = mappings.where("objective = 'bottleneck'").select("run_id", "source_vertex", F.col("target_vertex").alias("tb"))
    same = a.join(b, ["run_id", "source_vertex"]).groupBy("run_id").agg(F.avg((F.col("ta") == F.col("tb")).cast("double")).alias("agreement"))
    gain = F.col("additive_worst") - F.col("bottleneck_worst")
    return w.join(same, "run_id", "left").select("run_id", "additive_worst", "bottleneck_worst", gain.alias("reduction"), F.when(F.col("additive_worst") > ZERO, gain / F.col("additive_worst")).alias("reduction_fraction"), "agreement")


def zero_cost(edges: DataFrame) -> DataFrame:
    zero = F.count_if(F.abs("value") <= ZERO)
    return edges.groupBy("run_id", "objective").agg(F.count("*").alias("edges"), zero.alias("zero_edges"), (zero / F.count("*")).alias("zero_fraction"))


def _products(row_a: np.ndarray, row_b: np.ndarray, code_a: np.ndarray, code_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Sums of n_a * n_b over equal codes for each pair of rows; codes are worked off in stretches, so wide mappings need no more memory."""
    out = np.zeros(shape)
    shared, both = np.unique(code_a), np.unique(code_b)
    shared = shared[np.isin(shared, both, assume_unique=True)]
    for k in range(0, len(shared), CODES_AT_ONCE):
        part = shared[k : k + CODES_AT_ONCE]
        sides = []
        for row, code, n, height in ((row_a, code_a, n_a, shape[0]), (row_b, code_b, n_b, shape[1])):
            held = np.isin(code, part)
            sides.append(np.bincount(row[held] * len(part) + np.searchsorted(part, code[held]), n[held], height * len(part)).reshape(height, len(part)))
        out += sides[0] @ sides[1].T
    return out


def cost_agreement(runs: DataFrame, mappings: DataFrame) -> DataFrame:
    """(pair_id, objective, cost_a, cost_b, common, agreeing, agreement) of all pairs of costs of a graph pair.

    Costs are dealt to blocks, and every two blocks of a graph pair meet in one task, which counts as products of
    matrices; so a mapping is copied once for each block and the pairs of costs are never shuffled. One mapping must fit
    in a task.
    """
    known = ["pair_id", "objective", "cost", "source_vertex"]
    met = runs.select("run_id", "pair_id", "cost").join(mappings, "run_id").dropna(subset=known)
    rows = durable(met.groupBy(*known, "target_vertex").agg(F.count("*").alias("n")))
    each = rows.groupBy("pair_id", "objective", "cost").agg(F.count("*").alias("k")).groupBy("pair_id", "objective")
    sizes = each.agg(F.greatest(F.ceil(F.count("*") / COSTS_AT_ONCE), F.ceil(F.sum("k") / ROWS_AT_ONCE)).alias("blocks"))
    groups = sizes.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 1
    dealt = rows.join(sizes, ["pair_id", "objective"]).withColumn("block", F.pmod(F.xxhash64("cost"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    by = ["pair_id", "objective", "low", "high"]
    dealt = dealt.select("pair_id", "objective", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cost", "source_vertex", "target_vertex", "n")
    fields = [T.StructField(name, rows.schema[c].dataType) for name, c in (("pair_id", "pair_id"), ("objective", "objective"), ("cost_a", "cost"), ("cost_b", "cost"))]
    schema = T.StructType([*fields, T.StructField("common", T.LongType()), T.StructField("agreeing", T.LongType()), T.StructField("agreement", T.DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        pair, objective, low, high = (t[c][0] for c in by)
        names = t["cost"].unique()
        names = names.take(pc.sort_indices(names))
        cost = pc.index_in(t["cost"], names).to_numpy()
        vertex = pc.index_in(t["source_vertex"], t["source_vertex"].unique()).to_numpy().astype(np.int64)
        places = t["target_vertex"].unique()
        place = pc.index_in(t["target_vertex"], places).to_numpy().astype(np.int64)
        n = t["n"].to_numpy().astype(float)
        # null is no place to agree on
        placed = t["target_vertex"].is_valid().to_numpy()
        first = np.ones(len(cost), bool) if low == high else (t["block"].to_numpy() == low.as_py())
        second = first if low == high else ~first
        a, b = np.unique(cost[first]), np.unique(cost[second])
        if not (len(a) and len(b)):
            return

        def counted(code: np.ndarray, used: np.ndarray) -> np.ndarray:
            f, s = first & used, second & used
            return _products(np.searchsorted(a, cost[f]), np.searchsorted(b, cost[s]), code[f], code[s], n[f], n[s], (len(a), len(b)))

        common, agreeing = counted(vertex, np.ones(len(cost), bool)), counted(vertex * len(places) + place, placed)
        for k in range(0, len(a), COSTS_A_BATCH):
            wanted = common[k : k + COSTS_A_BATCH] > 0
            if low == high:
                wanted &= a[k : k + COSTS_A_BATCH, None] < b[None, :]
            i, j = np.nonzero(wanted)
            if not len(i):
                continue
            i += k
            both, same = common[i, j], agreeing[i, j]
            left, right = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
            columns = [pa.repeat(pair, len(i)), pa.repeat(objective, len(i)), names.take(pa.array(left)), names.take(pa.array(right)), pa.array(both.astype(np.int64)), pa.array(same.astype(np.int64)), pa.array(same / both)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return dealt.repartition(int(min(max(groups, 8), 1000)), *by).groupBy(*by).applyInArrow(compare, schema)


def mapping_hash(mappings: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 of each mapping as text ``s:t`` by source vertex."""
    pairs = F.array_sort(F.collect_list(F.struct("source_vertex", "target_vertex")))
    text = F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["source_vertex"], p["target_vertex"])), ",")
    return mappings.groupBy(*keys).agg(F.sha2(text, 256).alias("mapping_hash"))


def timing_summary(trials: DataFrame, keys: list[str], value: str = "seconds") -> DataFrame:
    return trials.groupBy(*keys).agg(F.count("*").alias("trials"), *spread(F.col(value)))


def displacement(base: DataFrame, other: DataFrame, positions_base: DataFrame, positions_other: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(pair_id, common, changed, changed_fraction, mean, most): how far mapped places move from one mapping to another."""
    def placed(mapping: DataFrame, positions: DataFrame, tag: str) -> DataFrame:
        return mapping.join(positions, "target_vertex").select("pair_id", "source_vertex", F.col("x").alias(f"x{tag}"), F.col("y").alias(f"y{tag}"))

    both = placed(base, positions_base, "a").join(placed(other, positions_other, "b"), ["pair_id", "source_vertex"])
    d = F.hypot(F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb"))
    moved = both.withColumn("d", d)
    n = F.count_if(F.col("d") > tolerance)
    return moved.groupBy("pair_id").agg(F.count("*").alias("common"), n.alias("changed"), (n / F.count("*")).alias("changed_fraction"), F.avg("d").alias("mean"), F.max("d").alias("most"))


def changed_vertices(base: DataFrame, other: DataFrame) -> DataFrame:
    b = other.select("pair_id", "source_vertex", F.col("target_vertex").alias("to"))
    return base.select("pair_id", "source_vertex", F.col("target_vertex").alias("was")).join(b, ["pair_id", "source_vertex"]).where("was <> to")


def region_bounds(vertices: DataFrame, edges: DataFrame, matched: DataFrame, window: float = 155.0, margin: float = 28.0) -> DataFrame:
    """(source_vertex, min_x, max_x, min_y, max_y): for each of ``vertices`` (source_vertex, x, y) a square for display, y down.

    It holds the vertex, its ``edges`` (edge_id, u, v, polyline) and their witnesses in ``matched`` (edge_id, witness) of any
    number of solutions, with a margin, and is no smaller than ``window``.
    """
    ends = edges.select("edge_id", F.explode(F.array_distinct(F.array("u", "v"))).alias("source_vertex"), "polyline").join(vertices.select("source_vertex"), "source_vertex", "left_semi")
    drawn = ends.select("source_vertex", F.col("polyline").alias("line")).unionByName(ends.join(matched, "edge_id").select("source_vertex", F.col("witness").alias("line")))
    points = drawn.select("source_vertex", F.inline("line")).unionByName(vertices.select("source_vertex", "x", "y"))
    box = points.groupBy("source_vertex").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min(-F.col("y")).alias("y0"), F.max(-F.col("y")).alias("y1"))
    half = F.greatest(F.lit(float(window)), F.col("x1") - F.col("x0") + margin, F.col("y1") - F.col("y0") + margin) / 2
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return box.select("source_vertex", (x - half).alias("min_x"), (x + half).alias("max_x"), (y - half).alias("min_y"), (y + half).alias("max_y"))


def farthest_points(points: list[tuple[int, float, float]], n: int) -> list[int]:
    """Ids of a farthest-first traversal from the first point; a figure's few regions, so on the driver."""
    left = {i: (x, y) for i, x, y in points}
    if not left:
        return []
    chosen = [points[0][0]]
    while len(chosen) < min(n, len(left)):
        def near(i: int) -> float:
            return min((left[i][0] - left[c][0]) ** 2 + (left[i][1] - left[c][1]) ** 2 for c in chosen)

        chosen.append(max((i for i in left if i not in chosen), key=lambda i: (near(i), -i)))
    return chosen


def request_diagnostics(requests: DataFrame, costs: DataFrame, paths: DataFrame, shortest: float = 1e-12) -> DataFrame:
    """How many requests have equal targets, no witness, one without length, one with length but no finite cost, or a cost.

    ``paths`` is (pair_id, target_u, target_v, distance).
    """
    keys = ["pair_id", "target_u", "target_v"]
    met = requests.join(paths.select(*keys, "distance"), keys, "left").join(costs.select("pair_id", "edge_id", "target_u", "target_v", F.lit(True).alias("has_cost")), ["pair_id", "edge_id", "target_u", "target_v"], "left")
    kind = F.when(F.col("target_u") == F.col("target_v"), "same target").when(F.col("distance").isNull(), "no witness").when(F.col("distance") <= shortest, "zero length").when(F.col("has_cost").isNull(), "no finite cost").otherwise("cost")
    return met.groupBy("pair_id", kind.alias("category")).agg(F.count("*").alias("requests"))


def _digest(rows: DataFrame, keys: list[str], order: list[str], text, name: str) -> DataFrame:
    """SHA-256 of the texts of a group's rows in order, one a line; the lists are those of one graph pair."""
    listed = F.array_sort(F.collect_list(F.struct(*order, text.alias("text"))))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["text"]), "\n"), 256).alias(name))


def candidate_digest(candidates: DataFrame) -> DataFrame:
    """(pair_id, candidates): a digest of the candidate sets, ``s:t`` by source and target vertex."""
    return _digest(candidates, ["pair_id"], ["source_vertex", "target_vertex"], F.concat_ws(":", "source_vertex", "target_vertex"), "candidates")


def decomposition_digest(bags: DataFrame) -> DataFrame:
    """(graph, bags): a digest of the rooted bags in postorder: parent, vertices and owned edges."""
    text = F.concat_ws("|", F.coalesce(F.col("parent_bag_id").cast("string"), F.lit("-")), F.concat_ws(",", F.col("variables").cast("array<string>")), F.concat_ws(",", F.col("edge_ids").cast("array<string>")))
    return _digest(bags, ["graph"], ["bag_id"], text, "bags")


def solution_digest(values: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair_id, objective, value, edges): the exact value as a hexadecimal float, and a digest of the edges' values and witnesses.

    Equal digests of two runs mean equal bits.
    """
    hexed = "%a"
    points = F.concat_ws(",", F.transform("witness", lambda p: F.format_string("%a %a", p["x"], p["y"])))
    text = F.concat_ws("|", "edge_id", "target_u", "target_v", F.format_string(hexed, F.col("value")), points)
    found = _digest(edges, ["pair_id", "objective"], ["edge_id"], text, "edges")
    return values.where("feasible").select("pair_id", "objective", F.format_string(hexed, F.col("value")).alias("value")).join(found, ["pair_id", "objective"], "left")


def histogram(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of values in sqrt(n) equal bins, from 5 to 30."""
    every = Window.partitionBy(*keys)
    marked = edges.withColumn("_lo", F.min("value").over(every)).withColumn("_hi", F.max("value").over(every)).withColumn("_bins", F.least(F.greatest(F.floor(F.sqrt(F.count("*").over(every))), F.lit(5)), F.lit(30)))
    place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_bins")), F.col("_bins") - 1)).otherwise(F.lit(0))
    return marked.groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("edges"))
