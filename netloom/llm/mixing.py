"""Mixing sources to target weights with DataFrame operations only.

Every document gets a hash-random key. Within each source documents are ordered by that key, prefix sums of their sizes
are taken, and the source is cut at its exact budget; a budget above the source's size repeats whole epochs first.

The prefix sums are distributed. A source's key range is divided into cells of about ``CELL_ROWS`` rows, so a larger
source has more cells; cells are ordered ranges of keys, so rows are dealt out by (source, cell) and sorted inside a
cell, and a cell's offset is the sum of the cells before it. A source with a third of all rows is thus spread over as
many tasks as its rows need. Only ids, sizes and keys are shuffled, never texts. Rows equal in source, key, id, size and
text are counted before, so any number of them is one row of a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.tables import col, cols, fresh
from netloom.plans.durable import durable

#: Weights of the sources in code-point order, repeating; a null source comes last.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix holds, and the most epochs of a source.
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
CELL_ROWS = 2_000
#: Sources whose cuts, some 200 bytes each, are sent to every task; more of them are joined by a shuffle.
SENT_SOURCES = 100_000
#: Ranges over which the sources are numbered.
RANGES = 64


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column) -> Column:
    """32 hexadecimal digits, the same in every run, from the id, or from the text where the id is null."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.coalesce(text, F.lit("")))).cast("binary"))


def source_targets(sizes: DataFrame, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sizes`` (one row for each source, with source_size) with its number ``sid`` and ``target``: water-filling by weight.

    A source whose share would exceed ``max_epochs`` times its size gets just that, and the excess goes to the others by
    weight until none is above. Each round takes three sums to the driver; rounds end when no source is capped anew.
    """
    by_source = F.col("source").asc_nulls_last()
    ranged = durable(sizes.repartitionByRange(RANGES, by_source).withColumn("range", F.spark_partition_id()))
    # one row for each range
    counts = ranged.groupBy("range").agg(F.count("*").alias("m"))
    first = counts.select("range", F.coalesce(F.sum("m").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    nth = F.col("first") + F.row_number().over(Window.partitionBy("range").orderBy(by_source)) - 1
    numbered = ranged.join(F.broadcast(first), "range").withColumn("sid", nth.cast("long")).drop("range", "first")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    rows = durable(numbered.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))))
    first = rows.agg(F.sum("source_size"), F.sum("w")).first()
    budget, share, held, capped = (first[0] or 0) * total_share, first[1] or 1.0, 0.0, 0
    while True:
        due = F.lit(budget - held) * F.col("w") / F.lit(share)
        over = F.col("cap") < due
        n, held_now, share_now = rows.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        if n == capped or not share_now:
            return rows.withColumn("target", F.when(over, F.col("cap")).otherwise(due)).drop("w", "cap")
        capped, held, share = n, held_now, share_now


def _own(id_col: str, text_col: str) -> list[Column]:
    """What places a document within its source, as columns key, some, id, size, h."""
    text = col(text_col)
    return [random_key(col(id_col), text).alias("key"), col(id_col).isNotNull().alias("some"), col(id_col).alias("id"), word_count(text).alias("size"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h")]


PLACE = ("key", "some", "id", "size", "h")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(col(source_col).alias("source"), *_own(id_col, text_col))
    return rows.groupBy("source", *PLACE).agg(F.count("*").alias("times"))


def _placed(rows: DataFrame, cell_rows: int) -> DataFrame:
    """``rows`` with their source's size, target, whole epochs and rest, and the words of the source before each row.

    Sources are joined by number from here on: the join with the cells and the window share one shuffle.
    """
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count("*").alias("n"))
    goals = source_targets(sources).withColumn("n_cells", F.ceil(F.col("n") / cell_rows)).withColumn("goal", F.round("target").cast("long"))
    goals = goals.withColumn("epochs", F.expr("if(source_size > 0, goal div source_size, 0L)"))
    goals = durable(goals.withColumn("rest", F.col("goal") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "s"))
    # the cells of a source divide the keys' first 32 bits evenly
    head = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    mapped = rows.join(goals.select("s", "sid", "n_cells"), F.col("source").eqNullSafe(F.col("s"))).withColumn("cell", F.shiftright(head * F.col("n_cells"), 32)).drop("s", "n_cells")
    sums = mapped.groupBy("sid", "cell").agg(F.sum(F.col("size") * F.col("times")).alias("cell_size"))
    before = F.coalesce(F.sum("cell_size").over(Window.partitionBy("sid").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = sums.select("sid", "cell", before.alias("before")).join(goals.select("sid", "source_size", "target", "epochs", "rest"), "sid")
    order = Window.partitionBy("sid", "cell").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, -1)
    return mapped.join(cells, ["sid", "cell"]).withColumn("before", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("times")).over(order), F.lit(0)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, size, source_size, target, taken) of every row: how many words the mix takes of it, repeats counted.

    The words taken of a source sum to its rounded target exactly: the document at the cut gives a part of its words.
    A null text has no words; null sources are one source; rows with equal ids are ordered by size, and equal rows may
    swap places, which no result shows. An empty table gives no rows.
    """
    rows = durable(_keyed(docs, id_col, text_col, source_col))
    each = _placed(rows, cell_rows).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("nth") * F.col("size")))
    return each.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def draw(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cell_rows: int = CELL_ROWS) -> DataFrame:
    """The mix itself: ``docs`` repeated by epoch, with the column ``epoch`` from 1 (a column of this name is replaced); whole documents only.

    In its last epoch a source gives the documents ordered before its cut, so its words miss the target by less than
    one document, equal rows counted one by one: of those at the cut the last epoch holds copies of the first by a hash
    of its columns. Where whole epochs meet the target nothing more is drawn, so a source without words gives none. Texts are not shuffled: each source's cut is one row, which is joined to the documents. No rows give
    no rows.
    """
    rows = durable(_keyed(docs, id_col, text_col, source_col))
    place = F.struct(*PLACE)
    total = F.col("size") * F.col("times")
    cut = F.struct(place.alias("place"), F.expr("if(size > 0, (rest - before) div size, 0L)").alias("extra"))
    # the first document that does not fit the rest any more; null where all do
    cuts = _placed(rows, cell_rows).groupBy("source").agg(F.first("epochs").alias("epochs"), F.first("rest").alias("rest"), F.min(F.when(F.col("before") + total > F.col("rest"), cut)).alias("cut"))
    s, epochs, rest, at, extra, copies, own = fresh(docs, "source_", "epochs", "rest", "cut", "extra", "copies", "own")
    cuts = durable(cuts.select(F.col("source").alias(s), F.col("epochs").alias(epochs), F.col("rest").alias(rest), F.col("cut.place").alias(at), F.col("cut.extra").alias(extra)))
    few = cuts.limit(SENT_SOURCES + 1).count() <= SENT_SOURCES
    joined = docs.withColumn(own, F.struct(*_own(id_col, text_col))).join(F.broadcast(cuts) if few else cuts, col(source_col).eqNullSafe(F.col(s)))
    kept = [c for c in docs.columns if c.lower() != "epoch"]
    whole = joined.withColumn(copies, F.col(epochs) + F.when((F.col(rest) > 0) & (F.col(at).isNull() | (F.col(own) < F.col(at))), 1).otherwise(0)).where(F.col(copies) > 0)
    whole = whole.select(*cols(kept), F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias("epoch"))
    plain = [c for c, kind in docs.dtypes if c in kept and "map<" not in kind and "variant" not in kind]
    edge = joined.where((F.col(own) == F.col(at)) & (F.col(extra) > 0)).groupBy(s, epochs, extra).agg(F.min_by(F.struct(*cols(kept)), F.xxhash64(*cols(plain))).alias("row"))
    edge = edge.select("row.*", F.explode(F.array_repeat((F.col(epochs) + 1).cast("int"), F.col(extra).cast("int"))).alias("epoch"))
    return whole.unionByName(edge)


#: The query's rows in DuckDB: the same order of keys, with one running sum for each source.
SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null:' || coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS wt FROM s),
b AS (SELECT sum(source_size)::DOUBLE * 1.5::DOUBLE AS budget FROM s),
o AS (SELECT w.*, budget, coalesce(sum(cap) OVER lower_ones, 0) AS held, sum(wt) OVER upper_ones AS share FROM w, b
  WINDOW lower_ones AS (ORDER BY cap / wt, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), upper_ones AS (ORDER BY cap / wt, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT coalesce(sum(cap) FILTER (cap < (budget - held) * wt / share), 0) AS held, sum(wt) FILTER (NOT cap < (budget - held) * wt / share) AS share FROM o),
t AS (SELECT w.source, source_size, CASE WHEN f.share IS NULL OR cap < (budget - f.held) * wt / f.share THEN cap ELSE (budget - f.held) * wt / f.share END AS target FROM w, b, f),
g AS (SELECT *, CAST(round(target) AS BIGINT) AS goal, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs * size + greatest(0, least(size, goal - epochs * source_size - before)) AS BIGINT) AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
"""
