"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents confirmed toxic, the rest of the sample is unlabelled text. A linear model over word presence
minimises the non-negative risk of Kiryo et al. (2017), pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)), with the logistic
loss and the class prior pi taken from the confirmed labels. Fitting uses a bounded sample: ``FIT_POSITIVE`` and
``FIT_UNLABELLED`` distinct ids with one text each, and of a text at most ``FIT_WORDS`` distinct words, so the driver
holds at most 8 * FIT_WORDS * (FIT_POSITIVE + FIT_UNLABELLED) bytes. Every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm import arrays
from netloom.llm.tables import col

#: Most rows of each kind that the classifier is fitted on.
FIT_POSITIVE = 4_000
FIT_UNLABELLED = 8_000
#: Most distinct words of a text in the sample: those with the smallest hashes, so that texts keep the same words.
FIT_WORDS = 2_000
#: Words that the model weighs: those that tell most between the two samples.
FEATURES = 4_096
#: A word in fewer positive rows than this is no feature.
LEAST_ROWS = 3
THRESHOLD = 0.7


@dataclass
class Model:
    """Sorted word hashes, their weights, and the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float


def distinct_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct words of each text, for each text its first and behind the last the end)."""
    buf, starts, ends, first = arrays.words(arrays.LOWER[raw], at, arrays.ALNUM)
    h = arrays.hashes(buf, starts, ends)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(at)))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _select(rows: list[np.ndarray], positive: np.ndarray) -> np.ndarray:
    """The words with the largest signed root of the likelihood ratio between positive and unlabelled rows."""
    words = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    of = np.repeat(positive, [len(r) for r in rows])
    distinct, which = np.unique(words, return_inverse=True)
    p = np.bincount(which[of], minlength=len(distinct))
    u = np.bincount(which[~of], minlength=len(distinct))
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    # against what chance would give, so that words of many rare kinds don't count
    expected = (p + u) * n_p / (n_p + n_u)
    gain = (p - expected) / np.sqrt(expected + 1)
    good = np.flatnonzero((p >= LEAST_ROWS) & (gain > 3))
    good = good[np.lexsort((distinct[good], -gain[good]))][:FEATURES]
    return np.sort(distinct[good])


def fit_rows(rows: list[np.ndarray], positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, ridge: float = 0.015) -> Model:
    """Adam over the whole sample with the non-negative risk; where the negative part falls below 0 its gradient is undone.

    The weights' penalty is ``ridge`` for each positive row, so that words of few rows count as much in any sample.
    """
    words = _select(rows, positive)
    m = len(words)
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    if not n_p or not n_u or not m:
        return Model(words[:0], np.zeros(0), -30.0)
    all_words = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    slot = np.minimum(np.searchsorted(words, all_words), m - 1)
    on = words[slot] == all_words
    row, slot = row[on], slot[on]
    prior = min(max(prior, 1e-4), 0.9999)
    decay = ridge / n_p
    w, b = np.zeros(m), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[slot], minlength=len(rows)) + b
        s = _logistic(z)
        # logistic loss l(z) = log(1 + exp(-z)); its slope is s - 1, that of l(-z) is s
        negative = np.log1p(np.exp(np.clip(z, -30, 30)))
        rest = negative[~positive].mean() - prior * negative[positive].mean()
        slope = np.zeros(len(rows))
        if rest >= 0:
            slope[positive] = prior * (s[positive] - 1) / n_p - prior * s[positive] / n_p
            slope[~positive] = s[~positive] / n_u
        else:
            slope[positive] = prior * s[positive] / n_p
            slope[~positive] = -s[~positive] / n_u
        g = np.append(np.bincount(slot, slope[row], minlength=m) + decay * w, slope.sum())
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return Model(words, w, b)


def _features(ids_and_texts: DataFrame) -> DataFrame:
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, raw, at in arrays.slices(batch.column(1)):
                h, first = distinct_words(raw, at)
                # words are ordered by hash
                out += [h[a : min(b, a + FIT_WORDS)].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["positive", "words"])

    return ids_and_texts.mapInArrow(made, "positive boolean, words binary")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", usable: Column | None = None) -> Model:
    """A model from the documents with label toxic = 1 and a hash sample of the others; ``usable`` limits both to ids.

    A document with several labels is positive if one of them says so. Null labels say nothing. Of rows that repeat an
    id the one with the smallest text hash is taken. Without a positive label or a text nothing is learned.
    """
    usable = F.lit(True) if usable is None else usable
    known = labels.where(F.col("toxic").isNotNull() & col(id_col).isNotNull() & usable).groupBy(col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0))).first()
    if not n_toxic:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -30.0)
    rows = docs.where(col(id_col).isNotNull() & col(text_col).isNotNull() & usable).select(col(id_col).alias("id"), col(text_col).alias("text"))
    n_rows = docs.count()
    # 63 bits: the share is fine enough for any number of rows
    key = F.shiftrightunsigned(F.xxhash64("id"), 1)
    share = min(1.0, 1.2 * FIT_UNLABELLED / max(1, n_rows))

    def chosen(ids: DataFrame, most: int) -> DataFrame:
        return F.broadcast(ids.distinct().orderBy(F.xxhash64("id"), "id").limit(most))

    # at most FIT_POSITIVE and FIT_UNLABELLED ids
    positive = rows.join(chosen(known.where("toxic = 1").select("id"), FIT_POSITIVE), "id").withColumn("positive", F.lit(True))
    unlabelled = rows.join(chosen(rows.where(key <= F.lit(int(share * (2**63 - 1024)))).select("id"), FIT_UNLABELLED), "id").withColumn("positive", F.lit(False))
    one = positive.unionByName(unlabelled).groupBy("positive", "id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = _features(one.select("positive", "text")).collect()
    sample = sorted((bool(r["positive"]), bytes(r["words"])) for r in found)
    return fit_rows([np.frombuffer(x, np.uint64) for _, x in sample], np.array([p for p, _ in sample], bool), n_toxic / n)


def score_with(spark, model: Model):
    """A function from a text column to scores; null, empty and wordless texts have the model's score of no word."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for column in texts:
            out = [np.zeros(0)]
            for _, _, raw, at in arrays.slices(column):
                buf, starts, ends, first = arrays.words(arrays.LOWER[raw], at, arrays.ALNUM)
                z = np.full(len(at) - 1, model.bias)
                if len(model.words) and len(starts):
                    h = arrays.hashes(buf, starts, ends)
                    slot = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
                    on = np.flatnonzero(model.words[slot] == h)
                    doc = np.searchsorted(first, on, "right") - 1
                    pairs = np.unique(doc * len(model.words) + slot[on])
                    z += np.bincount(pairs // len(model.words), model.weights[pairs % len(model.words)], minlength=len(z))
                out.append(_logistic(z))
            yield pa.array(np.concatenate(out), pa.float64())

    return scored


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 3 is 1; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row, learned from rows that are not held out.

    Without a toxic label nothing is learned and all scores are near 0. Repeated rows are judged each.
    """
    model = learn(docs, labels, id_col, text_col, ~held_out(col(id_col)))
    scored = docs.select(col(id_col), held_out(col(id_col)).alias("held_out"), score_with(docs.sparkSession, model)(col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
