"""Language identification with hyperdimensional profiles.

Every code point has a random vector of ``DIM`` signs, made from a hash of the code point, so that any alphabet has
vectors without a table. A trigram binds its letters by position: the element-wise product of the letter vectors, the
first two of them rotated by two and by one place. A document bundles (sums) the vectors of its trigrams, a language
bundles the unit vectors of its training documents, and a document has the language with the largest cosine.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm import arrays
from netloom.llm.tables import col, cols, fresh

DIM = 1024
#: Rows of each language, on average, from which its prototype is learned; all if it has fewer.
FIT_ROWS = 20_000
#: Cells of a block's count matrix, 4 bytes each.
BLOCK_CELLS = 1_000_000
UNKNOWN = "und"
#: Letters from which a low cosine tells that a text is like no learned language; short texts have low ones in any language.
LEAST_LETTERS = 200
#: A prototype of each language is held by the driver and sent to all workers; more values are an error.
MOST_LANGUAGES = 4096

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def signs(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """A row of +1 and -1 for each code point, the same everywhere."""
    lanes = np.arange(dim // 64, dtype=np.uint64)
    h = arrays.mix(codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + arrays.mix(lanes + np.uint64(1)))
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(codes), -1), axis=1, bitorder="little")
    return bits.astype(np.float32) * 2 - 1


def trigram_vectors(a: np.ndarray, b: np.ndarray, c: np.ndarray, dim: int = DIM) -> np.ndarray:
    codes, which = np.unique(np.concatenate((a, b, c)), return_inverse=True)
    letter = signs(codes, dim)
    first, second = np.roll(letter, 2, axis=1), np.roll(letter, 1, axis=1)
    i, j, k = which.reshape(3, -1)
    out = first[i]
    for at in range(0, len(out), 1024):
        out[at : at + 1024] *= second[j[at : at + 1024]]
        out[at : at + 1024] *= letter[k[at : at + 1024]]
    return out


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case code points with one blank around each run of letters, the text of each, run together; letters in each text)."""
    text = "\n".join(texts).lower() if len(texts) > 1 else texts[0].lower()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.cumsum(codes == 10) if len(texts) > 1 else np.zeros(len(codes), np.int64)
    return codes, doc


def bundles(texts: list[str | None], dim: int = DIM) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, bundled vectors of it and the next ones); a text without letters has the zero vector."""
    clean = [t.replace("\n", " ") if t else "" for t in texts]
    i = 0
    while i < len(clean):
        j, size = i, 0
        while j < len(clean) and (j == i or size + len(clean[j]) <= arrays.SLICE_BYTES // 2):
            size += len(clean[j]) + 1
            j += 1
        codes, doc = _trigrams(clean[i:j])
        letter = _is_letter()[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[:-1] |= letter[1:]
        codes, doc, letter = np.where(letter, codes, np.uint32(32))[keep], doc[keep], letter[keep]
        # a trigram has a letter in its middle and lies in one text; the edges of a text are blanks
        mid = np.flatnonzero(letter)
        n = len(codes)
        left = np.where((mid > 0) & (doc[np.maximum(mid - 1, 0)] == doc[mid]), codes[np.maximum(mid - 1, 0)], 32).astype(np.int64)
        right = np.where((mid < n - 1) & (doc[np.minimum(mid + 1, n - 1)] == doc[mid]), codes[np.minimum(mid + 1, n - 1)], 32).astype(np.int64)
        key = left << 42 | codes[mid].astype(np.int64) << 21 | right
        grams, which = _distinct(key)
        vectors = trigram_vectors(grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF, dim)
        step = max(1, BLOCK_CELLS // max(1, len(grams)))
        at = doc[mid]
        for a in range(0, j - i, step):
            b = min(j - i, a + step)
            lo, hi = np.searchsorted(at, [a, b])
            counts = np.bincount((at[lo:hi] - a) * len(grams) + which[lo:hi], minlength=(b - a) * len(grams)).astype(np.float32)
            yield i + a, counts.reshape(b - a, len(grams)) @ vectors if len(grams) else np.zeros((b - a, dim), np.float32)
        i = j


def batches_of(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of a column in runs of about a megabyte, so that few Python strings exist at once."""
    for i, j, _, _ in arrays.slices(column, arrays.SLICE_BYTES // 2):
        yield i, column.slice(i, j - i).to_pylist()


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(key) else np.zeros(0, bool)
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], which


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", dim: int = DIM, fit_rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """A unit prototype for each language, from rows with a language and a text.

    A hash of the text chooses about ``fit_rows`` rows of each language, or all if there are fewer. Partial bundles are
    summed in the tasks, so that one vector for each language and task is shuffled.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if not known:
        return {}
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"the language column has more than {MOST_LANGUAGES} values")
    shares = F.create_map(*[x for lang, n in known.items() for x in (F.lit(lang), F.lit(min(1.0, fit_rows / n)))])
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < shares[F.col("lang")] * (1 << 20))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for start, first, vectors in ((i, k, v) for i, texts in batches_of(batch.column(1)) for k, v in bundles(texts, dim)):
                vectors = unit(vectors)
                mine = langs[start + first : start + first + len(vectors)]
                for lang in set(mine):
                    total[lang] = total.get(lang, 0) + vectors[mine == lang].sum(axis=0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([np.rint(v * 2**20).astype(np.int64) for v in total.values()], pa.list_(pa.int64()))], ["lang", "v"])

    # integers: the sum does not depend on the order of tasks
    parts = chosen.mapInArrow(partial, "lang string, v array<bigint>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return {r["lang"]: unit(np.array([c["x"] for c in r["v"]], np.float64)).astype(np.float32) for r in sorted(summed.collect(), key=lambda r: r["lang"])}


_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cosine", T.DoubleType())])


def predictor(spark, prototypes: dict[str, np.ndarray], dim: int = DIM):
    """A function from a text column to a column (lang_pred, score, cosine).

    ``cosine`` is that of the best language; ``score`` is the best one's share after a softmax over the cosines.
    A null text or one without a letter is ``und`` with score and cosine 0, as is every text if nothing was learned.
    Ties go to the language first in code-point order.
    """
    names = sorted(prototypes)
    sent = spark.sparkContext.broadcast((names, np.stack([prototypes[x] for x in names], axis=1) if names else np.zeros((dim, 0), np.float32)))

    @F.arrow_udf(_RESULT)
    def predicted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, matrix = sent.value
        for column in texts:
            langs, scores, cosines = [], [], []
            for vectors in (v for _, texts in batches_of(column) for _, v in bundles(texts, dim)):
                some = vectors.any(axis=1) & bool(names)
                if not names:
                    langs += [UNKNOWN] * len(vectors)
                    scores += [0.0] * len(vectors)
                    cosines += [0.0] * len(vectors)
                    continue
                cosine = (unit(vectors) @ matrix).astype(np.float64)
                best = cosine.argmax(axis=1)
                top = cosine[np.arange(len(best)), best]
                share = 1 / np.exp((cosine - top[:, None]) * 20).sum(axis=1)
                langs += [names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                scores += np.where(some, share, 0.0).tolist()
                cosines += np.where(some, top, 0.0).tolist()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(cosines, pa.float64())], _RESULT.names)

    return predicted


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5 is 0; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score, cosine) of every row, learned from the rows that are not held out.

    Repeated rows are judged each; an empty table gives an empty result. The language is never read for a prediction.
    """
    learned = fit(docs.where(~held_out(F.col(id_col))), lang_col, text_col)
    predict = predictor(docs.sparkSession, learned)
    judged = docs.select(col(id_col).alias("id"), held_out(col(id_col)).alias("held_out"), predict(col(text_col)).alias("p"))
    return judged.select(F.col("id").alias(id_col), "held_out", "p.lang_pred", "p.score", "p.cosine")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.08) -> DataFrame:
    """``docs`` without rows that are ``und`` or, from ``LEAST_LETTERS`` letters on, have a best cosine below ``least``: texts like no learned language.

    If nothing could be learned all rows stay.
    """
    learned = fit(docs.where(~held_out(F.col(id_col))), lang_col, text_col)
    if not learned:
        return docs
    (name,) = fresh(docs, "predicted")
    judged = docs.withColumn(name, predictor(docs.sparkSession, learned)(col(text_col)))
    short = F.length(F.regexp_replace(col(text_col), r"\P{L}+", "")) < LEAST_LETTERS
    return judged.where((F.col(name)["lang_pred"] != UNKNOWN) & ((F.col(name)["cosine"] >= least) | short)).select(*cols(docs.columns))
