"""Quality rules: repetition and length limits, then divergence from language references.

A language's reference is a histogram of character classes and one of its most common words, over all documents
that are known to be of the language. A document's histograms are compared with those of each language by the
Jensen-Shannon distance (base 2, from 0 to 1); the nearest language counts. Documents with too little text for a
histogram pass this test.

Common words are only a part of a language's words, so even a text without any has a distance far below 1. The limit of
the word distance is therefore a share of that distance, which is larger for shorter texts, whose histograms are noisier.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm import arrays
from netloom.llm.tables import col
from netloom.plans.durable import durable

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
#: Words of a language's histogram.
COMMON_WORDS = 50
#: Guards: fewer characters or words than these are not compared.
GUARD_CHARS = 200
GUARD_WORDS = 40
#: Largest class distance of kept documents.
MAX_CLASS_DISTANCE = 0.25
#: Largest word distance of kept documents, as a share of the distance of a text without common words: WORD_SHARE, and
#: WORD_NOISE over the root of the number of common words that a text of the language has at this length.
WORD_SHARE = 0.7
WORD_NOISE = 1.2
#: Entries after which a task hands on its partial word counts.
FLUSH = 2_000_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Character classes: 0 lower, 1 upper, 2 digit, 3 white space, 4 sentence marks, 5 other marks, 6 control, 7 to 16 beyond
#: ASCII by the first UTF-8 byte: further Latin, Greek, Cyrillic, Hebrew to N'Ko, South and South East Asian, marks and
#: symbols, kana, Han, Hangul, all others; 17 is no character of its own.
CLASSES = 17
_CLASS = np.full(256, 5, np.int64)
_CLASS[:32] = 6
_CLASS[127] = 6
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[0x80:0xC0] = CLASSES
for _first, _end, _kind in ((0xC0, 0xCD, 7), (0xCD, 0xD0, 8), (0xD0, 0xD5, 9), (0xD5, 0xE0, 10), (0xE0, 0xE2, 11), (0xE2, 0xE3, 12), (0xE3, 0xE4, 13), (0xE4, 0xEA, 14), (0xEA, 0xEE, 15), (0xEE, 0x100, 16)):
    _CLASS[_first:_end] = _kind


def _common(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positive hashes of the lower-case alphanumeric words, for each text its first)."""
    buf, starts, ends, first = arrays.words(arrays.LOWER[raw], at, arrays.ALNUM)
    return ((arrays.hashes(buf, starts, ends) >> np.uint64(1)) | np.uint64(1)).astype(np.int64), first


def class_counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Characters of each class in each text."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    return np.bincount(doc * (CLASSES + 1) + _CLASS[raw], minlength=n * (CLASSES + 1)).reshape(n, CLASSES + 1)[:, :CLASSES]


@dataclass
class Reference:
    """Histograms of the languages: class shares, and the common words with their shares and the rest's."""

    langs: list[str]
    classes: np.ndarray
    words: list[np.ndarray]
    shares: list[np.ndarray]


def references(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Reference:
    """From all rows with a language and a text. Counts are summed within tasks before they are shuffled."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        classes: dict[str, np.ndarray] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                keys, counts = _merge(parts)
                yield _rows(lang, keys, counts)
            held.clear()

        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for i, j, raw, at in arrays.slices(batch.column(1)):
                mine = langs[i:j]
                packed, first = _common(raw, at)
                doc = np.repeat(np.arange(j - i), np.diff(first))
                of = class_counts(raw, at)
                for lang in dict.fromkeys(mine):
                    on = mine == lang
                    classes[lang] = classes.get(lang, 0) + of[on].sum(axis=0)
                    one = _merge([(packed[on[doc]], np.ones(int(on[doc].sum()), np.int64))])
                    held.setdefault(lang, []).append(one)
                    size += len(one[0])
            if size > FLUSH:
                held = {lang: [_merge(parts)] for lang, parts in held.items()}
                size = sum(len(p[0][0]) for p in held.values())
                if size > FLUSH // 2:
                    yield from flush()
                    size = 0
        yield from flush()
        for lang, n in classes.items():
            yield _rows(lang, -1 - np.arange(CLASSES), n)

    # read three times below
    counts = durable(rows.mapInArrow(counted, "lang string, k long, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")))
    top = counts.where("k > 0").withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "k"))).where(F.col("nth") <= COMMON_WORDS).drop("nth")
    rest = counts.where("k >= 0").groupBy("lang").agg(F.sum("n").alias("n")).select("lang", F.lit(0).cast("long").alias("k"), "n")
    found: dict[str, dict[int, int]] = {}
    for r in counts.where("k < 0").unionByName(top).unionByName(rest).collect():
        found.setdefault(r["lang"], {})[r["k"]] = r["n"]
    langs = sorted(lang for lang, n in found.items() if sum(n.get(-1 - c, 0) for c in range(CLASSES)))
    classes = np.array([[found[lang].get(-1 - c, 0) for c in range(CLASSES)] for lang in langs], float).reshape(len(langs), CLASSES)
    words = [np.array(sorted(k for k in found[lang] if k > 0), np.int64) for lang in langs]
    shares = []
    for lang, keys in zip(langs, words, strict=True):
        n = np.array([found[lang][int(k)] for k in keys], float)
        total = max(1.0, float(found[lang].get(0, 0)))
        shares.append(np.append(n, total - n.sum()) / total)
    return Reference(langs, classes / np.maximum(1, classes.sum(axis=1, keepdims=True)), words, shares)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(n, new) if len(new) else n


def _rows(lang: str, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["lang", "k", "n"])


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of ``p`` from ``q``; rows sum to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.maximum(0, (a + b) / 2))


def word_limits(shares: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The largest word distance from a language's ``shares`` for texts of ``total`` words."""
    without = np.zeros(len(shares))
    without[-1] = 1
    expected = (1 - shares[-1]) * np.maximum(1, total)
    return js_distance(without, shares) * (WORD_SHARE + WORD_NOISE / np.sqrt(np.maximum(1e-9, expected)))


def distances(raw: np.ndarray, at: np.ndarray, ref: Reference) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(characters, smallest class distance, smallest word distance, 1 if all word distances are beyond their limits) of each text; 0 where nothing can be compared."""
    n = len(at) - 1
    classes = class_counts(raw, at)
    chars = classes.sum(axis=1)
    share = classes / np.maximum(1, chars)[:, None]
    packed, first = _common(raw, at)
    total = np.diff(first)
    doc = np.repeat(np.arange(n), total)
    by_class, by_word = np.ones((len(ref.langs) or 1, n)), np.ones((len(ref.langs) or 1, n))
    strange = np.ones(n, bool)
    for k in range(len(ref.langs)):
        by_class[k] = js_distance(share, ref.classes[k])
        keys = ref.words[k]
        if len(keys):
            slot = np.minimum(np.searchsorted(keys, packed), len(keys) - 1)
            slot = np.where(keys[slot] == packed, slot, len(keys))
            counts = np.bincount(doc * (len(keys) + 1) + slot, minlength=n * (len(keys) + 1)).reshape(n, -1)
            by_word[k] = js_distance(counts / np.maximum(1, total)[:, None], ref.shares[k])
            strange &= by_word[k] > word_limits(ref.shares[k], total)
        else:
            # nothing is known of its words
            strange[:] = False
    some = bool(ref.langs)
    return chars, np.where((chars > 0) & some, by_class.min(axis=0), 0.0), np.where((total > 0) & some, by_word.min(axis=0), 0.0), ((total > 0) & some & strange).astype(np.int64)


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which entries' keys occur twice or more."""
    order = np.argsort(key)
    ordered = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    out = np.empty(len(key), bool)
    out[order] = same[1:] | same[:-1]
    return out


def base_counts(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each text of a slice."""
    n = len(at) - 1
    buf, starts, ends, first = arrays.words(raw, at, arrays.NOT_SPACE)
    n_words = np.diff(first)
    off = at + np.arange(n + 1)
    inside = arrays.NOT_SPACE[buf]
    word_chars = arrays.group_ends(off, inside & ((buf & 0xC0) != 0x80))
    n_symbols = arrays.group_ends(off, _SYMBOL[buf])

    salt = arrays.mix(np.arange(1, n + 1, dtype=np.uint64))
    lines, line_off = arrays.spaced(raw, at, 10)
    line_ends = np.flatnonzero(lines == 10)
    line_starts = np.concatenate(([0], line_ends[:-1] + 1)) if len(line_ends) else line_ends
    words_before = np.concatenate(([0], np.cumsum(arrays.NOT_SPACE[lines], dtype=np.int64)))
    with_word = words_before[line_ends] > words_before[line_starts]
    line_starts, line_ends = line_starts[with_word], line_ends[with_word]
    line_doc = np.searchsorted(line_off, line_starts, "right") - 1
    key = arrays.hashes(lines, line_starts, line_ends) ^ salt[line_doc]
    order = np.argsort(key)
    again = key[order][1:] == key[order][:-1]
    n_dup = np.bincount(line_doc[order][1:][again], minlength=n) if len(key) else np.zeros(n, np.int64)

    h = arrays.hashes(buf, starts, ends)
    n_windows = np.maximum(n_words - WINDOW + 1, 0)
    total = int(n_windows.sum())
    covered = np.zeros(len(h) + 1, np.int64)
    if total:
        doc = np.repeat(np.arange(n), n_windows)
        begin = first[doc] + np.arange(total) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        window = np.zeros(total, np.uint64)
        for k in range(WINDOW):
            window = window * np.uint64(0x9E3779B97F4A7C15) + h[begin + k]
        twice = begin[_repeated(arrays.mix(window) ^ salt[doc])]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    n_repeat = arrays.group_ends(first, np.cumsum(covered)[:-1] > 0)
    return n_words, word_chars, n_symbols, n_dup, n_repeat


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_RESULT = T.StructType([T.StructField(c, T.LongType()) for c in _LONGS] + [T.StructField("class_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()), T.StructField("n_chars", T.LongType()), T.StructField("strange", T.LongType())])


def measured(spark, ref: Reference):
    """A function from a text column to a column of the base counts and the distances."""
    sent = spark.sparkContext.broadcast(ref)

    @F.arrow_udf(_RESULT)
    def measures(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = []
            for _, _, raw, at in arrays.slices(column):
                chars, by_class, by_word, strange = distances(raw, at, sent.value)
                parts.append((*base_counts(raw, at), by_class, by_word, chars, strange))
            merged = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0)] * 9
            kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.int64()] * 2
            yield pa.StructArray.from_arrays([pa.array(x.astype(k.to_pandas_dtype()), k) for x, k in zip(merged, kinds, strict=True)], _RESULT.names)

    return measures


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, base counts, base_failed, kept, distances) of every row.

    Null texts have no words and fail; repeated rows are judged each. Where no row has a language nothing is compared
    and the base rules decide. The language column only serves the references.
    """
    ref = references(docs, lang_col, text_col)
    rows = docs.select(col(id_col).alias("id"), measured(docs.sparkSession, ref)(col(text_col)).alias("m")).select(F.col("id").alias(id_col), "m.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    compared = (F.col("n_chars") >= GUARD_CHARS) & (F.col("n_words") >= GUARD_WORDS)
    far = compared & ((F.col("class_distance") > MAX_CLASS_DISTANCE) | (F.col("strange") == 1))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far).select(id_col, *_LONGS, "base_failed", "kept", "class_distance", "word_distance")


