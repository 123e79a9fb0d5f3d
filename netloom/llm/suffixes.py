"""Benchmark decontamination with suffix arrays over the training texts.

Training texts are cut into shards of whole documents. A shard's word positions are sorted by the words that follow
(``suffix_array``), and every suffix of a benchmark text is located in it by binary search (``intervals``). Every place so
found is carried on to its longest verbatim match: a pair of places that no common word precedes, with all common words
behind them. Matches of at least a window of words, or of a whole shorter text, give the words hit, the items, the longest
match and its locations. A shard never leaves its task, so no training text is shuffled.

Benchmark texts travel to the shards in blocks of whole items with about ``BLOCK_WORDS`` words, of which a task holds one
at a time. Words are compared by 64-bit hashes; a benchmark of a million words against 10**13 distinct training words meets
one wrong word with a probability below one in a million, and a hit needs all words of a window.
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
from netloom.llm.tables import col, cols, fresh

WINDOW = 10
#: Suffixes are ordered by this many words at least, and by the whole window if it is longer.
DEPTH = 16
#: Benchmark words that a task holds at once, some 24 bytes each; a single longer item is held alone.
BLOCK_WORDS = 1_000_000
#: Patterns, and pairs of places, that are worked on at once.
AT_ONCE = 1 << 17


def suffix_array(tokens: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions ordered by their next ``depth`` tokens, by prefix doubling. Behind the last token come zeros."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(tokens)
    span = 1
    rank = _ranks(tokens[order], order)
    while span < depth and rank[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        after[: max(0, n - span)] = rank[span:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        rank = _ranks(key[order], order)
        span *= 2
    return order


def _ranks(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
    return rank


def intervals(tokens: np.ndarray, order: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``patterns`` the interval of ``order`` whose suffixes begin with it; no more columns than the order's depth."""
    width = patterns.shape[1]
    padded = np.concatenate((tokens, np.zeros(width, np.uint64)))
    columns = np.arange(width)
    found = []
    for after in (False, True):
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), len(order), np.int64)
        while len(on := np.flatnonzero(lo < hi)):
            mid = (lo[on] + hi[on]) >> 1
            there = padded[order[mid][:, None] + columns]
            want = patterns[on]
            differ = there != want
            first = differ.argmax(axis=1)
            row = np.arange(len(on))
            equal = ~differ[row, first]
            right = (there[row, first] < want[row, first]) | (equal & after)
            lo[on[right]] = mid[right] + 1
            hi[on[~right]] = mid[~right]
        found.append(lo)
    return found[0], found[1]


def tokenise(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts with a zero after each text, the first of each text and behind the last the end)."""
    buf, starts, ends, first = arrays.words(arrays.LOWER[raw], at, arrays.ALNUM)
    return np.insert(arrays.hashes(buf, starts, ends), first[1:], np.uint64(0)), first + np.arange(len(first))


@dataclass
class Items:
    """A block of benchmark texts: words, the first of each text, each text's place in ``names``, and for each length of
    windows the starts of all windows, equal ones together, with the first of each distinct one.
    """

    names: list[str]
    tokens: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    windows: dict[int, tuple[np.ndarray, np.ndarray]]


def items_of(ids: list[str | None], texts: list[str | None], window: int = WINDOW) -> Items:
    """Windows of ``window`` consecutive words; a shorter text with words is one window; a null id or text has none."""
    if window < 1:
        raise ValueError("a window has one word or more")
    kept = [(i, t) for i, t in zip(ids, texts, strict=True) if i is not None and t]
    names = sorted({i for i, _ in kept})
    number = {name: k for k, name in enumerate(names)}
    tokens, first = tokenise(*arrays.utf8(pa.array([t for _, t in kept], pa.large_string())))
    size = np.diff(first) - 1
    width = np.minimum(size, window)
    windows = {}
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        n = size[of] - w + 1
        starts = np.repeat(first[of] - np.cumsum(n) + n, n) + np.arange(n.sum())
        place = np.empty(len(tokens), np.int64)
        order = suffix_array(tokens, w)
        place[order] = np.arange(len(order))
        starts = starts[np.argsort(place[starts])]
        new = np.ones(len(starts), bool)
        for k in range(0, len(starts) - 1, AT_ONCE):
            a, b = starts[k : k + AT_ONCE], starts[k + 1 : k + AT_ONCE + 1]
            columns = np.arange(w)
            new[k + 1 : k + 1 + len(b)] = (tokens[a[: len(b), None] + columns] != tokens[b[:, None] + columns]).any(axis=1)
        windows[w] = (starts, np.append(np.flatnonzero(new), len(starts)))
    return Items(names, tokens, first, np.array([number[i] for i, _ in kept], np.int64), windows)


@dataclass
class Shard:
    """Words of some documents with a zero after each, the first of each, the suffix array and the sorted distinct words."""

    tokens: np.ndarray
    first: np.ndarray
    order: np.ndarray
    vocabulary: np.ndarray


def shard_of(raw: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> Shard:
    tokens, first = tokenise(raw, at)
    order = suffix_array(tokens, max(depth, DEPTH))
    ordered = tokens[order]
    vocabulary = ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))] if len(ordered) else ordered
    return Shard(tokens, first, order, vocabulary)


def matches(shard: Shard, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the shard, places in the items, words) of all longest matches, in parts.

    A match is longest if the words before it differ and those behind it do, or a text begins or ends there.
    """
    if not len(shard.tokens):
        return
    slot = np.minimum(np.searchsorted(shard.vocabulary, items.tokens), len(shard.vocabulary) - 1)
    absent = np.concatenate(([0], np.cumsum((shard.vocabulary[slot] != items.tokens) | (items.tokens == 0))))
    train, test = np.append(shard.tokens, np.uint64(0)), np.append(items.tokens, np.uint64(0))
    for width, (starts, begin) in items.windows.items():
        one = starts[begin[:-1]]
        may = np.flatnonzero(absent[one + width] == absent[one])
        for k in range(0, len(may), AT_ONCE):
            some = may[k : k + AT_ONCE]
            lo, hi = intervals(shard.tokens, shard.order, items.tokens[one[some][:, None] + np.arange(width)])
            n_here, n_there = hi - lo, begin[some + 1] - begin[some]
            upto = np.concatenate(([0], np.cumsum(n_here * n_there)))
            for g in range(0, int(upto[-1]), AT_ONCE):
                pair = np.arange(g, min(g + AT_ONCE, int(upto[-1])))
                of = np.searchsorted(upto, pair, "right") - 1
                here, there = np.divmod(pair - upto[of], n_there[of])
                p, q = shard.order[lo[of] + here], starts[begin[some[of]] + there]
                # -1 is the zero behind the last word
                longest = (train[p - 1] != test[q - 1]) | (train[p - 1] == 0)
                p, q = p[longest], q[longest]
                n = np.full(len(p), width, np.int64)
                on = np.arange(len(p))
                while len(on):
                    word = train[p[on] + n[on]]
                    on = on[(word == test[q[on] + n[on]]) & (word != 0)]
                    n[on] += 1
                yield p, q, n


def _loaded(sent: list) -> Iterator[Items]:
    """The blocks one after another; of several, each is let go before the next one is read."""
    for block in sent:
        yield block.value
        if len(sent) > 1:
            block.__dict__.pop("_value", None)


def _shards(column: pa.Array, sent: list, depth: int) -> Iterator[tuple[int, Shard, list[Items]]]:
    """(first row, shard, blocks): a shard comes once with all blocks if there is one, else once with each."""
    if len(sent) == 1:
        for row, _, raw, at in arrays.slices(column):
            yield row, shard_of(raw, at, depth), sent[0].value
    else:
        shards = [(row, shard_of(raw, at, depth)) for row, _, raw, at in arrays.slices(column)]
        for items in _loaded(sent):
            for row, shard in shards:
                yield row, shard, items


_RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType())])


def matches_with(text: Column, sent: list, window: int = WINDOW) -> Column:
    """A column (n_words, n_hit, items, longest) of the texts against the blocks, broadcast variables."""

    @F.arrow_udf(_RESULT)
    def matched(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            total = len(column)
            n_words, n_hit, longest = np.zeros(total, np.int64), np.zeros(total, np.int64), np.zeros(total, np.int64)
            names: list[set[str]] = [set() for _ in range(total)]
            # changes of the number of matches over each word of a shard, summed over the blocks
            covers: dict[int, np.ndarray] = {}
            firsts: dict[int, np.ndarray] = {}
            for row, shard, items in _shards(column, sent, window):
                firsts[row] = shard.first
                cover = covers.setdefault(row, np.zeros(len(shard.tokens) + 1, np.int64))
                for p, q, n in matches(shard, items):
                    np.add.at(cover, p, 1)
                    np.add.at(cover, p + n, -1)
                    doc = np.searchsorted(shard.first, p, "right") - 1
                    np.maximum.at(longest, row + doc, n)
                    item = items.owner[np.searchsorted(items.first, q, "right") - 1]
                    for x in np.unique(doc * len(items.names) + item).tolist():
                        names[row + x // len(items.names)].add(items.names[x % len(items.names)])
            for row, first in firsts.items():
                n = len(first) - 1
                n_words[row : row + n] = np.diff(first) - 1
                n_hit[row : row + n] = arrays.group_ends(first, np.cumsum(covers[row])[:-1] > 0)
            columns = [pa.array(n_words), pa.array(n_hit), pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array(longest)]
            yield pa.StructArray.from_arrays(columns, _RESULT.names)

    return matched(text)


def blocks(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list:
    """Broadcast variables of the benchmark's items; one unless it has more than ``block_words`` words. The driver holds one at a time."""
    spark = bench.sparkSession
    rows = bench.where(col(id_col).isNotNull() & col(text_col).isNotNull()).select(col(id_col).cast("string").alias("i"), col(text_col).alias("t"))
    # bytes bound the number of words
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // (2 * block_words)) or 1
    out = []
    for k in range(n):
        part = (rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k) if n > 1 else rows).collect()
        out.append(spark.sparkContext.broadcast(items_of([r["i"] for r in part], [r["t"] for r in part], window)))
        if n > 1:
            # the executors read it from its file
            out[-1].__dict__.pop("_value", None)
    return out


def hits(docs: DataFrame, bench: DataFrame, text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit, items (sorted ids as strings of the benchmark items with a window in the text) and longest.

    ``longest`` is the number of words of the longest verbatim match, 0 if there is none. Null and wordless texts have no
    words and no hits; repeated rows are judged each. Items with a null id or without words are no windows; an empty
    benchmark hits nothing. Columns of these names are replaced; all others stay.
    """
    held = docs.drop(*_RESULT.names)
    (name,) = fresh(held, "matched")
    found = held.withColumn(name, matches_with(col(text_col), blocks(bench, window=window, block_words=block_words), window))
    return found.select(*cols(held.columns), *[F.col(name)[c].alias(c) for c in _RESULT.names])


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that hold a window of a benchmark item; columns and clean rows stay as they are."""
    return docs.where(matches_with(col(text_col), blocks(bench, window=window), window)["n_hit"] == 0)


_MATCH = "item_id string, item_from long, doc_id string, doc_from long, n_words long"


def longest_matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The longest verbatim match of at least ``window`` words of each item in each document, with its word positions.

    Ties go to the smaller place in the document, then in the item. Items shorter than the window match only as a whole.
    Repeated rows are searched each; null and empty texts and an empty benchmark give no rows.
    """
    sent = blocks(bench, window=window, block_words=block_words)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, shard, items in _shards(batch.column(1), sent, window):
                parts = list(matches(shard, items))
                if not parts:
                    continue
                p, q, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                doc = np.searchsorted(shard.first, p, "right") - 1
                text = np.searchsorted(items.first, q, "right") - 1
                item = items.owner[text]
                order = np.lexsort((q, p, -n, item, doc))
                doc, item, p, q, n, text = (x[order] for x in (doc, item, p, q, n, text))
                best = np.ones(len(doc), bool)
                best[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
                doc, item, p, q, n, text = (x[best] for x in (doc, item, p, q, n, text))
                names = pa.array(items.names, pa.string()).take(pa.array(item))
                yield pa.RecordBatch.from_arrays([names, pa.array(q - items.first[text]), ids.take(pa.array(row + doc)), pa.array(p - shard.first[doc]), pa.array(n)], ["item_id", "item_from", "doc_id", "doc_from", "n_words"])

    return docs.select(col(id_col).cast("string"), col(text_col)).mapInArrow(found, _MATCH)


#: The query's rows in DuckDB, by comparing window texts instead of suffixes; windows in a row on a diagonal are one match.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS t, CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bn AS (SELECT t, item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT t, item, n, j, array_to_string(w[j : j + n - 1], ' ') AS win FROM (SELECT t, item, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM bn)),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT r, i, n, item, t, j FROM dw JOIN bw USING (n, win)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r),
g AS (SELECT r, t, n, i - j AS diagonal, i - row_number() OVER (PARTITION BY r, t, i - j ORDER BY i) AS island FROM h),
l AS (SELECT r, max(size) AS longest FROM (SELECT r, count(*) + any_value(n) - 1 AS size FROM g GROUP BY r, t, diagonal, island) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r) LEFT JOIN l USING (r)
"""
