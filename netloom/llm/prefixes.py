"""Token counts by prefix dynamic programming over a sentencepiece BPE model.

In such a model no piece has a blank behind another character (``check_boundaries`` proves it from the vocabulary), so
merges never cross the border between a run of blanks with the word behind it and the next such run. Texts are cut into
such segments, and each distinct segment is encoded once, for all of its prefixes together:

    count(i) = count(i - length of the last token of prefix i) + 1

A sequence of tokens is what BPE makes of a string if and only if each two neighbours are what it makes of theirs. So the
last token of a prefix is the one piece that ends there and that the model keeps apart from the last token of the prefix
before it. Pieces that end at a place come from an automaton, and the verdict on two pieces is remembered. A character
without a piece counts its bytes and merges with nothing.

A text's table has the exact count of every prefix in code points: its segments' rows, each raised by the count before
it. Totals, prefixes and budgets are look-ups; nothing is encoded again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm import arrays

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Characters of distinct segments whose rows a worker remembers, and pairs of pieces; beyond it the memory is emptied and filled again.
REMEMBERED_CHARS = 8_000_000
REMEMBERED = 2_000_000
BLANK = "▁"


def tokenizer_path(name: str = MODEL) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


class PrefixTable:
    """``counts[n]`` is the exact number of tokens of a text's first ``n`` code points."""

    def __init__(self, counter: Counter, text: str):
        self.ends, segments = _segments(text.replace(BLANK, " "))
        rows = counter.rows(segments)
        # the first segment begins with a blank that the text has not
        rows[:1] = [rows[0][1:]] if rows else []
        before = np.cumsum([0, *(r[-1] for r in rows)], dtype=np.int64)
        self.counts = np.concatenate([[0], *(r + n for r, n in zip(rows, before[:-1], strict=True))]).astype(np.int64)

    @property
    def total(self) -> int:
        return int(self.counts[-1])

    def at(self, n: int) -> int:
        """Tokens of the first ``n`` code points; of the whole text beyond its end."""
        return int(self.counts[min(max(n, 0), len(self.counts) - 1)])

    def longest(self, budget: int) -> int:
        """The most code points whose tokens fit the budget; 0 if it is negative."""
        fit = np.flatnonzero(self.counts <= budget)
        return int(fit[-1]) if len(fit) else 0


def _segments(text: str) -> tuple[np.ndarray, list[str]]:
    """Ends in code points, and the segments as written, the first one with the blank that the model puts before a text."""
    if not text:
        return np.zeros(0, np.int64), []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = codes == 32
    cut = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    ends = np.concatenate((cut, [len(text)])).astype(np.int64)
    out, a = [], 0
    for b in ends.tolist():
        out.append(text[a:b])
        a = b
    out[0] = " " + out[0]
    return ends, out


class Counter:
    """Rows of prefix counts of distinct segments, remembered."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        check_boundaries(sp)
        self._scores: dict[str, float] = {}
        self._pieces: list[str] = []
        self._automaton = ahocorasick.Automaton()
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                piece = sp.id_to_piece(i)
                self._automaton.add_word(piece, (len(piece), len(self._pieces)))
                self._scores[piece] = sp.get_score(i)
                self._pieces.append(piece)
        self._automaton.make_automaton()
        self._apart: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self._known: dict[str, np.ndarray] = {}
        self._held = 0

    def _merged(self, text: str) -> list[str]:
        """What BPE makes of a short string of characters with pieces: the best pair, the leftmost of equals, is merged first."""
        parts = list(text)
        while True:
            best = max(((self._scores[m], -k) for k in range(len(parts) - 1) if (m := parts[k] + parts[k + 1]) in self._scores), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _keeps(self, before: int, piece: int) -> bool:
        """Whether the two pieces stay as they are side by side; ``before`` is -1 where nothing merges with the piece."""
        if before < 0:
            if (found := self._alone.get(piece)) is None:
                found = self._alone[piece] = self._merged(self._pieces[piece]) == [self._pieces[piece]]
            return found
        key = before << 32 | piece
        if (found := self._apart.get(key)) is None:
            if len(self._apart) >= REMEMBERED:
                self._apart.clear()
            a, b = self._pieces[before], self._pieces[piece]
            found = self._apart[key] = self._merged(a + b) == [a, b]
        return found

    def _fill(self, segments: list[str]) -> None:
        """Adds the rows of segments: one pass over all their characters."""
        text = "".join(segments)
        starts = np.cumsum([0, *map(len, segments)]).tolist()
        count, last = [0] * len(text), [-1] * len(text)
        begins = [False] * (len(text) + 1)
        for x in starts:
            begins[x] = True
        apart, start, done, seen = self._apart, 0, -1, -1

        def unknown(upto: int) -> None:
            # characters without a piece
            nonlocal start, done
            for k in range(done + 1, upto):
                if begins[k]:
                    start = k
                count[k] = (count[k - 1] if k > start else 0) + len(text[k].encode("utf-8", "replace"))
            done = max(done, upto - 1)

        for end, (size, piece) in self._automaton.iter(text):
            if end == done:
                continue
            if end > seen:
                if done < seen:
                    raise ValueError(f"no piece can end at {text[seen]!r}")
                seen = end
                if end > done + 1:
                    unknown(end)
            if begins[end]:
                start = end
            begin = end - size + 1
            if begin < start:
                continue
            before = last[begin - 1] if begin > start else -1
            fits = apart.get(before << 32 | piece) if before >= 0 else None
            if fits is None:
                fits = self._keeps(before, piece)
            if fits:
                count[end] = (count[begin - 1] if begin > start else 0) + 1
                last[end] = piece
                done = end
        unknown(len(text))
        rows = np.array(count, np.int32)
        for s, a, b in zip(segments, starts[:-1], starts[1:], strict=True):
            self._known[s] = rows[a:b].copy()
        self._held += len(text)

    def rows(self, segments: list[str]) -> list[np.ndarray]:
        """For each segment, which begins with its blanks, the tokens of its first 1, 2, ... code points."""
        return self._rows([s.replace(" ", BLANK) for s in segments])

    def _rows(self, segments: list[str]) -> list[np.ndarray]:
        known = self._known
        new = [s for s in dict.fromkeys(segments) if s not in known]
        if new:
            if self._held + sum(map(len, new)) > REMEMBERED_CHARS:
                known.clear()
                self._held = 0
                new = list(dict.fromkeys(segments))
            self._fill(new)
        return [known[s] for s in segments]

    def of(self, segments: list[str]) -> np.ndarray:
        """Tokens of each segment: the last entries of the rows."""
        return np.fromiter((r[-1] for r in self.rows(segments)), np.int64, len(segments))

    def table(self, text: str | None) -> PrefixTable:
        return PrefixTable(self, text or "")

    def totals(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Token counts of a slice of texts: the last entries of their tables, filled for all texts at once."""
        n = len(at) - 1
        text = raw.tobytes()
        # a separator byte that no UTF-8 text holds keeps texts apart; the model's own blank counts as a blank
        if BLANK.encode() in text:
            parts = [text[a:b].replace(BLANK.encode(), b" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            text = b"".join(parts)
            at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        buf = np.frombuffer(text, np.uint8)
        blank = buf == 32
        cut = np.zeros(len(buf) + 1, bool)
        cut[1:-1] = blank[1:] & ~blank[:-1]
        cut[at] = True
        ends = np.flatnonzero(cut)
        starts, ends = ends[:-1], ends[1:]
        if not len(starts):
            return np.zeros(n, np.int64)
        head = np.isin(starts, at)
        counts = np.zeros(len(starts), np.int64)
        # distinct segments by hash and kind: of those only, Python strings are made
        key = arrays.hashes(buf, starts, ends) ^ head.astype(np.uint64)
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        one = order[new]
        segments = [(" " if h else "") + text[a:b].decode("utf-8", "replace") for a, b, h in zip(starts[one].tolist(), ends[one].tolist(), head[one].tolist(), strict=True)]
        counts[order] = self.of(segments)[np.cumsum(new) - 1]
        return arrays.group_ends(np.searchsorted(starts, at), counts)


def check_boundaries(sp) -> None:
    """Refuses a model in which a piece has a blank behind another character, or texts are changed before encoding."""
    for i in range(sp.get_piece_size()):
        if BLANK in sp.id_to_piece(i).lstrip(BLANK):
            raise ValueError("merges of this model cross blanks; its prefix counts are no sums over segments")
    if len(sp.encode("x  y ")) - len(sp.encode("x  y")) == 0 or sp.decode(sp.encode("ﬁ　x")) != "ﬁ　x":
        raise ValueError("this model changes texts before encoding")


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_count(text: Column, path: str) -> Column:
    """Exact token counts of a text column; null and empty texts have none."""

    @F.arrow_udf(T.LongType())
    def counted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            out = [counter(path).totals(raw, at) for _, _, raw, at in arrays.slices(column)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64())

    return counted(text)


def prefix_counts(text: Column, path: str) -> Column:
    """The exact token counts of the text's first 0, 1, 2, ... code points, to answer truncation and budgets later; [0] for null."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def tables(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array([counter(path).table(t).counts for t in column.to_pylist()], pa.list_(pa.int64()))

    return tables(text)


def within_budget(text: Column, budget: int, path: str) -> Column:
    """The longest beginning of the text whose tokens fit the budget."""

    @F.arrow_udf(T.StringType())
    def cut(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array([None if t is None else t[: counter(path).table(t).longest(budget)] for t in column.to_pylist()], pa.string())

    return cut(text)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; repeated rows are counted each, no rows give no rows."""
    rows = docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), token_count(F.col(text_col), path or tokenizer_path()).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
