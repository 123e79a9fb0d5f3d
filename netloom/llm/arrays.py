"""NumPy helpers over whole Arrow string columns, shared by the text operators.

Texts are handled as one UTF-8 buffer with offsets, so that a batch costs a few array passes instead of a
Python loop for each word. Every helper works on slices of bounded size, see ``slices``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once in a Python worker; a single longer text is handled alone.
SLICE_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, a to z and all that is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 & ~7 | 5)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most ``limit`` bytes, or one longer row."""
    raw, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def spaced(raw: np.ndarray, at: np.ndarray, by: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The same with one byte ``by`` after each text, so that no word runs into the next text."""
    n = len(at) - 1
    out = np.full(len(raw) + n, by, np.uint8)
    keep = np.ones(len(out), bool)
    keep[at[1:] + np.arange(n)] = False
    out[keep] = raw
    return out, at + np.arange(n + 1)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    step = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def words(raw: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a blank after each text, word starts, word ends, for each text its first word and after the last the end)."""
    buf, off = spaced(raw, at)
    starts, ends = runs(table[buf])
    return buf, starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers (SplitMix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash's base and its inverse to the powers 0 to n, modulo 2**64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            out = np.full(n + 1, base, np.uint64)
            out[0] = 1
            _powers[k] = np.cumprod(out, dtype=np.uint64)
    return _powers[0], _powers[1]


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans of ``buf``, from prefix sums of a polynomial over randomised bytes; never 0."""
    up, down = powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTES[buf] * up[: len(buf)], out=total[1:])
    out = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    out[out == 0] = 1
    return out


def group_ends(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets; empty groups sum to 0."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]
