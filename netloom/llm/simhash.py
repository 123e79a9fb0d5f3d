"""SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprints are computed in whole-column NumPy passes (``fingerprints``). Distinct fingerprints are then put into
2**(radius+1) - 1 tables. Table ``t`` keeps the bits of a mask built from parities (Pagh, "CoveringLSH"): every bit
``i`` has a vector m(i) of radius+1 bits, and mask ``t`` holds the bits with odd <m(i), t>. At most ``radius`` differing
bits span no more than ``radius`` dimensions, so some t is orthogonal to all of them, and the two fingerprints agree
on all bits of that mask. No pair within the radius can be missed.

A bucket's fingerprints are compared with each other in one task only up to ``bucket_limit``, and only a spanning star
of its links is emitted. Larger buckets take another exact way without comparisons: every fingerprint names all points
within radius/2 of it, and those that name the same point are linked (they are within the radius), while any two within
the radius share such a point.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.llm import arrays
from netloom.llm.tables import col, cols, fresh, joined_by
from netloom.operators.components import connected_components
from netloom.plans.durable import durable

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of a bucket that one task compares with each other.
BUCKET_LIMIT = 8192

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: For each byte its eight bits as eight bytes of an integer, lowest first.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(256, 8).copy().view("<u8").ravel()


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many spans of one buffer."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    lane8 = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    lane4 = np.ndarray((len(padded) - 3,), "<u4", padded, 0, (1,))
    size = ends - starts
    at = starts.astype(np.int64, copy=True)
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(starts), s + _P5, np.uint64)
        if len(wide := np.flatnonzero(size >= 32)):
            v = [np.full(len(wide), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            active, n, pos = np.arange(len(wide)), size[wide] // 32, at[wide]
            step = 0
            while len(active):
                where = pos[active] + 32 * step
                for k in range(4):
                    v[k][active] = _round(v[k][active], lane8[where + 8 * k])
                step += 1
                active = active[n[active] > step]
            out = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            zero = np.zeros(1, np.uint64)
            for k in range(4):
                out = (out ^ _round(zero, v[k])) * _P1 + _P4
            h[wide] = out
            at[wide] += 32 * n
        h += size.astype(np.uint64)
        zero = np.zeros(1, np.uint64)
        for _ in range(3):
            if not len(on := np.flatnonzero(ends - at >= 8)):
                break
            h[on] = _rotl(h[on] ^ _round(zero, lane8[at[on]]), 27) * _P1 + _P4
            at[on] += 8
        if len(on := np.flatnonzero(ends - at >= 4)):
            h[on] = _rotl(h[on] ^ lane4[at[on]].astype(np.uint64) * _P1, 23) * _P2 + _P3
            at[on] += 4
        for _ in range(3):
            if not len(on := np.flatnonzero(ends > at)):
                break
            h[on] = _rotl(h[on] ^ padded[at[on]].astype(np.uint64) * _P5, 11) * _P1
            at[on] += 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h


def _majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each group ``h[first[i]:first[i+1]]`` the bits set in over half of its hashes."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    blocks = -(-n[full] // 255)
    group = np.repeat(np.arange(len(full)), blocks)
    inner = np.arange(len(group)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    lanes = np.add.reduceat(_SPREAD[h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)], first[full][group] + 255 * inner, axis=0)
    counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), np.cumsum(blocks) - blocks, axis=0)
    out[full] = np.packbits(counts * 2 > n[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(raw: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprints of a slice of texts; a text without words has 0."""
    buf, starts, _, word0 = arrays.words(arrays.LOWER[raw], at, arrays.NOT_SPACE)
    n_words = np.diff(word0)
    inside = arrays.NOT_SPACE[buf]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    joined = np.where(inside, buf, np.uint8(32))[keep]
    starts, ends = arrays.runs(joined != 32)
    n_sh = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    first = np.concatenate(([0], np.cumsum(n_sh)))
    doc = np.repeat(np.arange(len(n_sh)), n_sh)
    begin = word0[doc] + np.arange(first[-1]) - first[doc]
    last = begin + np.minimum(n_words[doc], shingle) - 1
    return _majority(xxh64(joined, starts[begin], ends[last]), first)


@F.arrow_udf(T.LongType())
def _fingerprint(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        out = [fingerprints(raw, at) for _, _, raw, at in arrays.slices(column)]
        yield pa.array(np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64))


def fingerprint(text: Column) -> Column:
    """The 64-bit SimHash as a signed long; a null text has no words and so 0."""
    return _fingerprint(text)


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering masks: unsigned integers, one for each non-zero vector of radius+1 bits."""
    tables = (1 << (radius + 1)) - 1
    vectors = np.random.default_rng(7).permutation(np.arange(bits) % tables) + 1
    return [sum(1 << i for i in range(bits) if int(vectors[i] & t).bit_count() & 1) for t in range(1, tables + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def merged(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A flat forest (each node's root, the first of its component) after links between ``x`` and ``y``.

    Only roots are hooked, always to smaller ones, and the forest is flat before each pass: no earlier link is lost.
    """
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        root = root.copy()
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, flat := root[root]):
            root = flat


def local_roots(fps: np.ndarray, radius: int, block: int = 1024) -> np.ndarray:
    """For each of the sorted distinct fingerprints the index of its component's first; links are within ``radius``."""
    n = len(fps)
    root = np.arange(n)
    for i in range(0, n, block):
        for j in range(0, i + 1, block):
            x, y = np.nonzero(np.bitwise_count(fps[i : i + block, None] ^ fps[None, j : j + block]) <= radius)
            x, y = x + i, y + j
            # one block's links are merged at once: they need not be kept
            root = merged(root, x[x > y], y[x > y])
    return root


def _bucket_stars(radius: int):
    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("fps")
            values = lists.values.to_numpy().view(np.uint64)
            offsets = lists.offsets.to_numpy()
            u, v = [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                fps = np.sort(values[a:b].view(np.int64)).view(np.uint64)
                root = local_roots(fps, radius)
                on = np.flatnonzero(root != np.arange(len(root)))
                u.append(fps[on])
                v.append(fps[root[on]])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], ["u", "v"])

    return stars


def near_links(fps: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(u, v) links whose components are those of all pairs within ``radius``; ``fps`` has distinct non-null ``fp``."""
    if radius % 2:
        raise ValueError("the radius must be even: the way for large buckets halves it")
    masks = covering_masks(radius)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "k"))
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    sizes = durable(sizes)
    pairs = sizes.where("n = 2").where(F.bit_count(F.expr("u ^ v")) <= radius).select("u", "v")
    members = keyed.join(sizes.where("n > 2").select("t", "k", "n"), ["t", "k"])
    lists = members.where(F.col("n") <= bucket_limit).groupBy("t", "k").agg(F.collect_list("fp").alias("fps")).select("fps")
    links = pairs.unionByName(lists.mapInArrow(_bucket_stars(radius), "u long, v long"))
    if sizes.where(F.col("n") > bucket_limit).limit(1).count():
        links = links.unionByName(_by_midpoints(members.where(F.col("n") > bucket_limit).select("fp").distinct(), radius))
    return links.distinct()


def _by_midpoints(fps: DataFrame, radius: int) -> DataFrame:
    """Links among any number of fingerprints without comparing pairs: 1 + 64 + 2016 points each at radius 4."""
    flips = [_signed(sum(1 << b for b in bits)) for k in range(radius // 2 + 1) for bits in combinations(range(BITS), k)]
    named = fps.select("fp", F.explode(F.array(*[F.lit(x) for x in flips])).alias("flip")).select("fp", F.expr("fp ^ flip").alias("z"))
    hubs = named.groupBy("z").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("z", "v")
    return named.join(hubs, "z").where("fp <> v").select(F.col("fp").alias("u"), "v")


def _components(rows: DataFrame, radius: int, bucket_limit: int) -> DataFrame:
    """(fp, n, low, component) of each distinct fingerprint of (fp, low): its rows, its least ``low``, its component."""
    fps = durable(rows.groupBy("fp").agg(F.min("low").alias("low"), F.count("*").alias("n")))
    parts = connected_components(near_links(fps, radius, bucket_limit)).select(F.col("node").alias("fp"), "component")
    return durable(fps.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(id, fingerprint, component_id) for every row; other columns are not read.

    Null and blank texts have fingerprint zero, which is linked like any other. ``component_id`` is the smallest
    non-null id of the rows reachable over links; null if none has an id. Repeated rows are returned as often as they
    are given. An empty table gives an empty result. Components and fingerprints of many rows are joined by broadcast.
    """
    rows = durable(docs.select(col(id_col).alias("low"), fingerprint(col(text_col)).alias("fp")))
    placed = _components(rows, radius, bucket_limit)
    least = durable(placed.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("members")))
    named = joined_by(placed.select("fp", "n", "component"), least, "component", "members").select("fp", "n", "component_id")
    out = joined_by(rows, durable(named), "fp", "n")
    return out.select(F.col("low").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``docs`` with one row for each group of near-duplicates: the one with the smallest id, then text hash; null ids last.

    Groups are of texts, so rows of one id with unrelated texts all stay, and rows without an id are searched like any
    other. Rows equal in id and text are one document: one of them stays, the first by a hash of its columns. Ids and
    hashes choose the rows; texts are shuffled once, to be met by those chosen. No rows give no rows.
    """
    rank = F.struct(col(id_col).isNull().alias("no_id"), col(id_col).alias("id"), F.coalesce(F.xxhash64(col(text_col)), F.lit(0)).alias("h"))
    rows = durable(docs.select(rank.alias("low"), fingerprint(col(text_col)).alias("fp")))
    chosen = _components(rows, radius, bucket_limit).groupBy("component").agg(F.min("low").alias("low"))
    counted = rows.groupBy("low").agg(F.count("*").alias("times")).join(chosen.select("low"), "low")
    my_id, my_hash, times = fresh(docs, "id", "h", "times")
    wanted = durable(counted.select(F.col("low.id").alias(my_id), F.col("low.h").alias(my_hash), F.col("times").alias(times)))
    same = (docs[f"`{id_col}`"].eqNullSafe(wanted[my_id])) & (F.coalesce(F.xxhash64(docs[f"`{text_col}`"]), F.lit(0)) == wanted[my_hash])
    single = docs.join(wanted.where(F.col(times) == 1), same, "left_semi")
    # repeated rows: one is kept for each task before anything is shuffled
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    again = docs.join(F.broadcast(wanted.where(F.col(times) > 1)) if _few(wanted.where(F.col(times) > 1)) else wanted.where(F.col(times) > 1), same)
    one = again.groupBy(my_id, my_hash).agg(F.min_by(F.struct(*cols(docs.columns)), F.xxhash64(*cols(plain))).alias("row"))
    return single.unionByName(one.select("row.*"))


#: Rows of at most 32 bytes that are sent to every task.
FEW = 500_000


def _few(rows: DataFrame) -> bool:
    return rows.limit(FEW + 1).count() <= FEW
