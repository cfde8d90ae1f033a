"""TF-IDF weights of word shingles, and improved consistent weighted sampling over them, as array operations."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefall.llm.common import U, counter_blocks, discard, mix, shingle_hashes, stash, step_texts, steps, summed_blocks

BANDS, ROWS = 10, 3
#: Shingles in at least this share of the documents have an IDF below the ceiling.
COMMON = 0.01
#: Minima by which near copies are counted together, and the share of all distinct texts from which a shared one counts.
GROUPS, HOT = 3, 0.001
#: Items that one step of a comparison holds.
COLUMNS = 1 << 12
#: Counters of the sketch that finds the common shingles' buckets.
COUNTERS = 1 << 17


@dataclass(frozen=True)
class Idf:
    """Weights of the common shingles (sorted hashes); all others weigh 1, the ceiling."""

    keys: np.ndarray
    weights: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(len(h))
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.weights[at], 1.0)


def distinct_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles in ascending order, how often each occurs, and where each text's begin (one more for the end)."""
    h, at = shingle_hashes(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint32), np.diff(at))
    by_hash = np.argsort(h)
    d = doc[by_hash]
    order = by_hash[np.argsort(d.astype(np.uint16) if len(texts) < 1 << 16 else d, kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(h)))
    return h[first], tf, np.searchsorted(doc[first], np.arange(len(texts) + 1)).astype(np.int64)


def distinct_shingles_stepwise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same in steps, so that only the shingles are held of all texts, not the arrays of their characters."""
    parts = [distinct_shingles(texts[i:j]) for i, j in steps(texts)]
    sizes = [np.diff(at) for _, _, at in parts]
    at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if parts else np.zeros(1)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), at.astype(np.int64)


def minima(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """GROUPS least hashes of each text of distinct_shingles (texts by GROUPS), each under a hash function of its own; 0 for none."""
    out = np.zeros((len(at) - 1, GROUPS), dtype=np.int64)
    full = np.flatnonzero(np.diff(at))
    for k in range(GROUPS if len(full) else 0):
        x = mix(h ^ U((k + 1) * 0xA0761D6478BD642F & (2**64 - 1)))
        out[full, k] = np.minimum.reduceat(x, at[:-1][full]).view(np.int64)
    return out


def shares(least: np.ndarray, hot: dict[int, int]) -> np.ndarray:
    """What each text counts: one over the greatest number of distinct texts that it shares a minimum with."""
    size = np.array([max(hot.get(x, 1) for x in row) for row in least.tolist()], dtype=np.float64)
    return 1.0 / size if len(size) else np.zeros(0)


def fit_idf(df: DataFrame, text: str, common: float = COMMON) -> Idf:
    """IDF of all distinct texts: (1 + ln(N / df)) over its value at df = common * N, where it has its ceiling of 1.

    Copies and near copies count together as about one text, so that a group doesn't devalue what its own members share: a text
    counts one over the number of distinct texts with which it shares one of GROUPS minima, if these are at least HOT of all
    (two texts share a minimum with a chance of their similarity, so that nearly all of a group of near copies share one, and of
    texts that have a passage in common few). N and df are sums of these counts.

    The first pass adds counters of a fixed size over all rows and keeps each text's minima; a counter is no less than any of
    its shingles' document frequency. At most GROUPS / HOT minima are shared that widely. The second pass takes the shingles of
    counters that reach common * N, one list for each distinct text (by MD5), and sums them exactly. At most (mean distinct
    shingles) / common shingles are common, however many documents there are, so that bringing those to the driver is bounded.
    """
    texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    node = F.unhex(F.md5(F.col("t").cast("binary")))
    shift = U(64 - int(math.log2(COUNTERS)))
    none = Idf(np.zeros(0, dtype=U), np.zeros(0))

    def first(batches):
        total = np.zeros(COUNTERS, dtype=np.int64)
        for b in batches:
            done = 0
            for some in step_texts(b.column(1)):
                h, tf, at = distinct_shingles(some)
                total += np.bincount((h >> shift).astype(np.int64), minlength=COUNTERS)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * GROUPS, pa.int32()), pa.array(minima(h, at).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(some)), rows, pa.nulls(len(some), pa.int32()), pa.nulls(len(some), pa.binary())], names)
                done += len(some)
        blocks, parts = counter_blocks(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(blocks), pa.binary()), pa.nulls(len(blocks), pa.list_(pa.int64())), blocks, parts], names)

    names = ["node", "least", "block", "counts"]
    kept = stash(texts.select(node.alias("node"), "t").mapInArrow(first, "node binary, least array<bigint>, block int, counts binary"), "minima")
    nodes = stash(kept.where("node is not null").groupBy("node").agg(F.first("least").alias("least")).select("least"), "minima-once")
    distinct = nodes.count()
    if not distinct:
        return none
    pairs = nodes.select(F.posexplode("least").alias("k", "v")).where("v <> 0").groupBy("k", "v").count()
    hot = {r["v"]: r["count"] for r in pairs.where(F.col("count") >= max(2, HOT * distinct)).collect()}

    def weighed(batches):
        for b in batches:
            least = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, GROUPS)
            yield pa.RecordBatch.from_arrays([pa.array([shares(least, hot).sum()], pa.float64())], ["n"])

    n = float(nodes.mapInArrow(weighed, "n double").agg(F.sum("n")).first()[0])
    counts = summed_blocks(kept.where("block is not null").select("block", "counts"), COUNTERS)
    discard(nodes, kept)
    least_df = common * n
    heavy = counts >= least_df
    if not heavy.any():
        return none

    def common_of(batches):
        for b in batches:
            done = 0
            for some in step_texts(b.column(1)):
                h, _, at = distinct_shingles(some)
                here = heavy[(h >> shift).astype(np.int64)]
                upto = np.concatenate([[0], np.cumsum(here)])[at].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(upto), pa.array(h[here].view(np.int64)))
                full = pa.array(np.diff(upto) > 0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(some)).filter(full), lists.filter(full), pa.array(shares(minima(h, at), hot)).filter(full)], ["node", "hs", "share"])
                done += len(some)

    def counted(batches):
        for b in batches:
            size = np.diff(b.column(0).offsets.to_numpy())
            k, back = np.unique(b.column(0).flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            c = np.bincount(back, np.repeat(b.column(1).to_numpy(), size), len(k))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], ["h", "n"])

    lists = texts.select(node.alias("node"), "t").mapInArrow(common_of, "node binary, hs array<bigint>, share double")
    lists = lists.groupBy("node").agg(F.first("hs").alias("hs"), F.first("share").alias("share")).select("hs", "share")
    rows = lists.mapInArrow(counted, "h long, n double").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least_df).collect()
    keys = np.array([r["h"] for r in rows], dtype=np.int64).view(U)
    dfs = np.round(np.array([r["n"] for r in rows], dtype=np.float64), 6)
    weights = np.minimum(1.0, (1 + np.log(n / np.maximum(dfs, 1e-9))) / (1 + math.log(1 / common)))
    order = np.argsort(keys)
    return Idf(keys[order], weights[order])


@lru_cache(maxsize=1)
def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), of 2**12 levels, and the logarithms of 2**16 levels."""

    def inverse(levels: int) -> np.ndarray:
        p = (np.arange(levels) + 0.5) / levels
        x = np.where(p < 0.5, np.sqrt(2 * p), -np.log(1 - p) + 1)
        for _ in range(60):  # Newton on F(x) = 1 - (1 + x) e^-x
            x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), 1e-12)
        return np.round(x, 9)

    return inverse(1 << 12), np.round(np.log(inverse(1 << 16)), 9)


def signatures(texts: list[str], idf: Idf, bands: int = BANDS, rows: int = ROWS, family: int = 0) -> np.ndarray:
    """bands hashes for each text (texts by bands, signed); 0 throughout for a text without words. Families are independent.

    Improved consistent weighted sampling: for weight w and hash function k, r and c are Gamma(2, 1) and b uniform by the
    shingle's hash, t = floor(ln w / r + b), and the shingle with the least ln a = ln c - r (t - b + 1) is the sample. ln a
    tells the pair (shingle, t), so it stands for the sample itself. A band's hash is that of its samples.
    """
    h, tf, at = distinct_shingles(texts)
    out = np.zeros((len(texts), bands), dtype=np.int64)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    starts = at[:-1][full]
    r_of, c_of = _quantiles()
    w = np.log(tf * idf.of(h))
    odd = np.flatnonzero(w)
    w_odd = w[odd]
    for b in range(bands):
        acc = np.full(len(full), b + 1, dtype=U)
        for k in range((family * bands + b) * rows, (family * bands + b + 1) * rows):
            x = (h ^ U((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) * U(0xD6E8FEB86659FD93)
            x ^= x >> U(32)
            x *= U(0xD6E8FEB86659FD93)
            r = r_of[(x >> U(52)).astype(np.int64)]
            beta = ((x >> U(28)) & U(0xFFFFFF)).astype(np.float64) * 2.0**-24
            c = c_of[((x >> U(12)) & U(0xFFFF)).astype(np.int64)]
            a = c - r * (1.0 - beta)
            if len(odd):
                t = np.floor(w_odd / r[odd] + beta[odd])
                a[odd] = c[odd] - r[odd] * (t - beta[odd] + 1.0)
            acc = acc * U(0x9E3779B97F4A7C15) + mix(np.minimum.reduceat(a, starts).view(U).copy())
        out[full, b] = mix(acc).view(np.int64)
    return out


def weighted_jaccard(h: np.ndarray, w: np.ndarray, at: np.ndarray, i: int, j: int) -> float:
    """Sum of the lesser weights over sum of the greater, of texts i and j of distinct_shingles; 1 for two texts without words."""
    a, b = slice(at[i], at[i + 1]), slice(at[j], at[j + 1])
    total = w[a].sum() + w[b].sum()
    if not total:
        return 1.0
    pos = np.minimum(np.searchsorted(h[b], h[a]), max(at[j + 1] - at[j] - 1, 0))
    same = h[b][pos] == h[a] if at[j + 1] > at[j] else np.zeros(at[i + 1] - at[i], dtype=bool)
    shared = np.minimum(w[a][same], w[b][pos[same]]).sum()
    return float(shared / (total - shared))


def close_pairs(h: np.ndarray, tf: np.ndarray, at: np.ndarray, idf: Idf, heads: np.ndarray, others: np.ndarray, least: float) -> np.ndarray:
    """Which of the texts `heads` are of weighted Jaccard `least` or more with which of `others` (heads by others).

    A shingle's n-th occurrence in a text is an item of its own, so that the lesser of two counts is a number of shared items and
    all sums come from products of 0-1 matrices, COLUMNS items at a time. Pairs that rounding could turn are computed exactly.
    """
    weight = idf.of(h)
    w = tf * weight
    size = np.diff(np.concatenate([[0], np.cumsum(w)])[at])
    first = np.concatenate([[0], np.cumsum(tf)])
    nth = np.arange(first[-1]) - np.repeat(first[:-1], tf)
    item = mix(np.repeat(h, tf) ^ (nth.astype(U) * U(0xE7037ED1A0B428DB)))
    text = np.repeat(np.repeat(np.arange(len(at) - 1), np.diff(at)), tf)
    _, column, count = np.unique(item, return_inverse=True, return_counts=True)
    met = count[column] > 1  # others are in one text alone
    column = np.unique(column[met], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    column, text, value = column[order], text[met][order], np.repeat(weight, tf)[met][order].astype(np.float32)
    shared = np.zeros((len(heads), len(others)))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        x, y = np.searchsorted(column, [a, a + COLUMNS])
        m = np.zeros((len(at) - 1, min(COLUMNS, int(column[-1]) + 1 - a)), dtype=np.float32)
        m[text[x:y], column[x:y] - a] = 1.0
        scale = np.zeros(m.shape[1], dtype=np.float32)
        scale[column[x:y] - a] = value[x:y]
        shared += (m[heads] * scale) @ m[others].T
    union = size[heads][:, None] + size[others][None, :] - shared
    close = shared >= least * union
    for i, j in np.argwhere(np.abs(shared - least * union) < 1e-4 * union):
        close[i, j] = weighted_jaccard(h, w, at, heads[i], others[j]) >= least - 1e-12
    return close
