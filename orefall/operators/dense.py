"""Vector search: exact for a batch of queries, and inverted lists by cell for large tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefall.functions.vectors import doubles
from orefall.operators.lexical import top

#: Queries and vectors that meet in one matrix product at most, about, and queries that one step of it holds.
QUERIES, VECTORS, STEP = 4096, 4096, 256


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1, n)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of equal length as rows, without Python objects."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(flat):
        return np.zeros((0, 0))
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _ordered(pairs) -> np.ndarray:
    """The sum of products, added in order, so that equal vectors have equal sums wherever they stand."""
    total = 0.0
    for a, b in pairs:
        total = total + a * b
    return total


def nearest(q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, rows of x and cosine for the k best of every row of q; ties go to the earlier row of x.

    A matrix product picks candidates, with some to spare; their cosines are added in order, as functions/vectors.py does.
    """
    long_q, long_x = (np.sqrt(_ordered(zip(m.T, m.T))) for m in (q, x))
    near, found = unit(x).T, []
    for at in range(0, len(q), STEP):
        s = unit(q[at : at + STEP]) @ near
        least = np.partition(s, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(s), -np.inf)
        rows, cols = np.nonzero(s >= least[:, None] - 1e-9)
        rows = rows + at
        n = long_q[rows] * long_x[cols]
        score = np.where(n == 0, 0.0, _ordered((q[rows, j], x[cols, j]) for j in range(q.shape[1])) / np.where(n == 0, 1, n))
        order = np.lexsort((cols, -score, rows))
        first = np.searchsorted(rows, rows)  # rows are in order before and after the sort
        kept = order[np.arange(len(rows)) - first < k]
        found.append((rows[kept], cols[kept], score[kept]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _met(asked: DataFrame, held: DataFrame, by: list[str], k: int, key: str) -> DataFrame:
    """(query_id, key, score): the k best of each query among the vectors that share its group `by`; groups are of bounded size."""
    kind, qkind = held.schema[key].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        if not len(q) or not len(x):
            return pa.table({"query_id": q.column("query_id").slice(0, 0), key: x.column(key).slice(0, 0), "score": pa.array([], pa.float64())})
        x = x.sort_by(key)
        rows, cols, score = nearest(matrix(q.column("v")).astype(np.float64), matrix(x.column("v")).astype(np.float64), k)
        return pa.table({"query_id": q.column("query_id").take(pa.array(rows)), key: x.column(key).take(pa.array(cols)), "score": pa.array(score)})

    both = asked.select("query_id", "v", *by).groupBy(*by).cogroup(held.select(key, "v", *by).groupBy(*by))
    return both.applyInArrow(run, f"query_id {qkind}, {key} {kind}, score double")


def _part(key: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key, "v"), parts).cast("int")


def exact(queries: DataFrame, vectors: DataFrame, k: int, key: str = "node_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank): cosine of every query with every vector; zero where one has no length.

    Queries and vectors are rows throughout. Both are dealt into parts of bounded size by a hash, each part of the one meets each of
    the other in a task of its own, and what is shuffled then is k rows for each query and part.
    """
    asked = queries.select("query_id", F.col(vector).alias("v")).where("v is not null")
    held = vectors.select(key, F.col(vector).alias("v")).where("v is not null")
    qs, xs = -(-asked.count() // QUERIES) or 1, -(-held.count() // VECTORS) or 1
    asked = asked.withColumn("_q", _part("query_id", F.lit(qs))).withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(xs - 1))))
    held = held.withColumn("_x", _part(key, F.lit(xs))).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(qs - 1))))
    return top(_met(asked, held, ["_q", "_x"], k, key), k, key)


def cells(vectors: DataFrame, count: int, sample: int = 20_000, rounds: int = 8, key: str = "node_id", vector: str = "embedding") -> np.ndarray:
    """Centres of `count` cells by spherical k-means over at most `sample` vectors, those whose keys hash lowest."""
    rows = vectors.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(key)).limit(sample).select(doubles(F.col(vector)).alias("v")).collect()
    x = unit(np.array([r["v"] for r in rows]))
    c = x[np.random.default_rng(5).permutation(len(x))[:count]]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c = np.where(np.bincount(own, minlength=len(c))[:, None] > 0, unit(sums), c)
    return c


def in_cells(vectors: DataFrame, centres: np.ndarray, key: str = "node_id", vector: str = "embedding", best: int = 1) -> DataFrame:
    """vectors with a row for each of their `best` nearest cells in the column cell."""
    rows = vectors.select(key, doubles(F.col(vector)).alias("v")).where(F.col("v").isNotNull())

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = unit(matrix(b.column(1)))
            near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :best]
            at = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(near.ravel(), pa.int32())], [key, "v", "cell"])

    return rows.mapInArrow(run, f"{key} {vectors.schema[key].dataType.simpleString()}, v array<double>, cell int")


def approximate(queries: DataFrame, vectors: DataFrame, k: int, centres: np.ndarray, probes: int = 12, key: str = "node_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank) among the vectors of each query's `probes` nearest cells; every vector is indexed."""
    index = in_cells(vectors, centres, key, vector)
    asked = in_cells(queries, centres, "query_id", vector, probes)
    size = asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("_qs")).join(index.groupBy("cell").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("_xs")), "cell")
    size = F.broadcast(size)  # a row for each cell
    asked = asked.join(size, "cell").withColumn("_q", _part("query_id", F.col("_qs"))).withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_xs") - 1)))
    held = index.join(size, "cell").withColumn("_x", _part(key, F.col("_xs"))).withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_qs") - 1)))
    return top(_met(asked, held, ["cell", "_q", "_x"], k, key), k, key)
