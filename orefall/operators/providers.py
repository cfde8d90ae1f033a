"""Boundaries to models: batched embedding, reranking, hypothetical answers. Offline stand-ins keep everything runnable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orefall.errors import CodedError
from orefall.functions.text import tokens
from orefall.functions.vectors import jaccard

Embedder = Callable[[list[str]], np.ndarray]


def hashed_embedder(dimensions: int = 64) -> Embedder:
    """A stand-in without a model: signed counts of hashed character trigrams at unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dimensions))
        for i, t in enumerate(texts):
            for j in range(max(len(t) - 2, 1)):
                h = zlib.crc32(t[j : j + 3].lower().encode())
                out[i, h % dimensions] += 1 if h & 0x10000 else -1
        n = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(n == 0, 1, n)

    return embed


def embedded(df: DataFrame, text: str, load: Callable[[], Embedder], dimensions: int, batch: int = 16) -> DataFrame:
    """df with a column embedding. The model is loaded once for each task; a wrong number of dimensions is an error."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = load()
        for s in batches:
            parts = [embed(s.iloc[i : i + batch].fillna("").tolist()) for i in range(0, len(s), batch)]
            v = np.concatenate(parts) if parts else np.zeros((0, dimensions))
            if v.shape[1] != dimensions:
                raise CodedError("dimension_mismatch", f"the model gave {v.shape[1]} dimensions, not {dimensions}")
            yield pd.Series(list(v.astype("float32")))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn("embedding", F.pandas_udf(run, "array<float>")(F.col(text)))


def reranked(candidates: DataFrame, queries: DataFrame, score: Callable[[list[str], list[str]], np.ndarray] | None = None) -> DataFrame:
    """candidates (query_id, node_id, rank, content) in a new order by a pair scorer on body texts; the whole pool stays.

    Without a scorer the share of common tokens orders the pool, in the JVM.
    """
    pairs = candidates.join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    if score is None:
        scored = pairs.withColumn("score", jaccard(F.array_distinct(tokens(F.col("question"))), F.array_distinct(tokens(F.col("content")))))
    else:

        def run(q: pd.Series, c: pd.Series) -> pd.Series:
            return pd.Series(np.asarray(score(q.tolist(), c.tolist()), dtype=float))

        run.__annotations__ = {"q": pd.Series, "c": pd.Series, "return": pd.Series}
        scored = pairs.withColumn("score", F.pandas_udf(run, "double")("question", "content"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).drop("question")


def hypothetical(queries: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with a model's hypothetical text before them; without one they stay as they are."""
    return queries.join(answers.select("query_id", "answer"), "query_id", "left").withColumn("text", F.concat_ws("\n", "answer", "text")).drop("answer")
