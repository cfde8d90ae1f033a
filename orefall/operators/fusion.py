"""Reciprocal-rank fusion, order-preserving deduplication, and maximal marginal relevance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

K = 60


def rrf(arms: dict[str, DataFrame], k: int = K, tie: str | None = None, key: str = "node_id") -> DataFrame:
    """(query_id, key, score, rank): sum of 1 / (k + rank) over the arms; ties by the arm `tie`'s rank (missing last), then key."""
    rows = None
    for name, arm in arms.items():
        one = arm.select("query_id", key, F.col("rank").cast("long").alias("r"), F.lit(name).alias("arm"))
        rows = one if rows is None else rows.union(one)
    fused = rows.groupBy("query_id", key).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("r"))).alias("score"), F.min(F.when(F.col("arm") == (tie or ""), F.col("r"))).alias("tie_rank"))
    best = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("tie_rank"), F.asc(key))
    return fused.withColumn("rank", F.row_number().over(best).cast("long"))


def keep_first(ranked: DataFrame, by: str, key: str = "query_id", order: str = "rank") -> DataFrame:
    """Of rows of a query that share `by`, the one of the least rank; rows without `by` stay. Ranks are made anew."""
    own = F.coalesce(F.col(by).cast("string"), F.concat(F.lit("\0"), F.col(order).cast("string")))
    first = ranked.withColumn("_n", F.row_number().over(W.partitionBy(key, own).orderBy(order))).where("_n = 1").drop("_n")
    return first.withColumn(order, F.row_number().over(W.partitionBy(key).orderBy(order)).cast("long"))


def mmr(candidates: DataFrame, k: int, weight: float = 0.7, floor: float = 0.85) -> DataFrame:
    """(query_id, node_id, rank, mmr_rank) of the k chosen of each query.

    candidates: query_id, node_id, rank, filename, embedding. A choice is greedy and depends on the ones before, so that each
    query's pool, which the caller's pool size bounds, is worked on as a whole. Relevance is one minus the place over the pool's
    size; redundancy the largest cosine with a chosen one, at least `floor` within a document.
    """
    import numpy as np

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "node_id"]).reset_index(drop=True)
        n = len(pdf)
        if n > k:
            v = np.array(pdf["embedding"].tolist(), dtype=float)
            size = np.sqrt((v * v).sum(axis=1))
            v = v / np.where(size == 0, 1, size)[:, None]
            alike = (v @ v.T).clip(0, 1)
            files = pdf["filename"].to_numpy()
            alike = np.where(files[:, None] == files[None, :], np.maximum(alike, floor), alike)
            relevance, worst, taken = 1 - np.arange(n) / n, np.zeros(n), []
            while len(taken) < k:
                score = weight * relevance - (1 - weight) * worst
                score[taken] = -np.inf
                best = int(np.lexsort((np.arange(n), -relevance, -score))[0])
                taken.append(best)
                worst = np.maximum(worst, alike[best])
            pdf = pdf.loc[taken]
        return pdf.assign(mmr_rank=range(1, len(pdf) + 1))[["query_id", "node_id", "rank", "mmr_rank"]]

    kinds = {c: candidates.schema[c].dataType.simpleString() for c in ("query_id", "node_id", "rank")}
    return candidates.groupBy("query_id").applyInPandas(choose, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", mmr_rank long")
