"""Retrieval modes side by side: the rankings of all arms over one pool, their metrics, and what a mode makes worse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefall.operators import fusion, providers

#: Depths at which rankings are measured, and the mean reciprocal rank from which a category counts as solved (fixed values).
DEPTHS, SOLVED = (3, 5, 10), 0.999


def rankings(arms: dict[str, DataFrame], nodes: DataFrame, queries: DataFrame, k: int, pool: int, mmr_weight: float | None = None, rerank=None) -> DataFrame:
    """(arm, query_id, node_id, rank): the k best of vector, keyword, hybrid, hybrid+rerank, and with a weight hybrid+mmr.

    arms: dense and keyword candidates (query_id, node_id, score, rank), each computed once for all modes. Of nodes with equal
    content (nodes.hash) the best one stays in each ranking. The reranker, by default the share of common tokens, and MMR order
    the same `pool` of hybrid candidates, one question's pool at a time.
    """
    lists = {"vector": arms["dense"], "keyword": arms["keyword"], "hybrid": fusion.rrf(arms, tie="keyword")}
    every = reduce(DataFrame.union, [one.select(F.struct(F.lit(arm).alias("arm"), "query_id").alias("list"), "node_id", F.col("rank").cast("long").alias("rank")) for arm, one in lists.items()])
    one = fusion.keep_first(every.join(nodes.select("node_id", "hash"), "node_id"), "hash", key="list").select("list.arm", "list.query_id", "node_id", "rank")
    hybrid = one.where((F.col("arm") == "hybrid") & (F.col("rank") <= pool)).select("query_id", "node_id", "rank").join(nodes, "node_id")
    out = one.union(providers.reranked(hybrid, queries, rerank).select(F.lit("hybrid+rerank"), "query_id", "node_id", "rank"))
    if mmr_weight is not None:
        out = out.union(fusion.mmr(hybrid, k, mmr_weight).select(F.lit("hybrid+mmr"), "query_id", "node_id", F.col("mmr_rank")))
    return out.where(F.col("rank") <= k)


def measured(judged: DataFrame, need: DataFrame, arms: list[str], depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """(arm, query_id, n, reciprocal_rank, and for each depth d recall_d, ndcg_d, hit_d, complete_d), in one aggregate.

    judged: arm, query_id, rank, relevant. need: query_id and n, its number of relevant nodes. A question for which an arm finds
    nothing counts as zero there, and one without relevant nodes has recall and NDCG one.
    """
    hit = F.col("relevant")
    sums = [F.min(F.when(hit, F.col("rank"))).alias("first")]
    for d in depths:
        top = hit & (F.col("rank") <= d)
        sums += [F.count_if(top).alias(f"h{d}"), F.sum(F.when(top, F.lit(1.0) / F.log2(F.col("rank") + 1))).alias(f"g{d}")]
    asked = need.select("query_id", "n", F.explode(F.array(*map(F.lit, arms))).alias("arm"))
    rows = asked.join(judged.groupBy("arm", "query_id").agg(*sums), ["arm", "query_id"], "left")
    n, out = F.col("n"), []
    for d in depths:
        h = F.coalesce(f"h{d}", F.lit(0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(d)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1))
        out += [F.when(n == 0, 1.0).otherwise(h / n).alias(f"recall_{d}"), F.when(n == 0, 1.0).otherwise(F.coalesce(f"g{d}", F.lit(0.0)) / ideal).alias(f"ndcg_{d}")]
        out += [(h > 0).cast("double").alias(f"hit_{d}"), (h == n).cast("double").alias(f"complete_{d}")]
    return rows.select("arm", "query_id", "n", F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), *out)


def summary(metrics: DataFrame) -> DataFrame:
    """(arm, queries, mrr, and the mean of each metric)."""
    means = [F.round(F.avg(c), 6).alias("mrr" if c == "reciprocal_rank" else c) for c in metrics.columns[3:]]
    return metrics.groupBy("arm").agg(F.count("*").alias("queries"), *means)


def by_category(metrics: DataFrame, categories: DataFrame, before: str = "vector", after: str = "hybrid") -> DataFrame:
    """(category, queries, one mean reciprocal rank for each arm of before, keyword and after, gain, broken).

    categories: query_id, category. gain is after less before; a category is broken that `before` solves and `after` doesn't.
    """
    modes = list(dict.fromkeys((before, "keyword", after)))
    rows = metrics.where(F.col("arm").isin(modes)).join(categories, "query_id")
    mean = {m: F.avg(F.when(F.col("arm") == m, F.col("reciprocal_rank"))) for m in modes}
    table = rows.groupBy("category").agg(F.count_if(F.col("arm") == before).alias("queries"), *[F.round(x, 6).alias(m) for m, x in mean.items()], F.round(mean[after] - mean[before], 6).alias("gain"))
    return table.withColumn("broken", (F.col(before) >= SOLVED) & (F.col(after) < SOLVED))
