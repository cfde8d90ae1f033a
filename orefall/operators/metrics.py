"""Ranking metrics, run dashboards, rater agreement, calibration and regression gates as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """Null where nothing was counted."""
    return F.when(b > 0, a / b)


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, precision, hit, complete, reciprocal_rank, ndcg) at k.

    ranked: query_id, doc, rank. relevant: query_id, doc. A query without relevant documents has recall and NDCG one.
    """
    need = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    known = relevant.select("query_id", "doc", F.lit(True).alias("relevant")).distinct()
    return judged_metrics(ranked.join(known, ["query_id", "doc"], "left"), need, k)


def judged_metrics(judged: DataFrame, need: DataFrame, k: int) -> DataFrame:
    """The same from a ranking that says which documents are relevant, and how many each query has.

    judged: query_id, rank, relevant (null counts as false). need: query_id, n.
    """
    hit, top = F.col("relevant"), F.col("relevant") & (F.col("rank") <= k)
    gain = F.lit(1.0) / F.log2(F.col("rank") + 1)
    found = judged.groupBy("query_id").agg(F.count_if(top).alias("h"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.when(top, gain)).alias("dcg"))
    rows = found.join(need, "query_id", "left")
    n, h = F.coalesce("n", F.lit(0)), F.coalesce("h", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1))
    return rows.select(
        "query_id",
        F.when(n == 0, 1.0).otherwise(h / n).alias("recall"),
        (h / F.lit(k)).alias("precision"),
        (h > 0).cast("double").alias("hit"),
        (h == n).cast("double").alias("complete"),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(n == 0, 1.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )


def dashboard(runs: DataFrame) -> DataFrame:
    """Counts by status, latency percentiles, feedback rate of runs (status, latency_ms, rating, tokens)."""
    n = F.count("*")
    ok = F.count_if(F.col("status") == "succeeded")
    bad = F.count_if(F.col("status") == "failed")
    done = F.col("status") == "succeeded"
    return runs.agg(
        n.alias("runs"), ok.alias("succeeded"), bad.alias("failed"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("rating") > 0).alias("positive"), F.count_if(F.col("rating") < 0).alias("negative"),
        F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY latency_ms) FILTER (WHERE status = 'succeeded')").alias("p50"),
        F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY latency_ms) FILTER (WHERE status = 'succeeded')").alias("p95"),
        F.round(F.avg(F.when(done, F.col("latency_ms"))), 6).alias("mean"), F.sum("tokens").alias("tokens"), F.round(ratio(ok, ok + bad), 6).alias("success_rate"), F.round(ratio(F.count("rating"), n), 6).alias("feedback_rate"),
    )


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa and exact agreement of two raters; kappa is null where chance agrees always."""
    cells = pairs.groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").cast("double").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    ra, rb = cells.groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("x")), cells.groupBy(F.col("b").alias("v")).agg(F.sum("n").alias("y"))
    chance = ra.join(rb, "v").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("c"))
    po, pe = F.col("same") / F.col("n"), F.col("c") / (F.col("n") * F.col("n"))
    return total.crossJoin(F.broadcast(chance)).select(F.round(F.when(pe < 1, (po - pe) / (1 - pe)), 6).alias("kappa"), F.round(po, 6).alias("agreement"))  # one row each


def calibrate(rows: DataFrame, score: str = "score", answerable: str = "answerable") -> DataFrame:
    """The threshold below which most unanswerable questions and no answerable one falls; of equal ones the highest.

    No threshold over the least answerable score is allowed, so that only the distinct scores below it matter, and the midpoint
    between that score and the greatest one below it catches all that any midpoint can catch: two aggregates decide. Without an answerable
    question there is no threshold.
    """
    low = rows.agg(F.min(F.when(F.col(answerable), F.col(score))).alias("floor"))
    below = rows.crossJoin(F.broadcast(low)).where(F.col(score) < F.col("floor"))  # one row
    return below.agg(F.count("*").alias("caught"), ((F.max(score) + F.max("floor")) / 2).alias("threshold")).where("caught > 0")


def gate(baseline: DataFrame, candidate: DataFrame, drop: float = 0.03, slower: float = 1.5) -> DataFrame:
    """(task, metric, base, value, verdict): quality may fall by `drop`, latency rise to `slower` times; missing ones fail."""
    rows = baseline.withColumnRenamed("value", "base").join(candidate, ["task", "metric"], "full_outer")
    fast = F.col("metric") == "p50"
    bad = F.col("base").isNull() | F.col("value").isNull() | F.when(fast, F.col("value") > F.col("base") * slower).otherwise(F.col("base") - F.col("value") > drop + 1e-12)
    return rows.select("task", "metric", "base", "value", F.when(bad, "fail").otherwise("pass").alias("verdict"))
