"""Document registry, queue and session transitions as pure functions of snapshots and a point in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Snapshot after an upload: (source_name, filename, content_hash, version, status, change).

    The same content is no change; other content raises the version and goes back to the queue; new files begin at one.
    """
    old = current.select("source_name", "filename", F.col("content_hash").alias("old"), F.col("version").alias("v"), F.col("status").alias("s"))
    new = incoming.select("source_name", "filename", F.col("content_hash").alias("new"))
    rows = old.join(new, ["source_name", "filename"], "full_outer")
    change = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull() | (F.col("new") == F.col("old")), "unchanged").otherwise("updated")
    return rows.select(
        "source_name",
        "filename",
        F.coalesce("new", "old").alias("content_hash"),
        (F.coalesce("v", F.lit(0)) + F.when(change == "unchanged", 0).otherwise(1)).cast("long").alias("version"),
        F.when(change == "unchanged", F.col("s")).otherwise("uploaded").alias("status"),
        change.alias("change"),
    )


def due(asof: Column) -> Column:
    """Uploaded and available, or processing with a lease that has run out."""
    return ((F.col("status") == "uploaded") & (F.col("available_at") <= asof)) | ((F.col("status") == "processing") & (F.col("lease_until") < asof))


def claim(queue: DataFrame, asof: Column, n: int = 1) -> DataFrame:
    """The next n jobs of a queue."""
    return queue.where(due(asof)).orderBy("available_at", "created_at", "job_id").limit(n)


def failure(attempts: Column, coded: Column, most: int = 3, base: int = 5) -> tuple[Column, Column]:
    """Status after a failed attempt, and the seconds until the next: coded errors are final, others wait twice as long each time."""
    status = F.when(coded, "failed").when(attempts >= most, "dead_letter").otherwise("uploaded")
    return status, F.when(status == "uploaded", F.pow(F.lit(2), F.greatest(attempts - 1, F.lit(0))) * base)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def archived(runs: DataFrame, asof: Column, seconds: int = 900) -> DataFrame:
    """Runs that have been running for too long are failed."""
    stale = (F.col("status") == "running") & (F.col("started_at") < asof - F.make_interval(secs=F.lit(seconds)))
    return runs.withColumn("status", F.when(stale, "failed").otherwise(F.col("status")))


def audit(registry: DataFrame, dense: DataFrame, sparse: DataFrame, key: str = "node_id") -> DataFrame:
    """(kind, key) of rows that one side has and another lacks."""
    sides = {"registry": registry, "dense": dense, "sparse": sparse}
    out = None
    for a, b in (("registry", "dense"), ("registry", "sparse"), ("dense", "registry"), ("sparse", "registry"), ("dense", "sparse")):
        one = sides[a].select(key).distinct().join(sides[b].select(key).distinct(), key, "left_anti").select(F.lit(f"{a}_without_{b}").alias("kind"), key)
        out = one if out is None else out.union(one)
    return out


def backfill(rows: DataFrame, candidates: DataFrame, keys: list[str], target: str) -> DataFrame:
    """rows with the target that their natural key names, and link: linked for one match, ambiguous for more, unmatched for none."""
    n = candidates.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(target).alias("_one"))
    joined = rows.join(n, keys, "left")
    return joined.select(*rows.columns, F.when(F.col("_n") == 1, F.col("_one")).alias(target), F.when(F.col("_n") == 1, "linked").when(F.col("_n") > 1, "ambiguous").otherwise("unmatched").alias("link"))
