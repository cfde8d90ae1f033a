"""Byte-balanced contiguous shards from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orefall.llm.common import stash

SHARDS = 8


def shard_by_bytes(df: DataFrame, text: str = "text", key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """One row for each row of df: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows are put in one global order (digest of the text, key), in which equal texts stand together. Each range partition's
    total goes to the driver, and the running sums of those totals turn local prefix sums into global ones. A shard takes the
    groups of equal texts whose middle byte lies in its equal share of all bytes, so that shards are contiguous, no group is
    cut, and a shard misses its target by half a group at most. slot is the row's place in its shard.

    Null text counts as empty, with size 1. Rows without a key come first in their group; the order of rows that repeat key
    and text is arbitrary but they get different slots. More shards than groups leave some shards empty. An empty table gives
    no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The key is part of the order, so that a text which very many rows share is dealt out over several partitions.
    rows = df.select(F.col(key).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.md5(t.cast("binary")).alias("_group"))
    placed = stash(rows.repartitionByRange(parts, "_group", "doc_id").withColumn("_part", F.spark_partition_id()), "shard-rows")
    # One row for each partition: its size is the number of partitions, whatever the rows.
    totals = placed.groupBy("_part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).orderBy("_part").collect()
    before, b, n = [], 0, 0
    for r in totals:
        before.append((r["_part"], b, n))
        b, n = b + r["b"], n + r["n"]
    offsets = spark.createDataFrame(before, "_p int, _b0 long, _n0 long")
    here = W.partitionBy("_part").orderBy("_group", "doc_id")
    summed = (
        placed.withColumns({"_b": F.sum("size").over(here.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"), "_n": F.row_number().over(here) - 1})
        .join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
        .withColumns({"_b": F.col("_b") + F.col("_b0"), "_n": F.col("_n") + F.col("_n0")})
        .drop("_p", "_b0", "_n0")
    )
    groups = summed.groupBy("_group").agg(F.min("_b").alias("start"), F.sum("size").alias("bytes"), F.min("_n").alias("first"))
    share = F.least(F.lit(shards - 1), F.floor((F.col("start") * 2 + F.col("bytes")) * F.lit(shards) / F.lit(max(1, 2 * b)))).cast("int")
    cuts = groups.groupBy(share.alias("shard")).agg(F.min("_group").alias("g"), F.min("first").alias("n")).orderBy("shard").collect()
    shard, slot = F.lit(0), F.col("_n")
    for c in cuts:  # at most `shards` of them
        shard = F.when(F.col("_group") >= c["g"], F.lit(c["shard"])).otherwise(shard)
        slot = F.when(F.col("_group") >= c["g"], F.col("_n") - F.lit(c["n"])).otherwise(slot)
    return summed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
