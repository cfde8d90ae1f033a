"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Copies are removed inside each input partition first (the partial aggregate), the survivors of a digest meet per salt,
and the winners of the salts meet once more. Every stage groups by the digest and by the full text, so that no two texts
are taken for equal because of a digest. A text that a third of all rows share reaches each stage once for each
partition or salt, never row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orefall.llm.common import quoted, stash

SALTS = 16


def _combined(keyed: DataFrame, aggs: list, again: list) -> DataFrame:
    """keyed has _digest, _salt and _text; aggs make a salt's winner and again the winner of the salts."""
    salted = keyed.groupBy("_digest", "_salt", "_text").agg(*aggs)
    return salted.groupBy("_digest", "_text").agg(*again)


def mark_copies(df: DataFrame, text: str = "text", key: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """One row for each row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; whole texts are compared, very long ones too. Rows are told their group by digest only after it has
    been seen that no two texts share it; texts that do are told apart by themselves. Of equal texts the row with the largest key
    stays, rows without a key come last; keep_id is null only where no row of a group has a key. Of rows that repeat key and text exactly one is kept. An empty table gives
    an empty result; other columns of df are ignored, whatever their names.
    """
    base = df.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    keyed = base.withColumns({"_digest": F.sha2("_text", 256), "_salt": F.pmod(F.spark_partition_id(), F.lit(salts))})
    aggs = [F.max("_id").alias("_keep"), F.count("*").alias("_n")], [F.max("_keep").alias("keep_id"), F.sum("_n").alias("group_size")]
    won = stash(_combined(keyed, *aggs).select(F.col("_digest").alias("_wd"), "keep_id", "group_size"), "winners")
    # The winners are one for each text. A digest that only one of them has stands for its text exactly; others need the texts.
    shared = won.groupBy("_wd").count().where("count > 1").select(F.col("_wd").alias("_sd"))
    rows = keyed.select("_id", "_digest")
    if shared.isEmpty():
        # The join has the hot digests on its left side only, where Spark splits large partitions.
        marked = rows.join(won, F.col("_digest") == F.col("_wd")).withColumn("_print", F.lit(0).cast("long"))
    else:
        one = won.join(shared, F.col("_wd") == F.col("_sd"), "left_anti")
        marked = rows.join(one, F.col("_digest") == F.col("_wd")).withColumn("_print", F.lit(0).cast("long"))
        few = keyed.join(shared, F.col("_digest") == F.col("_sd"), "left_semi")
        again = _combined(few, *aggs).select(F.col("_digest").alias("_wd"), F.col("_text").alias("_wt"), "keep_id", "group_size")
        told = few.join(again, (F.col("_digest") == F.col("_wd")) & (F.col("_text") == F.col("_wt")))
        marked = marked.union(told.select("_id", "_digest", "_wd", "keep_id", "group_size", F.xxhash64("keep_id", "_text").alias("_print")))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nth = W.partitionBy("_digest", "_print", "_id").orderBy(F.lit(1))
    return (
        marked.repartition(parts, "_digest", "_print", "_id")
        .withColumn("_nth", F.row_number().over(nth))
        .select(
            F.col("_id").alias("doc_id"),
            "keep_id",
            "group_size",
            (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_nth") == 1)).alias("kept"),
            F.col("_digest").alias("text_sha256"),
        )
    )


def drop_copies(df: DataFrame, text: str = "text", key: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """The rows of df that stay, with all their columns: of equal texts the one with the largest key.

    Null text equals empty text; rows without a key come last; of rows with the same key and text the one with the greatest
    xxhash64 of all columns stays. Whole texts are compared, very long ones too. An empty table gives an empty one; other columns
    may have any names.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    every = [F.col(quoted(c)) for c in df.columns]
    keyed = df.select(
        F.sha2(t, 256).alias("_digest"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"),
        t.alias("_text"),
        F.struct(F.col(key).isNotNull().alias("has"), F.col(key).alias("id"), F.xxhash64(*every).alias("row")).alias("_order"),
        F.struct(*[c for c, n in zip(every, df.columns) if n != text], F.col(text).isNull().alias("_null_text")).alias("_rest"),
    )
    won = _combined(
        keyed,
        [F.max_by("_rest", "_order").alias("_rest"), F.max("_order").alias("_order")],
        [F.max_by("_rest", "_order").alias("_rest")],
    )
    kept_text = F.when(~F.col("_rest._null_text"), F.col("_text"))
    return won.select(*[(kept_text if c == text else F.col(f"_rest.{quoted(c)}")).alias(c) for c in df.columns])
