"""Importance resampling towards a target distribution: hashed word features, bucket gains, and a draw by perturbed weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orefall.llm.common import discard, stash

BUCKETS = 10_000
#: Seed of the draw, the share drawn in per cent, and the words that a document needs to take part.
SEED, PER_CENT, LEAST_WORDS = "2024", 10, 20
#: Characters of words once A to Z are lower-cased: digits, letters a to z, and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order; null has none. Where bytes and characters are as many, lower() changes A to Z alone."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def features(w: Column, runs: int = 1) -> Column:
    """All runs of 1 to `runs` consecutive words, joined by one space, repeats kept."""

    def of(n: int) -> Column:
        first = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(first, lambda i: F.array_join(F.slice(w, i, n), " "))

    return F.concat(w, *[of(n) for n in range(2, runs + 1)]) if runs > 1 else w


def buckets(f: Column, n: int = BUCKETS) -> Column:
    return F.transform(f, lambda x: (F.crc32(x.cast("binary")) % n).cast("int"))


def bucket_counts(df: DataFrame, text: str, n_buckets: int = BUCKETS, runs: int = 1) -> DataFrame:
    """(bucket, n): features of all rows by bucket. Tasks sum what they have read, so that their totals alone are shuffled."""
    return df.select(F.explode(buckets(features(words(F.col(text)), runs), n_buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(df: DataFrame, target: DataFrame, text: str, target_text: str, n_buckets: int = BUCKETS, runs: int = 1) -> list[int]:
    """For each bucket the thousandfold log ratio of its smoothed shares in target and in df, rounded down.

    n_buckets rows reach the driver, whatever the tables hold.
    """
    s, t = bucket_counts(df, text, n_buckets, runs), bucket_counts(target, target_text, n_buckets, runs)
    both = s.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(t.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    seen = {r["bucket"]: (r["s"], r["t"]) for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()}
    all_s, all_t = (sum(x[i] for x in seen.values()) for i in (0, 1))
    one = df.sparkSession.createDataFrame([(k, *seen.get(k, (0, 0))) for k in range(n_buckets)], "bucket int, s long, t long").coalesce(1)
    ratio = (F.col("t") + 1).cast("double") * float(all_s + n_buckets) / ((F.col("s") + 1).cast("double") * float(all_t + n_buckets))
    return [r["gain"] for r in one.select("bucket", F.floor(F.ln(ratio) * 1000).cast("long").alias("gain")).orderBy("bucket").collect()]


def weights(df: DataFrame, gain: list[int], text: str = "text", key: str = "doc_id", runs: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains of a row's features, without a row for each feature."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # one literal once the optimizer has folded it
    rows = df.select(F.col(key).alias("doc_id"), words(F.col(text)).alias("w"))
    f = features(F.col("w"), runs)
    total = F.aggregate(buckets(f, len(gain)), F.lit(0).cast("long"), lambda a, b: a + F.element_at(table, b + 1))
    return rows.select("doc_id", F.size("w").alias("n_words"), F.size(f).cast("long").alias("n_features"), total.alias("weight"))


def perturbed(weight: Column, key: Column, seed: str = SEED) -> Column:
    """weight plus a thousandfold Gumbel draw, which the digest of seed and key decides."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with rank: 1, 2, 3... for the per_cent of the eligible rows that score highest.

    Ties go to the smaller doc_id, rows without one last. Rows are range-partitioned by that order; running sums of the
    partitions' totals, one row each, turn places within partitions into global ones.
    """
    spark = scored.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    eligible = F.col("n_words") >= least_words
    order = [F.when(eligible, -F.col("score")).asc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    dealt = stash(scored.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "importance-rows")
    totals = dealt.groupBy("_part").agg(F.count_if(eligible).alias("n")).orderBy("_part").collect()
    before, n = [], 0
    for r in totals:
        before.append((r["_part"], n))
        n += r["n"]
    offsets = spark.createDataFrame(before, "_p int, _before long")  # a row for each partition
    here = F.row_number().over(W.partitionBy("_part").orderBy(*order)) + F.col("_before")
    rank = F.when(eligible & (F.col("_place") <= per_cent * n // 100), F.col("_place")).cast("long")
    return dealt.join(F.broadcast(offsets), F.col("_part") == F.col("_p")).withColumn("_place", here).withColumn("rank", rank).drop("_part", "_p", "_before", "_place")


def resample(df: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text", runs: int = 1) -> DataFrame:
    """One row for each row of df: doc_id, n_features, weight, score, rank (null if not drawn).

    Null text has no features, and a document without any has weight 0; such rows and all with fewer than LEAST_WORDS words take
    no part in the draw. Whole texts are read, very long ones too. Rows that repeat a key have equal scores if their texts are
    equal, and different ranks in arbitrary order; a null key counts as the empty one and comes last among ties. An empty target
    leaves gains that only favour rare buckets; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    gain = gains(df, target, text, target_text, runs=runs)
    # Narrow rows are written once: the range partitioning reads its input twice, which would score every text again.
    scored = stash(weights(df, gain, text, key, runs).withColumn("score", perturbed(F.col("weight"), F.col("doc_id"))), "importance-scores")
    out = ranked(scored).select("doc_id", "n_features", "weight", "score", "rank")
    discard(scored)
    return out
