"""Benchmark decontamination: short test items are searched for inside long documents, in DataFrame operations only.

Jaccard similarity says little when a short item lies inside a long document, so minima are taken of the item alone: if a
document holds a share t of an item's shingles, it lacks all of k independent minima of the item with a chance of about
(1 - t) ** k, however long the document is. Items are partitioned by size: a partition has its own number of minima, small
items are searched by all their shingles, and documents with too few shingles to hold an item aren't compared with it.

The minima of a block of items are a small table that the shingles of each document are looked up in, where they are made: the
lookup is a broadcast hash join, whose build side is bounded by BLOCK, so that documents are never shuffled and neither a
frequent passage nor a document that holds many items gathers rows anywhere. Items of equal shingles are searched as one, so that
repeats of a benchmark row add nothing to a block; their keys are joined back to what was found. A hit is verified in its row by exact containment,
once for each document and item: at the first of the item's minima that the document has. A larger benchmark is searched in
several blocks, each a pass over the documents; nothing of the items goes to the driver but their number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefall.llm.common import NEAR, WORDS, rows_again, stash, whole_row

#: Size partitions: items of up to so many shingles have so many minima. Items in the first are searched by all shingles.
PARTITIONS = ((8, 8), (64, 8), (512, 12), (1 << 62, 16))
#: 64-bit numbers (minima and shingles) that the items of one block have together, about; a longer item is a block of its own.
BLOCK = 1 << 21


def pinned(c: Column) -> Column:
    """c, marked so that Catalyst computes it once where it stands and never copies it into filters above or below."""
    return F.when(F.spark_partition_id() >= 0, c)


def words_of(text: Column) -> Column:
    """Lower-cased words, longest runs of letters and numbers; null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, width: int) -> Column:
    """Distinct 64-bit hashes of all runs of `width` words."""
    runs = F.transform(words, lambda _, i: F.xxhash64(F.lit(width), *[F.get(words, i + k) for k in range(width)]))
    return F.array_distinct(F.slice(runs, 1, F.greatest(F.size(words) - (width - 1), F.lit(0))))


def minima(shingles: Column) -> Column:
    """The shingles by which an item is searched: the least under each of its partition's hash functions, or all of few."""

    def least(k: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.array_min(F.transform(shingles, lambda h: F.struct(F.xxhash64(h, i).alias("r"), h.alias("h"))))["h"])

    out = shingles
    for (below, _), (most, k) in zip(PARTITIONS, PARTITIONS[1:]):
        out = F.when((F.size(shingles) > below) & (F.size(shingles) <= most), F.array_distinct(least(k))).otherwise(out)
    return out


def indexed(items: DataFrame, item_key: str, item_text: str, words: int) -> DataFrame:
    """(item, width, shingles, minima) of the items with words; an item of fewer than `words` words has its own width."""
    w = F.col("_w")
    rows = items.select(F.col(item_key).alias("item"), pinned(words_of(F.col(item_text))).alias("_w")).where(F.size(w) > 0)
    made = F.coalesce(*[F.when(F.size(w) >= n if n == words else F.size(w) == n, shingles_of(w, n)) for n in range(1, words + 1)])
    rows = rows.select("item", F.least(F.size(w), F.lit(words)).alias("width"), pinned(made).alias("shingles"))
    return rows.withColumn("minima", pinned(minima(F.col("shingles"))))


def _hits(docs: DataFrame, items: DataFrame, width: int, share: float) -> DataFrame:
    """(doc columns, item, n_found, n_shingles) for a block of items of one width. docs has _words and columns of its own."""
    own = [c for c in docs.columns if c != "_words"]
    least = items.select(F.explode("minima").alias("_at"), "item", "minima", "shingles")
    rows = docs.withColumn("_sh", pinned(shingles_of(F.col("_words"), width)))
    met = rows.select(*own, "_sh", F.explode("_sh").alias("_h")).join(F.broadcast(least), F.col("_h") == F.col("_at"))
    met = met.where((F.size("_sh") >= F.lit(share) * F.size("shingles") - 1e-9) & (F.get(F.array_intersect("minima", "_sh"), F.lit(0)) == F.col("_h")))
    found = met.select(*own, "item", pinned(F.size(F.array_intersect("shingles", "_sh"))).alias("n_found"), F.size("shingles").alias("n_shingles"))
    return found.where(F.col("n_found") >= F.lit(share) * F.col("n_shingles") - 1e-9)


def _found(docs: DataFrame, items: DataFrame, item_key: str, item_text: str, share: float, words: int, named: bool = True) -> DataFrame:
    """_hits of all items, or (not named) of the distinct sets of shingles, told by digests. docs: the columns to keep and _text."""
    known = indexed(items, item_key, item_text, words).withColumn("shingles", F.array_sort("shingles"))
    known = stash(known.withColumn("same", F.sha2(F.concat_ws(",", "width", F.col("shingles").cast("array<string>")), 256)), "items")
    index = known.dropDuplicates(["same"]).select(F.col("same").alias("item"), "width", "shingles", "minima", F.xxhash64("same").alias("block"))
    sizes = index.groupBy("width").agg(F.sum(F.size("shingles") * F.size("minima") + F.size("minima") * (F.size("minima") + 1)).alias("n")).collect()  # at most `words` rows
    rows = docs.select(*[c for c in docs.columns if c != "_text"], pinned(words_of(F.col("_text"))).alias("_words"))
    out = None
    for width, n in sorted(tuple(r) for r in sizes):
        blocks = math.ceil(n / BLOCK)
        for i in range(blocks):
            part = index.where((F.col("width") == width) & (F.pmod("block", F.lit(blocks)) == i))
            hit = _hits(rows, part, width, share)
            out = hit if out is None else out.unionByName(hit)
    if out is None:
        out = docs.drop("_text").limit(0).select("*", F.lit("").alias("item"), F.lit(0).alias("n_found"), F.lit(0).alias("n_shingles"))
    if not named:
        return out
    keys = known.select(F.col("same").alias("_same"), F.col("item").alias("_key"))
    return out.join(keys, F.col("item") == F.col("_same")).drop("item", "_same").withColumnRenamed("_key", "item")


def digest_of(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def find_leaks(df: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", share: float = NEAR, words: int = WORDS) -> DataFrame:
    """One row for each document and benchmark item of which its text holds `share` or more of the shingles: doc_id, item_id,
    n_found, n_shingles, containment.

    An item of fewer than `words` words is one shingle of all its words. Items without words (null, empty) are in no text; null
    and empty texts hold no item. Whole texts are searched, however long. Repeated documents and repeated items have rows of
    their own each, null keys stay null, a share that is just reached counts. Empty tables on either side give no rows; other
    columns are ignored, whatever their names.
    """
    found = _found(df.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")), items, item_key, item_text, share, words)
    return found.select("doc_id", F.col("item").alias("item_id"), F.col("n_found").cast("long").alias("n_found"), F.col("n_shingles").cast("long").alias("n_shingles"), (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def drop_leaks(df: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = NEAR, words: int = WORDS) -> DataFrame:
    """The rows of df whose text holds no item of the benchmark, with all their columns, whatever their names.

    Rows are told by SHA-256 of their text: equal texts hold the same items. Null and empty texts stay, repeated rows stay or go
    together, null keys don't matter; without items all rows stay, and an empty table gives none.
    """
    found = _found(df.select(F.col(text).alias("_text"), digest_of(text).alias("_digest")), items, item_key, item_text, share, words, named=False)
    gone = stash(found.select("_digest").distinct(), "leaks")
    plain = df.select(whole_row(df), digest_of(text).alias("_digest"))
    return rows_again(plain.join(gone, "_digest", "left_anti"), df.columns)
