"""Connected components by alternating large-star and small-star steps; nothing but counts goes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefall.llm.common import discard, stash


#: Edges that one task joins at most; more are dealt out, with the same result.
SMALL = 1 << 13


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict = {}

    def top(x):
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = sorted((top(a), top(b)))
            up.setdefault(a, a)
            up[b] = a
        kinds = [batch.schema.field(0).type] * 2
    rows = [(x, r) for x in up if (r := top(x)) != x]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["node", "root"])


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), any order and repeats. One row (node, root) for each node that isn't its component's least node."""
    if edges.count() <= SMALL:
        kind = edges.schema["a"].dataType.simpleString()
        return stash(edges.select("a", "b").coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}"), "roots")
    e = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stash(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(low, large["a"] == low["k"]).select("a", "b", "m")
        last, e = e, stash(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct(), "small-star")
        discard(last, large)
        # Done when all is stars: no node has two edges down, and none that has one is another's least.
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
