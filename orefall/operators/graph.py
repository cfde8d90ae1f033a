"""Hops over edges of a graph for many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reached(front: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, reached): how many distinct nodes a have an edge to one of a question's b. front: query_id, b; edges: a, b.

    Nodes with the same set of b are reached by the same questions, and are counted once for all of them: a question meets sets,
    not the nodes, of which a frequent b has a share of the whole table.
    """
    sets = edges.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("bs")).groupBy("bs").agg(F.count("*").alias("n"))
    met = front.select("query_id", "b").distinct().join(sets.select(F.explode("bs").alias("b"), "bs", "n"), "b").select("query_id", "bs", "n").distinct()
    return met.groupBy("query_id").agg(F.sum("n").alias("reached"))
