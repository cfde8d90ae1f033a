"""Derived pages and topics: plans from a model's JSON, staleness, lint, search and numbered references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orefall.functions.text import slug, title
from orefall.operators import lexical
from orefall.operators.cells import folder

PLAN = "array<struct<title: string, summary: string, related: array<string>>>"


def pages(docs: DataFrame) -> DataFrame:
    """One page for each ready document: document_id, title, content, version."""
    return docs.where("status = 'ready'").select("document_id", "source_name", title(F.col("text"), F.col("filename")).alias("title"), F.col("text").alias("content"), "version")


def topics(plans: DataFrame, most: int = 3, related: int = 8) -> DataFrame:
    """(document_id, slug, title, summary, related) from a model's JSON: blank and repeated topics go, lists and titles are cut."""
    rows = plans.select("document_id", F.posexplode(F.from_json("plan", PLAN)).alias("place", "x"))
    rows = rows.select("document_id", "place", F.left(F.trim("x.title"), F.lit(200)).alias("title"), F.trim("x.summary").alias("summary"), F.slice(F.coalesce("x.related", F.expr("cast(array() as array<string>)")), 1, related).alias("related"))
    rows = rows.where("title <> ''").withColumn("slug", slug(F.col("title")))
    one = rows.withColumn("nth", F.row_number().over(W.partitionBy("document_id", "slug").orderBy("place"))).where("nth = 1")
    return one.withColumn("nth", F.row_number().over(W.partitionBy("document_id").orderBy("place"))).where(F.col("nth") <= most).drop("nth", "place")


def stale(page: DataFrame, docs: DataFrame) -> DataFrame:
    """Pages whose document has another version, or none any more."""
    now = docs.select("document_id", F.col("version").alias("now"))
    return page.join(now, "document_id", "left").where(F.col("now").isNull() | (F.col("now") != F.col("version"))).drop("now")


def lint(page: DataFrame, docs: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, n): stale pages, failed documents, pages without a document, pages that no topic links."""
    parts = {
        "stale": page.join(docs.select("document_id", F.col("version").alias("now")), "document_id").where("now <> version"),
        "failed": docs.where("status = 'failed'"),
        "orphan": page.join(docs, "document_id", "left_anti"),
        "unlinked": page.join(links, "document_id", "left_anti"),
    }
    out = None
    for kind, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.union(one)
    return out.where("n > 0")


def search(page: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, document_id, score, rank, reference): BM25 over all tokens with the title counted twice; W1 is the best."""
    text = page.withColumn("body", F.concat_ws(" ", "title", "title", "content"))
    best = lexical.search(queries, text, k, folder(page.sparkSession, "counts"), True, "document_id", "body")
    return best.select("query_id", "document_id", F.round("score", 6).alias("score"), "rank", F.concat(F.lit("W"), "rank").alias("reference"))
