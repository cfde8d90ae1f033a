"""Where queries and their SQL are registered, and the views both are written against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefall.config import User
from orefall.functions.text import collapsed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The caller of the registered queries.
CALLER = User("u1", "caller")


def register(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as child nodes: owner and visibility follow from the number of the source."""
    n = F.substring("source", 4, 10).cast("int")
    return t(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("node_id"),
        F.concat("lang", F.lit("-"), "doc_id", F.lit(".md")).alias("filename"),
        F.col("source").alias("source_name"),
        F.concat(F.lit("u"), n % 5).alias("owner_id"),
        F.when(n % 3 == 0, "private").otherwise("public").alias("visibility"),
        F.col("text").alias("content"),
        "lang",
        (F.col("doc_id") % 4 + 1).alias("version"),
        F.when(F.col("doc_id") % 10 == 7, "failed").when(F.col("doc_id") % 10 == 3, "processing").otherwise("ready").alias("status"),
    )


def seen_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orefall.operators.access import visible

    return visible(nodes(spark, sf_dir), CALLER)


NODES = """nodes AS (
    SELECT doc_id AS node_id, lang || '-' || doc_id || '.md' AS filename, source AS source_name, 'u' || (CAST(substr(source, 4) AS INT) % 5) AS owner_id,
        CASE WHEN CAST(substr(source, 4) AS INT) % 3 = 0 THEN 'private' ELSE 'public' END AS visibility, text AS content, lang, doc_id % 4 + 1 AS version,
        CASE WHEN doc_id % 10 = 7 THEN 'failed' WHEN doc_id % 10 = 3 THEN 'processing' ELSE 'ready' END AS status
    FROM documents
)"""
SEEN = NODES + ", seen AS (SELECT * FROM nodes WHERE visibility = 'public' OR owner_id = 'u1')"
#: Latin tokens of a text: compounds whole, then their parts.
TOKENS = "flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+(?:[-_./][a-z0-9]+)*'), lambda w: CASE WHEN regexp_matches(w, '[-_./]') THEN list_concat([w], list_filter(string_split_regex(w, '[-_./]'), lambda p: p <> '')) ELSE [w] END))"
COLLAPSED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as questions, whole."""
    return t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), collapsed(F.col("text")).alias("text"))


QUERY_SET = "queries AS (SELECT item_id AS query_id, " + COLLAPSED.format("text") + " AS text FROM benchmark)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding", F.col("label").cast("long").alias("label"))


def asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector whose id is divisible by 20 is a query against all."""
    return vectors(spark, sf_dir).where("node_id % 20 = 0").select(F.col("node_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


COSINE = "list_sum(list_transform(list_zip({0}, {1}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform({1}, lambda x: CAST(x AS DOUBLE) * x))))"
DENSE = f"""dense AS (
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank
        FROM (SELECT q.vec_id AS query_id, v.vec_id AS node_id, v.label, q.label AS query_label, {COSINE.format('q.embedding', 'v.embedding')} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
    ) WHERE rank <= 10
)"""
BM25 = f"""terms AS (SELECT DISTINCT query_id, unnest({TOKENS.format('text')}) AS term FROM queries),
toks AS (SELECT node_id, {TOKENS.format('content')} AS w FROM seen),
lens AS (SELECT node_id, len(w) AS n FROM toks), total AS (SELECT count(*) AS n, avg(n) AS avg_len FROM lens),
post AS (SELECT node_id, term, count(*) AS freq FROM (SELECT node_id, unnest(w) AS term FROM toks) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (
    SELECT query_id, node_id, sum(ln(1 + (total.n - df + 0.5) / (df + 0.5)) * freq * 2.5 / (freq + 1.5 * (0.25 + 0.75 * lens.n / avg_len))) AS score
    FROM terms JOIN dfs USING (term) JOIN post USING (term) JOIN lens USING (node_id), total GROUP BY query_id, node_id
),
keyword AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS rank FROM bm WHERE score > 0) WHERE rank <= 40)"""
