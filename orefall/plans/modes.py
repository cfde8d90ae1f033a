"""Registered queries that compare retrieval modes, decide on evidence from both arms, and list, transform and upsert whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefall.functions import vectors as V
from orefall.functions.text import content_hash
from orefall.operators import arms, catalogue, lifecycle
from orefall.plans.registry import BM25, CALLER, COLLAPSED, COSINE, NODES, TOKENS, nodes, query_set, register, t, vectors
from orefall.plans.retrieval import Options, Retriever, decision, signals

POOL, TOP = 40, 10
_POOL = Options(top_k=TOP, pool=POOL)

#: Visible nodes and questions that have a vector, the pools of both arms, and their fusion.
POOLS = f"""{NODES}, seen AS (SELECT nodes.*, sha256({COLLAPSED.format('content')}) AS h, embedding AS v, label FROM nodes JOIN embeddings ON vec_id = node_id WHERE visibility = 'public' OR owner_id = 'u1'),
queries AS (SELECT item_id AS query_id, {COLLAPSED.format('text')} AS text, embedding AS qv, label AS qlabel FROM benchmark JOIN embeddings ON vec_id = item_id), {BM25},
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM (SELECT query_id, node_id, {COSINE.format('qv', 'v')} AS score FROM queries, seen)) WHERE rank <= {POOL})"""
ARMS = f"""{POOLS}, fused AS (SELECT query_id, node_id, sum(1.0 / (60 + rank)) AS score, min(tie) AS tie FROM (SELECT query_id, node_id, rank, rank AS tie FROM keyword UNION ALL SELECT query_id, node_id, rank, NULL FROM near) GROUP BY 1, 2),
lists AS (SELECT 'vector' AS arm, query_id, node_id, rank FROM near UNION ALL SELECT 'keyword', query_id, node_id, rank FROM keyword UNION ALL SELECT 'hybrid', query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, tie NULLS LAST, node_id) FROM fused),
firsts AS (SELECT arm, query_id, node_id, row_number() OVER (PARTITION BY arm, query_id ORDER BY rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY arm, query_id, h ORDER BY rank) AS nth FROM lists JOIN seen USING (node_id)) WHERE nth = 1),
pairs AS (SELECT query_id, node_id, rank, list_distinct({TOKENS.format('text')}) AS a, list_distinct({TOKENS.format('content')}) AS b FROM firsts JOIN queries USING (query_id) JOIN seen USING (node_id) WHERE arm = 'hybrid' AND rank <= {POOL}),
again AS (SELECT 'hybrid+rerank' AS arm, query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END DESC, rank) AS rank FROM pairs),
judged AS (SELECT r.*, label = qlabel AS relevant FROM (SELECT * FROM firsts UNION ALL SELECT * FROM again) r JOIN seen USING (node_id) JOIN queries USING (query_id) WHERE rank <= {TOP}),
need AS (SELECT query_id, qlabel, coalesce(c, 0) AS n, arm FROM queries LEFT JOIN (SELECT label, count(*) AS c FROM seen GROUP BY 1) ON label = qlabel, (SELECT unnest(['vector', 'keyword', 'hybrid', 'hybrid+rerank']) AS arm)),
m AS (SELECT arm, query_id, qlabel, n, coalesce(1.0 / first, 0) AS rr, {', '.join(f'coalesce(h{d}, 0) AS h{d}, coalesce(g{d}, 0) AS g{d}' for d in arms.DEPTHS)} FROM need LEFT JOIN (SELECT arm, query_id, min(rank) FILTER (relevant) AS first, {', '.join(f'count(*) FILTER (relevant AND rank <= {d}) AS h{d}, sum(1 / log2(rank + 1)) FILTER (relevant AND rank <= {d}) AS g{d}' for d in arms.DEPTHS)} FROM judged GROUP BY 1, 2) USING (arm, query_id))"""
NAMES = ["vector", "keyword", "hybrid", "hybrid+rerank"]


def pooled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and whole benchmark items that have a vector; relevant is what has the vector label of the question."""
    v = vectors(spark, sf_dir)
    base = nodes(spark, sf_dir).join(v, "node_id").withColumn("hash", content_hash(F.col("content")))
    return base, query_set(spark, sf_dir).join(v.select(F.col("node_id").alias("query_id"), "embedding", F.col("label").alias("category")), "query_id")


def _metrics(spark: SparkSession, sf_dir: str, mmr_weight: float | None = None) -> tuple[DataFrame, DataFrame]:
    base, q = pooled(spark, sf_dir)
    found = Retriever(base, CALLER)
    ranked = arms.rankings(found.arms(q, _POOL), found.nodes, q, TOP, POOL, mmr_weight)
    judged = ranked.join(found.nodes.select("node_id", "label"), "node_id").join(q.select("query_id", "category"), "query_id")
    sizes = found.nodes.groupBy("label").agg(F.count("*").alias("n"))
    need = q.join(sizes, F.col("category") == F.col("label"), "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))
    names = NAMES + ["hybrid+mmr"] * (mmr_weight is not None)
    return arms.measured(judged.withColumn("relevant", F.col("label") == F.col("category")), need, names), q.select("query_id", "category")


@register("p2_modes_by_category", f"WITH {ARMS}, c AS (SELECT qlabel::BIGINT AS category, count(*) FILTER (arm = 'vector') AS queries, avg(rr) FILTER (arm = 'vector') AS v, avg(rr) FILTER (arm = 'keyword') AS k, avg(rr) FILTER (arm = 'hybrid') AS b FROM m GROUP BY 1) SELECT category, queries, round(v, 6) AS vector, round(k, 6) AS keyword, round(b, 6) AS hybrid, round(b - v, 6) AS gain, round(v, 6) >= 0.999 AND round(b, 6) < 0.999 AS broken FROM c")
def p2_modes_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reciprocal rank of vector, keyword and hybrid search by category, and the categories that hybrid breaks."""
    return arms.by_category(*_metrics(spark, sf_dir))


@register("p16_arms_of_the_chain", f"WITH {ARMS} SELECT arm, count(*) AS queries, round(avg(rr), 6) AS mrr, " + ", ".join(f"round(avg(CASE WHEN n = 0 THEN 1 ELSE h{d} / n END), 6) AS recall_{d}, round(avg(CASE WHEN n = 0 THEN 1 ELSE g{d} / (SELECT sum(1 / log2(i + 1)) FROM range(1, {d + 1}) r(i) WHERE i <= n) END), 6) AS ndcg_{d}, round(avg(CAST(h{d} > 0 AS DOUBLE)), 6) AS hit_{d}, round(avg(CAST(h{d} = n AS DOUBLE)), 6) AS complete_{d}" for d in arms.DEPTHS) + " FROM m GROUP BY arm")
def p16_arms_of_the_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four arms over one pool of forty, ten best of each."""
    return arms.summary(_metrics(spark, sf_dir)[0])


@register("p16_with_diversity")
def p16_with_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the arm that chooses by maximal marginal relevance, which SQL can't express."""
    return arms.summary(_metrics(spark, sf_dir, 0.7)[0])


@register("j18_decisions", f"WITH {POOLS}, refs AS (SELECT query_id, count(*) FILTER (node_id IS NULL) > 0 AS missed FROM queries LEFT JOIN seen ON node_id = query_id GROUP BY 1), s AS (SELECT query_id, max(score) FILTER (rank = 1) AS top, max(score) FILTER (rank = 2) AS second, list(node_id) FILTER (rank <= 5) AS ids FROM near GROUP BY 1), k AS (SELECT query_id, max(score) AS top, list(node_id) FILTER (rank <= 5) AS ids FROM keyword GROUP BY 1), e AS (SELECT query_id, count(DISTINCT node_id) AS n FROM (SELECT query_id, node_id FROM near UNION SELECT query_id, node_id FROM keyword) GROUP BY 1) SELECT query_id, round(s.top, 6) AS dense_top, round(s.top - second, 6) AS dense_margin, round(k.top, 6) AS keyword_top, CASE WHEN least(5, coalesce(len(s.ids), 0), coalesce(len(k.ids), 0)) > 0 THEN round(len(list_intersect(s.ids, k.ids)) / least(5, len(s.ids), len(k.ids)), 4) ELSE 0.0 END AS overlap_at_5, CASE WHEN coalesce(n, 0) = 0 OR missed THEN 'no_evidence' WHEN s.top < 0.339 AND coalesce(k.top, 0) <= 0 THEN 'uncertain' ELSE 'evidence_found' END AS decision FROM queries JOIN refs USING (query_id) LEFT JOIN s USING (query_id) LEFT JOIN k USING (query_id) LEFT JOIN e USING (query_id)")
def j18_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question names the document of its own number: one that the caller may not see is a missed reference."""
    base, q = pooled(spark, sf_dir)
    found = Retriever(base, CALLER)
    pools = found.arms(q, _POOL)
    held = pools["dense"].select("query_id", "node_id").union(pools["keyword"].select("query_id", "node_id")).groupBy("query_id").agg(F.count_distinct("node_id").alias("evidence"))
    named = found.nodes.select(F.col("node_id").alias("query_id"), F.lit(False).alias("missed"))
    rows = signals(pools["dense"], pools["keyword"], q).join(held, "query_id", "left").join(named, "query_id", "left")
    decided = decision(F.coalesce("evidence", F.lit(0)), F.coalesce("missed", F.lit(True)), F.col("dense_top"), F.col("keyword_top"))
    return rows.select("query_id", "dense_top", "dense_margin", "keyword_top", "overlap_at_5", decided.alias("decision"))


_LISTED = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")


@register("l3_table_listing", "WITH n AS (" + " UNION ALL ".join(f"SELECT '{n}' AS location, (SELECT count(*) FROM {n}) AS c" for n in _LISTED) + "), c AS (SELECT table_name AS location, string_agg(column_name, ', ' ORDER BY column_index) AS names FROM duckdb_columns() GROUP BY 1) SELECT 'E1.' || row_number() OVER (ORDER BY location) AS evidence_id, location, location || ': ' || n.c || ' rows, columns ' || names AS snippet FROM n JOIN c USING (location)")
def l3_table_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.listing({n: t(spark, sf_dir, n) for n in _LISTED})


@register("b14_vector_variants", "WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), w AS (SELECT 'native_l2' AS variant, vec_id, v FROM u UNION ALL SELECT 'truncate_l2', vec_id, v[1:16] FROM u) SELECT variant, vec_id AS node_id, len(v)::INT AS dimensions, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 9) AS first, round(v[len(v)] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 9) AS last FROM w")
def b14_vector_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("v", V.doubles(F.col("embedding")))
    every = [v.select(F.lit(name).alias("variant"), "node_id", V.transformed(F.col("v"), name, n).alias("v")) for name, n in (("native_l2", None), ("truncate_l2", 16))]
    made = every[0].union(every[1])
    return made.select("variant", "node_id", F.size("v").alias("dimensions"), F.round(F.element_at("v", 1), 9).alias("first"), F.round(F.element_at("v", -1), 9).alias("last"))


@register(
    "a17_upload_of_items",
    f"WITH {NODES}, old AS (SELECT 'all' AS source_name, node_id || '.md' AS filename, sha256({COLLAPSED.format('content')}) AS h, version, status FROM nodes), "
    f"new AS (SELECT 'all' AS source_name, item_id || '.md' AS filename, sha256({COLLAPSED.format('text')}) AS h FROM benchmark UNION ALL SELECT 'talks', conv_id || '-' || turn || '.md', sha256({COLLAPSED.format('text')}) FROM conversations), "
    "j AS (SELECT source_name, filename, coalesce(new.h, old.h) AS content_hash, CASE WHEN old.h IS NULL THEN 'created' WHEN new.h IS NULL OR new.h = old.h THEN 'unchanged' ELSE 'updated' END AS change, version AS v, status AS s FROM old FULL JOIN new USING (source_name, filename)) "
    "SELECT source_name, filename, content_hash, CAST(coalesce(v, 0) + CASE WHEN change = 'unchanged' THEN 0 ELSE 1 END AS BIGINT) AS version, CASE WHEN change = 'unchanged' THEN s ELSE 'uploaded' END AS status, change FROM j",
)
def a17_upload_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items uploaded over the documents of their numbers, and all turns of talks as new files."""

    def file(df: DataFrame, source: str, name: Column, text: str) -> DataFrame:
        return df.select(F.lit(source).alias("source_name"), F.concat(name, F.lit(".md")).alias("filename"), content_hash(F.col(text)).alias("content_hash"), *[c for c in ("version", "status") if c in df.columns])

    old = file(nodes(spark, sf_dir), "all", F.col("node_id").cast("string"), "content")
    items = file(t(spark, sf_dir, "benchmark"), "all", F.col("item_id").cast("string"), "text")
    talks = file(t(spark, sf_dir, "conversations"), "talks", F.concat_ws("-", "conv_id", "turn"), "text")
    return lifecycle.upsert(old, items.union(talks))
