"""Document retrieval as one plan for a batch of questions, and the queries registered for its parts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orefall.config import User
from orefall.errors import CodedError
from orefall.functions.text import content_hash, latin_tokens, tokens
from orefall.functions.vectors import cosine, doubles, dot, norm, truncated
from orefall.operators import dense, fusion, lexical
from orefall.operators.access import business, scoped, visible
from orefall.operators.cells import folder
from orefall.plans.index import Index
from orefall.plans.registry import BM25, CALLER, COLLAPSED, DENSE, NODES, QUERY_SET, SEEN, TOKENS, asked_vectors, nodes, query_set, register, seen_nodes, t, vectors

MODES = ("vector", "keyword", "hybrid")
#: Terms that are looked for by value in the stored postings; more are joined.
PUSHED = 256


@dataclass(frozen=True)
class Options:
    top_k: int = 5
    mode: str = "hybrid"
    pool: int = 12
    mmr_weight: float | None = None
    filename: str | None = None
    source: str | None = None
    filters: dict[str, list[str]] = field(default_factory=dict)
    fallback: bool = True

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise CodedError("unknown_mode", f"mode must be one of {MODES}")
        if self.pool < 0 or self.top_k <= 0:
            raise CodedError("invalid_pool", "pool must not be negative and top_k must be positive")
        if self.mmr_weight is not None and not 0 <= self.mmr_weight <= 1:
            raise CodedError("invalid_weight", "the MMR weight must lie between 0 and 1")
        if self.filename and self.source:
            raise CodedError("scope_conflict", "a document and a source cannot both be the scope")

    @property
    def fetch(self) -> int:
        """Candidates of each arm: duplicates and diversity need spare ones."""
        return max(self.top_k * (4 if self.mmr_weight is not None else 2), self.pool)


class Retriever:
    """Plans over nodes (node_id, filename, source_name, owner_id, visibility, content, embedding or none).

    With a stored index the keyword arm reads its postings and lengths, never the content of nodes that aren't found.
    """

    def __init__(self, nodes: DataFrame, user: User, index: Index | None = None) -> None:
        self.nodes, self.user, self.index = visible(nodes, user), user, index

    @classmethod
    def over(cls, index: Index, user: User) -> Retriever:
        return cls(index.part("nodes"), user, index)

    def _scored(self, base: DataFrame, queries: DataFrame, o: Options, filtered: bool) -> DataFrame:
        """From the stored index's postings and lengths."""
        terms = lexical.query_terms(queries)

        lengths = scoped(visible(self.index.part("lengths"), self.user), o.filename, o.source)
        postings = visible(self._asked(terms, "postings"), self.user)
        if filtered:
            lengths = lengths.join(base.select("node_id"), "node_id", "left_semi")
        if filtered or o.filename or o.source:
            postings = postings.join(lengths.select("node_id"), "node_id", "left_semi")
        return lexical.bm25(terms, postings, lengths)

    def _asked(self, terms: DataFrame, name: str) -> DataFrame:
        """Postings or blocks of the asked terms: few of them reach the files' statistics, more are joined."""
        asked = terms.select("term").distinct().limit(PUSHED + 1).collect()
        return self.index.part(name) if len(asked) > PUSHED else self.index.postings_of([r["term"] for r in asked], name)

    def keyword(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best of everything the user sees, from the stored blocks and postings; for many terms from the postings alone."""
        terms, dead = lexical.query_terms(queries), self.index.dead()
        postings, blocks = (visible(self._asked(terms, n), self.user) for n in ("postings", "blocks"))
        total = visible(self.index.part("totals"), self.user).agg(F.coalesce(F.sum("nodes"), F.lit(0)).cast("double").alias("n"), F.coalesce(F.sum("terms") / F.sum("nodes"), F.lit(0.0)).alias("avg_len"))
        pairs = lexical.held(terms)
        if pairs is not None and len({term for _, term in pairs}) > PUSHED:
            return lexical.top_of_postings(pairs, postings, total, k, queries.schema["query_id"].dataType)
        if dead is not None:
            every = self.index.raw("postings").join(terms.select("term").distinct(), "term", "left_semi")
            dead = visible(every, self.user).join(dead.select("segment", "node_id"), ["segment", "node_id"], "left_semi")
        return lexical.top_by_blocks(terms, postings, blocks, total, k, dead)

    def _arms(self, base: DataFrame, queries: DataFrame, o: Options, filtered: bool = False) -> dict[str, DataFrame]:
        arms = {}
        if o.mode != "vector" and self.index is not None and not (filtered or o.filename or o.source):
            arms["keyword"] = self.keyword(queries, o.fetch).withColumn("rank", F.col("rank").cast("long"))
        elif o.mode != "vector" and self.index is None:
            found = lexical.search(queries, base, o.fetch, folder(base.sparkSession, "counts"))
            arms["keyword"] = found.select("query_id", "node_id", "score", F.col("rank").cast("long").alias("rank"))
        elif o.mode != "vector":
            scored = self._scored(base, queries, o, filtered)
            arms["keyword"] = lexical.top(scored.withColumn("sort", F.round("score", 9)), o.fetch, score="sort").select("query_id", "node_id", "score", F.col("rank").cast("long").alias("rank"))
        if o.mode != "keyword":
            arms["dense"] = dense.exact(queries, base, o.fetch).select("query_id", "node_id", "score", F.col("rank").cast("long").alias("rank"))
        return arms

    def _fused(self, base: DataFrame, queries: DataFrame, o: Options, filtered: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
        arms = self._arms(base, queries, o, filtered)
        return arms, fusion.rrf(arms, tie="keyword" if "keyword" in arms else None) if len(arms) > 1 else next(iter(arms.values()))

    def arms(self, queries: DataFrame, o: Options = Options()) -> dict[str, DataFrame]:
        """The candidates of the mode's arms by name, dense and keyword, before they are fused."""
        return self._arms(scoped(self.nodes, o.filename, o.source), queries, o)

    def plan(self, queries: DataFrame, o: Options = Options()) -> DataFrame:
        """(query_id, node_id, score, rank, filename, content): the evidence of every question.

        queries: query_id, text, and embedding if an arm needs it. Questions that business filters leave without any hit are
        asked again without them, all in the same plan; an exact scope replaces filters and has no second try.
        """
        base = scoped(self.nodes, o.filename, o.source)
        filtered = o.filters and not (o.filename or o.source)
        _, fused = self._fused(base.where(business(o.filters)) if filtered else base, queries, o, bool(filtered))
        if filtered and o.fallback:
            missed = queries.join(fused.select("query_id").distinct(), "query_id", "left_anti")
            fused = fused.select("query_id", "node_id", "score", "rank").union(self._fused(base, missed, o)[1].select("query_id", "node_id", "score", "rank"))
        rows = lexical.few(fused, queries, 2 * o.fetch).join(self.nodes, "node_id")  # of two arms at most
        one = fusion.keep_first(rows.withColumn("hash", content_hash(F.col("content"))), "hash")
        if o.mmr_weight is not None:
            best = fusion.mmr(one.where(F.col("rank") <= o.fetch), o.top_k, o.mmr_weight).select("query_id", "node_id", F.col("mmr_rank").alias("rank"))
            one = best.join(one.drop("rank"), ["query_id", "node_id"])
        return one.where(F.col("rank") <= o.top_k).select("query_id", "node_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"), "filename", "content")


def trace(stages: dict[str, DataFrame]) -> DataFrame:
    """Candidates of all stages with their place: stage, query_id, rank, node_id, score."""
    out = None
    for name, s in stages.items():
        one = s.select(F.lit(name).alias("stage"), "query_id", F.col("rank").cast("long").alias("rank"), "node_id", F.round("score", 6).alias("score"))
        out = one if out is None else out.union(one)
    return out


def signals(dense_arm: DataFrame, keyword_arm: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, dense_top, dense_margin, keyword_top, overlap_at_5)."""
    d = dense_arm.where("rank <= 5").groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("dense_top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.collect_set("node_id").alias("dn"))
    k = keyword_arm.where("rank <= 5").groupBy("query_id").agg(F.max("score").alias("keyword_top"), F.collect_set("node_id").alias("kn"))
    rows = queries.select("query_id").join(d, "query_id", "left").join(k, "query_id", "left")
    n = F.least(F.lit(5), F.coalesce(F.size("dn"), F.lit(0)), F.coalesce(F.size("kn"), F.lit(0)))
    return rows.select("query_id", F.round("dense_top", 6).alias("dense_top"), F.round(F.col("dense_top") - F.col("second"), 6).alias("dense_margin"), F.round("keyword_top", 6).alias("keyword_top"), F.when(n > 0, F.round(F.size(F.array_intersect("dn", "kn")) / n, 4)).otherwise(0.0).alias("overlap_at_5"))


def decision(evidence, ref_missed, dense_top, keyword_top, threshold: float = 0.339, enabled: bool = False):
    """no_evidence, uncertain or evidence_found; the order of the rules matters."""
    low = (dense_top < threshold) & (keyword_top.isNull() | (keyword_top <= 0))
    return F.when(evidence == 0, "no_evidence").when(ref_missed, "no_evidence").when(low, "no_evidence" if enabled else "uncertain").otherwise("evidence_found")


# ---- registered queries ----


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


@register("j1_tokeniser", f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, sha256(array_to_string(w, ' ')) AS token_hash FROM (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents)")
def j1_tokeniser(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = t(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.sha2(F.array_join("w", " "), 256).alias("token_hash"))


@register("a20_postings", f"WITH {NODES} SELECT node_id, term, count(*) AS freq FROM (SELECT node_id, unnest({TOKENS.format('content')}) AS term FROM nodes) GROUP BY ALL")
def a20_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(nodes(spark, sf_dir))


@register("e1_lexical_totals", f"WITH {SEEN} SELECT count(*) AS n, coalesce(round(avg(len({TOKENS.format('content')})), 6), 0) AS avg_len FROM seen")
def e1_lexical_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.stats(seen_nodes(spark, sf_dir)).agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg("term_count"), 6), F.lit(0.0)).alias("avg_len"))


@register("e2_document_frequency", f"WITH {SEEN} SELECT term, count(*) AS df FROM (SELECT DISTINCT node_id, unnest({TOKENS.format('content')}) AS term FROM seen) GROUP BY term")
def e2_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(seen_nodes(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"))


def _keyword(spark: SparkSession, sf_dir: str, k: int = 40) -> DataFrame:
    base = seen_nodes(spark, sf_dir)
    return lexical.search(query_set(spark, sf_dir), base, k, folder(spark, "counts")).withColumn("rank", F.col("rank").cast("long"))


@register("j5_bm25_visible", f"WITH {SEEN}, {QUERY_SET}, {BM25} SELECT query_id, node_id, round(score, 6) AS score, rank FROM keyword")
def j5_bm25_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(spark, sf_dir).select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")


@register("j2_identifier_bm25", f"WITH {SEEN}, {QUERY_SET}, {BM25} SELECT query_id, count(*) AS hits, round(max(score), 6) AS best FROM keyword GROUP BY query_id")
def j2_identifier_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.max("score"), 6).alias("best"))


def _dense(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    return dense.exact(asked_vectors(spark, sf_dir), vectors(spark, sf_dir), k).withColumn("rank", F.col("rank").cast("long"))


@register("j6_dense_top_k", f"WITH {DENSE} SELECT query_id, node_id, round(score, 6) AS score, rank FROM dense")
def j6_dense_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")


@register("g1_nearest_to_one", "SELECT node_id, round(score, 6) AS score FROM (" + f"WITH {DENSE} SELECT node_id, score FROM dense WHERE query_id = 0)")
def g1_nearest_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("node_id", doubles(F.col("embedding")).alias("v"))
    q = v.where("node_id = 0").select(F.col("v").alias("q"))  # one row
    return v.crossJoin(F.broadcast(q)).select("node_id", F.round(cosine(F.col("q"), F.col("v")), 6).alias("score")).orderBy(F.desc("score"), "node_id").limit(10)


@register("j7_agreement_of_cells")
def j7_agreement_of_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the exact ten that the inverted lists find, for every query."""
    v, q = vectors(spark, sf_dir), asked_vectors(spark, sf_dir)
    near = dense.approximate(q, v, 10, dense.cells(v, 16)).select("query_id", "node_id")
    both = _dense(spark, sf_dir).join(near.withColumn("hit", F.lit(1)), ["query_id", "node_id"], "left")
    return both.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("agreement"))


@register("j8_rrf_two_way", f"WITH {SEEN}, {QUERY_SET}, {BM25}, other AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY node_id DESC) AS rank FROM keyword), fused AS (SELECT query_id, node_id, sum(1.0 / (60 + rank)) AS score, min(CASE WHEN arm = 'keyword' THEN rank END) AS tie FROM (SELECT query_id, node_id, rank, 'keyword' AS arm FROM keyword UNION ALL SELECT query_id, node_id, rank, 'other' FROM other) GROUP BY ALL) SELECT query_id, node_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, tie NULLS LAST, node_id) AS rank FROM fused")
def j8_rrf_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _keyword(spark, sf_dir)
    other = k.select("query_id", "node_id", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("node_id"))).alias("rank"))
    return fusion.rrf({"keyword": k, "other": other}, tie="keyword").select("query_id", "node_id", F.round("score", 9).alias("score"), "rank")


@register("f20_rrf_contribution", f"WITH {DENSE} SELECT query_id, node_id, round(1.0 / (60 + rank), 9) AS part FROM dense")
def f20_rrf_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("query_id", "node_id", F.round(F.lit(1.0) / (60 + F.col("rank")), 9).alias("part"))


@register("j9_rrf_many", f"WITH {DENSE} SELECT query_id, node_id, round(1.0 / (60 + rank) + 1.0 / (71 - rank), 9) AS score FROM dense")
def j9_rrf_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dense(spark, sf_dir)
    back = d.select("query_id", "node_id", (11 - F.col("rank")).alias("rank"))
    return fusion.rrf({"a": d, "b": back}).select("query_id", "node_id", F.round("score", 9).alias("score"))


@register("j10_hybrid_mode")
def j10_hybrid_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain over nodes that have a vector; a question's vector is that of the document its item number names."""
    base = nodes(spark, sf_dir).join(vectors(spark, sf_dir).select("node_id", "embedding"), "node_id")
    q = query_set(spark, sf_dir).join(vectors(spark, sf_dir).select(F.col("node_id").alias("query_id"), "embedding"), "query_id")
    return Retriever(base, CALLER).plan(q, Options(top_k=5)).drop("content")


@register("j10_keyword_mode", f"WITH {SEEN}, {QUERY_SET}, {BM25}, h AS (SELECT k.*, filename, sha256({COLLAPSED.format('content')}) AS h FROM keyword k JOIN seen USING (node_id) WHERE rank <= 12), one AS (SELECT *, row_number() OVER (PARTITION BY query_id, h ORDER BY rank) AS nth FROM h) SELECT query_id, node_id, round(score, 4) AS score, rank, filename FROM (SELECT query_id, node_id, score, filename, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM one WHERE nth = 1) WHERE rank <= 5")
def j10_keyword_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Retriever(nodes(spark, sf_dir), CALLER).plan(query_set(spark, sf_dir), Options(top_k=5, mode="keyword")).drop("content")


@register("j14_mmr")
def j14_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = dense.exact(asked_vectors(spark, sf_dir), vectors(spark, sf_dir), 12).join(vectors(spark, sf_dir).select("node_id", "embedding"), "node_id").withColumn("filename", F.col("node_id") % 50)
    return fusion.mmr(pool, 5)


@register("j11_multi_query", f"WITH {SEEN}, queries AS (SELECT item_id * 10 + v AS query_id, array_to_string(list_filter(string_split({COLLAPSED.format('text')}, ' '), lambda x, i: v = 0 OR i % 2 = 1), ' ') AS text FROM benchmark, (SELECT unnest([0, 1]) AS v)), {BM25} SELECT query_id // 10 AS query_id, node_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM keyword GROUP BY 1, 2")
def j11_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variants of each question, the whole one and every other of its words, fused."""
    w = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    both = t(spark, sf_dir, "benchmark").select("item_id", w.alias("w"), F.explode(F.array(F.lit(0), F.lit(1))).alias("v"))
    q = both.select((F.col("item_id") * 10 + F.col("v")).alias("query_id"), F.array_join(F.filter("w", lambda x, i: (F.col("v") == 0) | (i % 2 == 0)), " ").alias("text"))
    base = seen_nodes(spark, sf_dir)
    k = lexical.search(q, base, 40, folder(spark, "counts"))
    return k.groupBy(F.expr("query_id div 10").alias("query_id"), "node_id").agg(F.round(F.sum(F.lit(1.0) / (60 + F.col("rank"))), 9).alias("score"))


@register("f5_dense_margin", f"WITH {DENSE} SELECT query_id, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 6) AS margin FROM dense GROUP BY query_id")
def f5_dense_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("query_id").orderBy("rank")
    return _dense(spark, sf_dir).withColumn("next", F.lead("score").over(w)).where("rank = 1").select("query_id", F.round(F.col("score") - F.col("next"), 6).alias("margin"))


@register("j18_signals", f"WITH {DENSE}, k AS (SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY node_id) AS rank, score FROM dense), j AS (SELECT query_id, count(*) AS shared FROM dense d JOIN k USING (query_id, node_id) WHERE d.rank <= 5 AND k.rank <= 5 GROUP BY query_id) SELECT query_id, round(max(score) FILTER (rank = 1), 6) AS dense_top, round(max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2), 6) AS dense_margin, round(max(ks), 6) AS keyword_top, round(coalesce(any_value(shared), 0) / 5, 4) AS overlap_at_5, CASE WHEN max(score) FILTER (rank = 1) < 0.339 THEN 'uncertain' ELSE 'evidence_found' END AS decision FROM dense LEFT JOIN j USING (query_id) JOIN (SELECT query_id, max(score) AS ks FROM k WHERE rank <= 5 GROUP BY query_id) USING (query_id) GROUP BY query_id")
def j18_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dense(spark, sf_dir)
    k = d.select("query_id", "node_id", "score", F.row_number().over(W.partitionBy("query_id").orderBy("node_id")).alias("rank"))
    s = signals(d, k, asked_vectors(spark, sf_dir))
    return s.withColumn("decision", decision(F.lit(1), F.lit(False), F.col("dense_top"), F.lit(None).cast("double")))


@register("b16_candidate_snapshot", f"WITH {SEEN}, {QUERY_SET}, {BM25} SELECT query_id, rank, node_id, filename || ' #' || 0 AS location, left({COLLAPSED.format('content')}, 500) AS snippet, round(k.score, 6) AS score FROM keyword k JOIN seen USING (node_id) WHERE rank <= 10")
def b16_candidate_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lexical.few(_keyword(spark, sf_dir, 10), query_set(spark, sf_dir), 10).join(nodes(spark, sf_dir), "node_id")
    return rows.select("query_id", "rank", "node_id", F.concat("filename", F.lit(" #0")).alias("location"), F.substring(F.trim(F.regexp_replace("content", r"\s+", " ")), 1, 500).alias("snippet"), F.round("score", 6).alias("score"))


@register("j17_trace", f"WITH {DENSE} SELECT 'dense' AS stage, query_id, rank, node_id, round(score, 6) AS score FROM dense UNION ALL SELECT 'final', query_id, rank, node_id, round(score, 6) FROM dense WHERE rank <= 5")
def j17_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dense(spark, sf_dir)
    return trace({"dense": d, "final": d.where("rank <= 5")})


@register("f2_keep_first_by_content", f"WITH {NODES}, r AS (SELECT lang AS query_id, node_id, row_number() OVER (PARTITION BY lang ORDER BY node_id) AS rank, sha256({COLLAPSED.format('content')}) AS h FROM nodes) SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, h ORDER BY rank) AS nth FROM r) WHERE nth = 1")
def f2_keep_first_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = nodes(spark, sf_dir).select(F.col("lang").alias("query_id"), "node_id", content_hash(F.col("content")).alias("h")).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("node_id")))
    return fusion.keep_first(r, "h").select("query_id", "node_id", "rank")


@register("j16_parent_aware", f"WITH {DENSE}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id // 4 ORDER BY rank) AS nth FROM dense) SELECT * FROM (SELECT query_id, node_id, node_id // 4 AS parent_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM p WHERE nth = 1) WHERE rank <= 5")
def j16_parent_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dense(spark, sf_dir).withColumn("parent_id", F.expr("node_id div 4"))
    return fusion.keep_first(d, "parent_id").where("rank <= 5").select("query_id", "node_id", "parent_id", "rank")


@register("b13_mrl_truncate", "SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm2, round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM (SELECT vec_id, CAST(embedding[1:16] AS DOUBLE[]) AS e FROM embeddings))")
def b13_mrl_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = t(spark, sf_dir, "embeddings").select("vec_id", truncated(doubles(F.col("embedding")), 16).alias("v"))
    return v.select("vec_id", F.round(dot(F.col("v"), F.col("v")), 6).alias("norm2"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@register("i10_vector_functions", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
def i10_vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = doubles(F.col("embedding"))
    return t(spark, sf_dir, "embeddings").select("vec_id", F.round(norm(v), 6).alias("norm"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size("embedding").cast("long").alias("n"))


@register("j22_wiki_bm25", f"WITH {SEEN}, {QUERY_SET}, {BM25.replace('content', 'doc').replace('FROM seen', 'FROM (SELECT node_id, filename || chr(32) || filename || chr(32) || content AS doc FROM seen)')} SELECT query_id, node_id, round(score, 6) AS score, rank FROM keyword WHERE rank <= 3")
def j22_wiki_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose title counts twice, all tokens indexed; the three best."""
    pages = seen_nodes(spark, sf_dir).withColumn("content", F.concat_ws(" ", "filename", "filename", "content"))
    return lexical.search(query_set(spark, sf_dir), pages, 3, folder(spark, "counts"), all_tokens=True).select("query_id", "node_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("f4_chunk_to_document", f"WITH {DENSE} SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY r, doc) AS rank FROM (SELECT query_id, node_id // 5 AS doc, min(rank) AS r FROM dense GROUP BY ALL)")
def f4_chunk_to_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dense(spark, sf_dir).groupBy("query_id", F.expr("node_id div 5").alias("doc")).agg(F.min("rank").alias("r"))
    return d.select("query_id", "doc", F.row_number().over(W.partitionBy("query_id").orderBy("r", "doc")).cast("long").alias("rank"))


@register("d18_candidate_redundancy", f"WITH {DENSE} SELECT a.query_id, a.node_id AS a, b.node_id AS b, round({'{0}'}, 6) AS cosine FROM dense a JOIN dense b ON a.query_id = b.query_id AND a.rank < b.rank JOIN embeddings x ON x.vec_id = a.node_id JOIN embeddings y ON y.vec_id = b.node_id".replace("{0}", "list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(x.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(y.embedding, lambda x: CAST(x AS DOUBLE) * x))))"))
def d18_candidate_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dense(spark, sf_dir).join(vectors(spark, sf_dir).select("node_id", doubles(F.col("embedding")).alias("v")), "node_id")
    a, b = d.select("query_id", F.col("node_id").alias("a"), F.col("rank").alias("ra"), F.col("v").alias("va")), d.select("query_id", F.col("node_id").alias("b"), F.col("rank").alias("rb"), F.col("v").alias("vb"))
    return a.join(b, "query_id").where("ra < rb").select("query_id", "a", "b", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("cosine"))


@register("j25_delete_source", f"WITH {NODES} SELECT node_id, term, count(*) AS freq FROM (SELECT node_id, unnest({TOKENS.format('content')}) AS term FROM nodes WHERE source_name <> 'src3') GROUP BY ALL")
def j25_delete_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    return lexical.postings(n).join(n.where("source_name = 'src3'").select("node_id"), "node_id", "left_anti")


@register("d20_graph_hops", "WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, 1000 + c_custkey % 40 AS b FROM customer), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), h AS (SELECT 0 AS node, 0 AS depth UNION SELECT CAST(s.b AS INT), depth + 1 FROM h JOIN s ON s.a = h.node WHERE depth < 2) SELECT CAST(node AS BIGINT) AS node, CAST(min(depth) AS BIGINT) AS depth FROM h GROUP BY node")
def d20_graph_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two hops of one entity, with their distance."""
    e = t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("a"), (1000 + F.col("c_custkey") % 40).alias("b")).distinct()
    s = e.union(e.select("b", "a"))
    front = spark.range(1).select(F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"))
    found = front
    for d in (1, 2):
        front = front.join(s, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().withColumn("depth", F.lit(d).cast("long"))
        found = found.union(front)
    return found.groupBy("node").agg(F.min("depth").alias("depth"))
