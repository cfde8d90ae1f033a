"""Registered queries that go through the library's larger parts: guard, stored index, cells, fold, catalogue, provenance, judging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefall.operators import catalogue, cells, grounding, judging, lexical, provenance
from orefall.plans.guard import Guard
from orefall.plans.index import Index, derived
from orefall.plans.registry import BM25, CALLER, DENSE, QUERY_SET, SEEN, asked_vectors, nodes, query_set, register, seen_nodes, t, vectors
from orefall.plans.retrieval import Options, Retriever
from orefall.sources.workbooks import datasets_with_workbooks


def _guarded(spark: SparkSession, sf_dir: str, *names: str) -> Guard:
    return Guard(spark, {n: t(spark, sf_dir, n) for n in names})


_STATEMENT = "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000) SELECT c_mktsegment, count(*) AS n, max(o_totalprice) AS top FROM big JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"


@register("l1_guarded_statement", _STATEMENT)
def l1_guarded_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guarded(spark, sf_dir, "orders", "customer").plan(_STATEMENT + ";")


@register("l5_quoted_names", 'SELECT "s_nationkey" AS "国家", count(*) AS "数量" FROM supplier GROUP BY "s_nationkey"')
def l5_quoted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guarded(spark, sf_dir, "supplier").plan('SELECT "s_nationkey" AS "国家", count(*) AS "数量" FROM supplier GROUP BY "s_nationkey"')


@register("g5_row_cap", "SELECT count(*) AS n FROM (SELECT * FROM lineitem LIMIT 200)")
def g5_row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guarded(spark, sf_dir, "lineitem").plan("SELECT * FROM lineitem").agg(F.count("*").alias("n"))


def _fold(spark: SparkSession, sf_dir: str, identifiers_only: bool = True) -> DataFrame:
    return lexical.fold(seen_nodes(spark, sf_dir), query_set(spark, sf_dir), cells.folder(spark, "fold"), identifiers_only)


@register("j3_bm25_fold", f"WITH {SEEN}, {QUERY_SET}, {BM25} SELECT query_id, node_id, round(score, 6) AS score FROM bm WHERE score > 0")
def j3_bm25_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hits of every question, with all terms; the tables hold no CJK text, so that their Latin terms are all they have."""
    return _fold(spark, sf_dir, identifiers_only=False).select("query_id", "node_id", F.round("score", 6).alias("score"))


@register("j4_index_equals_fold", f"WITH {SEEN}, {QUERY_SET}, {BM25} SELECT query_id, count(*) AS n FROM bm WHERE score > 0 GROUP BY 1")
def j4_index_equals_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of which index and fold give one score; one that either lacks, or scores otherwise, isn't counted."""
    base = seen_nodes(spark, sf_dir)
    stored = lexical.bm25(lexical.query_terms(query_set(spark, sf_dir)), lexical.postings(base), lexical.stats(base))
    both = stored.join(_fold(spark, sf_dir).withColumnRenamed("score", "other"), ["query_id", "node_id"], "full_outer")
    return both.groupBy("query_id").agg(F.count_if(F.abs(F.col("score") - F.col("other")) < 1e-9).alias("n"))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as nodes of an index, each a piece of its own without a parent."""
    none = {c: F.lit(None).cast("string") for c in ("parent_id", "heading_path", "parent_content")}
    return nodes(spark, sf_dir).withColumns(none | {"document_id": F.col("node_id"), "parent_ordinal": F.lit(0)})


@register("j19_stored_index", f"WITH {SEEN}, {QUERY_SET}, {BM25} SELECT query_id, node_id, round(score, 6) AS score, rank FROM keyword")
def j19_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index is published to the shared folder, and searched block by block."""
    index = Index(spark, cells.folder(spark, "index"))
    index.publish(derived(pieces(spark, sf_dir)))
    best = Retriever.over(index, CALLER).keyword(query_set(spark, sf_dir), 40)
    return best.select("query_id", "node_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def _cells(spark: SparkSession, sf_dir: str) -> cells.Cells:
    return cells.build(vectors(spark, sf_dir), cells.folder(spark, "cells"), per_cell=8)


@register("j6_cells_exact", f"WITH {DENSE} SELECT query_id, node_id, round(score, 6) AS score, rank FROM dense")
def j6_cells_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cells.exact(asked_vectors(spark, sf_dir), _cells(spark, sf_dir), 10)
    return found.select("query_id", "node_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@register("j7_cells_recall")
def j7_cells_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every question, the share of its exact ten that is found in as many cells as a recall of 0.9 was measured to need."""
    made, asked = _cells(spark, sf_dir), asked_vectors(spark, sf_dir)
    near = cells.approximate(asked, made, 10, cells.share_for(asked, made, 10)).select("query_id", "node_id", F.lit(1).alias("hit"))
    both = cells.exact(asked, made, 10).join(near, ["query_id", "node_id"], "left")
    return both.groupBy("query_id").agg(F.round(F.coalesce(F.sum("hit"), F.lit(0)) / F.count("*"), 6).alias("recall"))


_CHOICES = ("part", "supplier", "nation", "customer", "orders")


@register(
    "b11_choices",
    "WITH v AS ("
    + " UNION ALL ".join(
        f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", {c} AS value FROM (SELECT DISTINCT {c} FROM {table} WHERE {c} IS NOT NULL)"
        for table, columns in (("part", ("p_name", "p_brand", "p_type")), ("supplier", ("s_name",)), ("nation", ("n_name",)), ("customer", ("c_name", "c_mktsegment")), ("orders", ("o_orderstatus", "o_orderpriority")))
        for c in columns
    )
    + "), few AS (SELECT \"table\", \"column\" FROM v GROUP BY ALL HAVING count(*) <= 12 AND max(length(value)) <= 40) SELECT \"table\", \"column\", value FROM v JOIN few USING (\"table\", \"column\")",
)
def b11_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.values({n: t(spark, sf_dir, n) for n in _CHOICES})


@register(
    "b11_value_links",
    "WITH w AS (SELECT n_name, list_distinct(list_filter(string_split_regex(lower(n_name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS ws FROM nation), "
    "q AS (SELECT c_custkey AS query_id, list_filter(string_split_regex(lower(c_mktsegment || ' of ' || n_name || ', ' || c_name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS qs FROM customer JOIN nation ON c_nationkey = n_nationkey), "
    "v AS (SELECT 'nation' AS \"table\", 'n_name' AS \"column\", n_name AS value, ws FROM w UNION ALL SELECT 'customer', 'c_mktsegment', s, list_distinct(list_filter(string_split_regex(lower(s), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) FROM (SELECT DISTINCT c_mktsegment AS s FROM customer)) "
    "SELECT query_id, \"table\", \"column\", value FROM q JOIN v ON list_has_all(qs, ws) AND len(ws) > 0",
)
def b11_value_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that name a market segment and a nation, made of every customer, linked to the values they name."""
    customer, nation = t(spark, sf_dir, "customer"), t(spark, sf_dir, "nation")
    asked = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("query_id"), F.concat("c_mktsegment", F.lit(" of "), "n_name", F.lit(", "), "c_name").alias("text"))
    held = catalogue.values({"nation": nation.select("n_name"), "customer": customer.select("c_mktsegment")}, most=1000)
    return catalogue.link(asked, catalogue.index(held))


@register("d4_datasets_with_workbooks", "SELECT n_nationkey AS dataset_id, n_name AS filename, workbook_id, r_name AS workbook_filename FROM (SELECT *, CASE WHEN n_nationkey % 4 <> 0 THEN n_regionkey END AS workbook_id FROM nation) LEFT JOIN region ON workbook_id = r_regionkey")
def d4_datasets_with_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("dataset_id"), F.col("n_name").alias("filename"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey")).alias("workbook_id"))
    r = t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("workbook_id"), F.col("r_name").alias("workbook_filename"))
    return datasets_with_workbooks(n, r).select("dataset_id", "filename", "workbook_id", "workbook_filename")


_LIMB = "lower(lpad(to_hex(CAST(sum(CAST(('0x' || substr(h, {0}, 8)) AS BIGINT)) % 4294967296 AS BIGINT)), 8, '0'))"


@register("o11_table_digest", "SELECT count(*) AS rows, " + " || ".join(_LIMB.format(8 * i + 1) for i in range(4)) + " AS digest FROM (SELECT md5(concat_ws(chr(31), coalesce(doc_id::VARCHAR, chr(0)), coalesce(lang, chr(0)), coalesce(\"source\", chr(0)), coalesce(text, chr(0)))) AS h FROM documents)")
def o11_table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.digest(t(spark, sf_dir, "documents"), ["doc_id", "lang", "source", "text"])


@register("p9_judge_coverage", "SELECT doc_id AS case_id, CASE WHEN d.doc_id IS NULL THEN 'x' ELSE 'missing' END AS problem, 0 AS claim_index FROM documents d ANTI JOIN labels USING (doc_id)")
def p9_judge_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a case of one claim, judged where it has a label."""
    claims = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.lit(0).alias("claim_index"))
    judged = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.lit(0).alias("claim_index"), F.when(F.col("quality") == 1, "supported").otherwise("unsupported").alias("verdict"))
    return judging.coverage(claims, judged)


@register(
    "p10_agreement_by_language",
    "WITH p AS (SELECT lang, quality AS a, 1 - toxic AS b, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), "
    "s AS (SELECT lang, sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM p GROUP BY lang), "
    "c AS (SELECT lang, sum(x * y)::DOUBLE AS lr FROM (SELECT lang, a AS v, sum(n) AS x FROM p GROUP BY ALL) JOIN (SELECT lang, b AS v, sum(n) AS y FROM p GROUP BY ALL) USING (lang, v) GROUP BY lang) "
    "SELECT lang, n::BIGINT AS n, round(same / n, 6) AS exact_agreement, CASE WHEN coalesce(lr, 0) / (n::DOUBLE * n) < 1 THEN round((same / n - coalesce(lr, 0) / (n::DOUBLE * n)) / (1 - coalesce(lr, 0) / (n::DOUBLE * n)), 6) END AS cohen_kappa FROM s LEFT JOIN c USING (lang)",
)
def p10_agreement_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").withColumn("fine", 1 - F.col("toxic"))
    return judging.agreement(judging.contingency(rated, ["lang"], "quality", "fine"), ["lang"])


@register("p10_agreement_interval")
def p10_agreement_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = t(spark, sf_dir, "labels").join(t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").withColumn("fine", 1 - F.col("toxic"))
    return judging.interval(judging.contingency(rated, ["lang"], "quality", "fine"), ["lang"])


@register("p10_blind_forms", "SELECT row_number() OVER (PARTITION BY lang ORDER BY form_id) AS turn, form_id, doc_id, lang FROM (SELECT lang, doc_id, sha256('2024' || chr(0) || doc_id::VARCHAR || chr(0) || \"source\") AS form_id FROM documents)")
def p10_blind_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an answer of the arm that its source stands for."""
    rows = t(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return judging.blind(rows, "2024", "lang", "doc_id", "source").select(F.col("turn").cast("long").alias("turn"), "form_id", "doc_id", "lang")


def _clean(text: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({text}, ''), '{grounding.CITATION}', ' ', 'g'), '{grounding.MARKDOWN}', '', 'g')"


def _all(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, '{pattern}')"


_UNGROUPED = f"regexp_replace(c, '{grounding.GROUPED}', ' ', 'g')"


@register(
    "i7_traced_values",
    f"WITH r AS (SELECT a.conv_id, a.turn, {_clean('a.text')} AS c, upper(replace({_clean('u.text')}, ',', '')) AS hay FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1), "
    f"s AS (SELECT *, list_concat(list_transform({_all('c', grounding.GROUPED)}, lambda x: replace(x, ',', '')), {_all(_UNGROUPED, grounding.NUMBER)}) AS n, {_all('c', grounding.IDENTIFIER)} AS i FROM r), "
    "d AS (SELECT conv_id, turn, hay, list_filter(n, lambda x, k: list_position(n, x) = k AND x NOT IN ('0', '1', '2', '3', '4', '5')) AS n, list_filter(i, lambda x, k: list_position(list_transform(i, lambda y: upper(y)), upper(x)) = k) AS i FROM s) "
    "SELECT conv_id, turn, array_to_string(n, ',') AS numbers, array_to_string(i, ',') AS identifiers, array_to_string(list_filter(n, lambda x: NOT contains(hay, x)), ',') AS numbers_missing, array_to_string(list_filter(i, lambda x: NOT contains(hay, upper(x))), ',') AS identifiers_missing FROM d",
)
def i7_traced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as an answer, with the turn before it as its evidence."""
    c = t(spark, sf_dir, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("evidence"))
    names = ("numbers", "identifiers", "numbers_missing", "identifiers_missing")
    found = grounding.traced(F.col("text"), F.col("evidence"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", *[F.array_join(x, ",").alias(n) for n, x in zip(names, found)])
