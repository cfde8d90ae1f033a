"""Registered queries over catalogues, filters, joins, inference and lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orefall.functions import text as X
from orefall.operators import inference, lifecycle
from orefall.operators.access import may_see, write_decision
from orefall.plans.registry import CALLER, COLLAPSED, NODES, SEEN, nodes, register, seen_nodes, t

AT = "1995-06-17 00:00:00"


@register("a17_versioned_upsert", f"WITH {NODES}, old AS (SELECT source_name, filename, sha256({COLLAPSED.format('content')}) AS h, version, status FROM nodes WHERE node_id % 7 <> 1), new AS (SELECT source_name, filename, sha256({COLLAPSED.format('content')} || CASE WHEN node_id % 3 = 0 THEN 'x' ELSE '' END) AS h FROM nodes WHERE node_id % 5 <> 2), j AS (SELECT source_name, filename, coalesce(new.h, old.h) AS content_hash, CASE WHEN old.h IS NULL THEN 'created' WHEN new.h IS NULL OR new.h = old.h THEN 'unchanged' ELSE 'updated' END AS change, old.version AS v, old.status AS s FROM old FULL JOIN new USING (source_name, filename)) SELECT source_name, filename, content_hash, CAST(coalesce(v, 0) + CASE WHEN change = 'unchanged' THEN 0 ELSE 1 END AS BIGINT) AS version, CASE WHEN change = 'unchanged' THEN s ELSE 'uploaded' END AS status, change FROM j")
def a17_versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    old = n.where("node_id % 7 <> 1").withColumn("content_hash", X.content_hash(F.col("content")))
    new = n.where("node_id % 5 <> 2").withColumn("content_hash", F.sha2(F.concat(X.collapsed(F.col("content")), F.when(F.col("node_id") % 3 == 0, "x").otherwise("")), 256))
    return lifecycle.upsert(old, new)


@register("a18_parent_upsert", "SELECT id, max_by(v, side) AS v FROM (SELECT n_nationkey AS id, n_name AS v, 0 AS side FROM nation UNION ALL SELECT n_nationkey + 10, upper(n_name) || '!', 1 FROM nation) GROUP BY id")
def a18_parent_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t(spark, sf_dir, "nation")
    new = n.select((F.col("n_nationkey") + 10).alias("id"), F.concat(F.upper("n_name"), F.lit("!")).alias("v"))
    old = n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("v"))
    return old.join(new, "id", "left_anti").union(new)


@register("a22_parquet_source", "SELECT item_id AS query_id, doc_id AS corpus_id FROM benchmark JOIN documents ON doc_id = item_id")
def a22_parquet_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "benchmark").join(t(spark, sf_dir, "documents"), F.col("doc_id") == F.col("item_id")).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("corpus_id"))


@register("a23_dataset_checks", "SELECT 'empty_text' AS problem, count(*) AS n FROM documents WHERE trim(text) = '' UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1) UNION ALL SELECT 'unknown_document', count(*) FROM labels ANTI JOIN documents USING (doc_id) UNION ALL SELECT 'no_positive', count(*) FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE quality > 0) USING (doc_id)")
def a23_dataset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels")
    checks = {
        "empty_text": d.where(F.trim("text") == "").select("doc_id"),
        "repeated_id": d.groupBy("doc_id").count().where("count > 1").select("doc_id"),
        "unknown_document": l.join(d, "doc_id", "left_anti").select("doc_id"),
        "no_positive": d.join(l.where("quality > 0"), "doc_id", "left_anti").select("doc_id"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.union(one)
    return out


@register("a24_virtual_filename", "SELECT url, 'nano--' || rtrim(translate(to_base64(encode(url)), '+/', '-_'), '=') || '.md' AS filename FROM pages")
def a24_virtual_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("url", F.concat(F.lit("nano--"), X.base64url(F.col("url")), F.lit(".md")).alias("filename"))


@register("a25_cache_misses", "SELECT sha256('judge-1' || chr(0) || text) AS cache_key, item_id FROM benchmark WHERE item_id % 3 <> 0")
def a25_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = t(spark, sf_dir, "benchmark").select(F.sha2(F.concat(F.lit("judge-1\0"), "text"), 256).alias("cache_key"), "item_id")
    return keyed.join(keyed.where("item_id % 3 = 0").select("cache_key"), "cache_key", "left_anti")


@register("a28_idempotent_seed", "SELECT r_regionkey, r_name FROM region WHERE r_name NOT IN ('ASIA', 'EUROPE')")
def a28_idempotent_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = t(spark, sf_dir, "region")
    return r.join(r.where(F.col("r_name").isin("ASIA", "EUROPE")).select("r_name"), "r_name", "left_anti").select("r_regionkey", "r_name")


PART_STRINGS = "(SELECT CAST(p_partkey AS VARCHAR) AS key, p_brand AS brand, CAST(p_size > 25 AS VARCHAR) AS big, CASE WHEN p_size < 10 THEN '0' || p_size ELSE CAST(p_size AS VARCHAR) END AS code FROM part)"


@register("b5_type_ladder", f"SELECT 'key' AS \"column\", 'numeric' AS type FROM {PART_STRINGS} HAVING bool_and(try_cast(key AS DOUBLE) IS NOT NULL) UNION ALL SELECT 'brand', 'text' FROM {PART_STRINGS} HAVING NOT bool_and(try_cast(brand AS DOUBLE) IS NOT NULL) UNION ALL SELECT 'big', 'boolean' FROM {PART_STRINGS} HAVING bool_and(lower(big) IN ('true', 'false')) UNION ALL SELECT 'code', 'text' FROM {PART_STRINGS} HAVING bool_or(code LIKE '0_%') UNION ALL SELECT 'day', 'date' FROM orders HAVING count(o_orderdate) > 0")
def b5_type_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.col("p_brand").alias("brand"), (F.col("p_size") > 25).cast("string").alias("big"), F.when(F.col("p_size") < 10, F.concat(F.lit("0"), "p_size")).otherwise(F.col("p_size").cast("string")).alias("code"))
    days = t(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return inference.column_types(p).union(inference.column_types(days))


@register("b2_numeric_test", "SELECT bool_and(regexp_matches(CAST(l_quantity AS VARCHAR), '^[0-9.]+$')) AS quantity, bool_and(try_cast(l_returnflag AS DOUBLE) IS NOT NULL) AS flag FROM lineitem")
def b2_numeric_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = t(spark, sf_dir, "lineitem")
    return l.agg((inference.type_of(F.col("l_quantity").cast("string")) == "numeric").alias("quantity"), (inference.type_of(F.col("l_returnflag")) == "numeric").alias("flag"))


@register("b9_corpus_catalogue", f"WITH {NODES} SELECT node_id, filename || ' —— ' || coalesce(nullif(trim(split_part(content, chr(10), 1)), ''), '') AS line FROM nodes WHERE status = 'ready' ORDER BY node_id DESC LIMIT 200")
def b9_corpus_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = nodes(spark, sf_dir).where("status = 'ready'").orderBy(F.desc("node_id")).limit(200)
    return ready.select("node_id", F.concat("filename", F.lit(" —— "), F.trim(F.split_part("content", F.lit("\n"), F.lit(1)))).alias("line"))


@register("b10_domain_catalogue", f"WITH {SEEN} SELECT source_name, count(*) AS documents, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS kinds FROM seen WHERE status = 'ready' GROUP BY source_name")
def b10_domain_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen_nodes(spark, sf_dir).where("status = 'ready'").groupBy("source_name").agg(F.count("*").alias("documents"), F.array_join(F.array_sort(F.collect_set("lang")), ", ").alias("kinds"))


@register("b12_enum_values", "SELECT 'o_orderstatus' AS \"column\", string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS vals FROM orders UNION ALL SELECT 'o_orderpriority', string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders UNION ALL SELECT 'o_orderkey', NULL")
def b12_enum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inference.enum_values(t(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_orderkey"])
    return e.select("column", F.array_join("values", ",").alias("vals"))


@register("b8_topic_slug", "SELECT n_name, regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') || '-' || left(sha256(lower(n_name)), 12) AS slug FROM nation")
def b8_topic_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "nation").select("n_name", X.slug(F.col("n_name")).alias("slug"))


@register("b19_document_metadata", f"WITH {NODES} SELECT node_id, 'md' AS file_type, array_to_string(list_sort(list_distinct(regexp_extract_all(filename || chr(10) || content, 'version ([0-9])', 0))), ',') AS versions, sha256({COLLAPSED.format('content')}) AS content_hash FROM nodes")
def b19_document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    hay = F.concat_ws("\n", "filename", "content")
    return n.select("node_id", X.file_type(F.col("filename")).alias("file_type"), F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(hay, F.lit("version ([0-9])"), F.lit(0)))), ",").alias("versions"), X.content_hash(F.col("content")).alias("content_hash"))


@register("c1_row_visibility", f"WITH {SEEN} SELECT node_id, owner_id, visibility FROM seen")
def c1_row_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where(may_see(CALLER)).select("node_id", "owner_id", "visibility")


@register("c4_business_filters", f"WITH {SEEN} SELECT node_id FROM seen WHERE lang IN ('en', 'fr') AND source_name IN ('src1', 'src2', 'src4')")
def c4_business_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orefall.operators.access import business

    listed = seen_nodes(spark, sf_dir).withColumn("langs", F.array("lang"))
    return listed.where(business({"langs": ["en", "fr"], "source_name": ["src1", "src2", "src4"]})).select("node_id")


@register("c6_document_scope", f"WITH {SEEN} SELECT node_id, filename FROM seen WHERE source_name = 'src4'")
def c6_document_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orefall.operators.access import scoped

    return scoped(seen_nodes(spark, sf_dir), source="src4").select("node_id", "filename")


@register("c7_zero_hit_fallback", f"WITH {SEEN}, q AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'xx' END AS want FROM benchmark), h AS (SELECT query_id, node_id FROM q JOIN seen ON lang = want), m AS (SELECT query_id FROM q ANTI JOIN h USING (query_id)) SELECT query_id, count(*) AS hits, fallback FROM (SELECT query_id, node_id, false AS fallback FROM h UNION ALL SELECT query_id, node_id, true FROM m, seen) GROUP BY ALL")
def c7_zero_hit_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits a question would have; those without any count all visible rows. Counts by language are enough, no pairs are made."""
    q = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "en").otherwise("xx").alias("want"))
    by_lang = seen_nodes(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"))
    total = by_lang.agg(F.sum("n").alias("total"))
    rows = q.join(by_lang, F.col("want") == F.col("lang"), "left").crossJoin(F.broadcast(total))  # one row
    return rows.select("query_id", F.coalesce("n", "total").alias("hits"), F.col("n").isNull().alias("fallback"))


@register("c8_write_authorisation", f"WITH {NODES} SELECT source_name, owner_id, visibility, CASE WHEN owner_id <> 'u1' THEN CASE WHEN visibility = 'public' THEN 'forbidden' ELSE 'not_found' END WHEN visibility = 'public' THEN 'admin_required' ELSE 'ok' END AS decision FROM (SELECT DISTINCT source_name, owner_id, visibility FROM nodes)")
def c8_write_authorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("source_name", "owner_id", "visibility").distinct().withColumn("decision", write_decision(CALLER))


@register("c9_ready_only", f"WITH {NODES} SELECT status, count(*) AS n FROM nodes WHERE status = 'ready' GROUP BY status")
def c9_ready_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("status = 'ready'").groupBy("status").agg(F.count("*").alias("n"))


@register("c10_fresh_pages", f"WITH {NODES}, pg AS (SELECT node_id, CASE WHEN node_id % 6 = 0 THEN version - 1 ELSE version END AS page_version FROM nodes), stale AS (SELECT DISTINCT source_name FROM nodes JOIN pg USING (node_id) WHERE page_version <> version) SELECT node_id, source_name NOT IN (SELECT source_name FROM stale) AS topic_fresh FROM nodes JOIN pg USING (node_id) WHERE page_version = version")
def c10_fresh_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes(spark, sf_dir).withColumn("page_version", F.col("version") - F.when(F.col("node_id") % 6 == 0, 1).otherwise(0))
    stale = rows.where("page_version <> version").select("source_name").distinct().withColumn("s", F.lit(True))
    return rows.where("page_version = version").join(stale, "source_name", "left").select("node_id", F.col("s").isNull().alias("topic_fresh"))


@register("c11_time_window", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS")
def c11_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("asof"))
    return e.crossJoin(F.broadcast(last)).where(F.expr("ts >= asof - INTERVAL 24 HOURS")).select("event_id")  # one row


@register("c12_json_predicates", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0")
def c12_json_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k is not null and k % 2 = 0")


@register("c17_name_prefix", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#0000001%'")
def c17_name_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "customer").where(F.col("c_name").startswith("Customer#0000001")).select("c_custkey", "c_name")


@register("d1_inner_join", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def d1_inner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@register("d3_left_join", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def d3_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").join(t(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality")


@register("d5_left_join_two_keys", "SELECT l.l_orderkey, l.l_linenumber, f.n FROM lineitem l LEFT JOIN (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) f ON l.l_orderkey = f.l_orderkey AND l.l_linenumber = f.l_linenumber")
def d5_left_join_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = t(spark, sf_dir, "lineitem")
    f = l.where("l_returnflag = 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return l.select("l_orderkey", "l_linenumber").join(f, ["l_orderkey", "l_linenumber"], "left")


@register("d6_left_chain", "SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers, coalesce(bool_or(c_acctbal < 0), false) AS any_debt FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def d6_left_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are counted by nation first, so that the chain joins a few rows."""
    c = t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"), F.bool_or(F.col("c_acctbal") < 0).alias("debt"))
    n = t(spark, sf_dir, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = t(spark, sf_dir, "region").join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.groupBy("r_name").agg(F.countDistinct("n_nationkey").alias("nations"), F.coalesce(F.sum("c"), F.lit(0)).alias("customers"), F.coalesce(F.bool_or("debt"), F.lit(False)).alias("any_debt"))


@register("d7_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def d7_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return t(spark, sf_dir, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@register("d8_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def d8_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "customer").join(t(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@register("d8_anti_join_pending", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def d8_anti_join_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = t(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return t(spark, sf_dir, "customer").join(pending, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@register("d9_array_membership", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 23, 50)")
def d9_array_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").where(F.col("p_size").isin(1, 7, 23, 50)).select("p_partkey", "p_size")


@register("d10_correlated_count", "SELECT n_nationkey, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
def d10_correlated_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return t(spark, sf_dir, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", F.coalesce("n", F.lit(0)).alias("suppliers"))


@register("d11_update_from", f"WITH {NODES}, c AS (SELECT node_id FROM nodes WHERE status = 'processing' AND version >= 3) SELECT node_id, CASE WHEN c.node_id IS NOT NULL THEN 'uploaded' ELSE status END AS status FROM nodes LEFT JOIN c USING (node_id)")
def d11_update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    c = n.where("status = 'processing' and version >= 3").select("node_id").withColumn("hit", F.lit(True))
    return n.join(c, "node_id", "left").select("node_id", F.when(F.col("hit"), "uploaded").otherwise(F.col("status")).alias("status"))


@register("d12_natural_key_backfill", "WITH c AS (SELECT p_brand, p_size, count(*) AS n, min(p_partkey) AS one FROM part GROUP BY ALL), r AS (SELECT DISTINCT p_brand, CAST(p_size + 40 AS INT) % 60 AS p_size FROM part) SELECT r.p_brand, r.p_size, CASE WHEN n = 1 THEN one END AS p_partkey, CASE WHEN n = 1 THEN 'linked' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS link FROM r LEFT JOIN c USING (p_brand, p_size)")
def d12_natural_key_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    r = p.select("p_brand", ((F.col("p_size") + 40) % 60).alias("p_size")).distinct()
    return lifecycle.backfill(r, p, ["p_brand", "p_size"], "p_partkey")


@register("d13_index_audit", "SELECT 'registry_without_dense' AS kind, doc_id AS node_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'registry_without_sparse', doc_id FROM documents WHERE doc_id % 9 = 4 UNION ALL SELECT 'dense_without_registry', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'dense_without_sparse', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 9 <> 4)")
def d13_index_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("node_id"))
    return lifecycle.audit(r, t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id")), r.where("node_id % 9 <> 4"))


@register("d14_ordered_lookup", "SELECT rank, c_custkey, c_name FROM (SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) JOIN customer ON c_custkey = o_custkey")
def d14_ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = t(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
    top = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long"))  # twenty rows
    return top.join(t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("rank", "c_custkey", "c_name").orderBy("rank")


@register("d19_symmetric_links", "SELECT a, b FROM (SELECT o_custkey % 50 AS a, o_orderkey % 50 AS b FROM orders UNION SELECT o_orderkey % 50, o_custkey % 50 FROM orders)")
def d19_symmetric_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("a"), (F.col("o_orderkey") % 50).alias("b")).distinct()
    return e.union(e.select("b", "a")).distinct()


@register("h2_union_all_aligned", "SELECT 'topic' AS kind, r_name AS name, NULL AS customers FROM region UNION ALL SELECT 'page', n_name, count(c_custkey) FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def h2_union_all_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    pages = t(spark, sf_dir, "nation").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.lit("page").alias("kind"), F.col("n_name").alias("name"), F.coalesce("c", F.lit(0)).alias("customers"))
    return t(spark, sf_dir, "region").select(F.lit("topic").alias("kind"), F.col("r_name").alias("name")).unionByName(pages, allowMissingColumns=True)


@register("h3_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def h3_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id").subtract(t(spark, sf_dir, "labels").select("doc_id"))


@register("h4_set_intersection", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def h4_set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").intersect(t(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


@register("h5_ordered_unique", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id")
def h5_ordered_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = t(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first"))
    ordered = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first", "role"))).alias("x"))
    return ordered.select("conv_id", F.array_join(F.array_distinct("x.role"), ",").alias("roles"))


@register("i4_hashes", f"WITH {NODES} SELECT node_id, sha256(owner_id || chr(0) || source_name || chr(0) || filename) AS id FROM nodes")
def i4_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("node_id", F.sha2(F.concat_ws("\0", "owner_id", "source_name", "filename"), 256).alias("id"))


@register("i5_numbers", "SELECT o_orderkey, CASE WHEN p LIKE '%.%' THEN rtrim(rtrim(p, '0'), '.') ELSE p END AS number FROM (SELECT o_orderkey, printf('%.2f', o_totalprice) AS p FROM orders)")
def i5_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").select("o_orderkey", X.canonical_number(F.format_number("o_totalprice", 2)).alias("number"))


@register("i13_url_identity", "SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) || rtrim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*(/[^?#]*)', 1), '/') AS identity FROM pages")
def i13_url_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", X.url_identity(F.col("url")).alias("identity"))


@register("i18_held_out", "SELECT doc_id, CAST('0x' || left(sha256(CAST(doc_id AS VARCHAR)), 8) AS BIGINT) % 4 = 0 AS held_out FROM documents")
def i18_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", X.held_out(F.col("doc_id")).alias("held_out"))


@register("i2_query_key", "SELECT p_partkey, lower(regexp_replace(p_name || '-' || p_type, '[\\s\\p{P}\\p{S}]', '', 'g')) AS key FROM part")
def i2_query_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", X.query_key(F.concat_ws("-", "p_name", "p_type")).alias("key"))


@register("i6_identifiers", "SELECT c_custkey, array_to_string(list_distinct(list_transform(regexp_extract_all(c_mktsegment || ' x ' || c_mktsegment, '[A-Z]{2,}'), lambda s: upper(s))), ',') AS ids FROM customer")
def i6_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "customer").select("c_custkey", F.array_join(X.identifiers(F.concat_ws(" x ", "c_mktsegment", "c_mktsegment")), ",").alias("ids"))


@register("i16_answer_match", "SELECT p_partkey, contains(lower(regexp_replace(p_type, '[,\\s]', '', 'g')), 'steel') AS hit FROM part")
def i16_answer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").select("p_partkey", X.answer_form(F.col("p_type")).contains("steel").alias("hit"))


QUEUE = f"(SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'uploaded' WHEN 'O' THEN 'processing' ELSE 'ready' END AS status, o_orderdate AS available_at, o_orderdate + INTERVAL 1 DAY AS created_at, o_orderdate + INTERVAL 2 DAYS AS lease_until, CAST(o_orderkey % 4 AS INT) + 1 AS attempts, o_orderpriority LIKE '1%' AS coded FROM orders)"


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "uploaded").when(F.col("o_orderstatus") == "O", "processing").otherwise("ready").alias("status"), F.col("o_orderdate").alias("available_at"), F.expr("o_orderdate + INTERVAL 1 DAY").alias("created_at"), F.expr("o_orderdate + INTERVAL 2 DAYS").alias("lease_until"), ((F.col("o_orderkey") % 4).cast("int") + 1).alias("attempts"), F.col("o_orderpriority").startswith("1").alias("coded"))


def _at():
    return F.lit(AT).cast("timestamp_ntz")


@register("m1_claim", f"SELECT job_id, status FROM {QUEUE} WHERE (status = 'uploaded' AND available_at <= TIMESTAMP '{AT}') OR (status = 'processing' AND lease_until < TIMESTAMP '{AT}') ORDER BY available_at, created_at, job_id LIMIT 5")
def m1_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.claim(queue(spark, sf_dir), _at(), 5).select("job_id", "status")


@register("c13_due_jobs", f"SELECT job_id FROM {QUEUE} WHERE (status = 'uploaded' AND available_at <= TIMESTAMP '{AT}') OR (status = 'processing' AND lease_until < TIMESTAMP '{AT}')")
def c13_due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue(spark, sf_dir).where(lifecycle.due(_at())).select("job_id")


@register("m3_retry_backoff", f"SELECT job_id, CASE WHEN coded THEN 'failed' WHEN attempts >= 3 THEN 'dead_letter' ELSE 'uploaded' END AS status, CASE WHEN NOT coded AND attempts < 3 THEN pow(2, greatest(attempts - 1, 0)) * 5 END AS wait FROM {QUEUE}")
def m3_retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, wait = lifecycle.failure(F.col("attempts"), F.col("coded"))
    return queue(spark, sf_dir).select("job_id", status.alias("status"), wait.alias("wait"))


@register("m6_archive_stale", f"SELECT event_id, CASE WHEN event_type = 'view' AND ts < (SELECT max(ts) FROM events) - INTERVAL 900 SECONDS THEN 'failed' WHEN event_type = 'view' THEN 'running' ELSE 'succeeded' END AS status FROM events")
def m6_archive_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").select("event_id", F.col("ts").alias("started_at"), F.when(F.col("event_type") == "view", "running").otherwise("succeeded").alias("status"))
    asof = e.agg(F.max("started_at").alias("asof"))
    return lifecycle.archived(e.crossJoin(F.broadcast(asof)), F.col("asof")).select("event_id", "status")  # one row


@register("m7_session_ttl", "SELECT event_id FROM events WHERE ts + INTERVAL 30 MINUTES > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def m7_session_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("asof")))).where(F.expr("ts + INTERVAL 30 MINUTES > asof - INTERVAL 1 HOUR")).select("event_id")  # one row


@register("m8_manual_transitions", f"WITH {NODES} SELECT node_id, CASE status WHEN 'failed' THEN 'uploaded' WHEN 'ready' THEN 'uploaded' ELSE status END AS next, status = 'processing' AS refused FROM nodes")
def m8_manual_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.createDataFrame([("failed", "uploaded"), ("ready", "uploaded")], "status string, to string")
    return nodes(spark, sf_dir).join(F.broadcast(table), "status", "left").select("node_id", F.coalesce("to", "status").alias("next"), F.col("to").isNull().alias("refused"))  # two rows


@register("m9_idempotent_request", "SELECT event_id, CASE WHEN f.first = event_id THEN 'run' WHEN f.kind <> event_type THEN 'conflict' ELSE 'stored' END AS answer FROM events JOIN (SELECT user_id, k, min(event_id) AS first, min_by(event_type, event_id) AS kind FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY ALL) f ON f.user_id = events.user_id AND f.k = CAST(json_extract_string(props, '$.k') AS BIGINT)")
def m9_idempotent_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    f = e.groupBy("user_id", "k").agg(F.min("event_id").alias("first"), F.min_by("event_type", "event_id").alias("kind"))
    return e.join(f, ["user_id", "k"]).select("event_id", F.when(F.col("first") == F.col("event_id"), "run").when(F.col("kind") != F.col("event_type"), "conflict").otherwise("stored").alias("answer"))


@register("m11_stale_propagation", f"WITH {NODES}, ch AS (SELECT DISTINCT source_name FROM nodes WHERE version = 4 AND node_id % 100 = 3) SELECT node_id, CASE WHEN source_name IN (SELECT source_name FROM ch) THEN 'stale' ELSE 'fresh' END AS page FROM nodes")
def m11_stale_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir)
    ch = n.where("version = 4 and node_id % 100 = 3").select("source_name").distinct().withColumn("hit", F.lit(True))
    return n.join(ch, "source_name", "left").select("node_id", F.when(F.col("hit"), "stale").otherwise("fresh").alias("page"))


@register("f19_latest_version", "SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id DESC) AS n FROM documents) WHERE n = 1")
def f19_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.latest(t(spark, sf_dir, "documents"), ["source", "lang"], [F.desc("n_chars"), F.desc("doc_id")]).select("source", "lang", "doc_id")


@register("o3_cascade_delete", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY l_orderkey")
def o3_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t(spark, sf_dir, "lineitem").join(gone, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@register("o6_feedback_upsert", "SELECT user_id, max_by(event_type, event_id) AS last, CASE WHEN max_by(event_type, event_id) = 'purchase' THEN NULL ELSE max_by(props, event_id) END AS reason FROM events GROUP BY user_id")
def o6_feedback_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last rating of each user; a positive one has no reason."""
    last = t(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"), F.max_by("props", "event_id").alias("reason"))
    return last.select("user_id", "last", F.when(F.col("last") != "purchase", F.col("reason")).alias("reason"))


@register("o7_regression_export", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 2000")
def o7_regression_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(2000).select("event_id", "user_id")


@register("o9_purge_user", "SELECT count(*) AS n FROM events WHERE user_id <> 1")
def o9_purge_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").where("user_id <> 1").agg(F.count("*").alias("n"))


@register("g6_clamped_limits", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def g6_clamped_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(max(1, min(5000, 200))).select("o_orderkey")


@register("g9_sort_modes", "SELECT row_number() OVER (ORDER BY visibility DESC, source_name) AS place, source_name, visibility FROM (SELECT DISTINCT 'src' || n AS source_name, CASE WHEN n % 3 = 0 THEN 'private' ELSE 'public' END AS visibility FROM (SELECT CAST(substr(source, 4) AS INT) AS n FROM documents))")
def g9_sort_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = nodes(spark, sf_dir).select("source_name", "visibility").distinct()
    return s.select(F.row_number().over(W.orderBy(F.desc("visibility"), "source_name")).cast("long").alias("place"), "source_name", "visibility")  # one row a source
