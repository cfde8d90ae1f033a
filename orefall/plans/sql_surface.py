"""Registered queries of the guarded SQL surface, segmentation, HTML loading and windowed metrics."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orefall.operators import segmentation
from orefall.plans.guard import Guard
from orefall.plans.registry import nodes, register, t
from orefall.streaming import windows

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

#: Statements that both engines run as they are: joins, set operations, windows, CTEs, grouping sets.
STATEMENTS = {
    "l6_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "l6_revenue_by_nation": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name",
    "l6_forecast_revenue": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.04999 AND 0.07001 AND l_quantity < 24",
    "l6_top_orders": "SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders) WHERE nth = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 150",
    "l6_order_priority": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority",
    "l6_customers_without_orders": "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY c_mktsegment",
    "l6_promotion_share": "SELECT round(100 * sum(CASE WHEN p_type LIKE 'P%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS share FROM lineitem JOIN part ON l_partkey = p_partkey",
    "l6_cte_large_orders": "WITH big AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) SELECT o_custkey, count(*) AS n FROM orders JOIN big ON o_orderkey = l_orderkey GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 100",
    "h6_intersect_except": "(SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 2",
    "e26_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS BIGINT) AS g FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
    "e26_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "f21_frames": "SELECT o_orderstatus, quarter, count(*) AS n, CAST(sum(CAST(round(s3 * 100) AS BIGINT)) AS BIGINT) AS cents, max(o_orderkey - before) AS widest FROM (SELECT o_orderkey, o_orderstatus, sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s3, CAST(ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS quarter, lag(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS before FROM orders) GROUP BY o_orderstatus, quarter",
    "d22_full_outer": "SELECT coalesce(c_nationkey, s_nationkey) AS nation, c, s FROM (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_nationkey < 15 GROUP BY 1) FULL OUTER JOIN (SELECT s_nationkey, count(*) AS s FROM supplier WHERE s_nationkey > 8 GROUP BY 1) ON c_nationkey = s_nationkey",
    "l6_recursive": "WITH RECURSIVE up(n, x) AS (SELECT 1, 1 UNION ALL SELECT n + 1, x * 2 FROM up WHERE n < 12) SELECT n, x FROM up",
    "l6_correlated_scalar": "SELECT p_brand, count(*) AS n, round(min(p_retailprice), 2) AS least FROM part p WHERE p_retailprice > (SELECT 1.0 * avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand) GROUP BY p_brand",
    "l6_self_join": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
}


def _statement(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Guard(spark, {n: partial(t, spark, sf_dir, n) for n in TABLES}).plan(sql)

    return run


for _name, _sql in STATEMENTS.items():
    register(_name, _sql)(_statement(_sql))


@register("l2_visible_tables", "SELECT 'nation' AS table_name, 25 AS row_count UNION ALL SELECT 'region', 5")
def l2_visible_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("nation", "region"):
        one = t(spark, sf_dir, name).agg(F.lit(name).alias("table_name"), F.count("*").cast("int").alias("row_count"))
        out = one if out is None else out.union(one)
    return out


@register("d22_as_of_join", "SELECT e.event_id, p.event_id AS last_error FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def d22_as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's last error up to it: both sides in one sorted pass, instead of a range join."""
    e = t(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("error"))
    seen = W.partitionBy("user_id").orderBy("ts").rangeBetween(W.unboundedPreceding, W.currentRow)
    last = F.max(F.when(F.col("error"), F.struct("ts", "event_id"))).over(seen)
    return e.select("event_id", last["event_id"].alias("last_error"))


@register("d22_range_join", "SELECT p.p_partkey, count(b.lo) AS bands FROM part p JOIN (SELECT 900 + 10 * i AS lo, 900 + 10 * i + 25 AS hi FROM range(0, 120) r(i)) b ON p.p_retailprice >= b.lo AND p.p_retailprice < b.hi GROUP BY 1")
def d22_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values in overlapping intervals: both sides are cut into cells of a width, joined by cell, and checked."""
    width = 25
    b = spark.range(120).select((900 + 10 * F.col("id")).alias("lo"), (925 + 10 * F.col("id")).alias("hi"))
    cells = b.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    p = t(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.floor(F.col("p_retailprice") / width).alias("cell"))
    return p.join(cells, "cell").where("p_retailprice >= lo and p_retailprice < hi").groupBy("p_partkey").agg(F.count("lo").alias("bands"))


@register("m13_windowed_metrics", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def m13_windowed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.windowed(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@register("m13_sessions", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS \"end\", count(*) AS n FROM (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTES, true) AS fresh FROM events)) GROUP BY user_id, s")
def m13_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = windows.sessions(e)
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@register("m13_sliding_windows", "SELECT start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS start FROM events) GROUP BY ALL")
def m13_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.windowed(e, "1 hour", "30 minutes").withColumn("start", F.col("start").cast("timestamp_ntz"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = nodes(spark, sf_dir).select(F.col("node_id").alias("document_id"), "source_name", "owner_id", "visibility", "filename", F.concat_ws("\n", F.concat(F.lit("# Document "), "node_id"), F.col("content")).alias("text"))
    return segmentation.hierarchy(d)


@register("k1_markdown_sections", "SELECT doc_id, 'Part ' || doc_id AS path, length(trim(text, chr(10) || ' ')) AS n FROM documents WHERE length(trim(text, chr(10) || ' ')) > 0")
def k1_markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of texts that got a heading: one for each, with the heading as its path."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [(d.doc_id, path, len(body.strip("\n "))) for d in pdf.itertuples(index=False) for path, body in segmentation.sections(f"# Part {d.doc_id} #\n{d.text}")]
            yield pd.DataFrame(rows, columns=["doc_id", "path", "n"])

    return t(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, path string, n long")


@register("k3_small_to_big")
def k3_small_to_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).drop("parent_content", "content")


@register("k3_parents")
def k3_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.parents(_chunks(spark, sf_dir)).drop("content")


@register("a8_html_to_markdown")
def a8_html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orefall.sources.files import parse_files

    pages = t(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("length"), F.col("html").cast("binary").alias("content"))
    return parse_files(pages)


@register("a15_upload_registration", "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 8000 THEN 'failed' ELSE 'uploaded' END AS status, CASE WHEN octet_length(encode(text)) > 8000 THEN 'too_large' END AS code FROM documents")
def a15_upload_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orefall.sources.files import parse_files

    files = t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    return parse_files(files, most=8000).select(F.col("path").cast("long").alias("doc_id"), "status", F.nullif(F.split_part("error", F.lit(":"), F.lit(1)), F.lit("")).alias("code"))
