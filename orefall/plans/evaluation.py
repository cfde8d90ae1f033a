"""Registered queries over runs, rankings, grounding and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orefall.functions import text as X
from orefall.operators import dense, grounding, metrics
from orefall.plans.registry import DENSE, NODES, asked_vectors, nodes, register, t, vectors

RUNS = "(SELECT event_id AS run_id, user_id, ts AS started_at, event_type, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' ELSE 'succeeded' END AS status, CAST(round(value * 10) AS BIGINT) AS latency_ms, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 END AS rating, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return t(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), "user_id", F.col("ts").alias("started_at"), "event_type",
        F.when(kind == "error", "failed").when(kind == "view", "running").otherwise("succeeded").alias("status"),
        F.round(F.col("value") * 10).cast("long").alias("latency_ms"), F.when(kind == "purchase", 1).when(kind == "error", -1).alias("rating"), F.get_json_object("props", "$.k").cast("long").alias("tokens"),
    )


@register("e4_dashboard", f"SELECT count(*) AS runs, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running, count(*) FILTER (rating > 0) AS positive, count(*) FILTER (rating < 0) AS negative, percentile_cont(0.5) WITHIN GROUP (ORDER BY latency_ms) FILTER (status = 'succeeded') AS p50, percentile_cont(0.95) WITHIN GROUP (ORDER BY latency_ms) FILTER (status = 'succeeded') AS p95, round(avg(latency_ms) FILTER (status = 'succeeded'), 6) AS mean, CAST(sum(tokens) AS BIGINT) AS tokens, round(count(*) FILTER (status = 'succeeded') / count(*) FILTER (status IN ('succeeded', 'failed')), 6) AS success_rate, round(count(rating) / count(*), 6) AS feedback_rate FROM {RUNS}")
def e4_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dashboard(runs(spark, sf_dir))


@register("e5_top_failures", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS code, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, code LIMIT 8")
def e5_top_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).where("status = 'failed'").groupBy(F.col("tokens").alias("code")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(8)


@register("e6_distinct_and_any", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, bool_or(l_discount > 0.09) AS deep, count(DISTINCT CASE WHEN l_tax > 0.05 THEN l_partkey END) AS taxed FROM lineitem GROUP BY 1")
def e6_distinct_and_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.bool_or(F.col("l_discount") > 0.09).alias("deep"), F.countDistinct(F.when(F.col("l_tax") > 0.05, F.col("l_partkey"))).alias("taxed"))


@register("e7_ordered_string_agg", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS kinds FROM orders GROUP BY 1")
def e7_ordered_string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("kinds"))


@register("e8_version_stamp", f"WITH {NODES} SELECT count(*) || ':' || max(node_id) || ':' || CAST(sum(version) AS BIGINT) AS stamp FROM nodes WHERE status = 'ready'")
def e8_version_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("status = 'ready'").agg(F.concat_ws(":", F.count("*"), F.max("node_id"), F.sum("version")).alias("stamp"))


@register("e9_health_issues", f"WITH {NODES} SELECT kind, count(*) AS n FROM (SELECT 'stale' AS kind FROM nodes WHERE version < 2 UNION ALL SELECT 'failed' FROM nodes WHERE status = 'failed' UNION ALL SELECT 'orphan' FROM embeddings ANTI JOIN nodes ON node_id = vec_id UNION ALL SELECT 'unlinked' FROM nodes ANTI JOIN embeddings ON vec_id = node_id) GROUP BY kind")
def e9_health_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = nodes(spark, sf_dir), vectors(spark, sf_dir)
    parts = {"stale": n.where("version < 2"), "failed": n.where("status = 'failed'"), "orphan": e.join(n, "node_id", "left_anti"), "unlinked": n.join(e, "node_id", "left_anti")}
    out = None
    for kind, rows in parts.items():
        one = rows.select(F.lit(kind).alias("kind"))
        out = one if out is None else out.union(one)
    return out.groupBy("kind").agg(F.count("*").alias("n"))


@register("e12_latency_summary", f"SELECT event_type, count(*) AS n, quantile_cont(latency_ms, 0.5) AS median, CAST(quantile_disc(latency_ms, 0.95) AS BIGINT) AS p95, min(latency_ms) AS low, max(latency_ms) AS high FROM {RUNS} GROUP BY 1")
def e12_latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY latency_ms)").alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").cast("long").alias("p95"), F.min("latency_ms").alias("low"), F.max("latency_ms").alias("high"))


@register("e13_error_rate", f"SELECT user_id, round(count(*) FILTER (status = 'failed') / count(*), 6) AS error_rate FROM {RUNS} GROUP BY 1")
def e13_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("user_id").agg(F.round(F.count_if(F.col("status") == "failed") / F.count("*"), 6).alias("error_rate"))


RELEVANT = f"{DENSE}, rel AS (SELECT DISTINCT query_id, v.vec_id AS doc FROM (SELECT DISTINCT query_id, query_label FROM dense) JOIN embeddings v ON v.label = query_label)"
METRIC = "m AS (SELECT q.query_id, coalesce(n, 0) AS n, coalesce(h, 0) AS h, first, coalesce(dcg, 0) AS dcg FROM (SELECT DISTINCT query_id FROM dense) q LEFT JOIN (SELECT query_id, count(*) AS n FROM rel GROUP BY 1) USING (query_id) LEFT JOIN (SELECT query_id, count(*) FILTER (rank <= 5) AS h, min(rank) AS first, sum(1 / log2(rank + 1)) FILTER (rank <= 5) AS dcg FROM dense JOIN rel USING (query_id) WHERE doc = node_id GROUP BY 1) USING (query_id))"


def _ranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rankings (query_id, doc, rank, relevant), and how many relevant documents each query has (query_id, n).

    Relevant are all vectors of the query's label: they are counted by label, and only ranked ones are judged one by one.
    """
    q, v = asked_vectors(spark, sf_dir), vectors(spark, sf_dir)
    asked = q.select("query_id", "query_label")
    ranked = dense.exact(q, v, 10).select("query_id", F.col("node_id").alias("doc"), "rank")
    judged = ranked.join(v.select(F.col("node_id").alias("doc"), "label"), "doc").join(asked, "query_id")
    judged = judged.select("query_id", "doc", "rank", F.coalesce(F.col("label") == F.col("query_label"), F.lit(False)).alias("relevant"))
    sizes = v.groupBy("label").agg(F.count("*").alias("n"))
    return judged, asked.join(sizes, F.col("label") == F.col("query_label")).select("query_id", "n")


@register("p1_ranking_metrics", f"WITH {RELEVANT}, {METRIC} SELECT query_id, round(CASE WHEN n = 0 THEN 1 ELSE h / n END, 6) AS recall, round(h / 5, 6) AS precision, CAST(h > 0 AS DOUBLE) AS hit, CAST(h = n AS DOUBLE) AS complete, round(coalesce(1.0 / first, 0), 6) AS reciprocal_rank, round(CASE WHEN n = 0 THEN 1 ELSE dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, 6) r(i) WHERE i <= n) END, 6) AS ndcg FROM m")
def p1_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.judged_metrics(*_ranked(spark, sf_dir), 5)
    return m.select("query_id", *[(F.round(c, 6) if c not in ("hit", "complete") else F.col(c)).alias(c) for c in m.columns[1:]])


@register("e14_metric_means", f"WITH {RELEVANT}, {METRIC} SELECT round(avg(CASE WHEN n = 0 THEN 1 ELSE h / n END), 6) AS recall, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr, round(avg(CAST(h > 0 AS DOUBLE)), 6) AS hit FROM m")
def e14_metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.judged_metrics(*_ranked(spark, sf_dir), 5)
    return m.agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"), F.round(F.avg("hit"), 6).alias("hit"))


@register("e15_metric_ceilings", f"WITH {RELEVANT}, n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1) SELECT round(avg(least(5, n) / n), 6) AS recall_ceiling, round(avg(CAST(n <= 5 AS INT)), 6) AS complete_ceiling FROM n")
def e15_metric_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _ranked(spark, sf_dir)[1]
    return n.agg(F.round(F.avg(F.least(F.lit(5), F.col("n")) / F.col("n")), 6).alias("recall_ceiling"), F.round(F.avg((F.col("n") <= 5).cast("int")), 6).alias("complete_ceiling"))


@register("f10_smallest_covering_k", f"WITH {RELEVANT} SELECT r.query_id, CASE WHEN count(d.rank) = count(*) THEN max(d.rank) END AS k FROM rel r LEFT JOIN dense d ON d.query_id = r.query_id AND d.node_id = r.doc GROUP BY 1")
def f10_smallest_covering_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, need = _ranked(spark, sf_dir)
    hits = judged.where("relevant").groupBy("query_id").agg(F.count("*").alias("h"), F.max("rank").alias("last"))
    return need.join(hits, "query_id", "left").select("query_id", F.when(F.col("h") == F.col("n"), F.col("last")).cast("long").alias("k"))


@register("f8_ndcg", f"WITH {RELEVANT}, {METRIC} SELECT query_id, round(dcg, 6) AS dcg FROM m")
def f8_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    gain = F.when(F.col("relevant") & (F.col("rank") <= 5), F.lit(1.0) / F.log2(F.col("rank") + 1))
    return _ranked(spark, sf_dir)[0].groupBy("query_id").agg(F.round(F.coalesce(F.sum(gain), F.lit(0.0)), 6).alias("dcg"))


@register("p2_mode_comparison", f"WITH {RELEVANT}, {METRIC} SELECT query_id % 3 AS category, round(avg(coalesce(1.0 / first, 0)), 6) AS vector, count(*) AS n FROM m GROUP BY 1")
def p2_mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.judged_metrics(*_ranked(spark, sf_dir), 5)
    return m.groupBy((F.col("query_id") % 3).alias("category")).agg(F.round(F.avg("reciprocal_rank"), 6).alias("vector"), F.count("*").alias("n"))


TURNS = "(SELECT conv_id, turn, role, text, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS turn_id, len(string_split(text, ' ')) AS tokens FROM conversations)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    upto = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.count(F.when(F.col("role") == "user", True)).over(upto).alias("turn_id"), F.size(F.split("text", " ")).cast("long").alias("tokens"))


@register("f15_current_turn", "SELECT conv_id, turn FROM (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE turn > last")
def f15_current_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(W.partitionBy("conv_id"))
    return t(spark, sf_dir, "conversations").withColumn("last", last).where("turn > last").select("conv_id", "turn")


@register("f16_step_numbers", "SELECT conv_id, turn, count(*) FILTER (role <> 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS step FROM conversations")
def f16_step_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    upto = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", F.count(F.when(F.col("role") != "user", True)).over(upto).alias("step"))


@register("f14_history_trim", f"WITH g AS (SELECT conv_id, turn_id, sum(tokens) AS tokens FROM {TURNS} GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_id DESC) AS back, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn_id DESC) AS total FROM g) SELECT conv_id, turn_id, CAST(total AS BIGINT) AS total FROM w WHERE back = 1 OR (back <= 2 AND total <= 300)")
def f14_history_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turn always, then whole turns back while they fit into two turns and 300 words."""
    g = turns(spark, sf_dir).groupBy("conv_id", "turn_id").agg(F.sum("tokens").alias("tokens"))
    back = W.partitionBy("conv_id").orderBy(F.desc("turn_id"))
    w = g.withColumns({"back": F.row_number().over(back), "total": F.sum("tokens").over(back.rowsBetween(W.unboundedPreceding, 0))})
    return w.where("back = 1 or (back <= 2 and total <= 300)").select("conv_id", "turn_id", "total")


@register("e24_turn_tokens", f"SELECT conv_id, turn_id, CAST(sum(tokens) AS BIGINT) AS tokens FROM {TURNS} GROUP BY ALL")
def e24_turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).groupBy("conv_id", "turn_id").agg(F.sum("tokens").alias("tokens"))


@register("f12_first_overflow", "SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE total <= 900 OR n = 1")
def f12_first_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = W.partitionBy("conv_id").orderBy("turn")
    c = t(spark, sf_dir, "conversations").withColumns({"total": F.sum(F.length("text")).over(by.rowsBetween(W.unboundedPreceding, 0)), "n": F.row_number().over(by)})
    return c.where("total <= 900 or n = 1").select("conv_id", "turn")


@register("f13_coverage_order", f"WITH {DENSE} SELECT query_id, node_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank = 1 THEN 0 WHEN nth = 1 THEN 1 ELSE 2 END, rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS nth FROM dense)")
def f13_coverage_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dense.exact(asked_vectors(spark, sf_dir), vectors(spark, sf_dir), 10).join(vectors(spark, sf_dir).select("node_id", "label"), "node_id")
    first = F.row_number().over(W.partitionBy("query_id", "label").orderBy("rank")) == 1
    order = F.when(F.col("rank") == 1, 0).when(F.col("first"), 1).otherwise(2)
    return d.withColumn("first", first).select("query_id", "node_id", F.row_number().over(W.partitionBy("query_id").orderBy(order, "rank")).cast("long").alias("place"))


@register("f17_marginal_evidence", "SELECT user_id, day, count(*) FILTER (first = day) AS fresh FROM (SELECT user_id, k, day, min(day) OVER (PARTITION BY user_id, k) AS first FROM (SELECT DISTINCT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(ts AS DATE) AS day FROM events)) GROUP BY ALL")
def f17_marginal_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = runs(spark, sf_dir).select("user_id", F.col("tokens").alias("k"), F.to_date("started_at").alias("day")).distinct()
    e = e.withColumn("first", F.min("day").over(W.partitionBy("user_id", "k")))
    return e.groupBy("user_id", "day").agg(F.count_if(F.col("first") == F.col("day")).alias("fresh"))


@register("f18_repeated_queries", "SELECT conv_id, count(*) AS repeats FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id, regexp_replace(lower(text), '[\\s\\p{P}\\p{S}]', '', 'g') ORDER BY turn) AS n FROM conversations) WHERE n > 1 GROUP BY 1")
def f18_repeated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "conversations").groupBy("conv_id", X.query_key(F.col("text")).alias("q")).agg((F.count("*") - 1).alias("r"))
    return c.where("r > 0").groupBy("conv_id").agg(F.sum("r").alias("repeats"))


@register("e16_trajectory", "SELECT steps, count(*) AS n FROM (SELECT conv_id, count(*) FILTER (role <> 'user') AS steps FROM conversations GROUP BY 1) GROUP BY 1")
def e16_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") != "user").alias("steps"))
    return s.groupBy("steps").agg(F.count("*").alias("n"))


@register("e17_kappa", "WITH c AS (SELECT quality AS a, 1 - toxic AS b, count(*) AS n FROM labels GROUP BY ALL), s AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM c), ch AS (SELECT sum(x * y) AS c FROM (SELECT a AS v, sum(n) AS x FROM c GROUP BY 1) JOIN (SELECT b AS v, sum(n) AS y FROM c GROUP BY 1) USING (v)) SELECT round((same / n - c / (n * n)) / (1 - c / (n * n)), 6) AS kappa, round(same / n, 6) AS agreement FROM s, ch")
def e17_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.kappa(t(spark, sf_dir, "labels").withColumn("fine", 1 - F.col("toxic")), "quality", "fine")


@register("e18_mean_error", "SELECT round(avg(abs(l_discount - l_tax)), 6) AS mae, round(avg(CAST(abs(l_discount - l_tax) <= 0.02 + 1e-12 AS INT)), 6) AS within FROM lineitem")
def e18_mean_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.abs(F.col("l_discount") - F.col("l_tax"))
    return t(spark, sf_dir, "lineitem").agg(F.round(F.avg(d), 6).alias("mae"), F.round(F.avg((d <= 0.02 + 1e-12).cast("int")), 6).alias("within"))


@register("e19_answer_scores", "SELECT o_custkey, round(avg(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE NULL END), 6) AS score FROM orders GROUP BY 1")
def e19_answer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted verdicts; those that do not apply are left out, and without any the score is null."""
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.5)), 6).alias("score"))


@register("e21_run_stability", "SELECT l_suppkey, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS low, max(l_quantity) AS high, round(coalesce(stddev_samp(l_quantity), 0), 6) AS deviation FROM lineitem GROUP BY 1")
def e21_run_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(q), 6).alias("mean"), F.min(q).alias("low"), F.max(q).alias("high"), F.round(F.coalesce(F.stddev_samp(q), F.lit(0.0)), 6).alias("deviation"))


@register("e22_win_loss", "SELECT CAST(sign(l_discount - l_tax) AS INT) AS outcome, count(*) AS n FROM lineitem GROUP BY 1")
def e22_win_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem").groupBy(F.sign(F.col("l_discount") - F.col("l_tax")).cast("int").alias("outcome")).agg(F.count("*").alias("n"))


@register("p3_routing_scores", "SELECT conv_id, list_sort(list_distinct(list(role))) = ['assistant', 'user'] AS strict, bool_or(role = 'assistant') AS loose, count(*) FILTER (role NOT IN ('assistant', 'user')) AS over_calls FROM conversations GROUP BY 1")
def p3_routing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = F.array(F.lit("assistant"), F.lit("user"))
    got = F.array_sort(F.collect_set("role"))
    return t(spark, sf_dir, "conversations").groupBy("conv_id").agg((got == want).alias("strict"), F.array_contains(got, "assistant").alias("loose"), F.count_if(~F.col("role").isin("assistant", "user")).alias("over_calls"))


@register("p5_multi_hop_coverage", "SELECT source, len(list_distinct(list(lang))) = 4 AS complete, round(len(list_distinct(list(lang))) / 4, 6) AS coverage FROM documents GROUP BY 1")
def p5_multi_hop_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.array_except(F.array(*map(F.lit, ("de", "en", "es", "fr"))), F.collect_set("lang"))
    return t(spark, sf_dir, "documents").groupBy("source").agg((F.size(missing) == 0).alias("complete"), F.round((4 - F.size(missing)) / 4, 6).alias("coverage"))


@register("p6_threshold_calibration", "WITH r AS (SELECT p_retailprice AS score, p_size > 3 OR p_retailprice > 950 AS ok FROM part), f AS (SELECT min(score) FILTER (ok) AS floor FROM r), m AS (SELECT (s + lead(s) OVER (ORDER BY s)) / 2 AS threshold FROM (SELECT DISTINCT score AS s FROM r)), c AS (SELECT threshold, count(*) FILTER (NOT ok AND score < threshold) AS caught, count(*) FILTER (ok AND score < threshold) AS wrong FROM m, r WHERE threshold IS NOT NULL GROUP BY 1) SELECT caught, threshold FROM c WHERE wrong = 0 AND caught > 0 ORDER BY caught DESC, threshold DESC LIMIT 1")
def p6_threshold_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "part").select(F.col("p_retailprice").alias("score"), ((F.col("p_size") > 3) | (F.col("p_retailprice") > 950)).alias("answerable"))
    return metrics.calibrate(rows)


@register("p6_threshold_found", "WITH r AS (SELECT p_retailprice AS score, p_size > 3 AND p_retailprice > 905 AS ok FROM part), m AS (SELECT (s + lead(s) OVER (ORDER BY s)) / 2 AS threshold FROM (SELECT DISTINCT score AS s FROM r)), c AS (SELECT threshold, count(*) FILTER (NOT ok AND score < threshold) AS caught, count(*) FILTER (ok AND score < threshold) AS wrong FROM m, r WHERE threshold IS NOT NULL GROUP BY 1) SELECT caught, threshold FROM c WHERE wrong = 0 AND caught > 0 ORDER BY caught DESC, threshold DESC LIMIT 1")
def p6_threshold_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p6_threshold_calibration, on scores of which some lie below all that are answerable."""
    rows = t(spark, sf_dir, "part").select(F.col("p_retailprice").alias("score"), ((F.col("p_size") > 3) & (F.col("p_retailprice") > 905)).alias("answerable"))
    return metrics.calibrate(rows)


@register("p7_regression_gate", "WITH b AS (SELECT n_name AS task, CASE WHEN n_nationkey % 3 = 0 THEN 'p50' ELSE 'recall' END AS metric, CASE WHEN n_nationkey % 3 = 0 THEN 100.0 ELSE 0.8 END AS base FROM nation WHERE n_nationkey <> 4), c AS (SELECT n_name AS task, CASE WHEN n_nationkey % 3 = 0 THEN 'p50' ELSE 'recall' END AS metric, CASE WHEN n_nationkey % 3 = 0 THEN 90.0 + 5 * n_nationkey ELSE 0.7 + 0.01 * n_nationkey END AS value FROM nation WHERE n_nationkey <> 7) SELECT task, metric, CAST(base AS DOUBLE) AS base, CAST(value AS DOUBLE) AS value, CASE WHEN base IS NULL OR value IS NULL OR (metric = 'p50' AND value > base * 1.5) OR (metric <> 'p50' AND base - value > 0.03 + 1e-12) THEN 'fail' ELSE 'pass' END AS verdict FROM b FULL JOIN c USING (task, metric)")
def p7_regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = t(spark, sf_dir, "nation")
    k, slow = F.col("n_nationkey"), F.col("n_nationkey") % 3 == 0
    metric = F.when(slow, "p50").otherwise("recall").alias("metric")
    base = n.where("n_nationkey <> 4").select(F.col("n_name").alias("task"), metric, F.when(slow, 100.0).otherwise(0.8).alias("value"))
    cand = n.where("n_nationkey <> 7").select(F.col("n_name").alias("task"), metric, F.when(slow, 90.0 + 5 * k).otherwise((70 + k) / 100).alias("value"))
    return metrics.gate(base, cand)


@register("p8_candidate_validation", "SELECT doc_id FROM labels WHERE quality NOT BETWEEN 0 AND 1 OR toxic IS NULL")
def p8_candidate_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "labels").where("quality not between 0 and 1 or toxic is null").select("doc_id")


@register("p8_contradictory_labels", "SELECT doc_id FROM labels WHERE quality NOT BETWEEN 0 AND 1 OR toxic IS NULL OR (quality = 1 AND toxic = 1)")
def p8_contradictory_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p8_candidate_validation, with a rule that some rows break."""
    return t(spark, sf_dir, "labels").where("quality not between 0 and 1 or toxic is null or (quality = 1 and toxic = 1)").select("doc_id")


@register("p10_agreement_report", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def p10_agreement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@register("p11_ablation_arms", f"WITH {RELEVANT} SELECT arm, round(avg(hit), 6) AS hit FROM (SELECT a AS arm, q.query_id, CAST(count(r.doc) > 0 AS DOUBLE) AS hit FROM (SELECT unnest([1, 3, 10]) AS a), (SELECT DISTINCT query_id FROM dense) q LEFT JOIN dense d ON d.query_id = q.query_id AND d.rank <= a LEFT JOIN rel r ON r.query_id = d.query_id AND r.doc = d.node_id GROUP BY ALL) GROUP BY arm")
def p11_ablation_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of questions with a hit for several depths, in one pass over the ranking."""
    first = _ranked(spark, sf_dir)[0].groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    arms = first.select("query_id", "first", F.explode(F.array(F.lit(1), F.lit(3), F.lit(10))).alias("arm"))
    return arms.groupBy("arm").agg(F.round(F.avg(F.coalesce((F.col("first") <= F.col("arm")).cast("double"), F.lit(0.0))), 6).alias("hit"))


def claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Assistant lines as claims, which cite the user's lines of their conversation."""
    c = t(spark, sf_dir, "conversations")
    said = c.where("role = 'assistant'").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("claim_id"), "text", F.array(F.concat(F.lit("E"), F.col("turn") - 1), F.lit("E99")).alias("evidence_ids"))
    return said, c.where("role = 'user'").select(F.col("conv_id").alias("run_id"), F.concat(F.lit("E"), "turn").alias("evidence_id"), "text")


@register("n3_claim_validation", "SELECT a.conv_id AS run_id, a.turn AS claim_id, CAST(u.turn IS NOT NULL AS INT) AS valid, CASE WHEN u.turn IS NULL THEN 2 ELSE 1 END AS invalid FROM conversations a LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' WHERE a.role = 'assistant'")
def n3_claim_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.check_claims(*claims(spark, sf_dir)).select("run_id", "claim_id", F.size("valid_ids").alias("valid"), F.size("invalid_ids").alias("invalid"))


@register("e10_citation_metrics", "SELECT a.conv_id AS run_id, count(*) AS claims, round(count(u.turn) / count(*), 6) AS coverage, round(count(u.turn) / (2 * count(*)), 6) AS validity FROM conversations a LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' WHERE a.role = 'assistant' GROUP BY 1")
def e10_citation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = grounding.citation_metrics(grounding.check_claims(*claims(spark, sf_dir)))
    return m.select("run_id", "claims", F.round("coverage", 6).alias("coverage"), F.round("validity", 6).alias("validity"))


@register("n5_answer_support", "SELECT DISTINCT conv_id AS run_id, 'blocked' AS support FROM conversations WHERE role = 'assistant'")
def n5_answer_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.support(grounding.citation_metrics(grounding.check_claims(*claims(spark, sf_dir)))).select("run_id", "support")


@register("n2_context_assembly")
def n2_context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dense.exact(asked_vectors(spark, sf_dir), vectors(spark, sf_dir), 10)
    rows = d.join(nodes(spark, sf_dir), "node_id").select(F.col("query_id").alias("run_id"), ((F.col("rank") - 1) % 2).cast("long").alias("call"), F.col("rank").cast("long").alias("rank"), F.col("source_name").alias("document"), X.content_hash(F.col("content")).alias("hash"), F.size(F.split("content", " ")).cast("long").alias("tokens"))
    return grounding.assemble(rows, budget=1500, limit=6, per_call=4)


@register("e11_context_metrics")
def e11_context_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n2_context_assembly(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@register("n6_duplicate_suppression", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, regexp_replace(lower(text), '[\\s\\p{P}\\p{S}]', '', 'g') ORDER BY turn) AS n FROM conversations) WHERE n > 1")
def n6_duplicate_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = W.partitionBy("conv_id", X.query_key(F.col("text"))).orderBy("turn")
    return t(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(by)).where("n > 1").select("conv_id", "turn")


@register("n4_truncated_answers", "SELECT conv_id, turn, CASE WHEN right(trim(text), 1) = ':' THEN trim(text) || chr(10) || 'claim' ELSE trim(text) END AS answer FROM (SELECT conv_id, turn, text || CASE WHEN turn % 2 = 0 THEN ':' ELSE '' END AS text FROM conversations)")
def n4_truncated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("text", F.when(F.col("turn") % 2 == 0, ":").otherwise("")).alias("text"))
    a = F.trim("text")
    return c.select("conv_id", "turn", F.when(F.right(a, F.lit(1)) == ":", F.concat_ws("\n", a, F.lit("claim"))).otherwise(a).alias("answer"))


@register("n9_string_grounding", "SELECT conv_id, turn, round(len(list_filter(w, lambda x: contains(upper(p), upper(x)))) / len(w), 6) AS share FROM (SELECT a.conv_id, a.turn, string_split(a.text, ' ') AS w, u.text AS p FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant')")
def n9_string_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.split("text", " ").alias("w"))
    u = c.select(F.col("conv_id").alias("k"), (F.col("turn") + 1).alias("n"), X.upper(F.col("text")).alias("p"))
    rows = a.join(u, (F.col("conv_id") == F.col("k")) & (F.col("turn") == F.col("n")))
    return rows.select("conv_id", "turn", F.round(F.size(F.filter("w", lambda x: F.contains(F.col("p"), X.upper(x)))) / F.size("w"), 6).alias("share"))
