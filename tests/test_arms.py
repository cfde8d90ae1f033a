"""Retrieval modes side by side against plain Python, rankings that find nothing, broken categories, vector variants, listings."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from orefall.functions import vectors as V
from orefall.operators import arms, catalogue, fusion

KINDS = "query_id long, node_id long, score double, rank long"
NODES = [(1, "a", "red fox runs", "x"), (2, "a", "red fox runs", "x"), (3, "b", "green pond", "y"), (4, "c", "red pond and fox", "x"), (5, "d", "", "y"), (6, "e", "fox", "x")]
DENSE = [(7, 3, 0.9, 1), (7, 2, 0.8, 2), (7, 1, 0.7, 3), (7, 4, 0.6, 4), (8, 5, 0.5, 1)]
KEYWORD = [(7, 4, 3.0, 1), (7, 1, 2.0, 2), (7, 6, 1.0, 3)]


def plain(dense, keyword, k, pool):
    """The four rankings of one question by their definition."""
    hashes, words = {n: h for n, h, _, _ in NODES}, {n: set(c.split()) for n, _, c, _ in NODES}

    def firsts(ranked):
        seen, out = set(), []
        for n in ranked:
            if hashes[n] not in seen:
                seen.add(hashes[n])
                out.append(n)
        return out

    place = [{n: i for i, n in enumerate(x, 1)} for x in (dense, keyword)]
    fused = sorted({*dense, *keyword}, key=lambda n: (-round(sum(1 / (60 + p[n]) for p in place if n in p), 12), place[1].get(n, math.inf), n))
    asked = {"red", "fox"}
    hybrid = firsts(fused)
    again = sorted(hybrid[:pool], key=lambda n: (-(len(words[n] & asked) / len(words[n] | asked) if words[n] else 0), hybrid.index(n)))
    return {"vector": firsts(dense)[:k], "keyword": firsts(keyword)[:k], "hybrid": hybrid[:k], "hybrid+rerank": again[:k]}


@pytest.fixture(scope="module")
def parts(spark):
    nodes = spark.createDataFrame(NODES, "node_id long, hash string, content string, label string").withColumn("filename", F.col("node_id")).withColumn("embedding", F.array(F.lit(1.0), F.col("node_id").cast("double")))
    return {"dense": spark.createDataFrame(DENSE, KINDS), "keyword": spark.createDataFrame(KEYWORD, KINDS)}, nodes, spark.createDataFrame([(7, "red fox"), (8, "red fox")], "query_id long, text string")


@pytest.mark.parametrize("k, pool", [(3, 4), (2, 2), (10, 10)])
def test_rankings_by_definition(parts, k, pool):
    got = {}
    for r in sorted(arms.rankings(*parts, k, pool).collect(), key=lambda r: r["rank"]):
        got.setdefault((r["arm"], r["query_id"]), []).append(r["node_id"])
    for q in (7, 8):
        want = plain([n for x, n, _, _ in DENSE if x == q], [n for x, n, _, _ in KEYWORD if x == q], k, pool)
        assert {a: got.get((a, q), []) for a in want} == want


def test_mmr_is_one_more_arm(parts):
    rows = arms.rankings(*parts, 3, 4, mmr_weight=0.7)
    assert {r["arm"] for r in rows.select("arm").distinct().collect()} == {"vector", "keyword", "hybrid", "hybrid+rerank", "hybrid+mmr"}
    assert rows.where("arm = 'hybrid+mmr' AND query_id = 7").count() == 3


def test_an_arm_that_finds_nothing_counts_as_zero(spark, parts):
    judged = arms.rankings(*parts, 3, 4).withColumn("relevant", F.col("node_id") == 4)
    need = spark.createDataFrame([(7, 1), (8, 2), (9, 0)], "query_id long, n long")
    m = {(r["arm"], r["query_id"]): r for r in arms.measured(judged, need, ["vector", "keyword"]).collect()}
    assert len(m) == 6
    assert m["keyword", 7]["reciprocal_rank"] == 1 and m["keyword", 7]["recall_3"] == 1 and m["keyword", 7]["ndcg_3"] == 1
    assert m["vector", 7]["reciprocal_rank"] == pytest.approx(1 / 3) and m["vector", 7]["ndcg_3"] == pytest.approx(1 / 2)
    assert m["keyword", 8]["reciprocal_rank"] == m["keyword", 8]["recall_10"] == m["vector", 8]["hit_5"] == 0
    assert m["vector", 9]["recall_3"] == m["vector", 9]["ndcg_10"] == m["vector", 9]["complete_5"] == 1
    s = {r["arm"]: r for r in arms.summary(arms.measured(judged, need, ["vector", "keyword"])).collect()}
    assert s["keyword"]["queries"] == 3 and s["keyword"]["mrr"] == round(1 / 3, 6)


def test_broken_categories(spark):
    rows = [(a, q, 1, x) for q, xs in ((1, (1.0, 0.0, 0.5)), (2, (1.0, 1.0, 1.0)), (3, (0.5, 0.5, 0.25)), (4, (1.0, 1.0, 1.0))) for a, x in zip(("vector", "keyword", "hybrid"), xs)]
    m = spark.createDataFrame(rows, "arm string, query_id long, n long, reciprocal_rank double")
    c = spark.createDataFrame([(1, "codes"), (2, "prose"), (3, "mixed"), (4, "codes")], "query_id long, category string")
    got = {r["category"]: r for r in arms.by_category(m, c).collect()}
    assert {k: r["broken"] for k, r in got.items()} == {"codes": True, "prose": False, "mixed": False}
    assert got["codes"]["queries"] == 2 and got["codes"]["gain"] == -0.25 and got["codes"]["keyword"] == 0.5
    assert arms.by_category(m.limit(0), c).count() == 0


def test_hybrid_is_the_fusion_of_both(parts):
    one = arms.rankings(*parts, 10, 10).where("arm = 'hybrid' AND query_id = 7").orderBy("rank").collect()
    whole = [r["node_id"] for r in fusion.rrf(parts[0], tie="keyword").where("query_id = 7").orderBy("rank").collect()]
    assert [r["node_id"] for r in one] == [n for n in whole if n != 2]


def test_vector_variants_never_pad(spark):
    df = spark.createDataFrame([([3.0, 4.0, 12.0],)], "v array<double>")

    def made(*a):
        return df.select(V.transformed(F.col("v"), *a).alias("x")).first()["x"]

    assert made("native_l2") == made("native_l2", 3) == pytest.approx([3 / 13, 4 / 13, 12 / 13])
    assert made("truncate_l2", 2) == pytest.approx([0.6, 0.8])
    for bad in (("native_l2", 2), ("truncate_l2", 4)):
        with pytest.raises(PySparkException):
            made(*bad)
    for bad in (("pad",), ("truncate_l2",)):
        with pytest.raises(ValueError):
            made(*bad)


def test_listing_in_order_of_name(spark):
    tables = {"b": spark.range(3).withColumn("x y", F.lit(1)), "a": spark.range(0)}
    rows = [tuple(r) for r in catalogue.listing(tables, call=2).orderBy("evidence_id").collect()]
    assert rows == [("E2.1", "a", "a: 0 rows, columns id"), ("E2.2", "b", "b: 3 rows, columns id, x y")]
    assert catalogue.listing(tables, most=1).count() == 1
    with pytest.raises(ValueError):
        catalogue.listing({})
