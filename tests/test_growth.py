"""Steps whose size once grew faster than their input, and values that once differed from SQL."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orefall.functions import text
from orefall.operators import catalogue, dense, graph, lexical, segmentation


def _vectors(spark, n, seed=3, copies=1):
    x = np.random.default_rng(seed).normal(size=(n, 8)).astype(np.float32).astype(float)
    return spark.createDataFrame([(i * copies + c, x[i].tolist()) for i in range(n) for c in range(copies)], "node_id long, embedding array<float>")


def _brute(rows, asked, k):
    x = np.array([r["embedding"] for r in rows])
    ids = np.array([r["node_id"] for r in rows])
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    out = {}
    for q in asked:
        s = np.round(u @ u[list(ids).index(q)], 12)
        out[q] = [int(ids[i]) for i in np.lexsort((ids, -s))[:k]]
    return out


@pytest.mark.parametrize("copies", [1, 7])
def test_dense_search_meets_in_parts_and_leaves_ties_to_keys(spark, monkeypatch, copies):
    monkeypatch.setattr(dense, "QUERIES", 16)
    monkeypatch.setattr(dense, "VECTORS", 50)
    monkeypatch.setattr(dense, "STEP", 5)
    v = _vectors(spark, 60, copies=copies)
    q = v.where("node_id % 5 = 0").select(F.col("node_id").alias("query_id"), "embedding")
    want = _brute(v.collect(), [r[0] for r in q.select("query_id").collect()], 10)
    # All vectors in one cell, or every cell probed: the lists must find what brute force does.
    for found in (dense.exact(q, v, 10), dense.approximate(q, v, 10, dense.cells(v, 4), probes=4)):
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["node_id"])
        assert got == want


def test_dense_search_keeps_queries_and_vectors_as_rows(spark, monkeypatch):
    from pyspark.sql import DataFrame

    v = _vectors(spark, 30)
    q = v.select(F.col("node_id").alias("query_id"), "embedding")
    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("rows went to the driver"))
    near = dense.approximate(q, v, 3, np.eye(4, 8), probes=4)
    plans = [d._jdf.queryExecution().executedPlan().toString() for d in (dense.exact(q, v, 3), near)]
    assert all("FlatMapCoGroupsInArrow" in p for p in plans)
    assert "zip_with" not in plans[1].lower()  # no cosine of one pair at a time over joined rows


def test_reached_nodes_are_counted_by_their_sets(spark):
    edges = [(a, a % 3) for a in range(40)] + [(a, 7) for a in range(0, 40, 4)] + [(None, 1), (5, None)]
    e = spark.createDataFrame(edges, "a long, b long")
    front = spark.createDataFrame([(1, 0), (1, 7), (1, 7), (2, 1), (3, 9), (4, None)], "query_id long, b long")
    got = {r["query_id"]: r["reached"] for r in graph.reached(front, e).collect()}
    asked = {1: {0, 7}, 2: {1}}
    assert got == {q: len({a for a, b in edges if b in bs}) for q, bs in asked.items()}
    big = spark.range(200_000).select(F.col("id").alias("a"), F.lit(1).cast("long").alias("b"))
    many = spark.range(20_000).select(F.col("id").alias("query_id"), F.lit(1).cast("long").alias("b"))
    assert graph.reached(many, big).agg(F.min("reached")).first()[0] == 200_000  # four thousand million pairs


def test_upper_case_keeps_one_character_one(spark, tmp_path):
    import duckdb

    from orefall.plans import catalog

    texts = ["Straße SS", "ﬁne FI ﬁ", "ᾳ ᾼ ΑΙ ΐ", "ŉ ǰ É é ı", "SS", "gruß"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(text.upper(F.col("t"))).collect()] == [duckdb.execute("select upper(?)", [t]).fetchall()[0][0] for t in texts]
    turns = [(1, 0, "user", "Die Straße am Fluß"), (1, 1, "assistant", "SS FI Straße STRASSE straẞe fluß"), (2, 0, "user", "ﬁn"), (2, 1, "assistant", "FI ﬁ")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("i7_traced_values", "n9_string_grounding"):
        got = catalog.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(got.columns)} from ({catalog.ORACLES[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("step", [3, 1 << 21])
def test_search_of_texts_equals_the_index(spark, tmp_path, monkeypatch, step):
    monkeypatch.setattr(lexical, "STEP", step)
    words = ["alpha", "beta-1", "gamma", "研发", "delta_x", "omega"]
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(40)] + ["alpha gamma"] * 30 + [None, ""]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node_id long, content string").coalesce(2)
    q = spark.createDataFrame([(1, "alpha gamma alpha"), (2, "beta 研发"), (3, None), (4, "none")], "query_id long, text string")
    key = lambda rows: sorted((r["query_id"], r["node_id"], round(r["score"], 9)) for r in rows.collect())
    for every in (True, False):
        want = lexical.bm25(lexical.query_terms(q, all_tokens=every), lexical.postings(nodes, all_tokens=every), lexical.stats(nodes))
        assert key(lexical.search(q, nodes, None, str(tmp_path / f"a{every}"), every)) == key(want) != []
        best = lexical.search(q, nodes, 4, str(tmp_path / f"b{every}"), every)
        assert key(best) == key(lexical.top(want.withColumn("sort", F.round("score", 9)), 4, score="sort"))
    twice = nodes.union(nodes.where("node_id < 5"))  # keys that repeat
    want = lexical.bm25(lexical.query_terms(q), lexical.postings(twice), lexical.stats(twice))
    assert key(lexical.search(q, twice, None, str(tmp_path / "c"))) == key(want)
    assert lexical.search(q.where("query_id = 3"), nodes, 4, str(tmp_path / "d")).count() == 0


def test_searched_texts_are_cut_in_batches(spark, tmp_path, monkeypatch):
    """The pass over the texts cut each of them by expressions, most of a search's time."""
    monkeypatch.setattr(lexical, "tokens", lambda c: pytest.fail("texts are cut by expressions"))
    nodes = spark.createDataFrame([(1, "Alpha-1 alpha 研发部"), (2, None), (3, "")], "node_id long, content string")
    q = spark.createDataFrame([(1, "alpha")], "query_id long, text string")
    assert [(r["node_id"], r["rank"]) for r in lexical.search(q, nodes, 2, str(tmp_path / "a")).collect()] == [(1, 1)]
    assert sorted(r["length"] for r in spark.read.parquet(str(tmp_path / "a")).where("node_id <> 2").collect()) == [0, 6]  # alpha-1, alpha, 1, alpha, 研发, 发部


def test_candidates_go_to_the_nodes(spark, monkeypatch):
    """Above the size at which Spark broadcasts by itself, every node's content was shuffled to meet a few candidates."""
    from orefall.plans.registry import CALLER
    from orefall.plans.retrieval import Options, Retriever

    kinds = "node_id long, filename string, source_name string, owner_id string, visibility string, content string"
    nodes = spark.createDataFrame([(i, f"{i}.md", "s", "u1", "public", f"alpha beta {i}") for i in range(20)], kinds)
    q = spark.createDataFrame([(1, "alpha"), (2, "beta 7")], "query_id long, text string")
    got = []
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, join in ((lexical.HELD_PAIRS, "BroadcastHashJoin"), (30, "SortMergeJoin")):
            monkeypatch.setattr(lexical, "HELD_PAIRS", most)
            found = Retriever(nodes, CALLER).plan(q, Options(top_k=3, mode="keyword"))
            assert join in found._jdf.queryExecution().executedPlan().toString()
            got.append(sorted(map(tuple, found.collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got[0] == got[1] and len(got[0]) == 6


def test_tokens_of_a_column_are_those_of_each_text(spark):
    import pyarrow as pa

    from orefall.functions.token_bytes import token_rows

    rng = np.random.default_rng(5)
    signs = list("ab09-_./ AZ\n研发䷿一鿿ꀀéßİK😀　")
    texts = [None, "", "a", "x.y-z", "-a--b_", "研", "研a发部", "K9-İ"] + ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    rows = df.select(F.lower("t").alias("low"), text.tokens(F.col("t")).alias("all"), text.latin_tokens(F.col("t")).alias("latin")).collect()
    low = pa.array([None] + [r["low"] for r in rows], pa.string()).slice(1)
    for cjk, name in ((True, "all"), (False, "latin")):
        got = [[] for _ in rows]
        row, words = token_rows(low, cjk)
        for i, w in zip(row.tolist(), words.to_pylist()):
            got[i].append(w)
        assert [sorted(g) for g in got] == [sorted(r[name] or []) for r in rows]


def test_texts_are_put_into_lower_case_in_batches(spark):
    """Each text was put into lower case by an expression, a sixth of the pass over the texts."""
    import pyarrow as pa

    from orefall.functions.token_bytes import token_rows

    texts = ["Alpha-1 BETA_x", "İstanbul Kelvin K9-İ ẞ", "研A发"] + [f"A{chr(c)}B" for c in [*range(1, 0x3000), *range(0xA000, 0xAC00), *range(0xF900, 0x10000)]]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = [sorted(r["w"]) for r in df.select("i", text.tokens(F.col("t")).alias("w")).orderBy("i").collect()]
    got = [[] for _ in texts]
    row, words = token_rows(pa.array(texts))
    for i, w in zip(row.tolist(), words.to_pylist()):
        got[i].append(w)
    assert [sorted(g) for g in got] == want


@pytest.mark.parametrize("step", [30, 1 << 21])
def test_copies_of_a_text_have_the_same_score(spark, tmp_path, monkeypatch, step):
    """A node's sum is not cut where a step ends: copies have one score to its last digit."""
    monkeypatch.setattr(lexical, "STEP", step)
    words = "one two three four five six seven eight nine ten".split()
    texts = [" ".join(words) + " two three three seven"] * 60 + [" ".join(words[: i % 11]) for i in range(40)]
    nodes = spark.createDataFrame(list(enumerate(texts)), "node_id long, content string").coalesce(1)
    q = spark.createDataFrame([(i, " ".join(words[i:])) for i in (0, 1, 2)], "query_id long, text string")
    found = lexical.search(q, nodes, None, str(tmp_path / "a")).where("node_id < 60")
    assert [tuple(r) for r in found.groupBy("query_id").agg(F.count("*"), F.countDistinct("score")).orderBy("query_id").collect()] == [(0, 60, 1), (1, 60, 1), (2, 60, 1)]


def test_keyword_scores_are_summed_where_their_nodes_are(spark, tmp_path):
    """Pairs of queries and postings, many times the postings, were shuffled to be summed."""
    nodes = spark.range(50).select(F.col("id").alias("node_id"), F.lit("alpha beta gamma").alias("content"))
    q = spark.createDataFrame([(i, "alpha beta gamma") for i in range(9)], "query_id long, text string")
    plan = lexical.search(q, nodes, None, str(tmp_path / "a"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    plan = lexical.bm25(lexical.query_terms(q), lexical.postings(nodes), lexical.stats(nodes))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, node_id", plan)


def test_pieces_are_handed_on_in_steps(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "s", "o", "public", f"{i}.md", f"# T {i}\n" + "One two three. " * 300) for i in range(30)], "document_id long, source_name string, owner_id string, visibility string, filename string, text string").coalesce(1)
    want = sorted(map(tuple, segmentation.hierarchy(docs).collect()))
    monkeypatch.setattr(segmentation, "STEP_CHARS", 5000)
    assert sorted(map(tuple, segmentation.hierarchy(docs).collect())) == want

    class Taken:
        """Stands for docs and gives the function of its tasks."""

        schema = docs.schema
        select = lambda self, *columns: self
        mapInPandas = lambda self, run, schema: run

    frames = [len(f) for f in segmentation.hierarchy(Taken())([docs.toPandas()])]
    assert sum(frames) == len(want) and max(frames) < len(want) / 5


def test_a_word_of_all_questions_gathers_none_of_them(spark):
    held = spark.createDataFrame([("t", "c", "New York"), ("t", "c", "York")], '`table` string, `column` string, value string')
    asked = spark.createDataFrame([(i, "york new" if i % 2 else "old york") for i in range(20)], "query_id long, text string")
    rows = catalogue.link(asked, catalogue.index(held))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search(r"hashpartitioning\(word", plan)
    assert sorted((r["query_id"], r["value"]) for r in rows.collect()) == sorted([(i, "York") for i in range(20)] + [(i, "New York") for i in range(1, 20, 2)])


@pytest.mark.parametrize("step", [3, 1 << 21])
def test_counts_of_a_node_are_its_postings(spark, monkeypatch, step):
    monkeypatch.setattr(lexical, "STEP", step)
    texts = ["alpha beta-1 alpha", None, "", "研发 alpha 研", "gamma/x gamma"] * 3
    nodes = spark.createDataFrame([(i, f"u{i}", t) for i, t in enumerate(texts)], "node_id long, owner_id string, content string").coalesce(2)
    made = lexical.counts(nodes, ["owner_id"])
    assert "Exchange hash" not in made._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["node_id"], t, f) for r in made.collect() for t, f in zip(r["terms"] or [], r["freqs"] or []))
    assert got == sorted(map(tuple, lexical.postings(nodes).collect()))
    assert {(r["node_id"], r["term_count"]) for r in made.collect()} == set(map(tuple, lexical.stats(nodes).collect()))


def test_many_questions_are_scored_once_from_the_stored_postings(spark, tmp_path, monkeypatch):
    """Postings were shuffled with all scopes three times to be stored, and for each question and block to be searched."""
    from orefall.config import User
    from orefall.plans import index, retrieval

    rng = np.random.default_rng(6)
    words = np.array([f"w{i}" for i in range(40)] + ["w-1", "w_2"])
    docs = [(i, f"s{i % 3}", f"u{i % 3}", ("public", "private")[i % 2], f"f{i}.md", " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(150)]
    df = spark.createDataFrame(docs, "document_id long, source_name string, owner_id string, visibility string, filename string, text string")
    ix = index.Index(spark, str(tmp_path / "ix"))
    ix.build(df.where("document_id < 120"))
    ix.add(df.where("document_id >= 110"))
    ix.delete(spark.createDataFrame([(5,), (8,)], "document_id long"))
    assert set(ix.part("postings").columns) == {"node_id", "term", "freq", "node_terms", "bucket", "visibility", "owner_id", "segment"}
    q = spark.createDataFrame([(i, " ".join(rng.choice(words, 8))) for i in range(12)] + [(99, None)], "query_id long, text string")
    found = {}
    for pushed in (1000, 3):
        monkeypatch.setattr(retrieval, "PUSHED", pushed)
        found[pushed] = sorted((r["query_id"], r["rank"], r["node_id"], round(r["score"], 9)) for r in retrieval.Retriever.over(ix, User("u1")).keyword(q, 7).collect())
    assert found[3] == found[1000] and len(found[3]) == 84
    blocks = ix.part("blocks").groupBy("segment", "term", "bucket").agg(F.sum("n").alias("n"))
    every = ix.raw("postings").groupBy("segment", "term", "bucket").agg(F.count("*").alias("n"))
    assert blocks.exceptAll(every).isEmpty() and every.exceptAll(blocks).isEmpty()


def test_pairs_of_terms_and_questions_are_held_in_bounded_steps():
    many = np.full(3000, lexical.STEP // 100)
    steps = lexical._steps(many)
    assert steps[0][0] == 0 and steps[-1][1] == 3000 and all(a[1] == b[0] for a, b in zip(steps, steps[1:]))
    assert max(many[a:b].sum() for a, b in steps) <= lexical.STEP + many[0]
