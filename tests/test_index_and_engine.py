"""Stored index, cache, providers, wiki and the engine's front."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from orefall.config import User
from orefall.errors import CodedError
from orefall.operators import providers, wiki
from orefall.plans.engine import Engine
from orefall.plans.index import Cache, Index, Signature

DOC = "document_id long, source_name string, owner_id string, visibility string, filename string, text string"
ROWS = [(1, "s", "u1", "private", "a.md", "# A\nalpha beta-1 gamma"), (2, "s", "u2", "public", "b.md", "# B\nalpha delta"), (3, "t", "u2", "private", "c.md", "alpha epsilon")]


def test_index(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "ix"))
    with pytest.raises(CodedError):
        ix.part("nodes")
    ix.check(Signature("m", 64))
    first = ix.build(spark.createDataFrame(ROWS, DOC))
    assert ix.part("nodes").count() == 3 and {r["term"] for r in ix.postings_of(["beta-1", "nope"]).collect()} == {"beta-1"}
    assert ix.rebuild() != first and ix.part("lengths").count() == 3
    ix.delete(spark.createDataFrame([(1,)], "document_id long"))
    assert {r["document_id"] for r in ix.part("nodes").collect()} == {2, 3} and ix.postings_of(["beta-1"]).count() == 0 and ix.part("parents").count() == 2
    ix.check(Signature("m", 64))
    with pytest.raises(CodedError) as e:
        ix.check(Signature("other", 64))
    assert e.value.code == "index_mismatch"
    before = ix.version
    with pytest.raises(Exception):
        ix.publish({"nodes": ix.part("nodes"), "parents": ix.part("parents"), "postings": ix.part("postings").select(F.raise_error(F.lit("x")).alias("term")), "lengths": ix.part("lengths")})
    assert ix.version == before


def test_unsigned_data_needs_adoption(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "ix"))
    ix.build(spark.createDataFrame(ROWS, DOC))
    with pytest.raises(CodedError) as e:
        ix.check(Signature("m", 64))
    assert e.value.code == "unsigned_index"
    ix.check(Signature("m", 64), adopt=True)


def test_cache():
    now = [0.0]
    c = Cache(seconds=60, entries=2, clock=lambda: now[0])
    a = Cache.key("u", False, "1", " Hello  world", k=5)
    assert a == Cache.key("u", False, "1", "hello world", k=5) != Cache.key("u", True, "1", "hello world", k=5) and a != Cache.key("u", False, "2", "hello world", k=5)
    c.put(a, [1])
    c.get(a).append(2)
    assert c.get(a) == [1]
    c.put("b", 1)
    c.get(a)
    c.put("c", 1)
    assert c.get("b") is None and c.get(a) == [1]
    now[0] = 61
    assert c.get(a) is None


def test_providers(spark):
    df = spark.createDataFrame([("one two",), (None,)], "t string")
    v = providers.embedded(df, "t", lambda: providers.hashed_embedder(8), 8).collect()
    assert len(v[0]["embedding"]) == 8 and abs(np.linalg.norm(v[0]["embedding"]) - 1) < 1e-6
    with pytest.raises(Exception, match="dimension"):
        providers.embedded(df, "t", lambda: providers.hashed_embedder(8), 9).collect()
    q = spark.createDataFrame([(1, "red fox")], "query_id long, text string")
    c = spark.createDataFrame([(1, 1, 1, "blue whale"), (1, 2, 2, "a red fox")], "query_id long, node_id long, rank long, content string")
    assert [r["node_id"] for r in providers.reranked(c, q).orderBy("rank").collect()] == [2, 1]
    assert [r["node_id"] for r in providers.reranked(c, q, lambda a, b: [len(x) for x in b]).orderBy("rank").collect()] == [1, 2]
    h = providers.hypothetical(q, spark.createDataFrame([(1, "foxes are red")], "query_id long, answer string"))
    assert h.first()["text"] == "foxes are red\nred fox"


def test_wiki(spark):
    docs = spark.createDataFrame([(1, "s", "a.md", "# Alpha\nred fox", 2, "ready"), (2, "s", "b.md", "blue", 1, "ready"), (3, "s", "c.md", "x", 1, "failed")], "document_id long, source_name string, filename string, text string, version long, status string")
    page = wiki.pages(docs)
    assert {r["document_id"]: r["title"] for r in page.collect()} == {1: "Alpha", 2: "b"}
    plan = '[{"title":"Big Topic","summary":"s","related":["a","b"]},{"title":"big topic"},{"title":" "},{"title":"T2"},{"title":"T3"},{"title":"T4"}]'
    assert [r["title"] for r in wiki.topics(spark.createDataFrame([(1, plan), (2, "broken")], "document_id long, plan string")).collect()] == ["Big Topic", "T2", "T3"]
    old = page.withColumn("version", F.lit(1))
    assert [r["document_id"] for r in wiki.stale(old, docs).collect()] == [1]
    assert {r["kind"]: r["n"] for r in wiki.lint(old, docs, spark.createDataFrame([(1,)], "document_id long")).collect()} == {"stale": 1, "failed": 1, "unlinked": 1}
    hits = wiki.search(page, spark.createDataFrame([(1, "alpha fox")], "query_id long, text string")).collect()
    assert [(r["document_id"], r["reference"]) for r in hits] == [(1, "W1")]


def test_engine(spark):
    nodes = spark.createDataFrame([(i, f, s, o, v, t) for i, s, o, v, f, t in ROWS], "node_id long, filename string, source_name string, owner_id string, visibility string, content string")
    tables = {"mine": (spark.range(3).toDF("n"), "u1", "private"), "theirs": (spark.range(4).toDF("n"), "u2", "private"), "all": (spark.range(5).toDF("n"), "u2", "public")}
    e, u = Engine(spark, nodes, tables), User("u1")
    assert {r["node_id"] for r in e.search(u, "alpha")} == {1, 2} and e.search(u, "alpha") == e.search(u, " Alpha ")
    assert e.visible_tables(u) == ["all", "mine"] and e.query(u, "SELECT sum(n) AS s FROM mine").rows == [(3,)]
    with pytest.raises(CodedError) as x:
        e.query(u, "SELECT * FROM theirs")
    assert x.value.code == "permission_denied"
    assert e.execute(u, 2, "vector_search", {"query": "delta", "top_k": 1})[0]["evidence_id"] == "E2.1" and e.execute(u, 1, "table_query", {"sql": "SELECT n FROM mine"})[0]["module"] == "table"
    with pytest.raises(CodedError):
        e.search(u, "  ")
    assert {r["source_name"] for r in e.domains(u).collect()} == {"s"} and e.describe(u)["mine"] == [("n", "bigint")]


def test_search_reads_the_stored_index(spark, tmp_path):
    """Same answers as over the nodes; the plan of a question reads postings and lengths, and content of what it found alone."""
    from orefall.plans.retrieval import Options, Retriever

    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rng = np.random.default_rng(4)
    rows = [(i, f"s{i % 3}", f"u{i % 4}", "public" if i % 2 else "private", f"f{i}.md", " ".join(rng.choice(words, 30)) + f" id-{i}") for i in range(60)]
    ix = Index(spark, str(tmp_path / "ix"))
    ix.build(spark.createDataFrame(rows, DOC))
    user = User("u1")
    q = spark.createDataFrame([(1, "alpha id-7"), (2, "beta gamma"), (3, "nothing here")], "query_id long, text string")
    for o in (Options(mode="keyword"), Options(mode="keyword", source="s1"), Options(mode="keyword", filters={"filename": ["f1.md", "f9.md", "f2.md"]})):
        plain = Retriever(ix.part("nodes"), user).plan(q, o).collect()
        stored = Retriever.over(ix, user).plan(q, o)
        assert sorted(map(str, stored.collect())) == sorted(map(str, plain)) and plain
    r = Retriever.over(ix, user)
    plan = r._arms(r.nodes, q, Options(mode="keyword"))["keyword"]._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[(.*?)\] .*?DataFilters: \[(.*)", plan)
    assert scans and not any("content" in columns for columns, _ in scans) and any("term" in columns and " IN (" in kept for columns, kept in scans)
    e = Engine(spark, ix)
    assert e.search(user, "id-7")[0]["filename"] == "f7.md" and e.version == ix.version


def test_publishing_never_shows_an_empty_index(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "ix"))
    versions = [ix.build(spark.createDataFrame(ROWS, DOC)) for _ in range(3)]
    other = Index(spark, str(tmp_path / "ix"))
    assert other.version == versions[-1] and sorted(ix._names("v-")) == sorted(versions[1:])  # the one before stays for its readers
    with pytest.raises(CodedError):
        ix.write_json(ix._names("current-")[-1], {"version": "x"})
    assert other.version == versions[-1] and not ix._names(".current")
