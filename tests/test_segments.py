"""Segments of the stored index: any history equals a full rebuild, only new folders are written, and pruned searches lose no row."""

import collections
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from orefall.config import User
from orefall.errors import CodedError
from orefall.operators import lexical
from orefall.operators.lifecycle import audit
from orefall.plans import question
from orefall.plans.engine import Engine
from orefall.plans.index import Index
from orefall.plans.retrieval import Options, Retriever

DOC = "document_id long, source_name string, owner_id string, visibility string, filename string, text string"
WORDS = [f"word{i}" for i in range(60)]


def documents(ids, salt=0):
    out = []
    for i in ids:
        rng = np.random.default_rng(1000 * salt + i)
        n = int(rng.integers(5, 400))
        words = [WORDS[min(59, int(x))] for x in rng.exponential(9, n)]
        out.append((i, f"s{i % 3}", f"u{i % 4}", "public" if i % 3 else "private", f"f{i}.md", f"# Title {i % 5}\n" + " ".join(words) + f" only-{i}."))
    return out


def contents(ix):
    drop = {"nodes": ["segment"], "parents": ["segment"], "postings": ["segment", "bucket"], "lengths": ["segment", "bucket"]}
    out = {n: sorted(str(sorted(r.asDict().items())) for r in ix.part(n).drop(*d).collect()) for n, d in drop.items()}
    total = ix.part("totals").groupBy("visibility", "owner_id").agg(F.sum("nodes").alias("nodes"), F.sum("terms").alias("terms")).where("nodes > 0")
    return out | {"totals": sorted(map(str, total.collect()))}


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def answers(spark, index, user, queries, **options):
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    return sorted(map(str, Retriever.over(index, user).plan(q, Options(mode="keyword", **options)).collect()))


def plain_answers(spark, nodes, user, queries, **options):
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    return sorted(map(str, Retriever(nodes, user).plan(q, Options(mode="keyword", **options)).collect()))


QUESTIONS = ["word1 word2 only-7", "word50 word51 word0", "only-3 only-9", "nothing", "word0", "only-4 word3 word3"]


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """An index with a history, and one built at once from what is left."""
    a, b = (Index(spark, str(tmp_path_factory.mktemp("ix") / "x")) for _ in range(2))
    a.build(spark.createDataFrame(documents(range(40)), DOC))
    before = files(a.path)
    a.add(spark.createDataFrame(documents(range(40, 44)) + documents([3, 5], salt=1), DOC))
    after = files(a.path)
    a.delete(spark.createDataFrame([(7,), (41,)], "document_id long"))
    last = files(a.path)
    left = [r for r in documents(range(44)) if r[0] not in (3, 5, 7, 41)] + documents([3, 5], salt=1)
    b.build(spark.createDataFrame(left, DOC))
    return a, b, (before, after, last)


def test_any_history_equals_a_full_build(grown):
    a, b, _ = grown
    assert contents(a) == contents(b)


def test_only_new_folders_are_written(grown):
    _, _, (before, after, last) = grown
    assert {k: after[k] for k in before} == before and {k: last[k] for k in after} == after
    added = {p.split("/x/")[1].split("/")[0] for p in set(after) - set(before)}
    assert sorted(x[:2] for x in added) == ["t-", "v-"]
    assert {p.split("/x/")[1][:2] for p in set(last) - set(after)} == {"t-"}


@pytest.mark.parametrize("user", [User("u1"), User("x", is_admin=True)])
def test_searches_equal_those_over_the_nodes(spark, grown, user):
    a, b, _ = grown
    for options in ({"top_k": 1, "pool": 2}, {"top_k": 30}, {"source": "s1"}):
        want = plain_answers(spark, b.part("nodes").drop("segment"), user, QUESTIONS, **options)
        assert answers(spark, a, user, QUESTIONS, **options) == want == answers(spark, b, user, QUESTIONS, **options) and want


@pytest.mark.parametrize("first", [256, 1])
def test_one_question_is_answered_as_in_a_batch(spark, grown, monkeypatch, first):
    monkeypatch.setattr(question, "FIRST_BLOCKS", first)
    a, _, _ = grown
    user, e = User("u1"), Engine(spark, a)
    q = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id long, text string")
    for options in ({}, {"top_k": 2, "pool": 1}):
        rows = [r.asDict() for r in Retriever.over(a, user).plan(q, Options(mode="keyword", **options)).orderBy("query_id", "rank").collect()]
        for i, text in enumerate(QUESTIONS):
            assert e.search(user, text, mode="keyword", **options) == [r | {"query_id": 1} for r in rows if r["query_id"] == i], (text, options)
    assert Engine(spark, a).search(User("u1"), "...", mode="keyword") == []


def test_questions_with_many_terms_or_buckets_go_through_the_batch_plan(spark, grown, monkeypatch):
    a, _, _ = grown
    want = Engine(spark, a).search(User("u1"), "word1 only-7", mode="keyword")
    for name in ("TERMS", "SUMS"):
        monkeypatch.setattr(question, name, 0)
        assert question.Question(a).best(User("u1"), "word1 only-7", 5) is None
        assert Engine(spark, a).search(User("u1"), "word1 only-7", mode="keyword") == want
        monkeypatch.undo()


def test_merging_keeps_rows_and_drops_tombstones(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "x"))
    ix.build(spark.createDataFrame(documents(range(30)), DOC))
    for k in range(4):
        ix.add(spark.createDataFrame(documents(range(30 + 2 * k, 32 + 2 * k)), DOC))
    ix.delete(spark.createDataFrame([(31,), (2,)], "document_id long"))
    want, was = contents(ix), ix.manifest
    big = max(was.segments, key=was.segments.get)
    ix.merge()
    now = ix.manifest
    assert contents(ix) == want and big in now.segments and len(now.segments) == 2 and now.tombstones
    assert {r["segment"] for r in ix.dead().collect()} == {big}
    ix.merge(everything=True)
    assert contents(ix) == want and len(ix.manifest.segments) == 1 and not ix.manifest.tombstones
    assert ix.merge() == ix.version
    ix.rebuild()
    assert contents(ix) == want


def test_prune_leaves_an_empty_audit(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "x"))
    ix.build(spark.createDataFrame(documents(range(12)), DOC))
    registry = spark.createDataFrame([(i,) for i in range(12) if i not in (4, 9)], "document_id long")

    def sides():
        return audit(registry, ix.part("nodes"), ix.part("postings"), "document_id").where("kind not like 'registry%'").select("document_id").distinct().collect()

    assert {r[0] for r in sides()} == {4, 9}
    v = ix.prune(registry)
    assert not sides() and v == ix.version and ix.prune(registry) == v


def test_the_second_of_two_writers_is_refused(spark, tmp_path, monkeypatch):
    one, two = (Index(spark, str(tmp_path / "x")) for _ in range(2))
    one.build(spark.createDataFrame(documents(range(3)), DOC))
    old = two.manifest
    one.delete(spark.createDataFrame([(1,)], "document_id long"))
    monkeypatch.setattr(Index, "_current", lambda self: old)
    with pytest.raises(CodedError) as e:
        two.delete(spark.createDataFrame([(2,)], "document_id long"))
    monkeypatch.undo()
    assert e.value.code == "publish_failed" and {r[0] for r in two.part("nodes").select("document_id").distinct().collect()} == {0, 2}


def test_a_failed_write_leaves_the_version(spark, tmp_path):
    ix = Index(spark, str(tmp_path / "x"))
    v = ix.build(spark.createDataFrame(documents(range(3)), DOC))
    bad = spark.createDataFrame(documents(range(3, 5)), DOC).withColumn("text", F.raise_error(F.lit("x")).cast("string"))
    with pytest.raises(Exception):
        ix.add(bad)
    assert ix.version == v and ix.part("nodes").select("document_id").distinct().count() == 3


def test_blocks_that_cannot_reach_the_kth_score_are_not_read(spark):
    """Against plain BM25 on many buckets; the bounds leave most postings of the frequent term aside."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(4000):
        rows.append((i, "common", int(rng.integers(1, 3)), 50))
        if i % 500 == 0:
            rows += [(i, "rare", 3, 50), (i, "rarer" if i % 1000 == 0 else "other", 2, 50)]
    post = spark.createDataFrame([("s", n // 16, t, n, f, m) for n, t, f, m in rows], "segment string, bucket long, term string, node_id long, freq long, node_terms long")
    blocks = post.groupBy("segment", "bucket", "term").agg(F.count("*").alias("n"), F.max("freq").alias("most"), F.min("node_terms").alias("shortest"))
    terms = spark.createDataFrame([(1, "common"), (1, "rare"), (2, "common"), (2, "rarer"), (3, "none")], "query_id long, term string")
    total = spark.createDataFrame([(4000.0, 50.0)], "n double, avg_len double")
    got = lexical.top_by_blocks(terms, post, blocks, total, 4, first=8)
    lengths = spark.createDataFrame([(i, 50) for i in range(4000)], "node_id long, term_count long")
    plain = lexical.top(lexical.bm25(terms, post.select("node_id", "term", "freq"), lengths).withColumn("sort", F.round("score", 9)), 4, score="sort")
    assert [(r["query_id"], r["node_id"], round(r["score"], 9), r["rank"]) for r in got.orderBy("query_id", "rank").collect()] == [(r["query_id"], r["node_id"], round(r["score"], 9), r["rank"]) for r in plain.orderBy("query_id", "rank").collect()]
    df = collections.Counter(t for _, t, _, _ in rows)
    gain = lambda f: f * 2.5 / (f + 1.5)
    idf = {t: math.log(1 + (4000 - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    kth = got.where("query_id = 1 and rank = 4").first()["score"]
    assert idf["common"] * gain(2) < kth <= idf["common"] * gain(2) + idf["rare"] * gain(3)
