"""Importance resampling against a plain computation, ranks over many partitions, and odd rows."""

import collections
import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from orefall.llm import importance
from tests.llm.test_operators import SCHEMA, odd_rows, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain(docs, target, runs=1, size=10_000):
    """The contract, read literally."""
    def feats(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % size for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    s, t = collections.Counter(b for _, x in docs for b in feats(x)), collections.Counter(b for x in target for b in feats(x))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + size) / ((s[b] + 1) * (T + size)))) for b in range(size)]
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        f = feats(x)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k for k, r in enumerate(able[: 10 * len(able) // 100], start=1)}
    return sorted((r[:4] + [drawn.get(id(r))] for r in rows), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    texts = [(1000 + i, prose(i, 10 + i % 60) + (" Ünïcode ÉCOLE Straße 日本 x1y2" if i % 4 == 0 else " UPPER Case") , *[None] * 8) for i in range(300)]
    rows = odd_rows() + texts
    target = [(1, "river stone light Under the ÉCOLE"), (2, None), (3, "")]
    return rows, target, spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(target, "item_id long, text string")


@pytest.mark.parametrize("runs", [1, 3])
def test_rows_equal_a_plain_computation(tables, runs):
    rows, target, docs, items = tables
    got = importance.resample(docs, items, runs=runs).collect()
    want = plain([(r[0], r[1]) for r in rows], [r[1] for r in target], runs)
    # Rows that repeat key and text have the same score; which of them has which rank is arbitrary.
    assert sorted((list(r) for r in got), key=str) == want
    assert sum(r["rank"] is not None for r in got) == 10 * sum(len(words(r[1])) >= 20 for r in rows) // 100 > 20


def test_ranks_have_no_gaps_whatever_the_partitions(spark):
    scored = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(30).alias("n_words"), (F.col("id") % 3).alias("score"))
    for n in ("1", "4", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got = importance.ranked(scored, per_cent=50).where("rank is not null").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        want = sorted(((-(i % 3), i) for i in range(5000)))[:2500]
        assert [(r["rank"], r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(k, i) for k, (_, i) in enumerate(want, start=1)]


def test_empty_tables(spark, tables):
    _, _, docs, items = tables
    assert importance.resample(docs.where("false"), items).count() == 0
    nothing = importance.resample(docs, items.where("false"))
    assert nothing.count() == docs.count()


def test_scoring_makes_no_row_for_a_feature(tables):
    _, _, docs, _ = tables
    plan = importance.weights(docs, [0] * importance.BUCKETS)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan.replace("RoundRobinPartitioning", "").split("Project")[0]
