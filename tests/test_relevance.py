"""The ranking queries against brute force, in which every vector of a query's label is relevant, whatever its id."""

import math

import numpy as np
import pytest

from orefall.plans import catalog
from tests.conftest import SMALL


def asked(spark, path):
    """For each query: its ten best vectors in order, and all vectors of its label."""
    rows = sorted((r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect())
    x = np.array([r[2] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i, (q, label, _) in enumerate(rows):
        if q % 20 == 0:
            best = np.argsort(-(x @ x[i]), kind="stable")[:10]
            yield q, [rows[j][0] for j in best], {r[0] for r in rows if r[1] == label}


@pytest.fixture(scope="module")
def want(spark):
    return {q: ([n + 1 for n, d in enumerate(docs) if d in rel], docs, rel) for q, docs, rel in asked(spark, SMALL)}


def got(spark, name):
    return catalog.QUERIES[name](spark, SMALL).collect()


def mean(x):
    return pytest.approx(sum(x) / len(x), abs=1e-6)


def test_relevant_ids_reach_past_any_prefix(want):
    assert max(max(rel) for _, _, rel in want.values()) > 400 and max(len(rel) for _, _, rel in want.values()) > 10


def test_metrics_of_each_query(spark, want):
    assert len(want) == len(got(spark, "p1_ranking_metrics"))
    dcg = {q: sum(1 / math.log2(r + 1) for r in ranks if r <= 5) for q, (ranks, _, _) in want.items()}
    for r in got(spark, "p1_ranking_metrics"):
        ranks, _, rel = want[r["query_id"]]
        h, ideal = sum(x <= 5 for x in ranks), sum(1 / math.log2(i + 1) for i in range(1, min(5, len(rel)) + 1))
        assert (r["recall"], r["precision"], r["hit"], r["complete"]) == (pytest.approx(h / len(rel), abs=1e-6), h / 5, float(h > 0), float(h == len(rel)))
        assert (r["reciprocal_rank"], r["ndcg"]) == (pytest.approx(1 / ranks[0], abs=1e-6), pytest.approx(dcg[r["query_id"]] / ideal, abs=1e-6))
    assert {r["query_id"]: r["dcg"] for r in got(spark, "f8_ndcg")} == pytest.approx(dcg, abs=1e-6)
    assert {r["query_id"]: r["reciprocal"] for r in got(spark, "f7_reciprocal_rank")} == pytest.approx({q: 1 / w[0][0] for q, w in want.items()}, abs=1e-6)
    assert {r["query_id"]: (r["complete"], r["recall"]) for r in got(spark, "f9_complete_recall")} == {q: (len(ranks) == len(rel), pytest.approx(len(ranks) / len(rel), abs=1e-6)) for q, (ranks, _, rel) in want.items()}
    assert {r["query_id"]: r["k"] for r in got(spark, "f10_smallest_covering_k")} == {q: ranks[-1] if len(ranks) == len(rel) else None for q, (ranks, _, rel) in want.items()}
    assert {(r["query_id"], r["doc"], r["rank"]) for r in got(spark, "d17_relevance_join")} == {(q, docs[r - 1], r) for q, (ranks, docs, _) in want.items() for r in ranks}


def test_means(spark, want):
    ranks, sizes = [w[0] for w in want.values()], [len(w[2]) for w in want.values()]
    h = [sum(x <= 5 for x in r) for r in ranks]
    e14, e15 = got(spark, "e14_metric_means")[0], got(spark, "e15_metric_ceilings")[0]
    assert (e14["recall"], e14["mrr"], e14["hit"]) == (mean([a / n for a, n in zip(h, sizes)]), mean([1 / r[0] for r in ranks]), mean([a > 0 for a in h]))
    assert (e15["recall_ceiling"], e15["complete_ceiling"]) == (mean([min(5, n) / n for n in sizes]), mean([n <= 5 for n in sizes]))
    assert {r["arm"]: r["hit"] for r in got(spark, "p11_ablation_arms")} == {a: mean([r[0] <= a for r in ranks]) for a in (1, 3, 10)}
    assert {r["arm"]: r["mrr"] for r in got(spark, "p16_benchmark_arms")} == {"dense": mean([1 / r[0] for r in ranks]), "reverse": mean([1 / (11 - r[-1]) for r in ranks])}
    assert {r["category"]: (r["vector"], r["n"]) for r in got(spark, "p2_mode_comparison")} == {c: (mean([1 / w[0][0] for q, w in want.items() if q % 3 == c]), sum(q % 3 == c for q in want)) for c in range(3)}
    docs = [[w[1][r - 1] for r in w[0]] for w in want.values()]
    arms = {"child": [len(d) for d in docs], "parent": [len({x // 4 for x in d}) for d in docs]}
    assert {r["arm"]: (r["mean"], r["median"]) for r in got(spark, "e23_parent_child_ablation")} == {a: (mean(v), float(np.median(v))) for a, v in arms.items()}
