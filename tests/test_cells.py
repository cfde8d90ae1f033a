"""Two-level cells against brute force: recall at a tenth of the cells, exact answers, hot cells, nulls, and no query on the driver."""

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefall.operators import cells

KIND = "node_id long, embedding array<double>"


def brute(x, ids, q, k):
    s = cells.unit(q) @ cells.unit(x).T
    return [[ids[j] for j in sorted(range(len(ids)), key=lambda j: (-round(r[j], 9), ids[j]))[:k]] for r in s]


def got_ids(df, n):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["node_id"])
    return [out.get(i, []) for i in range(n)]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    middle = rng.standard_normal((40, 16))
    own = np.where(rng.random(3000) < 0.34, 0, rng.integers(0, 40, 3000))  # one cluster holds a third
    x = middle[own] + 0.5 * rng.standard_normal((3000, 16))
    return x, x[::20] + 0.05 * rng.standard_normal((150, 16))


@pytest.fixture(scope="module")
def made(spark, clustered, tmp_path_factory):
    x, q = clustered
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(9000, None), (9001, [0.0] * 16)], KIND)
    return cells.build(v, str(tmp_path_factory.mktemp("cells") / "x"), per_cell=32), spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "query_id long, embedding array<double>")


def test_every_vector_lies_in_a_cell_within_its_radius(made, clustered):
    c, _ = made
    rows = c.members.join(c.fine, ["coarse", "fine"]).collect()
    assert sorted(r["node_id"] for r in rows) == list(range(3000))
    for r in rows[::50]:
        assert np.linalg.norm(np.array(r["v"]) - np.array(r["centre"])) <= r["radius"] + 1e-9
        assert np.linalg.norm(np.array(r["v"]) - c.coarse[r["coarse"]]) <= c.radius[r["coarse"]] + 1e-9
    assert 60 <= c.count <= 140 and max(r["n"] for r in c.fine.collect()) < 1000


def test_recall_at_a_tenth_of_the_cells(made, clustered):
    x, q = clustered
    c, asked = made
    want, got = brute(x, list(range(3000)), q, 10), got_ids(cells.approximate(asked, c, 10), len(q))
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(want, got)]) >= 0.9


def test_the_share_for_a_recall_is_measured(spark, made, clustered, tmp_path):
    c, asked = made
    assert cells.share_for(asked, c, 10) <= 0.1
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 32))  # no clusters
    flat = cells.build(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], KIND), str(tmp_path / "x"), per_cell=8)
    q = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:40])], "query_id long, embedding array<double>")
    share = cells.share_for(q, flat, 5)
    got = got_ids(cells.approximate(q, flat, 5, share), 40)
    assert share > 0.1 and np.mean([len(set(a) & set(b)) / 5 for a, b in zip(brute(x, list(range(400)), x[:40], 5), got)]) >= 0.88


def test_exact_answers_equal_brute_force(made, clustered):
    x, q = clustered
    c, asked = made
    assert got_ids(cells.exact(asked, c, 10), len(q)) == brute(x, list(range(3000)), q, 10)
    assert got_ids(cells.exact(asked.limit(3), c, 3000, share=0.01), 3) == brute(x, list(range(3000)), q[:3], 3000)


def test_more_cells_for_more_vectors(spark, made, clustered, tmp_path):
    x, _ = clustered
    few = cells.build(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:600])], KIND), str(tmp_path / "x"), per_cell=32)
    assert few.count * 3 < made[0].count and len(few.coarse) < len(made[0].coarse)


def test_cells_larger_than_a_block(spark, clustered, tmp_path, monkeypatch):
    x, q = clustered
    monkeypatch.setattr(cells, "VECTORS", 20)
    monkeypatch.setattr(cells, "QUERIES", 7)
    c = cells.build(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:800])], KIND), str(tmp_path / "x"), per_cell=100)
    assert c.members.agg(F.max("part")).first()[0] > 2
    asked = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q[:30])], "query_id long, embedding array<double>")
    assert got_ids(cells.exact(asked, c, 5), 30) == brute(x[:800], list(range(800)), q[:30], 5)


def test_ties_odd_queries_and_empty_tables(spark, tmp_path):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(7)] + [(9, [0.0, 1.0])], KIND)
    c = cells.build(v, str(tmp_path / "x"))
    asked = spark.createDataFrame([(0, [2.0, 0.0]), (1, None), (2, [0.0, 0.0])], "query_id long, embedding array<double>")
    got = got_ids(cells.exact(asked, c, 3), 3)
    assert got[0] == [0, 1, 2] and got[1] == [] and len(got[2]) == 3
    with pytest.raises(ValueError):
        cells.build(v.where("false"), str(tmp_path / "y"))


def test_no_query_reaches_the_driver(made, monkeypatch):
    c, asked = made
    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("collected"))
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: pytest.fail("collected"))
    assert cells.exact(asked, c, 3).schema.names == ["query_id", "node_id", "score", "rank"]


@pytest.fixture()
def many_partitions(spark):
    put = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_queries_meet_tiles_and_no_row_holds_a_query_and_a_fine_cell(spark, many_partitions, tmp_path, monkeypatch):
    """A row for each query and fine cell held the query's vector: without clusters these were many times the input."""
    monkeypatch.setattr(cells, "VECTORS", 100)
    monkeypatch.setattr(cells, "QUERIES", 20)
    monkeypatch.setattr(cells, "STEP", 7)
    x = np.random.default_rng(4).standard_normal((600, 16))
    x[500:520] = x[7]  # copies: ties go to the lesser key
    c = cells.build(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], KIND), str(tmp_path / "x"), per_cell=4)
    asked = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:50])], "query_id long, embedding array<double>")
    want = brute(x, list(range(600)), x[:50], 10)
    assert got_ids(cells.exact(asked, c, 10), 50) == want
    assert got_ids(cells.approximate(asked, c, 10, share=1.0), 50) == want
    near = got_ids(cells.approximate(asked, c, 10, share=cells.share_for(asked, c, 10)), 50)
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(want, near)]) >= 0.88
    first, many, tiles = cells._tiles(c)
    assert c.count > 5 * tiles and int(c.size.sum()) == 600 and 6 <= tiles <= 14
    rows = cells._rows(asked, "embedding").withColumns({"floor": F.lit(-2.0), "limit": F.lit(9.0)})
    met = cells._scores(rows, c, 1, lambda d, floor, limit: d < 9)
    assert met.count() <= 50 * tiles  # the best of each query in each tile, not in each cell


def test_limits_hold_the_share_of_cells(spark, made, clustered):
    c, asked = made
    x, q = clustered
    centre = np.array([r["centre"] for r in c.fine.collect()])
    limit = {r["query_id"]: r["limit"] for r in cells._limits(asked, c, "embedding", 0.2).collect()}
    d, probes = cells._distance(cells.unit(q), centre), round(c.count * 0.2)
    assert len(limit) == len(q) and all(probes <= (d[i] <= limit[i]).sum() and limit[i] - np.sort(d[i])[probes - 1] <= 2 / cells.BINS + 1e-9 for i in range(len(q)))
