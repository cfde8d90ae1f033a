"""Vector search by two levels of cells: their number grows with the table, and bounds make the answer exact where that is asked for."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orefall.functions.vectors import doubles
from orefall.operators.lexical import top

#: Vectors in a fine cell, about. Coarse cells at most, and fine cells of one coarse cell at most.
PER_CELL, COARSE, FINE = 64, 4096, 2048
#: Vectors that coarse centres are fitted on at most, and vectors for each fine centre; those whose keys hash lowest.
SAMPLE, SAMPLE_PER_CELL = 20_000, 16
#: Vectors, and queries, that meet in one task's group at most, about, and queries that one step in it holds.
VECTORS, QUERIES, STEP = 4096, 4096, 256
#: Steps of distance, from 0 to 2, by which the nearest cells are counted, and queries that recall is measured with.
BINS, MEASURED = 1024, 64


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1, n)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of equal length as rows, without Python objects."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(flat):
        return np.zeros((0, 0))
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))


def centres_of(x: np.ndarray, count: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """`count` centres by spherical k-means; an empty cell takes the vector that is farthest from its own centre."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:count]]
    for _ in range(rounds):
        s = x @ c.T
        own = s.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        c = unit(sums)
        c[empty] = x[np.argsort(s.max(axis=1), kind="stable")[: len(empty)]]
    return c


def _distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ c.T), 0))


@dataclass
class Cells:
    """coarse: centres, at most COARSE of them. radius, reach, size: of each, the largest distance of its vectors and of its fine
    centres, and the number of its vectors. The tables lie in `path`.

    fine: coarse, fine, centre, radius, n. members: key, v (unit length), coarse, fine, part; a vector without length or null is in none.
    """

    coarse: np.ndarray
    radius: np.ndarray
    reach: np.ndarray
    size: np.ndarray
    fine: DataFrame
    members: DataFrame
    count: int
    key: str


def build(vectors: DataFrame, path: str, key: str = "node_id", vector: str = "embedding", per_cell: int = PER_CELL) -> Cells:
    """Fit both levels and write every vector with its cell to `path`.

    A coarse cell has as many fine cells as its vectors need, up to FINE, so that a third of all rows in one coarse cell are
    split like any other. Fine centres are fitted and vectors are assigned in groups of bounded size.
    """
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
    rows = vectors.select(key, doubles(F.col(vector)).alias("v")).where(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))
    n = rows.count()
    if not n:
        raise ValueError("no vector to index")
    first = rows.orderBy(F.xxhash64(key)).limit(SAMPLE).select("v").collect()
    coarse = centres_of(unit(np.array([r["v"] for r in first])), min(COARSE, len(first), max(1, round((n / per_cell) ** 0.5))))

    def placed(batches):
        for b in batches:
            if b.num_rows:
                x = unit(matrix(b.column(1)))
                d = _distance(x, coarse)
                own = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), lists(x), pa.array(own, pa.int32()), pa.array(d[np.arange(len(x)), own])], [key, "v", "coarse", "far"])

    rows.mapInArrow(placed, f"{key} {kind}, v array<double>, coarse int, far double").write.parquet(f"{path}/placed")
    at = spark.read.parquet(f"{path}/placed")
    sizes = at.groupBy("coarse").agg(F.count("*").alias("size"), F.max("far").alias("radius"))  # a row for each coarse cell
    radius, reach, size = np.zeros(len(coarse)), np.zeros(len(coarse)), np.zeros(len(coarse), dtype=np.int64)
    for r in sizes.collect():
        radius[r["coarse"]], size[r["coarse"]] = r["radius"], r["size"]
    wanted = F.least(F.lit(FINE), F.ceil(F.col("size") / per_cell)).cast("int")
    chance = F.pmod(F.xxhash64(key, F.lit("fine")), F.lit(1 << 30)) / float(1 << 30)
    sample = at.join(F.broadcast(sizes.withColumn("k", wanted)), "coarse").where(chance * F.col("size") < F.col("k") * SAMPLE_PER_CELL)

    def fitted(group: pa.Table) -> pa.Table:
        x = matrix(group.column("v"))
        c = centres_of(x, min(len(x), group.column("k")[0].as_py()))
        return pa.table({"coarse": pa.array([group.column("coarse")[0].as_py()] * len(c), pa.int32()), "fine": pa.array(np.arange(len(c)), pa.int32()), "centre": lists(c)})

    sample.select("coarse", "k", "v").groupBy("coarse").applyInArrow(fitted, "coarse int, fine int, centre array<double>").write.parquet(f"{path}/centres")
    centres = spark.read.parquet(f"{path}/centres")
    salts = F.greatest(F.lit(1), F.ceil(F.col("size") / (2 * VECTORS))).cast("int")
    dealt = at.join(F.broadcast(sizes.select("coarse", "size")), "coarse").withColumn("salt", F.pmod(F.xxhash64(key), salts).cast("int"))
    copies = centres.join(F.broadcast(sizes.select("coarse", "size")), "coarse").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))

    def assigned(x: pa.Table, c: pa.Table) -> pa.Table:
        m, own = matrix(x.column("v")), np.zeros(len(x), dtype=np.int64)
        far = np.zeros(len(x))
        if len(c):
            d = _distance(m, matrix(c.column("centre")))
            best = d.argmin(axis=1)
            far, own = d[np.arange(len(m)), best], c.column("fine").to_numpy()[best]
        else:  # a cell whose sample was empty has one fine cell around the coarse centre
            at_ = x.column("coarse")[0].as_py() if len(x) else 0
            far = _distance(m, coarse[at_ : at_ + 1])[:, 0] if len(x) else far
        return pa.table({key: x.column(key), "v": x.column("v"), "coarse": x.column("coarse"), "fine": pa.array(own, pa.int32()), "far": pa.array(far)})

    both = dealt.select(key, "v", "coarse", "salt").groupBy("coarse", "salt").cogroup(copies.select("coarse", "salt", "fine", "centre").groupBy("coarse", "salt"))
    both.applyInArrow(assigned, f"{key} {kind}, v array<double>, coarse int, fine int, far double").write.parquet(f"{path}/assigned")
    done = spark.read.parquet(f"{path}/assigned")
    stats = done.groupBy("coarse", "fine").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    own = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(coarse)], "coarse int, own array<double>")
    named = stats.join(centres, ["coarse", "fine"], "left").join(own, "coarse").withColumn("centre", F.coalesce("centre", "own"))
    away = F.sqrt(F.aggregate(F.zip_with("centre", "own", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    named.withColumn("away", away).drop("own").write.parquet(f"{path}/fine")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / VECTORS))
    done.drop("far").join(stats.select("coarse", "fine", "n"), ["coarse", "fine"]).withColumn("part", F.pmod(F.xxhash64(key), parts).cast("int")).drop("n").repartition("coarse").sortWithinPartitions("coarse", "fine").write.parquet(f"{path}/members")
    fine = spark.read.parquet(f"{path}/fine")
    for r in fine.groupBy("coarse").agg(F.max("away").alias("away")).collect():  # a row for each coarse cell
        reach[r["coarse"]] = r["away"]
    return Cells(coarse, radius, reach, size, fine, spark.read.parquet(f"{path}/members"), fine.count(), key)


def _rows(queries: DataFrame, vector: str) -> DataFrame:
    return queries.select("query_id", doubles(F.col(vector)).alias("v")).where(F.col("v").isNotNull())


def _parts(rows: int, size: int) -> int:
    return -(-rows // size) or 1


def _fars(queries: DataFrame, cells: Cells, vector: str, made, kind: str) -> DataFrame:
    """What `made` gives for the distances of some queries to some fine centres, until every query has met every centre.

    Both are rows, dealt into parts of bounded size; made(query_id, fine rows, distances) holds STEP queries at a time.
    """
    asked = _rows(queries, vector)
    qs, fs = _parts(asked.count(), QUERIES), _parts(cells.count, VECTORS)
    asked = asked.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(qs)).cast("int")).withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(fs - 1))))
    held = cells.fine.select("coarse", "fine", "centre", F.pmod(F.xxhash64("coarse", "fine"), F.lit(fs)).cast("int").alias("_f")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(qs - 1))))

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        x, centres = unit(matrix(q.column("v"))), matrix(c.column("centre"))
        steps = range(0, len(q), STEP) if len(c) else []
        found = [made(q.column("query_id").slice(at, STEP), c, _distance(x[at : at + STEP], centres)) for at in steps]
        return pa.concat_tables(found) if found else made(q.column("query_id").slice(0, 0), c, np.zeros((0, len(c))))

    both = asked.groupBy("_q", "_f").cogroup(held.groupBy("_q", "_f"))
    return both.applyInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, {kind}")


def _limits(queries: DataFrame, cells: Cells, vector: str, share: float) -> DataFrame:
    """(query_id, limit): the distance within which the nearest `share` of all fine centres lie, up to the next of BINS steps."""
    probes = max(1, round(cells.count * share))

    def counts(ids, c, d):
        at = np.minimum((d * (BINS / 2)).astype(np.int64), BINS - 1) + np.arange(len(d))[:, None] * BINS
        n = np.bincount(at.ravel(), minlength=len(d) * BINS)
        return pa.table({"query_id": ids, "bins": pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * BINS, pa.int32()), pa.array(n, pa.int32()))})

    def run(t: pa.Table) -> pa.Table:
        ids = t.column("query_id").combine_chunks().dictionary_encode()
        total = np.zeros((len(ids.dictionary), BINS), dtype=np.int64)
        np.add.at(total, ids.indices.to_numpy(), matrix(t.column("bins")))
        upto = total.cumsum(axis=1)
        last = (upto >= np.minimum(probes, upto[:, -1:])).argmax(axis=1)
        limit = np.where(last == BINS - 1, np.inf, (last + 1) / (BINS / 2))
        return pa.table({"query_id": ids.dictionary, "limit": pa.array(limit)})

    kind = queries.schema["query_id"].dataType.simpleString()
    few = F.pmod(F.xxhash64("query_id"), F.lit(_parts(queries.count(), STEP))).cast("int")
    return _fars(queries, cells, vector, counts, "bins array<int>").groupBy(few.alias("_b")).applyInArrow(run, f"query_id {kind}, limit double")


def _most(far: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The highest cosine with a query `far` from a cell's centre that any unit vector within its radius can have."""
    return 1 - np.maximum(far - radius, 0) ** 2 / 2


def _tiles(cells: Cells) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each coarse cell its first tile and number of tiles, and how many there are: a tile holds about VECTORS vectors at most,
    those of some small coarse cells or some fine cells of a large one."""
    first, many = np.zeros(len(cells.size), dtype=np.int64), np.maximum(1, -(-cells.size // VECTORS))
    at, held = 0, 0
    for i, n in enumerate(cells.size):
        if held and held + n > VECTORS:
            at, held = at + 1, 0
        first[i], held = at, held + n
        if many[i] > 1:
            at, held = at + many[i], 0
    return first, many, int((first + many).max())


def _scores(rows: DataFrame, cells: Cells, k: int, chosen) -> DataFrame:
    """(query_id, key, score): the k best of each query in each tile that it meets, by matrix products.

    rows: query_id, v, floor, limit. chosen(distances to coarse centres, floor, limit) marks the coarse cells that a query needs; of
    the tiles with those it scores the fine cells that are within `limit` and can hold a vector of cosine `floor` or more. So no row
    is made for a query and a fine cell, and a query's vector is copied once for each tile.
    """
    key, kind, qkind = cells.key, cells.members.schema[cells.key].dataType.simpleString(), rows.schema["query_id"].dataType.simpleString()
    first, many, tiles = _tiles(cells)
    coarse, at = cells.coarse, np.arange(tiles)
    within = ((at >= first[:, None]) & (at < (first + many)[:, None])).astype(np.float32)
    qs = _parts(rows.count(), QUERIES)

    def dealt(batches):
        for b in batches:
            for i in range(0, b.num_rows, STEP):
                part = b.slice(i, STEP)
                x, floor, limit = unit(matrix(part.column(1))), part.column(2).to_numpy(), part.column(3).to_numpy()
                row, tile = np.nonzero(chosen(_distance(x, coarse), floor[:, None], limit[:, None]).astype(np.float32) @ within)
                r = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(r), lists(x[row]), part.column(2).take(r), part.column(3).take(r), pa.array(tile, pa.int32())], ["query_id", "q", "floor", "limit", "tile"])

    asked = rows.select("query_id", "v", "floor", "limit").mapInArrow(dealt, f"query_id {qkind}, q array<double>, floor double, limit double, tile int")
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(qs)).cast("int"))  # the kind of the other side's: cogroup casts none
    places = rows.sparkSession.createDataFrame([(i, int(a), int(n)) for i, (a, n) in enumerate(zip(first, many))], "coarse int, _first int, _many int")
    code = (F.col("coarse") * FINE + F.col("fine")).alias("code")
    members = cells.members.select(key, "v", F.lit(None).cast("double").alias("radius"), "coarse", "fine", "part")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / VECTORS)).cast("int")
    centres = cells.fine.select(F.lit(None).cast(kind).alias(key), F.col("centre").alias("v"), "radius", "coarse", "fine", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    tile = F.col("_first") + F.pmod(F.xxhash64("fine", "part"), F.col("_many")).cast("int")
    held = members.unionByName(centres).join(F.broadcast(places), "coarse").select(key, "v", "radius", code, tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(qs - 1))).alias("salt"))

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        ids, found = q.column("query_id"), []
        if len(q) and len(x):
            is_centre = x.column("radius").is_valid()
            c, x = x.filter(is_centre), x.filter(pc.invert(is_centre)).sort_by(key)
            codes, one = np.unique(c.column("code").to_numpy(), return_index=True)
            centre, radius, v = matrix(c.column("v"))[one], c.column("radius").to_numpy()[one], matrix(x.column("v"))
            own = np.searchsorted(codes, x.column("code").to_numpy())
            asks, floor, limit = matrix(q.column("q")), q.column("floor").to_numpy(), q.column("limit").to_numpy()
            for at in range(0, len(q) if len(x) else 0, STEP):
                a, low = asks[at : at + STEP], floor[at : at + STEP, None]
                d = _distance(a, centre)
                able = (_most(d, radius[None, :]) >= low - 1e-9) & (d <= limit[at : at + STEP, None] + 1e-9)
                held_ = np.flatnonzero(able.any(axis=0)[own])
                if len(held_):
                    row, col, score = _best(a, v if len(held_) == len(v) else v[held_], able[:, own[held_]], low, k)
                    found.append((row + at, held_[col], score))
        row, col, score = (np.concatenate(f) for f in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": ids.take(pa.array(row)), key: x.column(key).take(pa.array(col)), "score": pa.array(score)})

    both = asked.groupBy("tile", "salt").cogroup(held.groupBy("tile", "salt"))
    return both.applyInArrow(run, f"query_id {qkind}, {key} {kind}, score double")


def _best(q: np.ndarray, x: np.ndarray, able: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, rows of x and cosine for the k best of every row of q among those that are able to reach `floor`; ties go to the earlier row of x.

    A matrix product picks candidates; their cosines are added in order, so that equal vectors have equal ones.
    """
    s = np.where(able, q @ x.T, -np.inf)
    near = s >= floor - 1e-9
    if len(x) > k and near.sum() > 4 * k * len(q):
        near &= s >= np.partition(s, len(x) - k, axis=1)[:, len(x) - k, None] - 1e-9
    row, col = np.nonzero(near & able)
    score = np.zeros(len(row))
    for j in range(q.shape[1]):
        score += q[row, j] * x[col, j]
    order = np.lexsort((col, -score, row))
    kept = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
    return row[kept], col[kept], score[kept]


def approximate(queries: DataFrame, cells: Cells, k: int, share: float = 0.1, vector: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank): the k best among the vectors of the nearest `share` of all cells, and of those that are as near to
    within a step of BINS. queries: query_id, vector."""
    reach = cells.reach[None, :]
    rows = _rows(queries, vector).join(_limits(queries, cells, vector, share), "query_id").withColumn("floor", F.lit(-2.0))
    return top(_scores(rows, cells, k, lambda d, floor, limit: d - reach <= limit + 1e-9), k, cells.key)


def share_for(queries: DataFrame, cells: Cells, k: int, target: float = 0.9, vector: str = "embedding") -> float:
    """The share of cells that holds `target` of the k nearest, as measured against exact answers of at most MEASURED queries.

    Where vectors lie in no clusters it is near 1, and exact() is the better choice.
    """
    few = queries.orderBy(F.xxhash64("query_id")).limit(MEASURED)
    true = exact(few, cells, k, vector=vector).select("query_id", cells.key).join(cells.members.select(cells.key, "coarse", "fine"), cells.key)

    def every(ids, c, d):
        row, col = (pa.array(x.ravel()) for x in np.indices(d.shape))
        return pa.table({"query_id": ids.take(row), "coarse": c.column("coarse").take(col), "fine": c.column("fine").take(col), "far": pa.array(d.ravel())})

    place = F.row_number().over(W.partitionBy("query_id").orderBy("far", "coarse", "fine"))
    fars = _fars(few, cells, vector, every, "coarse int, fine int, far double").withColumn("place", place)
    at = true.join(fars.select("query_id", "coarse", "fine", "place"), ["query_id", "coarse", "fine"])
    needed = sorted(r["place"] for r in at.select("place").collect())  # MEASURED times k numbers
    return min(1.0, needed[min(len(needed) - 1, int(np.ceil(len(needed) * target)))] / cells.count) if needed else 1.0


def exact(queries: DataFrame, cells: Cells, k: int, share: float = 0.1, vector: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank): the k best of all vectors.

    The nearest coarse cells, with `share` of the vectors and k of them at least, give a k-th score; then all cells are read whose
    radius lets a vector reach it. Coarse cells are judged by their radius before their fine ones are looked at.
    """
    size, radius, need = cells.size, cells.radius[None, :], max(k, share * cells.size.sum())

    def nearest(d, floor, limit):
        order = np.argsort(d, axis=1, kind="stable")
        ahead = np.cumsum(size[order], axis=1) - size[order]
        out = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(out, order, ahead < need, axis=1)
        return out

    free = _rows(queries, vector).withColumns({"floor": F.lit(-2.0), "limit": F.lit(float("inf"))})
    ahead = top(_scores(free, cells, k, nearest), k, cells.key).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rows = free.join(ahead, "query_id", "left").select("query_id", "v", F.coalesce("kth", "floor").alias("floor"), "limit")
    return top(_scores(rows, cells, k, lambda d, floor, limit: _most(d, radius) >= floor - 1e-9), k, cells.key)


def folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one that the cluster names; a local session without a name has one of its own."""
    import uuid

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(named or '/tmp/checkpoints').rstrip('/')}/orefall-{label}-{uuid.uuid4().hex}"
