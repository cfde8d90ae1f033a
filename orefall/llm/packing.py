"""Packing documents into fixed-length sequences by cutting stock."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orefall.llm.common import STEP_CHARS, stash, step_texts
from orefall.llm.cutting_stock import Plan, solve
from orefall.llm.word_ids import WordIds

#: Sequence length, the id that ends a document, and the grain: a document's last part is cut at a multiple of it.
ROOM, END, GRAIN = 4096, 2, 64


@lru_cache(maxsize=2)
def _ids(path: str) -> WordIds:
    return WordIds(path)


def sizes(room: int = ROOM, grain: int = GRAIN) -> np.ndarray:
    """The sizes a piece can have: 1 to grain - 1, the multiples of grain, and the whole room."""
    return np.array([*range(1, grain), *range(grain, room + 1, grain)], dtype=np.int64)


def cuts(n: int, room: int = ROOM, grain: int = GRAIN) -> list[int]:
    """Sizes of a document's pieces in order: whole sequences, the multiple of grain, the rest."""
    rest = n % room
    return [room] * (n // room) + [x for x in (rest - rest % grain, rest % grain) if x]


def pieces(df: DataFrame, vocabulary: str, text: str, key: str, room: int, grain: int) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, and _part and _nth: the piece's place among a task's pieces of its size."""
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        enc, part, seen = _ids(vocabulary), TaskContext.get().partitionId(), {}
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            keys: list[int] = []
            cols: list[list[int]] = [[] for _ in range(5)]
            start, length, crc, total, nth = cols
            row = 0
            for texts in step_texts(batch.column(1), 2 * STEP_CHARS):
                flat, lens = enc.encode(texts)
                packed, stop = memoryview(flat.tobytes()), 0
                for size_of in lens.tolist():
                    ids = bytes(packed[4 * stop : 4 * (stop + size_of)]) + end
                    stop += size_of
                    n, at = len(ids) // 4, 0
                    for size in cuts(n, room, grain):
                        keys.append(row)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                        total.append(n)
                        nth.append(k := seen.get(size, 0))
                        seen[size] = k + 1
                        at += size
                    row += 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *[pa.array(c, pa.int64()) for c in cols], pa.array([part] * len(keys), pa.int32())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "_nth", "_part"])

    rows = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"doc_id {key_type}, start long, length long, ids_crc32 long, doc_tokens long, _nth long, _part int")


def _rows(plan: Plan, all_sizes: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """For each pattern and size: size, first and last rank it takes, its first sequence, pieces a sequence, offset of the first."""
    rank, seq, out = np.zeros(len(all_sizes), dtype=np.int64), 0, []
    for counts, times in plan.patterns:
        offset = 0
        for c in np.flatnonzero(counts)[::-1]:
            each = int(counts[c])
            out.append((int(all_sizes[c]), int(rank[c]), int(rank[c]) + each * times - 1, seq, each, offset))
            rank[c] += each * times
            offset += each * int(all_sizes[c])
        seq += times
    return out


def pack(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", room: int = ROOM, grain: int = GRAIN) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids (its text's, then the end id) are cut into whole sequences, a part of a multiple of `grain` ids and a
    part of fewer than `grain` ids. The histogram of those sizes, at most grain + room / grain numbers whatever the input, goes
    to the driver, where column generation makes patterns of sizes that fill sequences. Pieces of a size are ranked (per-task
    counts, then running sums over tasks), and a pattern takes a range of ranks of each size, so that a piece's sequence and
    offset follow from its rank. Null text counts as empty and gives the end id alone; rows without a key, repeated rows and
    ties are packed as they come; an empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    cut = stash(pieces(df, vocabulary, text, key, room, grain), "pieces")
    per_task = cut.groupBy("length", "_part").agg(F.count("*").alias("n"))
    before = per_task.select(F.col("length").alias("_l"), F.col("_part").alias("_p"), (F.sum("n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("_before"))
    all_sizes = sizes(room, grain)
    demand = np.zeros(len(all_sizes), dtype=np.int64)
    place = {int(s): i for i, s in enumerate(all_sizes)}
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        demand[place[r["length"]]] = r["n"]
    rows = _rows(solve(all_sizes, demand, room), all_sizes)
    plan = spark.createDataFrame(rows, "_s long, _lo long, _hi long, _seq long, _each long, _at long")
    ranked = cut.join(before, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p"))).withColumn("_rank", F.col("_nth") + F.col("_before"))
    # The plan has a row for each pattern and size in it, a number that the sizes bound.
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_s")) & F.col("_rank").between(F.col("_lo"), F.col("_hi")))
    nth = F.col("_rank") - F.col("_lo")
    inside = nth % F.col("_each")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_seq") + ((nth - inside) / F.col("_each")).cast("long")).alias("sequence_id"), (F.col("_at") + inside * F.col("length")).alias("offset"))
