"""What the corpus operators share: shared-folder tables, word shingles as arrays, chunked batches."""

from __future__ import annotations

import ctypes
import sys
import unicodedata
import uuid
import weakref
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs in one process on one machine, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"
#: Words in a shingle, and the similarity from which two texts count as near copies.
WORDS, NEAR = 5, 0.8
#: Characters that one numpy step handles; bounds its memory whatever the batch holds.
STEP_CHARS = 1 << 20

U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset a local session has a folder of our own; a cluster is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orefall-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STASHED[id(out)] = path
    weakref.finalize(out, _STASHED.pop, id(out), None)
    return out


#: Folders of the tables that stash wrote, by the DataFrame that reads them.
_STASHED: dict[int, str] = {}


def discard(*tables: DataFrame) -> None:
    """Delete the folders of stashed tables that nothing reads any more."""
    for df in tables:
        path = _STASHED.pop(id(df), None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def level(h: Column) -> Column:
    """Which sixteenth of a power of two a 63-bit hash lies in: 0 to 1008, and never less for a greater hash."""
    return F.floor(F.log2(F.pmod(h, F.lit(2**62)).cast("double") + 1) * 16).cast("int")


def highest_level(counts: list[tuple[int, int]], most: int) -> int:
    """The highest level up to which (level, count) sum to `most` at most, the lowest of all at least; -1 without any.

    Rows chosen so are a random sample by their keys, whatever the table's size: at least a half of `most`, unless rows that share
    one key (and so one hash) are more than that.
    """
    best, total = -1, 0
    for at, n in sorted(counts):
        total += n
        if best >= 0 and total > most:
            break
        best = at
    return best


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of df as the one column _row, so that none of their names can clash with an operator's own."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("_row")


def rows_again(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns that whole_row put away."""
    return df.select(*[F.col(f"_row.{quoted(c)}").alias(c) for c in names])


def apart(df: DataFrame, text: str) -> DataFrame:
    """df as (_rest, _text): the text as it is and all other columns as one, so that Python gets each text once."""
    rest = [F.col(quoted(c)) for c in df.columns if c != text]
    return df.select(F.struct(*rest, F.lit(0).alias("_")).alias("_rest"), F.col(text).alias("_text"))


def together(df: DataFrame, names: list[str], text: str) -> DataFrame:
    """The columns that apart put away, in their order."""
    return df.select(*[(F.col("_text") if c == text else F.col(f"_rest.{quoted(c)}")).alias(c) for c in names])


def crc32_of(column: str) -> Column:
    """crc32 of a column's decimal text, as the split rules of the contracts use it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def steps(texts: list[str], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most `most` characters each; a longer text has a range of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def step_texts(column: pa.Array, most: int = STEP_CHARS) -> Iterator[list[str]]:
    """A column's texts step by step, so that a batch is never held as Python strings as a whole."""
    stops = np.concatenate([[0], np.cumsum(pc.utf8_length(column).to_numpy(zero_copy_only=False))])
    start = 0
    while start < len(column):
        end = max(start + 1, int(np.searchsorted(stops, stops[start] + most, side="right")) - 1)
        yield column.slice(start, end - start).to_pylist()
        start = end
    release()


def release() -> None:
    """Give freed memory back to the machine: a worker lives on after its tasks, and others need the executor's share."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def over_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield fn(b)

    return df.mapInArrow(run, schema)


@lru_cache(maxsize=1)
def word_chars() -> np.ndarray:
    """For each code point, whether it is a letter or a number."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (_BASE, _INV):
        p = np.full(n, b, dtype=U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(16, (n - 1).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; changes h in place."""
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the lower-cased texts in order, and for each text where its words begin (one more for the end).

    A word is a longest run of letters and numbers.
    """
    joined = "\n".join(texts).lower()
    lens = np.array([len(t.lower()) if not t.isascii() else len(t) for t in texts], dtype=np.int64)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ok = np.zeros(len(cp) + 2, dtype=bool)
    ok[1:-1] = word_chars()[cp]
    turns = np.flatnonzero(ok[1:] != ok[:-1])
    a, b = turns[::2], turns[1::2]
    up, down = powers(len(cp) + 1)
    sums = np.zeros(len(cp) + 1, dtype=U)
    np.cumsum(cp.astype(U) * up[: len(cp)], out=sums[1:])
    h = mix((sums[b] - sums[a]) * down[a])
    ends = np.cumsum(lens + 1) - 1
    return h, np.concatenate([[0], np.searchsorted(a, ends)]).astype(np.int64)


def shingle_hashes(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts in order, and where each text's shingles begin (one more for the end).

    A text of fewer words than a shingle has one shingle of all its words; a text without words has none.
    """
    h, at = word_hashes(texts)
    n = np.diff(at)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(count)])
    total = int(out_at[-1])
    doc = np.repeat(np.arange(len(texts)), count)
    first = np.arange(total) - out_at[doc] + at[doc]
    s = np.zeros(total, dtype=U)
    short = n[doc] < words
    padded = np.concatenate([h, np.zeros(words, dtype=U)])
    for k in range(words):
        v = padded[first + k] * U(pow(_BASE, 2 * k + 3, 1 << 64))
        if short.any():
            v = np.where(short & (k >= n[doc]), U(0), v)
        s += v
    return mix(s), out_at


#: Counters in a row of a summed table.
ROOM = 1 << 12


def summed_counters(texts: DataFrame, count: Callable[[list[str], np.ndarray], None], size: int) -> np.ndarray:
    """Sums of `size` counters over all rows of a one-column table of texts.

    count adds a step's texts to an array. Each task sends its counters once, they are summed by block and salt and then by
    block, and `size` numbers reach the driver, whatever the input.
    """

    def local(batches):
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for some in step_texts(b.column(0)):
                count(some, total)
        yield pa.RecordBatch.from_arrays([*counter_blocks(total)], ["block", "counts"])

    return summed_blocks(texts.mapInArrow(local, "block int, counts binary"), size)


def counter_blocks(total: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Counters as rows (block, counts) of ROOM each, for summed_blocks."""
    at = range(0, len(total), ROOM)
    return pa.array([i // ROOM for i in at], pa.int32()), pa.array([total[i : i + ROOM].astype("<i8").tobytes() for i in at], pa.binary())


def summed_blocks(parts: DataFrame, size: int) -> np.ndarray:
    """Sums of the rows (block, counts) of all tasks."""

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype="<i8") for x in rows.column("counts").to_pylist())
        return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, counts binary"
    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    out = np.zeros(size, dtype=np.int64)
    for r in salted.groupBy("block", "salt").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema).collect():
        part = np.frombuffer(r["counts"], dtype="<i8")
        out[r["block"] * ROOM : r["block"] * ROOM + len(part)] = part
    return out
