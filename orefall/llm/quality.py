"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefall.llm.boosted_trees import Forest, fit
from orefall.llm.common import STEP_CHARS, apart, crc32_of, highest_level, level, step_texts, together, word_hashes

#: Labelled documents that the trees are fitted on at most, those whose keys have the lowest hash levels.
FIT_ROWS = 20_000
FEATURES = (
    "log_chars", "log_words", "letters", "capitals", "digits", "symbols", "bars", "exclamations", "spaces", "stops", "commas",
    "symbol_runs", "log_lines", "word_length", "distinct_words", "repeated_next", "distinct_pairs", "most_frequent_word",
)
#: Characters of one kind, as a share of all.
KINDS = {"bars": "|", "exclamations": "!", "stops": ".", "commas": ",", "lines": "\n"}


def statistics(texts: list[str]) -> np.ndarray:
    """Texts by FEATURES, from the whole texts. A text without characters or words has zeros."""
    n = len(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    begin = ends - [len(t) + 1 for t in texts]
    cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    chars = np.maximum(ends - begin - 1, 1).astype(np.float64)
    ascii_ = np.minimum(cp, 128).astype(np.uint8)
    upper, digit, symbol, space = _tables()

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[ends - 1] - total[begin]) / chars

    sym = symbol[ascii_]
    runs = sym.copy()
    runs[1:] &= sym[:-1] & (cp[1:] == cp[:-1])
    runs[0] = False
    capital = upper[ascii_]
    wide = cp >= 128
    if wide.any():
        codes, back = np.unique(cp[wide], return_inverse=True)
        capital[wide] = np.array([chr(c).isupper() for c in codes], dtype=bool)[back]
    letter = (capital | ((ascii_ >= 97) & (ascii_ <= 122)) | wide)
    by_kind = {k: share(ascii_ == ord(c)) for k, c in KINDS.items()}
    h, at = word_hashes(texts)
    count = np.diff(at)
    words = np.maximum(count, 1).astype(np.float64)
    doc = np.repeat(np.arange(n), count)
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    distinct, most = _distinct(h, doc, n)
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    inside = doc[1:] == doc[:-1]
    pairs, _ = _distinct(pair[inside], doc[1:][inside], n)
    out = {
        "log_chars": np.log1p(chars), "log_words": np.log1p(count), "letters": share(letter), "capitals": share(capital), "digits": share(digit[ascii_]),
        "symbols": share(sym), "spaces": share(space[ascii_]), "symbol_runs": share(runs), "log_lines": np.log1p(by_kind["lines"] * chars),
        "word_length": chars / words, "distinct_words": distinct / words, "repeated_next": np.bincount(doc, again, n) / words,
        "distinct_pairs": pairs / np.maximum(count - 1, 1), "most_frequent_word": most / words,
    } | {k: by_kind[k] for k in ("bars", "exclamations", "stops", "commas")}
    return np.stack([out[k] for k in FEATURES], axis=1)


def _tables() -> tuple[np.ndarray, ...]:
    c = [chr(i) for i in range(128)] + ["\x80"]
    return tuple(np.array(x, dtype=bool) for x in ([k.isascii() and k.isupper() for k in c], [k.isascii() and k.isdigit() for k in c], [k.isascii() and k.isprintable() and not k.isalnum() and k != " " for k in c], [k.isascii() and k.isspace() for k in c]))


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many distinct values each document has, and how often its most frequent one occurs."""
    order = np.argsort(h)
    d = doc[order]
    order = order[np.argsort(d.astype(np.uint16) if n < 1 << 16 else d, kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(h)))
    most = np.zeros(n, dtype=np.int64)
    np.maximum.at(most, doc[first], size)
    return np.bincount(doc[first], minlength=n), most


def _stepwise(column: pa.Array) -> np.ndarray:
    """Statistics of a batch's texts, null as empty."""
    parts = [statistics(["" if t is None else t for t in texts]) for texts in step_texts(column, STEP_CHARS // 2)]
    return np.concatenate(parts or [np.zeros((0, len(FEATURES)))])


def train(docs: DataFrame, labels: DataFrame, learn: Column, fit_rows: int = FIT_ROWS) -> Forest:
    """Trees for the labels of the rows of docs (doc_id, t) for which `learn` holds, at most fit_rows of them.

    labels: doc_id, quality. Null labels are left out; a document with several labels has the one of their mean, 1 at one half.
    Keys alone are counted by hash level; only the texts up to the level that fit_rows allows are read, and of them the
    statistics, FEATURES numbers a row, go to the driver.
    """
    hashed = F.xxhash64("doc_id")
    one = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    known = docs.where(learn).join(one, F.col("doc_id") == F.col("_id"))
    top = highest_level([tuple(r) for r in known.groupBy(level(hashed)).count().collect()], fit_rows)
    sample = docs.where(learn & (level(hashed) <= top)).select("doc_id", "t").join(one.where(level(F.xxhash64("_id")) <= top), F.col("doc_id") == F.col("_id"))

    def run(batches):
        for b in batches:
            x = _stepwise(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel(), pa.float64()))], ["h", "y", "x"])

    rows = sample.select(hashed.alias("h"), "y", "t").mapInArrow(run, "h long, y int, x array<double>").limit(fit_rows).collect()
    rows = sorted(rows, key=lambda r: (r["h"], r["x"]))
    return fit(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["y"] for r in rows], dtype=np.float64))


def with_scores(df: DataFrame, forest: Forest, text: str = "t") -> DataFrame:
    """df with its text column replaced by score (0 to 1, higher: better), from the whole text; null text counts as empty."""
    other = [f for f in df.schema if f.name != text]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in other)

    def run(batches):
        for b in batches:
            scores = forest.scores(_stepwise(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], [*b.schema.names[:-1], "score"])

    return df.select(*[f.name for f in other], text).mapInArrow(run, f"{kinds}, score double")


def held_out(key: str, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.pmod(crc32_of(key), F.lit(folds)) == fold, F.lit(False))


def score_quality(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each row of df: doc_id, held_out, score, predicted. Labels of held-out rows are not learned.

    Empty and null texts have the score that their statistics get; without labels every score is 0.5. Whole texts are read,
    very long ones too; ties of a score with 0.5 count as 1. Repeated rows and null keys come back as they are; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("t"))
    held = held_out("doc_id")
    scored = with_scores(docs.select("doc_id", held.alias("held_out"), "t"), train(docs, labels, ~held))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of df that score 0.5 or more (ties stay), with all their columns, whatever their names.

    Null and empty texts stay or go by the score that empty statistics get; repeated rows share their fate; without labels all
    rows score 0.5 and stay; an empty table gives no rows; whole texts are read, very long ones too.
    """
    forest = train(df.select(F.col(key).alias("doc_id"), F.col(text).alias("t")), labels, ~held_out("doc_id"))
    return together(keep_by(apart(df, text), forest), df.columns, text)


def keep_by(rows: DataFrame, forest: Forest) -> DataFrame:
    """The rows of (_rest, _text) whose text scores 0.5 or more."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(forest.scores(_stepwise(b.column(1))) >= 0.5, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)
