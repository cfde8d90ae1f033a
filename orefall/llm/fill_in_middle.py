"""Fill-in-middle transformation: texts cut at two boundaries between units and put together in another order."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefall.llm.common import step_texts, word_chars

#: Marks before the three parts; a text that contains one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed, and of 100 transformed ones so many have the suffix first.
RATE, SUFFIX_FIRST = 90, 20
UNITS = ("char", "word", "line")


def classes(cp: np.ndarray, unit: str) -> np.ndarray:
    """A class for each code point; where neighbours differ, a unit ends.

    char: every code point is a unit. word: runs of letters and numbers, and runs of anything else. line: a line with its end.
    """
    if unit == "char":
        return np.arange(len(cp))
    if unit == "word":
        return word_chars()[cp]
    if unit == "line":
        return np.concatenate([[0], np.cumsum(cp == 10)[:-1]]) if len(cp) else np.zeros(0, dtype=np.int64)
    raise ValueError(f"unit is one of {', '.join(UNITS)}")


def boundaries(cp: np.ndarray, unit: str) -> np.ndarray:
    """All places where a text can be cut, its begin and its end among them, in order."""
    k = classes(cp, unit)
    inner = np.flatnonzero(k[1:] != k[:-1]) + 1
    return np.unique(np.concatenate([[0], inner, [len(cp)]]))


def draws(seed: str, key: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document, from the digest of seed and key alone."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def form_of(text: str, h3: int, h4: int, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> str:
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return "plain"
    return "spm" if h4 % 100 < suffix_first else "psm"


def restore(output: str, form: str) -> str:
    """The exact text again. No part holds a mark, and no mark overlaps another, so the first of each is the true one."""
    if form == "plain":
        return output
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    b = output.index(order[1], len(order[0]))
    c = output.index(order[2], b + len(order[1]))
    part = dict(zip(order, (output[len(order[0]) : b], output[b + len(order[1]) : c], output[c + len(order[2]) :])))
    return part[PREFIX] + part[MIDDLE] + part[SUFFIX]


def cut(cp: np.ndarray, h1: int, h2: int, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, middle and suffix of a text's code points. Both cuts are any boundary, the ends among them."""
    at = boundaries(cp, unit)
    a, b = sorted((at[h1 % len(at)], at[h2 % len(at)]))
    return cp[:a], cp[a:b], cp[b:]


def _encoded(cp: np.ndarray) -> bytes:
    return cp.tobytes().decode("utf-32-le").encode()


def arranged(cp: np.ndarray, text: str, draw: tuple[int, int, int, int], unit: str) -> tuple[str, int | None, int | None, bytes]:
    """Form, code points of the prefix and of the middle (None if plain), and the UTF-8 of the output."""
    form = form_of(text, draw[2], draw[3])
    if form == "plain":
        return form, None, None, _encoded(cp)
    p, m, s = cut(cp, draw[0], draw[1], unit)
    mp, ms, mm = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    parts = (mp, _encoded(p), ms, _encoded(s), mm) if form == "psm" else (ms, _encoded(s), mp, _encoded(p), mm)
    return form, len(p), len(m), b"".join((*parts, _encoded(m)))


def fill_in_middle(df: DataFrame, text: str = "text", key: str = "doc_id", seed: str = "1", unit: str = "char") -> DataFrame:
    """One row for each row of df: doc_id, n (code points), form, prefix_chars, middle_chars, output.

    What becomes of a row follows from seed, key and text alone, so that rows that repeat have equal results and a lost task gives
    the same again. A null key counts as the empty one. Null text counts as empty, and an empty text is plain; texts are cut as a whole, however
    long. Equal cuts leave the middle empty. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            done = []
            at = 0
            for texts in step_texts(b.column(2)):
                cp = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
                ends = np.cumsum([len(t) for t in texts])
                for t, e, k in zip(texts, ends, b.column(1).slice(at, len(texts)).to_pylist()):
                    own = cp[e - len(t) : e]
                    done.append((len(own), *arranged(own, t, draws(seed, k), unit)))
                at += len(texts)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)]], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = df.select(F.col(key).alias("doc_id"), name.alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"doc_id {key_type}, n long, form string, prefix_chars long, middle_chars long, output string")


def digests(made: DataFrame) -> DataFrame:
    """The output of fill_in_middle as digests: output_sha256, and restored_sha256 of the text rebuilt from output and form."""
    key_type = made.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            back = []
            forms = b.column(2).to_pylist()
            for texts in step_texts(b.column(5)):
                back += [hashlib.sha256(restore(t, f).encode()).hexdigest() for t, f in zip(texts, forms[len(back) :])]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], b.column(6), pa.array(back, pa.string())], [*b.schema.names[:5], "output_sha256", "restored_sha256"])

    schema = f"doc_id {key_type}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return made.withColumn("output_sha256", F.sha2("output", 256)).mapInArrow(run, schema)
