"""Personal data in whole texts: base patterns, and a skip-chain conditional random field that adds spans."""

from __future__ import annotations

import hashlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefall.llm import skip_chain
from orefall.llm.common import highest_level, level, step_texts
from orefall.llm.pii_base import ANY, KINDS, refused_and_found

#: Examples that the field is fitted on at most, those of the documents whose keys hash lowest.
FIT_TOKENS = 20_000


def fit_field(df: DataFrame, text: str = "text", key: str = "doc_id", fit_tokens: int = FIT_TOKENS) -> skip_chain.Weights:
    """Weights learned from the base spans of a bounded sample of documents.

    A first pass counts examples by level of the documents' hashes, a thousand numbers whatever the input; the second reads only
    the documents up to the level that fit_tokens allows.
    """

    def counted(batches):
        for b in batches:
            n = [len(skip_chain.examples(t)) if ANY.search(t) else 0 for some in step_texts(b.column(1)) for t in some]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["lv", "n"])

    def listed(batches):
        for b in batches:
            rows = [e for some in step_texts(b.column(1)) for t in some if ANY.search(t) for e in skip_chain.examples(t)]
            cols = [pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([r[4] for r in rows], pa.int32())], ["s", "b", "a", "f", "y"])

    docs = df.select(level(F.xxhash64(F.col(key), F.col(text))).alias("lv"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    counts = docs.mapInArrow(counted, "lv int, n long").where("n > 0").groupBy("lv").agg(F.sum("n").alias("n")).collect()
    top = highest_level([tuple(r) for r in counts], fit_tokens)
    rows = docs.where(F.col("lv") <= top).mapInArrow(listed, "s array<int>, b array<int>, a array<int>, f array<int>, y int")
    return skip_chain.fit([tuple(r) for r in rows.limit(fit_tokens).collect()])


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def find_personal_data(df: DataFrame, text: str = "text", key: str = "doc_id", weights: skip_chain.Weights | None = None) -> DataFrame:
    """One row for each row of df: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are those of the base spans; spans lists these and the added ones. The field adds what a base
    mention of the same document is repeated as in another form, and the mentions inside a run that no base pattern took as a
    whole, such as two cards beside each other. Offsets are code points of the whole text. Null text counts as empty and has no spans; repeated rows and null keys come back as they are; an empty
    table gives no rows; other columns are ignored.
    """
    w = weights or fit_field(df, text, key)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            digest, spans = [], []
            for t in chain.from_iterable(step_texts(b.column(1))):
                found = refused_and_found(t)[1]
                more = skip_chain.added(t, w) if ANY.search(t) else []
                for c, kind in zip(counts, KINDS):
                    c.append(sum(s[2] == kind for s in found))
                digest.append(hashlib.sha256(joined(found).encode()).hexdigest())
                spans.append(joined(found + more))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array(spans, pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    rows = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"doc_id {key_type}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
