"""Token counts by rank-synchronous array merging."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefall.llm.bpe import TokenCounter
from orefall.llm.common import STEP_CHARS, over_arrow, step_texts


@lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", limit: int = 1024) -> DataFrame:
    """One row for each row of df: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    vocabulary: path of a byte-level BPE file that every machine has. Null text counts as empty (0 bytes, 0 tokens). Whole
    texts are counted, special strings in them as one token each. Repeated rows and null keys come back as they are; an empty
    table gives no rows; other columns are ignored.
    """
    key_type = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n: list[int] = []
        counter = _counter(vocabulary)
        for texts in step_texts(batch.column(1), 2 * STEP_CHARS):
            n += counter.count(texts).tolist()
        size = pc.binary_length(batch.column(1)).cast(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return over_arrow(rows, run, f"doc_id {key_type}, n_bytes long, n_tokens long, over_limit boolean")
