"""Documents to packed sequences: quality classifier, exact dedup, near dedup, decontamination, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orefall.llm.common import discard, stash, table
from orefall.llm.decontaminate import drop_leaks
from orefall.llm.exact_dedup import drop_copies
from orefall.llm.near_dedup import drop_near_copies
from orefall.llm.packing import pack
from orefall.llm.quality import keep_good


# All stages read whole texts, however long, and count null text as empty; an empty table gives an empty one, and other columns
# of documents stay as they are whatever their names (but for the last stage, which returns pieces).


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, scores 0.5 or more; repeated rows and null keys are scored alike."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; rows without one come last, of repeated rows one stays."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest doc_id; rows without one come last, of repeated rows one stays."""
    return drop_near_copies(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; those without words stay."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of 4096 tokens; an empty text is its end id alone."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", clean), ("packing", packed)]

#: SQL can express neither the classifier nor column generation; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents. Each result is written to the shared folder, and its predecessor then deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
