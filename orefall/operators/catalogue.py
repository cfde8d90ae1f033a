"""What tables hold, and which of their values a question names: an inverted index from words of values to columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefall.operators.inference import enum_values

#: A text column with more values, or a longer one, is no list of choices and is described by name and type alone (fixed values).
MOST_VALUES, LONGEST = 12, 40

#: Rows of an index of values that every task holds at most; a larger one is joined by word.
HELD_WORDS = 100_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def values(tables: dict[str, DataFrame], most: int = MOST_VALUES, longest: int = LONGEST) -> DataFrame:
    """(table, column, value) of the text columns with few and short values; one pass over each table, all its columns at once."""
    parts = []
    for name, df in tables.items():
        texts = [f.name for f in df.schema if f.dataType.typeName() == "string"]
        if texts:
            parts.append(enum_values(df, texts, most, longest).select(F.lit(name).alias("table"), "column", F.explode("values").alias("value")))
    if not parts:
        raise ValueError("no table with a text column")
    return reduce(DataFrame.unionByName, parts)


def describe(tables: dict[str, DataFrame], most: int = MOST_VALUES, longest: int = LONGEST) -> DataFrame:
    """(table, position, column, type, choices) of all columns; choices in order, null where there are too many or no text."""
    some = next(iter(tables.values())).sparkSession
    columns = some.createDataFrame([(t, i, f.name, f.dataType.simpleString()) for t, df in tables.items() for i, f in enumerate(df.schema)], "table string, position int, column string, type string")
    held = values(tables, most, longest).groupBy("table", "column").agg(F.array_sort(F.collect_list("value")).alias("choices"))  # `most` at most
    return columns.join(held, ["table", "column"], "left").select("table", "position", "column", "type", "choices")


def listing(tables: dict[str, DataFrame], call: int = 1, most: int | None = None) -> DataFrame:
    """(evidence_id, location, snippet): what a caller can ask of, one table a row in order of name, as evidence of a call.

    Rows are counted by one aggregate for each table, which reads no column.
    """
    parts = []
    for i, name in enumerate(sorted(tables)[:most], start=1):
        about = F.concat(F.lit(f"{name}: "), F.count("*"), F.lit(" rows, columns " + ", ".join(tables[name].columns)))
        parts.append(tables[name].agg(about.alias("snippet")).select(F.lit(f"E{call}.{i}").alias("evidence_id"), F.lit(name).alias("location"), "snippet"))
    if not parts:
        raise ValueError("no table to list")
    return reduce(DataFrame.unionByName, parts)


def index(held: DataFrame) -> DataFrame:
    """(word, table, column, value, of): for each word of a value where it occurs, and how many distinct words the value has."""
    w = F.array_distinct(words(F.col("value")))
    return held.select(F.explode(w).alias("word"), "table", "column", "value", F.size(w).alias("of"))


def link(questions: DataFrame, inverted: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, table, column, value): values all of whose words a question has. Only the words of questions are looked up.

    A word that many questions have would gather them in one task, so that an index of at most HELD_WORDS rows goes to the questions.
    """
    asked = questions.select("query_id", F.explode(F.array_distinct(words(F.col(text)))).alias("word"))
    if inverted.limit(HELD_WORDS + 1).count() <= HELD_WORDS:
        inverted = F.broadcast(inverted)
    hits = asked.join(inverted, "word").groupBy("query_id", "table", "column", "value").agg(F.count("*").alias("n"), F.first("of").alias("of"))
    return hits.where("n = of").select("query_id", "table", "column", "value")
