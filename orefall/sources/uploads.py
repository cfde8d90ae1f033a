"""User tables from CSV and XLSX bytes: rows as strings, then inferred types."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession

from orefall.errors import CodedError
from orefall.operators.inference import column_names, typed
from orefall.sources import office
from orefall.sources.files import TABLE_ENCODINGS, decoded, kind_of


def csv_rows(raw: bytes) -> list[list[str]]:
    """Rows without the all-blank ones, filled or cut to the header's width; a header and a row are required."""
    text = decoded(raw, TABLE_ENCODINGS)
    if text is None:
        raise CodedError("bad_encoding", "the file is in none of the known encodings")
    return squared([r for r in csv.reader(io.StringIO(text)) if any(c.strip() for c in r)])


def squared(rows: list[list[str]]) -> list[list[str]]:
    if len(rows) < 2:
        raise CodedError("empty_table", "a table needs a header and a row")
    width = len(rows[0])
    return [(r + [""] * width)[:width] for r in rows]


def tables(raw: bytes) -> list[tuple[str | None, list[list[str]]]]:
    """(sheet, rows) by content: each visible sheet of a workbook, or the one table of a CSV file."""
    kind = kind_of(raw)
    if kind == "xlsx":
        return [(name, squared(rows)) for name, rows in office.sheets(raw) if rows]
    if kind != "text":
        raise CodedError("unsupported_table", f"{kind} files are not tables")
    return [(None, csv_rows(raw))]


def frame(spark: SparkSession, rows: list[list[str]]) -> DataFrame:
    """A typed DataFrame of one upload, whose size the upload limit bounds."""
    names = column_names(rows[0])
    return typed(spark.createDataFrame([tuple(r) for r in rows[1:]], ", ".join(f"`{n.replace('`', '``')}` string" for n in names)))


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file or folder of any size: read as strings in parallel, then typed; all-blank rows are dropped."""
    raw = spark.read.csv(path, header=True, multiLine=False, mode="PERMISSIVE", encoding=encoding, inferSchema=False)
    names = column_names(raw.columns)
    return typed(raw.toDF(*names).dropna(how="all"))
