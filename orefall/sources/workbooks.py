"""Uploaded workbooks as tables: all sheets of one become visible together, or none does."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefall.errors import CodedError
from orefall.sources import uploads
from orefall.sources.snapshots import Snapshots

RELATION = "kind string, workbook_id string, dataset_id string, filename string, sheet_name string, path string, columns array<struct<name:string,type:string>>, row_count long"


class Workbooks:
    """A folder of Parquet tables, one for each sheet, and snapshots of the relation that names them.

    The tables of an upload are written first and named by nobody; one commit then puts all of them, and the workbook, into the
    relation in place of an earlier upload of that workbook. If a sheet fails, what was written of the others is removed.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.known = Snapshots(spark, f"{self.path}/relation")

    def _rows(self) -> tuple[int, DataFrame]:
        number, held, _ = self.known.read()
        return number, self.spark.createDataFrame([], RELATION) if held is None else held

    def put(self, workbook_id: str, filename: str, raw: bytes) -> list[str]:
        """The dataset ids of an upload's sheets, in order; a CSV file is one dataset of no workbook."""
        sheets = uploads.tables(raw)
        if not sheets:
            raise CodedError("empty_table", "the workbook has no sheet with rows")
        of = [None if name is None else workbook_id for name, _ in sheets]
        rows, written = [], []
        try:
            for (name, cells), own in zip(sheets, of):
                at = f"{self.path}/tables/{uuid.uuid4().hex}"
                written.append(at)
                df = uploads.frame(self.spark, cells)
                df.write.parquet(at)
                dataset = workbook_id if name is None else f"{workbook_id}/{name}"
                rows.append(("dataset", own, dataset, filename, name, at, df.dtypes, len(cells) - 1))
            if any(of):
                rows.append(("workbook", workbook_id, None, filename, None, None, None, None))
            number, held = self._rows()
            mine = (F.col("workbook_id") == workbook_id) | (F.col("dataset_id") == workbook_id)
            kept = held.where(~F.coalesce(mine, F.lit(False)))
            self.known.commit(kept.unionByName(self.spark.createDataFrame(rows, RELATION)).coalesce(1), number)
        except Exception:
            self._remove(written)
            raise
        self._remove([r["path"] for r in held.where(F.coalesce(mine, F.lit(False)) & F.col("path").isNotNull()).select("path").collect()])  # one a sheet
        return [r[2] for r in rows if r[0] == "dataset"]

    def _remove(self, paths: list[str]) -> None:
        for p in paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def datasets(self) -> DataFrame:
        return self._rows()[1].where("kind = 'dataset'").select("dataset_id", "workbook_id", "filename", "sheet_name", "path", "columns", "row_count")

    def workbooks(self) -> DataFrame:
        return self._rows()[1].where("kind = 'workbook'").select("workbook_id", F.col("filename").alias("workbook_filename"))

    def relation(self) -> DataFrame:
        """Every dataset with its workbook, which CSV files have none of."""
        return datasets_with_workbooks(self.datasets(), self.workbooks())

    def table(self, dataset_id: str) -> DataFrame:
        one = self.datasets().where(F.col("dataset_id") == dataset_id).select("path").first()
        if one is None:
            raise CodedError("not_found", dataset_id, 404)
        return self.spark.read.parquet(one["path"])


def datasets_with_workbooks(datasets: DataFrame, workbooks: DataFrame) -> DataFrame:
    return datasets.join(workbooks, "workbook_id", "left")
