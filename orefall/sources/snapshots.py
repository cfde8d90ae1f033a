"""A table kept as numbered snapshots: readers see one whole, and of two writers from the same number the second is refused."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from orefall.errors import CodedError

POINTER = "at-"


class Snapshots:
    """A folder of Parquet tables and numbered pointers, the highest of which names the current table.

    Spark's own file system calls alone are used. A pointer is renamed into a place that must be free; stores whose rename isn't
    one step with that test, and local disks, need a single writer at a time. The snapshot before stays for its readers.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._file = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._file(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        if not self._fs.exists(self._file(self.path)):
            return []
        return sorted(n for f in self._fs.listStatus(self._file(self.path)) if (n := f.getPath().getName()).startswith(POINTER))

    def _named(self, pointer: str) -> dict:
        stream = self._fs.open(self._file(f"{self.path}/{pointer}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self) -> tuple[int, DataFrame | None, dict]:
        """Number, table and notes of the current snapshot; 0, None and no notes before the first."""
        names = self._pointers()
        if not names:
            return 0, None, {}
        held = self._named(names[-1])
        return int(names[-1].removeprefix(POINTER)), self.spark.read.parquet(f"{self.path}/{held['table']}"), held["notes"]

    def commit(self, table: DataFrame, number: int, notes: dict | None = None) -> int:
        """table as the snapshot after `number`."""
        name = f"s-{uuid.uuid4().hex}"
        table.write.parquet(f"{self.path}/{name}")
        tmp, final = self._file(f"{self.path}/.{name}"), self._file(f"{self.path}/{POINTER}{number + 1:012}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps({"table": name, "notes": notes or {}}, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(tmp, final):
            self._fs.delete(tmp, False)
            self._fs.delete(self._file(f"{self.path}/{name}"), True)
            raise CodedError("conflict", f"there is a snapshot after {number} already", 409)
        for old in self._pointers()[:-2]:
            self._fs.delete(self._file(f"{self.path}/{self._named(old)['table']}"), True)
            self._fs.delete(self._file(f"{self.path}/{old}"), False)
        return number + 1
