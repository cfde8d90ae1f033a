"""Uploads as a stream into the stored index: each batch is one commit, and a batch that comes again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from orefall.plans.index import Index

UPLOAD = "document_id long, version long, source_name string, owner_id string, visibility string, filename string, text string, error string"


class Ingest:
    """Loads uploads (columns of UPLOAD) into an index and keeps their registry beside it.

    Of a document the highest version counts; an earlier or repeated one is left alone. Uploads with an error, or without text, are
    registered as failed and indexed nowhere, and an older version of theirs stays. Segment, tombstones and the number of the batch become current
    in one step. A batch that died before that step leaves folders that no version names; the next attempt removes them
    and begins anew. A batch that died after it is recognised by its number.
    """

    def __init__(self, index: Index, name: str = "uploads") -> None:
        self.index, self.name = index, name
        self._statuses = f"{index.path}/registry-{name}"

    def registry(self) -> DataFrame | None:
        """(document_id, version, status, error, batch): the last row of every document, of committed batches only."""
        done = self.index.applied(self.name)
        if done < 0:
            return None
        rows = self.index.spark.read.parquet(self._statuses).where(F.col("run") <= done).withColumnRenamed("run", "batch")
        last = W.partitionBy("document_id").orderBy(F.desc("version"), F.desc("batch"))
        return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")

    def batch(self, uploads: DataFrame, number: int) -> None:
        """One micro-batch, any number of times."""
        if number <= self.index.applied(self.name):
            return
        self.index.sweep()
        best = W.partitionBy("document_id").orderBy(F.desc("version"), F.xxhash64("text", "filename"))
        new = uploads.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
        known = self.registry()
        if known is not None:
            old = known.select("document_id", F.col("version").alias("_known"))
            new = new.join(old, "document_id", "left").where(F.col("_known").isNull() | (F.col("version") > F.col("_known"))).drop("_known")
        error = F.coalesce(F.col("error"), F.when(F.trim(F.coalesce(F.col("text"), F.lit(""))) == "", F.lit("empty_document")))
        marked = new.withColumn("error", error).withColumn("status", F.when(error.isNull(), "ready").otherwise("failed"))
        # Written first and under the batch's number: read only once that number is committed, and written anew when it is not.
        marked.select("document_id", "version", "status", "error").write.mode("overwrite").parquet(f"{self._statuses}/run={number}")
        ready = marked.where("status = 'ready'").select("document_id", "source_name", "owner_id", "visibility", "filename", "text")
        self.index.add(ready, applied={self.name: number})

    def start(self, uploads: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """All that is available and then an end, or a batch each `every`."""
        writer = uploads.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
