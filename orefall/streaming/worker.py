"""Worker passes over a queue kept as snapshots: at most one job a module and pass, stale runs archived, arrivals from a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from orefall.config import Settings
from orefall.errors import CodedError
from orefall.operators.lifecycle import archived, due, failure
from orefall.sources.snapshots import Snapshots

JOB = "job_id string, module string, status string, available_at timestamp, created_at timestamp, lease_until timestamp, attempts long, error string"
RUN = "run_id string, status string, started_at timestamp"
#: Times that a claim is tried again when another pass was first.
TRIES = 5


class Worker:
    """queue: snapshots of JOB rows. runs: snapshots of RUN rows. work: does a job (a dict), raises CodedError for a final failure."""

    def __init__(self, queue: Snapshots, runs: Snapshots | None, work: Callable[[dict], None], settings: Settings = Settings()) -> None:
        self.queue, self.runs, self.work, self.settings = queue, runs, work, settings

    def enqueue(self, jobs: DataFrame, stream: str = "", batch: int = -1) -> None:
        """Add jobs (job_id, module, available_at, created_at); a known id, or a batch that was added before, changes nothing."""
        number, held, notes = self.queue.read()
        if stream and notes.get(stream, -1) >= batch:
            return
        one = W.partitionBy("job_id").orderBy("created_at", "available_at", "module")
        new = jobs.withColumn("_n", F.row_number().over(one)).where("_n = 1").select(
            "job_id", "module", F.lit("uploaded").alias("status"), "available_at", "created_at",
            F.lit(None).cast("timestamp").alias("lease_until"), F.lit(0).cast("long").alias("attempts"), F.lit(None).cast("string").alias("error"),
        )
        rows = new if held is None else held.unionByName(new.join(held.select("job_id"), "job_id", "left_anti"))
        self.queue.commit(rows, number, notes | ({stream: batch} if stream else {}))

    def claim(self, asof: Column) -> list[dict]:
        """The first due job of each module, now processing under a lease. One commit takes them all, so that no other pass has them."""
        for _ in range(TRIES):
            number, held, notes = self.queue.read()
            if held is None:
                return []
            first = W.partitionBy("module").orderBy("available_at", "created_at", "job_id")
            chosen = held.where(due(asof)).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
            jobs = [r.asDict() for r in chosen.collect()]  # one a module
            if not jobs:
                return []
            mine = F.col("job_id").isin([j["job_id"] for j in jobs])
            taken = held.withColumns({
                "status": F.when(mine, "processing").otherwise(F.col("status")),
                "lease_until": F.when(mine, asof + F.make_interval(secs=F.lit(self.settings.lease_seconds))).otherwise(F.col("lease_until")),
                "attempts": F.when(mine, F.col("attempts") + 1).otherwise(F.col("attempts")),
            })
            try:
                self.queue.commit(taken, number, notes)
            except CodedError as e:
                if e.code != "conflict":
                    raise
                continue
            return [j | {"attempts": j["attempts"] + 1} for j in jobs]
        return []

    def _settle(self, done: dict[str, tuple[bool, str | None]], asof: Column) -> None:
        """done: for each job whether its failure is final, and its error; None if it went well."""
        spark = self.queue.spark
        rows = spark.createDataFrame([(k, c, e) for k, (c, e) in done.items()], "job_id string, _coded boolean, _error string")
        for _ in range(TRIES):
            number, held, notes = self.queue.read()
            status, wait = failure(F.col("attempts"), F.col("_coded"), self.settings.ingest_attempts, self.settings.retry_seconds)
            ours = F.col("_coded").isNotNull() & (F.col("status") == "processing")
            failed = F.col("_error").isNotNull()
            seconds = F.coalesce(wait, F.lit(0.0))
            settled = held.join(F.broadcast(rows), "job_id", "left").select(  # rows: one a module
                "job_id", "module",
                F.when(ours, F.when(failed, status).otherwise("ready")).otherwise(F.col("status")).alias("status"),
                F.when(ours & failed, asof + F.make_interval(secs=seconds)).otherwise(F.col("available_at")).alias("available_at"),
                "created_at",
                F.when(ours, F.lit(None).cast("timestamp")).otherwise(F.col("lease_until")).alias("lease_until"),
                "attempts",
                F.when(ours, F.col("_error")).otherwise(F.col("error")).alias("error"),
            )
            try:
                self.queue.commit(settled, number, notes)
                return
            except CodedError as e:
                if e.code != "conflict":
                    raise
        raise CodedError("conflict", "the results of a pass could not be written", 409)

    def archive(self, asof: Column) -> None:
        if self.runs is not None:
            number, held, notes = self.runs.read()
            if held is not None and not held.where((F.col("status") == "running") & (F.col("started_at") < asof - F.make_interval(secs=F.lit(self.settings.stale_seconds)))).isEmpty():
                self.runs.commit(archived(held, asof, self.settings.stale_seconds), number, notes)

    def once(self, asof: Column | None = None) -> list[str]:
        """Archive stale runs, then claim and do at most one job of each module. The ids of the jobs."""
        at = F.current_timestamp() if asof is None else asof
        self.archive(at)
        done: dict[str, tuple[bool, str | None]] = {}
        for job in self.claim(at):
            try:
                self.work(job)
                done[job["job_id"]] = (False, None)
            except CodedError as e:
                done[job["job_id"]] = (True, e.code)
            except Exception as e:  # a failure of any kind is the job's, and is tried again
                done[job["job_id"]] = (False, f"{type(e).__name__}: {e}"[:500])
        if done:
            self._settle(done, at)
        return sorted(done)

    def serve(self, jobs: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Micro-batches of arriving jobs: each is added to the queue once, and followed by passes until no job is due."""

        def batch(arrived: DataFrame, number: int) -> None:
            self.enqueue(arrived, checkpoint, number)
            while self.once():
                pass

        writer = jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
