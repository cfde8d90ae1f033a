"""Structured Streaming: windowed run metrics, sessions, idempotent requests, and queue claims kept as state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; ts becomes a zoned timestamp, which watermarks need."""
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts, failures and sums of each window and kind; events later than `late` are dropped."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide or width)
    out = stream.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Each user's sessions: events without a pause of `gap`."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    out = stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(requests: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark: the streaming form of idempotent requests."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def attempts(failures: DataFrame, most: int = 3, base: int = 5) -> DataFrame:
    """For each failure event (job_id, coded, ts) the job's attempt, next status and wait; the count is kept as state."""

    def step(key, batches, state: GroupState):
        n = state.get[0] if state.exists else 0
        for pdf in batches:
            out = []
            for coded in pdf.sort_values("ts")["coded"]:
                n += 1
                status = "failed" if coded else "dead_letter" if n >= most else "uploaded"
                out.append((key[0], n, status, base * 2 ** (n - 1) if status == "uploaded" else None))
            yield pd.DataFrame(out, columns=["job_id", "attempt", "status", "wait"]).astype({"wait": "Float64"})
        state.update((n,))

    return failures.groupBy("job_id").applyInPandasWithState(step, "job_id long, attempt long, status string, wait double", "n long", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run all that is available into Parquet files, exactly once for each checkpoint."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
