"""Votes that arrive over time: an extension, since the batch operators know no event time.

Counts add up, so a stream keeps one count per (entity, class) or per window, and
the consensus of each micro-batch is the batch operator over these counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """(start, event_type, n): rows per window; those later than ``late`` are left out."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), "event_type", "n")
    )


def running_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.col("user_id").alias("entity"), "event_type").agg(F.count("*").alias("n"))


def drained(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """Run what is there to the end; the last complete result, as a written table.

    Every micro-batch overwrites its own folder, so a repeated one changes nothing.
    """
    schema, done = stream.schema, []

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result-{epoch}")
        done.append(epoch)

    q = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/result-{max(done)}") if done else spark.createDataFrame([], schema)
