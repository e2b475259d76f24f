"""Structured Streaming over events: an extension beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.encodings import table
from ..storage import scratch_path
from ..streaming import votes as op
from .registry import query


def _stream(spark, d):
    # A glob takes the table whether it is one file or a folder of files.
    rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("S1", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, d):
    out = op.drained(spark, op.windowed_counts(_stream(spark, d)), scratch_path(spark, "stream"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("S2", "WITH n AS (SELECT user_id AS entity, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY entity) AS top, sum(n) OVER (PARTITION BY entity) AS total FROM n) SELECT entity, CASE WHEN count(*) = 1 AND 2 * max(top) > max(total) THEN min(event_type) ELSE '' END AS label FROM m WHERE n = top GROUP BY 1")
def stream_consensus(spark, d):
    counts = op.drained(spark, op.running_counts(_stream(spark, d)), scratch_path(spark, "stream"))
    top = counts.groupBy("entity").agg(F.max("n").alias("top"), F.sum("n").alias("total"))
    j = counts.join(top, "entity").where("n = top").groupBy("entity").agg(F.count("*").alias("ties"), F.min("event_type").alias("e"), F.max("top").alias("top"), F.max("total").alias("total"))
    return j.select("entity", F.when((F.col("ties") == 1) & (2 * F.col("top") > F.col("total")), F.col("e")).otherwise("").alias("label"))
