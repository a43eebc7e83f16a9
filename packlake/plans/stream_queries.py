"""Queries over streams: the same windows from a table and from a stream over it, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from packlake.session import checkpoint_dir, table
from packlake.streaming.refresh import windowed_churn

_WINDOWS = "SELECT date_trunc('day', ts) AS window_start, event_type AS path, count(*) AS commits FROM events WHERE ts IS NOT NULL GROUP BY 1, 2"


def _without_zone(counted):
    return counted.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def churn_windows(spark, sf_dir):
    return _without_zone(windowed_churn(table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("path"))))


def churn_windows_streamed(spark, sf_dir):
    """A stream over the table run to its end; its windows land in a table of the shared folder."""
    held = table(spark, sf_dir, "events")
    folder, _, name = held.inputFiles()[0].rpartition("/")
    only = name if name == "events.parquet" else "*.parquet"  # one file among others, or a folder of its own
    touched = spark.readStream.schema(held.schema).option("pathGlobFilter", only).parquet(folder).select("ts", F.col("event_type").alias("path"))
    place = f"{checkpoint_dir(spark)}/churn-{uuid.uuid4().hex}"

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{place}/windows")  # complete mode: each batch holds all windows

    query = windowed_churn(touched).writeStream.outputMode("complete").option("checkpointLocation", f"{place}/mark").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return _without_zone(spark.read.parquet(f"{place}/windows"))


QUERIES = {"churn_windows": churn_windows, "churn_windows_streamed": churn_windows_streamed}
ORACLES = {"churn_windows": _WINDOWS, "churn_windows_streamed": _WINDOWS}
