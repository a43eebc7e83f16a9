"""Incremental refresh and churn over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packlake.operators import extract
from packlake.operators.classify import language
from packlake.functions.text import line_count

FILES = "repo string, rel_path string, content string, loaded_at timestamp"


def described(files: DataFrame) -> DataFrame:
    """Arriving files with the columns summaries are made from."""
    known = files.where(F.col("content").isNotNull() & F.col("rel_path").isNotNull())
    return known.select("repo", "rel_path", "loaded_at", language(F.col("rel_path")).alias("language"), "content", line_count(F.col("content")).alias("line_count"), F.sha2("content", 256).alias("content_hash"))


def refresh_summaries(arriving: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Keep a versioned Parquet store of summaries up to date with a stream of files.

    A batch reads again only files whose path and content hash the store lacks, and appends its rows under its batch number, so a batch that
    is repeated after a failure overwrites itself; ``current_summaries`` reads the latest row of each path.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = described(batch).dropDuplicates(["repo", "rel_path", "content_hash"])
        try:
            known = spark.read.parquet(store).where(F.col("batch") < number).select("repo", "rel_path", "content_hash").distinct()
            rows = rows.join(known, ["repo", "rel_path", "content_hash"], "left_anti")
        except Exception as error:  # noqa: BLE001 - the store begins with the first batch
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        made = extract.summaries(rows).join(rows.select("repo", "rel_path", "content_hash", "loaded_at"), ["repo", "rel_path", "content_hash"])
        made.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return arriving.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_summaries(store: DataFrame) -> DataFrame:
    """The latest summary of every path."""
    columns = [c for c in store.columns if c not in ("repo", "rel_path")]
    latest = store.groupBy("repo", "rel_path").agg(F.max(F.struct("loaded_at", "batch", *[c for c in columns if c not in ("loaded_at", "batch")])).alias("s"))
    return latest.select("repo", "rel_path", "s.*")


def windowed_churn(events: DataFrame, path: str = "path", ts: str = "ts", window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(window_start, path, commits) of a stream or table of touches; touches later than ``late`` behind the newest are dropped by a stream's watermark."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))  # a watermark needs an instant
    counted = events.withWatermark(ts, late) if events.isStreaming else events
    return counted.groupBy(F.window(ts, window).alias("w"), F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("commits")).select(F.col("w.start").alias("window_start"), "path", "commits")
