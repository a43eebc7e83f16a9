"""The engine's model tables, bound to the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake import dims
from packlake.functions import text
from packlake.operators import classify
from packlake.operators.churn import churn
from packlake.session import spread, table

#: Patterns of the ignore file that the corpus queries are run with.
IGNORE_PATTERNS = ("*.map", "fixtures/", "static/*.css", "docs/**/draft_?.md", "*-lock.json", "/rooted.py", "# note", "!kept.py")
CHURN_DAYS = 90


def scanned(spark, sf_dir) -> DataFrame:
    """Every file of the corpus as the scanner records it, with its reason to be skipped."""
    return classify.classified(spread(table(spark, sf_dir, "files").select("repo", "rel_path", "content")), list(IGNORE_PATTERNS))


def files(spark, sf_dir) -> DataFrame:
    """Files as the engine reads them, without regard to the recorded language and sizes."""
    rows = spread(table(spark, sf_dir, "files").select("repo", "rel_path", "content"))
    return rows.select("repo", "rel_path", classify.language(F.col("rel_path")).alias("language"), "content")


def summaries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "summaries").drop("file_id")


def tasks(spark, sf_dir) -> DataFrame:
    """(task_id, task, budget) of every task with a text; the default budget where a task names none."""
    rows = table(spark, sf_dir, "tasks").where(F.col("task").isNotNull()).dropDuplicates(["task_id"])
    return rows.select("task_id", "task", F.coalesce("budget", F.lit(dims.DEFAULT_BUDGET)).alias("budget"))


def churn_counts(spark, sf_dir) -> DataFrame:
    """Listings of the last days as a log of touched paths."""
    log = table(spark, sf_dir, "file_snapshots").select("repo", F.col("rel_path").alias("path"), F.col("loaded_at").alias("ts"))
    return churn(log, CHURN_DAYS)
