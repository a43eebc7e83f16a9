"""The paths that recent commits touched, as a log."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "repo string, path string"
TIMEOUT_S, DAYS = 10, 30


def touched_paths(root: str, days: int = DAYS, timeout_s: int = TIMEOUT_S) -> list[str]:
    """One entry per commit and path of the last ``days``; empty on any failure, also where there is no history."""
    command = ["git", "log", f"--since={days} days ago", "--name-only", "--format=", "--diff-filter=ACMR"]
    try:
        done = subprocess.run(command, cwd=root, capture_output=True, text=True, timeout=timeout_s, check=True)
    except (OSError, subprocess.SubprocessError):
        return []
    return [line.strip() for line in done.stdout.splitlines() if line.strip()]


def churn_of(spark: SparkSession, root: str, repo: str, days: int = DAYS) -> DataFrame:
    """(repo, rel_path, commits) of a working copy."""
    from pyspark.sql import functions as F

    log = spark.createDataFrame([(repo, p) for p in touched_paths(root, days)], SCHEMA)
    return log.groupBy("repo", F.col("path").alias("rel_path")).agg(F.count(F.lit(1)).alias("commits"))
