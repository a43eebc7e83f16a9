"""Churn of files: how often a path was touched in a window before the last record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.dims import WEIGHTS
from packlake.operators.snapshot_diff import plain_path


def churn(log: DataFrame, days: int = 30, ts: str = "ts", path: str = "path", key: str = "repo") -> DataFrame:
    """(key, rel_path, commits) of a log of touched paths, over the last ``days`` before its latest record. Null paths are none."""
    latest = log.agg(F.max(ts)).first()[0]
    if latest is None:
        recent = log.where(F.lit(False))
    else:
        recent = log.where(F.col(ts) >= F.lit(latest) - F.expr(f"INTERVAL {int(days)} DAYS"))
    named = recent.select(key, plain_path(F.col(path)).alias("rel_path")).where(F.col("rel_path").isNotNull())
    return named.groupBy(key, "rel_path").agg(F.count(F.lit(1)).alias("commits"))


def churn_score(commits: Column) -> Column:
    return F.least(F.coalesce(commits, F.lit(0)), F.lit(5)) * WEIGHTS["churn"]


def churn_top(counted: DataFrame, n: int) -> DataFrame:
    """The ``n`` most touched files of all; ties by repository and path."""
    return counted.orderBy(F.desc("commits"), "repo", "rel_path").limit(n)
