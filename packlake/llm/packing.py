"""Filling containers of fixed capacity with documents (problem 7).

Method: sum-of-squares online packing. A shard keeps an array of how many containers stand at each fill level;
a document goes to the level where the sum of squared counts afterwards is least, so that no level piles up.
Documents above the capacity fill whole containers of their own and only their remainder is packed.

Shards are made by a hash of the document id and hold about ``SHARD_TOKENS`` tokens each whatever the corpus, so a
task sees a bounded list of integers, and what stays open at the end of a shard is a small, constant share.

Defined results: null and empty texts measure 0 tokens and need no container (container_id null, one row); repeated
texts are packed each for itself; rows without an id are documents too; equal sizes are placed in order of the document id; a null capacity or one below 1 is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake.llm.bpe import DEFAULT_VOCABULARY, token_count

#: Tokens a shard holds on average; about 2,000 containers of 2,048.
SHARD_TOKENS = 4_000_000
#: Characters that make a token at least, for sizing shards without encoding twice; only the number of shards hangs on it.
CHARS_PER_TOKEN = 2.5
PLACED = "doc_id long, part_no int, start_token int, n_tokens int, container_id string"


class LevelArray:
    """Counts of containers by fill level, and the containers of each level."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> int:
        """Number of the container that takes an item of 1 to ``capacity``."""
        top = self.capacity - size
        # taking a container from level h changes the sum of squares by 1 - 2 N[h], bringing one to h + size by 2 N[h + size] + 1; empty and full containers count nothing
        cost = 2 * (self.count[size:] - self.count[: top + 1]) + 2
        cost[0] -= 1
        cost[top] -= 1
        allowed = self.count[: top + 1] > 0
        allowed[0] = True
        # ties go to the fullest level: less is opened
        best = top - int(np.argmin(np.where(allowed, cost, np.iinfo(np.int64).max)[::-1]))
        if best:
            container = self.open[best].pop()
            self.count[best] -= 1
        else:
            container, self.made = self.made, self.made + 1
        level = best + size
        if level < self.capacity:
            self.count[level] += 1
            self.open[level].append(container)
        return container


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Container number of every size, in order of arrival."""
    levels = LevelArray(capacity)
    return [levels.place(s) for s in sizes]


def _pack_shard(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "part_no"], ascending=[False, True, True], kind="stable")
        shard = int(rows["shard"].iloc[0])
        sizes = rows["n_tokens"].to_numpy()
        loose = (sizes > 0) & (sizes < capacity)  # a full part is a container already, an empty one needs none
        names = np.where(sizes > 0, "full-" + rows["doc_id"].astype(str) + "-" + rows["part_no"].astype(str), None).astype(object)
        names[loose] = [f"{shard}-{n}" for n in pack(sizes[loose].tolist(), capacity)]
        return pd.DataFrame({"doc_id": rows["doc_id"], "part_no": rows["part_no"], "start_token": rows["start_token"], "n_tokens": rows["n_tokens"], "container_id": names})

    return run


def fill_containers(sized: DataFrame, capacity: int, shards: int) -> DataFrame:
    """Assign (doc_id, n_tokens) rows to containers; one row per document, or per part of one above the capacity."""
    if capacity is None or capacity < 1:
        raise ValueError("capacity must be at least 1")
    whole = F.floor(F.col("n_tokens") / capacity)
    last = F.when(F.col("n_tokens") % capacity == 0, whole - 1).otherwise(whole)
    parts = sized.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int"))).alias("part_no"))
    parts = parts.select(
        "doc_id",
        "part_no",
        (F.col("part_no") * capacity).cast("int").alias("start_token"),
        F.least(F.lit(capacity), F.col("n_tokens") - F.col("part_no") * capacity).cast("int").alias("n_tokens"),
    )
    # one group function for all parts, so the texts are read and encoded once; what moves is a few numbers a document
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(shards)).cast("int"))
    return parts.groupBy("shard").applyInPandas(_pack_shard(capacity), PLACED)


def pack_documents(documents: DataFrame, capacity: int, path: str = DEFAULT_VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Containers of ``capacity`` tokens for the texts of ``documents`` (doc_id, text)."""
    chars = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, round(chars / CHARS_PER_TOKEN / shard_tokens))
    sized = documents.select("doc_id", token_count(F.col("text"), path).alias("n_tokens"))
    return fill_containers(sized, capacity, shards)


def container_fill(placed: DataFrame, capacity: int) -> DataFrame:
    """(container_id, n_items, used, unused) of every container."""
    return (
        placed.where(F.col("container_id").isNotNull())
        .groupBy("container_id")
        .agg(F.count(F.lit(1)).alias("n_items"), F.sum("n_tokens").alias("used"))
        .withColumn("unused", F.lit(capacity) - F.col("used"))
    )
