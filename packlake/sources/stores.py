"""Stores of summaries and graphs: Parquet for the engine, single JSON documents for exchange.

A missing or damaged store reads as empty with its schema, so callers need no special case.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY = "repo string, rel_path string, language string, purpose string, imports array<string>, exports array<string>, symbols array<string>, docstring string, line_count int, content_hash string"
EDGE = "repo string, source string, target string, kind string, raw_import string, ord int"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path`` in ``schema``, empty if there is none."""
    try:
        found = spark.read.schema(schema).parquet(path)
        found.limit(1).collect()  # a damaged file shows only when it is read
        return found
    except Exception as error:  # noqa: BLE001 - any kind of damage means the same
        if isinstance(error, (AnalysisException,)) or "parquet" in str(error).lower():
            return spark.createDataFrame([], schema)
        raise


def write_summaries_json(summaries: DataFrame, path: str) -> None:
    """One JSON object keyed by path, sorted, for one repository; the caller bounds its size."""
    rows = {r["rel_path"]: {k: v for k, v in r.asDict().items() if k != "repo"} for r in summaries.orderBy("rel_path").collect()}
    Path(path).write_text(json.dumps(rows, indent=2, ensure_ascii=False, sort_keys=True), encoding="utf-8")


def read_summaries_json(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """Summaries of a JSON document; fields that are missing or of another type take their empty value."""
    try:
        held = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        held = {}
    names = lambda x: [str(i) for i in x] if isinstance(x, list) else []
    rows = []
    for rel_path, r in held.items() if isinstance(held, dict) else ():
        if isinstance(r, dict):
            text = {k: str(r.get(k) or "") for k in ("language", "purpose", "docstring", "content_hash")}
            lines = r.get("line_count") or 0
            rows.append((repo, rel_path, text["language"], text["purpose"], names(r.get("imports")), names(r.get("exports")), names(r.get("symbols")), text["docstring"], int(lines) if str(lines).isdigit() else 0, text["content_hash"]))
    return spark.createDataFrame(rows, SUMMARY)


def write_graph_json(nodes: DataFrame, edges: DataFrame, cycles: DataFrame, path: str) -> None:
    """Nodes, edges, unresolved imports and cycles of one repository as a JSON document."""
    kept = edges.where("kind <> 'unresolved'").orderBy("source", "ord").select("source", "target", "kind", "raw_import").collect()
    lost = edges.where("kind = 'unresolved'").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("ord", "target"))).alias("t")).orderBy("source").collect()
    document = {
        "nodes": [r.asDict() for r in nodes.select(F.col("rel_path").alias("id"), "language").orderBy("id").collect()],
        "edges": [r.asDict() for r in kept],
        "unresolved": {r["source"]: [t["target"] for t in r["t"]] for r in lost},
        "cycles": [list(r["cycle"]) for r in cycles.collect()],
    }
    Path(path).write_text(json.dumps(document, indent=2, ensure_ascii=False), encoding="utf-8")
