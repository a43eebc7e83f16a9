"""The engine's functions and tables in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packlake.dims import STOPWORDS
from packlake.functions.redaction import PATTERNS
from packlake.functions.text import FRAGMENT, TOKEN, WORD


def _literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_functions(spark: SparkSession) -> None:
    """``count_tokens``, ``keywords``, ``identifiers`` and ``redact`` as SQL functions; they are expressions and stay in generated code."""
    words = f"regexp_extract_all(t, {_literal(WORD)}, 0)"
    stop = "array(" + ", ".join(map(_literal, STOPWORDS)) + ")"
    fragments = f"filter(flatten(transform({words}, w -> regexp_extract_all(w, {_literal(FRAGMENT)}, 0))), p -> length(p) >= 3)"
    shown = "t"
    for _, pattern, placeholder in PATTERNS:
        shown = f"regexp_replace({shown}, {_literal(pattern.replace('(?m)', '(?dm)'))}, {_literal(placeholder)})"
    for name, kind, body in (
        ("count_tokens", "INT", f"regexp_count(t, {_literal(TOKEN)})"),
        ("identifiers", "ARRAY<STRING>", f"array_distinct(regexp_extract_all(lower(t), {_literal(WORD)}, 0))"),
        ("keywords", "ARRAY<STRING>", f"array_sort(array_except(array_distinct(filter(transform(concat({words}, {fragments}), x -> lower(x)), x -> length(x) >= 3)), {stop}))"),
        ("redact", "STRING", shown),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")


def register_views(**tables: DataFrame) -> None:
    """DataFrames as temporary views of their argument names."""
    for name, rows in tables.items():
        rows.createOrReplaceTempView(name)
