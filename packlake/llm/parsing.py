"""Source files that do not parse (problem 1).

Method: memoised parsing with derivatives over token streams. An empty derivative marks the line of the token at fault; a last derivative
that does not hold the empty word means the file broke off. The grammar decides; two exact checks follow it: a Python file it refuses is
read once more by the interpreter's own parser, since string literals may nest beyond tokens, and a TOML file it accepts is
looked through for keys set twice, which no grammar of this kind can see.

Defined results: the language is taken from the end of ``rel_path``, whatever ``language`` and ``extension`` say; null content, null paths
and other endings have no verdict; an empty file is valid except as JSON; repeated rows give equal answers; texts are
parsed whole, however long and deep; one too deep for the exact check keeps the verdict of the grammar.
"""

from __future__ import annotations

import ast
import sys
import tomllib
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.llm.grammars import Json, Language, Python, Toml, Verdict
from packlake.llm.grammars2 import Bash, JavaScript, TypeScript, Yaml

# Endings of the languages that are parsed.
LANGUAGES = {"py": "Python", "js": "JavaScript", "mjs": "JavaScript", "ts": "TypeScript", "json": "JSON", "yml": "YAML", "yaml": "YAML", "toml": "TOML", "sh": "Shell"}
_MAKERS = {"Python": Python, "JavaScript": JavaScript, "TypeScript": TypeScript, "JSON": Json, "YAML": Yaml, "TOML": Toml, "Shell": Bash}
_ENDING = r"\.([A-Za-z]+)$"
VERDICT = "valid boolean, line int, truncated boolean, checked boolean"


@lru_cache(maxsize=None)
def parser(language: str) -> Language:
    """The parser of a language in this worker, with all derivatives it has learnt."""
    return _MAKERS[language]()


def _python_reads(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
        except (SyntaxError, ValueError):
            return False
        except (RecursionError, MemoryError):
            return False
    return True


def _toml_repeats(text: str) -> int | None:
    """The line where a TOML text, well formed by its grammar, sets a key or table twice."""
    try:
        tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        return getattr(error, "lineno", None) or 1
    except RecursionError:
        return None
    return None


def parse(language: str, text: str) -> tuple[Verdict, bool]:
    """The verdict on a text as source of a language, and whether it is that of the exact check behind the grammar."""
    verdict = read(language, text)
    if language == "Python" and not verdict.valid and _python_reads(text):
        return Verdict(True), True
    if language == "TOML" and verdict.valid and (line := _toml_repeats(text)):
        return Verdict(False, line), True
    return verdict, False


def read(language: str, text: str) -> Verdict:
    """The grammar's own verdict; a text of very many optional parts at once may need more room than a worker starts with."""
    try:
        return parser(language).parse(text)
    except RecursionError:
        usual = sys.getrecursionlimit()
        sys.setrecursionlimit(max(usual, 100 * len(text) + 10_000))  # derivatives nest a few calls a token at most
        try:
            return parser(language).parse(text)
        finally:
            sys.setrecursionlimit(usual)


def true_language(path: Column) -> Column:
    """The language a path stands for, or null where it is none of those parsed."""
    ending = F.lower(F.regexp_extract(path, _ENDING, 1))
    pairs = [F.lit(x) for pair in LANGUAGES.items() for x in pair]
    return F.create_map(*pairs)[ending]


def verdicts(language: Column, content: Column) -> Column:
    """A struct (valid, line, truncated, checked) of each content; null where language or content are."""

    @F.pandas_udf(VERDICT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for languages, contents in batches:
            out = []
            for name, text in zip(languages, contents):
                if name is None or text is None:
                    out.append((None, None, None, None))
                else:
                    v, checked = parse(name, text)
                    out.append((v.valid, v.line, v.truncated, checked))
            frame = pd.DataFrame(out, columns=["valid", "line", "truncated", "checked"])
            yield frame.astype({"valid": "boolean", "line": "Int32", "truncated": "boolean", "checked": "boolean"})

    return run(language, content)


def parse_files(files: DataFrame) -> DataFrame:
    """(file_id, repo, rel_path, true_language, valid, line, truncated, checked) of every file of a parsed language with content.

    ``checked`` tells the files whose verdict comes from the exact check and not from the grammar.
    """
    known = files.select("file_id", "repo", "rel_path", true_language(F.col("rel_path")).alias("true_language"), "content")
    known = known.where(F.col("true_language").isNotNull() & F.col("content").isNotNull())
    judged = known.withColumn("verdict", verdicts(F.col("true_language"), F.col("content")))
    return judged.select("file_id", "repo", "rel_path", "true_language", "verdict.valid", "verdict.line", "verdict.truncated", "verdict.checked")


def error_rates(parsed: DataFrame) -> DataFrame:
    """Files, files in error, files that broke off and files decided by the exact check, per repository and true language."""
    return parsed.groupBy("repo", "true_language").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum((~F.col("valid")).cast("int")).alias("n_errors"),
        F.sum(F.col("truncated").cast("int")).alias("n_truncated"),
        F.sum(F.col("checked").cast("int")).alias("n_checked"),
        F.round(F.avg((~F.col("valid")).cast("int")), 6).alias("error_rate"),
    )


def repaired_headers(file_symbols: DataFrame, parsed: DataFrame) -> DataFrame:
    """``file_symbols`` with ``parse_error`` as found; one row per file, rows of files without a verdict keep what was recorded."""
    headers = file_symbols.where(F.col("file_id").isNotNull()).groupBy("file_id").agg(
        F.min("repo").alias("repo"), F.min("rel_path").alias("rel_path"), F.max("parse_error").alias("recorded"), F.max("n_symbols").alias("n_symbols")
    )
    found = parsed.groupBy("file_id").agg(F.max(~F.col("valid")).alias("found"))
    return headers.join(found, "file_id", "left").select("file_id", "repo", "rel_path", F.coalesce("found", "recorded").alias("parse_error"), "n_symbols")
