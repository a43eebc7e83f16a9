"""Per-language extraction of imports, exports, symbols and a first line of documentation.

Markdown, JSON, YAML, shell, JavaScript and the fallback for Python are columns; the Python and TOML readers run as Arrow batches.
All give a struct (imports, exports, symbols, docstring).
"""

from __future__ import annotations

import ast
import tomllib
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake.functions import paths, text

NAMES, TOP_KEYS, MARKDOWN_SYMBOLS, SHELL_SYMBOLS, DOC_CHARS = 50, 20, 30, 30, 500
EXTRACTED = "imports array<string>, exports array<string>, symbols array<string>, docstring string"


def _all(content: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), group)


def _sorted_set(*arrays: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*arrays)))


def _empty() -> Column:
    return F.array().cast("array<string>")


def _struct(imports: Column, exports: Column, symbols: Column, docstring: Column) -> Column:
    return F.struct(imports.alias("imports"), exports.alias("exports"), symbols.alias("symbols"), F.coalesce(docstring, F.lit("")).alias("docstring"))


def _prefixed(prefix: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(prefix), n))


def _stripped(content: Column) -> Column:
    return F.transform(text.lines(content), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))


def markdown(content: Column) -> Column:
    """Headings as symbols; the first heading, or a paragraph before any, as documentation. A paragraph before any heading ends the reading."""
    rows = F.filter(_stripped(content), lambda s: s != "")
    title = lambda s: F.regexp_replace(s, r"^#+\s*", "")
    told = F.filter(rows, lambda s: ~s.startswith("#") | (title(s) != ""))
    opened_by_text = ~F.get(told, F.lit(0)).startswith("#")
    heads = F.transform(F.filter(told, lambda s: s.startswith("#")), title)
    symbols = F.when(opened_by_text, _empty()).otherwise(F.slice(heads, 1, MARKDOWN_SYMBOLS))
    doc = F.when(opened_by_text, F.get(told, F.lit(0))).otherwise(F.get(heads, F.lit(0)))
    return _struct(_empty(), _empty(), F.coalesce(symbols, _empty()), doc)


def json_keys(content: Column, path: Column) -> Column:
    """Top-level keys of an object in order, or the first indexes of a list; a package manifest's description. Invalid JSON gives nothing."""
    content = F.when(F.try_parse_json(content).isNotNull(), content)
    keys = F.slice(F.array_distinct(F.json_object_keys(content)), 1, TOP_KEYS)
    count = F.json_array_length(content)
    indexes = F.transform(F.sequence(F.lit(0), F.least(count, F.lit(5)) - 1), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]")))
    field = lambda k: F.get_json_object(content, f"$.{k}")
    named = F.when(field("name") != "", F.concat(F.lit("npm package: "), field("name"), F.when(field("version") != "", F.concat(F.lit(" v"), field("version"))).otherwise("")))
    doc = F.when(paths.name(path) == "package.json", F.coalesce(F.when(field("description") != "", field("description")), named))
    return _struct(_empty(), _empty(), F.coalesce(keys, F.when(count > 0, indexes), _empty()), doc)


def yaml_keys(content: Column) -> Column:
    """Keys in the first column, once each, in order."""
    keys = F.slice(F.array_distinct(_all(content, r"(?dm)^([a-zA-Z_][a-zA-Z0-9_-]*)\s*:")), 1, TOP_KEYS)
    return _struct(_empty(), _empty(), keys, F.lit(""))


def shell(content: Column) -> Column:
    """Sourced files, functions and upper-case variables; the first comment after the interpreter line."""
    head = F.slice(_stripped(content), 1, 30)
    head = F.when(F.get(head, F.lit(0)).startswith("#!"), F.slice(head, 2, 29)).otherwise(head)
    before_code = F.aggregate(
        head,
        F.struct(F.lit("").alias("doc"), F.lit(False).alias("over")),
        lambda s, x: F.when(
            s["over"] | (x == ""), s
        ).otherwise(
            F.struct(
                F.when((s["doc"] == "") & x.startswith("#"), F.regexp_replace(x, r"^#\s*", "")).otherwise(s["doc"]).alias("doc"),
                (~x.startswith("#")).alias("over"),
            )
        ),
    )
    sourced = F.filter(F.transform(_all(content, r"(?dm)^(?:source\s+|[.]\s+)([^\s$#;]+)"), lambda s: F.regexp_replace(s, "^[\"']+|[\"']+$", "")), lambda s: s != "")
    keywords = F.array(*map(F.lit, "if while for do then else fi case esac in".split()))
    functions = F.filter(_all(content, r"(?dm)^(?:function\s+)?(\w+)\s*\(\s*\)\s*\{"), lambda s: ~F.array_contains(keywords, s))
    variables = _all(content, r"(?dm)^(?:export\s+)?([A-Z_][A-Z0-9_]{1,})\s*=")
    symbols = F.slice(F.array_distinct(F.concat(_prefixed("function ", functions), variables)), 1, SHELL_SYMBOLS)
    return _struct(_sorted_set(sourced), _empty(), symbols, before_code["doc"])


def javascript(content: Column) -> Column:
    """Imported modules, exported and top-level names, and the leading comment."""
    imports = [
        _all(content, r"(?d)\bimport\b[^(].*?from\s+['\"]([^'\"]+)['\"]"),
        _all(content, r"\bimport\s+['\"]([^'\"]+)['\"]"),
        _all(content, r"\brequire\s*\(\s*['\"]([^'\"]+)['\"]\s*\)"),
    ]
    exported = {
        "function": _all(content, r"(?dm)^export\s+(?:default\s+)?(?:async\s+)?function\s+(\w+)"),
        "class": _all(content, r"(?dm)^export\s+(?:default\s+)?class\s+(\w+)"),
        "const": _all(content, r"(?dm)^export\s+(?:const|let|var)\s+(\w+)"),
        "type": _all(content, r"(?dm)^export\s+(?:type|interface)\s+(\w+)"),
    }
    inner = [
        _all(content, r"(?dm)^(?:async\s+)?function\s+(\w+)\s*[\(<]"),
        _all(content, r"(?dm)^class\s+(\w+)"),
        _all(content, r"(?dm)^(?:const|let|var)\s+([A-Z][A-Z0-9_]{1,})\s*="),
    ]
    exports = [_prefixed(f"{kind} ", names) for kind, names in exported.items()]
    inside = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^/\*+\s*", ""), r"\*+/$", ""), r"^\s+|\s+$", "")
    told = F.aggregate(
        F.slice(_stripped(content), 1, 30),
        F.struct(F.lit("").alias("doc"), F.lit(False).alias("over")),
        lambda s, x: F.when(s["over"] | (x == ""), s)
        .when(x.startswith("//"), F.struct(F.regexp_replace(x, r"^//\s*", "").alias("doc"), (F.regexp_replace(x, r"^//\s*", "") != "").alias("over")))
        .when(x.startswith("/*"), F.struct(inside(x).alias("doc"), (inside(x) != "").alias("over")))
        .otherwise(F.struct(F.lit("").alias("doc"), (~x.startswith("*")).alias("over"))),
    )
    return _struct(_sorted_set(*imports), _sorted_set(*exports), _sorted_set(*exported.values(), *inner), told["doc"])


def python_by_pattern(content: Column) -> Column:
    """What can be read of a Python file that does not parse."""
    imports = [_all(content, r"(?dm)^import\s+([\w.]+)"), _all(content, r"(?dm)^from\s+([\w.]+)\s+import")]
    symbols = _all(content, r"(?dm)^(?:def|class|async\s+def)\s+(\w+)")
    return _struct(_sorted_set(*imports), _empty(), _sorted_set(symbols), F.lit(""))


def read_python(source: str) -> tuple[list, list, list, str] | None:
    """Imports, public definitions, symbols and first line of documentation of a module; None if it does not parse."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            module = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None
    imports, exports, symbols = set(), set(), set()
    kinds = {ast.FunctionDef: "def", ast.AsyncFunctionDef: "async def", ast.ClassDef: "class"}
    for node in module.body:
        kind = kinds.get(type(node))
        if isinstance(node, ast.Import):
            imports.update(alias.name for alias in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            imports.add(node.module)
        elif kind:
            symbols.add(node.name)
            if not node.name.startswith("_"):
                exports.add(f"{kind} {node.name}")
            if kind == "class":
                methods = [m.name for m in node.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef))]
                symbols.update(m for m in methods if not m.startswith("_") or m in ("__init__", "__call__"))
        elif isinstance(node, ast.Assign):
            symbols.update(t.id for t in node.targets if isinstance(t, ast.Name) and t.id.isupper() and len(t.id) > 1)
    doc = ast.get_docstring(module) or ""
    return sorted(imports), sorted(exports), sorted(symbols), doc.strip().split("\n")[0] if doc else ""


def read_toml(source: str, path: str) -> tuple[list, list, list, str] | None:
    """Top-level keys of a TOML file, and a project's description; None if it is not valid."""
    try:
        data = tomllib.loads(source)
    except (tomllib.TOMLDecodeError, RecursionError):
        return None
    project = data.get("project") if path.rsplit("/", 1)[-1] == "pyproject.toml" else None
    told = project.get("description") if isinstance(project, dict) else None
    return [], [], list(data)[:TOP_KEYS], told if isinstance(told, str) else ""


def _parsed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for contents, languages, names in batches:
        rows = []
        for content, language, path in zip(contents, languages, names):
            row = None
            if content is not None:
                row = read_python(content) if language == "Python" else read_toml(content, path)
            rows.append(row or (None, None, None, None))
        yield pd.DataFrame(rows, columns=["imports", "exports", "symbols", "docstring"])


def python_or_toml(content: Column, language: Column, path: Column) -> Column:
    """The struct of a Python or TOML file; its fields are null where the file does not parse."""
    return F.pandas_udf(_parsed, EXTRACTED)(content, language, path)


def toml_headers(content: Column) -> Column:
    """Section names of a TOML file that is not valid."""
    names = F.transform(_all(content, r"(?dm)^\[([^\]]+)\]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return _struct(_empty(), _empty(), F.array_distinct(names), F.lit(""))


def summaries(files: DataFrame) -> DataFrame:
    """The summary row of each accepted file (repo, rel_path, language, content, line_count, content_hash).

    Rows of Python and TOML alone pass the Arrow boundary; the others stay in the JVM.
    """
    from packlake.operators.classify import purpose

    content, path, lang = F.col("content"), F.col("rel_path"), F.col("language")
    parsed = files.where(lang.isin("Python", "TOML")).withColumn("read", python_or_toml(content, lang, path))
    fallback = F.when(lang == "Python", python_by_pattern(content)).otherwise(toml_headers(content))
    parsed = parsed.withColumn("found", F.when(F.col("read.symbols").isNotNull(), F.col("read")).otherwise(fallback)).drop("read")
    other = files.where(~lang.isin("Python", "TOML") | lang.isNull()).withColumn(
        "found",
        F.when(lang.isin("JavaScript", "TypeScript"), javascript(content))
        .when(lang == "Markdown", markdown(content))
        .when(lang == "JSON", json_keys(content, path))
        .when(lang == "YAML", yaml_keys(content))
        .when(lang == "Shell", shell(content))
        .otherwise(_struct(_empty(), _empty(), _empty(), F.lit(""))),
    )
    cut = lambda name: F.slice(f"found.{name}", 1, NAMES).alias(name)
    return parsed.unionByName(other).select(
        "repo",
        "rel_path",
        "language",
        purpose(path, lang).alias("purpose"),
        cut("imports"),
        cut("exports"),
        cut("symbols"),
        F.left("found.docstring", F.lit(DOC_CHARS)).alias("docstring"),
        "line_count",
        "content_hash",
    )


def refreshed(files: DataFrame, previous: DataFrame) -> DataFrame:
    """Summaries of ``files``, taken from ``previous`` where path and content hash are equal; only the others are read again."""
    keys = ["repo", "rel_path", "content_hash"]
    known = previous.where(F.col("content_hash").isNotNull()).dropDuplicates(keys)
    hit = known.join(files.select(*keys).distinct(), keys, "left_semi")
    miss = files.join(known.select(*keys), keys, "left_anti")
    return hit.select(summaries(miss).columns).withColumn("cached", F.lit(True)).unionByName(summaries(miss).withColumn("cached", F.lit(False)))
