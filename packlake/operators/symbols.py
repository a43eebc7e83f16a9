"""Named definitions with their line ranges: one row per function, class and method of Python, JavaScript and TypeScript files.

Functions below a class are its methods, also where they stand inside another of its functions; bodies of JavaScript functions are not
entered. A file that does not parse gives no rows and is marked; lines count from 1.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "symbols array<struct<name:string,kind:string,start_line:int,end_line:int,parent:string>>, parse_error boolean"
#: Weights of a keyword hit by the kind of symbol; classes and anything else weigh 1.
KIND_WEIGHTS = {"function": 2.0, "method": 1.5}

_TOKEN = re.compile(
    r"(?P<skip>//[^\n]*|/\*[\s\S]*?\*/|`(?:[^`\\]|\\[\s\S])*`|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|(?:(?<=[(,=:\[!&|?{};+])\s*|\b(?:return|typeof|case|in|of)[ \t]+)/(?![/*])(?:[^\n/\\\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*)"
    r"|(?P<word>#?[A-Za-z_$][\w$]*)|(?P<sign>=>|[{}()\[\];,<>=*:?.!])"
)
_MODIFIERS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract"}
_NO_METHOD = {"if", "for", "while", "switch", "catch", "return", "function", "new", "super", "await", "typeof"}


def python_symbols(source: str) -> list[tuple] | None:
    """(name, kind, start_line, end_line, parent) of a module's definitions in order; None if it does not parse."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            module = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None
    out: list[tuple] = []
    waiting: list[tuple[ast.AST, str | None]] = [(module, None)]
    while waiting:
        node, parent = waiting.pop()
        below = parent
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append((node.name, "method" if parent else "function", node.lineno, node.end_lineno, parent))
        elif isinstance(node, ast.ClassDef):
            out.append((node.name, "class", node.lineno, node.end_lineno, parent))
            below = node.name
        waiting += [(child, below) for child in reversed(list(ast.iter_child_nodes(node)))]
    return out


def javascript_symbols(source: str) -> list[tuple] | None:
    """The same of JavaScript or TypeScript source, read by its brackets; None where they do not match."""
    tokens = [(m.lastgroup, m[0], m.start()) for m in _TOKEN.finditer(source) if m.lastgroup != "skip"]
    close: dict[int, int] = {}
    opened: list[int] = []
    pairs = {"{": "}", "(": ")", "[": "]"}
    for i, (_, text, _) in enumerate(tokens):
        if text in pairs:
            opened.append(i)
        elif text in ("}", ")", "]"):
            if not opened or pairs[tokens[opened[-1]][1]] != text:
                return None
            close[opened.pop()] = i
    if opened:
        return None
    starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def line(i: int) -> int:
        from bisect import bisect_right

        return bisect_right(starts, tokens[i][2])

    def body_after(i: int) -> int | None:
        """The opening brace of the body behind parameters that open at ``i``; none for a signature alone."""
        j = close[i] + 1
        while j < len(tokens) and tokens[j][1] not in ("{", ";", "}", "=>"):
            j = close[j] + 1 if j in close else j + 1
        if j < len(tokens) and tokens[j][1] == "{" and tokens[j - 1][1] in (":", "|", "<"):  # a type literal, not yet the body
            j = close[j] + 1
            while j < len(tokens) and tokens[j][1] not in ("{", ";", "}"):
                j += 1
        return j if j < len(tokens) and tokens[j][1] == "{" else None

    out: list[tuple] = []
    work: list[tuple[int, int, str | None, bool]] = [(0, len(tokens), None, False)]
    while work:
        i, end, parent, in_class = work.pop()
        while i < end:
            kind, text, _ = tokens[i]
            first = i
            if text == "=>" and i + 1 < end and tokens[i + 1][1] == "{":
                i = close[i + 1] + 1
                continue
            if in_class and kind == "word":
                while i + 1 < end and tokens[i][1] in _MODIFIERS and (tokens[i + 1][0] == "word" or tokens[i + 1][1] == "*"):
                    i += 1
                if tokens[i][1] == "*":
                    i += 1
                j = i + 1
                if j < end and tokens[j][1] == "(" and tokens[i][1] not in _NO_METHOD:
                    brace = body_after(j)
                    if brace is not None:
                        out.append((tokens[i][1], "method", line(first), line(close[brace]), parent))
                        i = close[brace] + 1
                        continue
                while i < end and tokens[i][1] != ";" and not (i > first and line(i) > line(i - 1) and tokens[i][0] == "word"):
                    i = close[i] + 1 if i in close else i + 1
                continue
            if text == "function" and i + 1 < end:
                j = i + 2 if tokens[i + 1][1] == "*" else i + 1
                named = tokens[j][0] == "word"
                at = j + 1 if named else j
                while at < end and tokens[at][1] != "(":
                    at += 1
                brace = body_after(at) if at < end else None
                if brace is not None:
                    begin = i - 1 if i and tokens[i - 1][1] == "async" else i
                    if named:
                        out.append((tokens[j][1], "method" if parent else "function", line(begin), line(close[brace]), parent))
                    i = close[brace] + 1
                    continue
            if text == "class" and i + 1 < end and tokens[i + 1][0] == "word" and (i == 0 or tokens[i - 1][1] != "."):
                name = tokens[i + 1][1]
                j = i + 2
                while j < end and tokens[j][1] != "{":
                    j = close[j] + 1 if j in close else j + 1
                if j < end:
                    out.append((name, "class", line(i), line(close[j]), parent))
                    work.append((close[j] + 1, end, parent, in_class))
                    work.append((j + 1, close[j], name, True))
                    break
            i += 1
    return sorted(out, key=lambda s: (s[2], -s[3]))


def _extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    names = ("name", "kind", "start_line", "end_line", "parent")
    for languages, contents in batches:
        rows = []
        for language, content in zip(languages, contents):
            found = None if content is None else python_symbols(content) if language == "Python" else javascript_symbols(content)
            rows.append(([dict(zip(names, s)) for s in found or []], found is None))
        yield pd.DataFrame(rows, columns=["symbols", "parse_error"])


def file_symbols(files: DataFrame) -> DataFrame:
    """(repo, rel_path, symbols, parse_error) of every Python, JavaScript and TypeScript file."""
    wanted = files.where(F.col("language").isin("Python", "JavaScript", "TypeScript"))
    found = wanted.select("repo", "rel_path", F.pandas_udf(_extract, SYMBOLS)("language", "content").alias("s"))
    return found.select("repo", "rel_path", "s.symbols", "s.parse_error")


def symbol_rows(symbols: DataFrame) -> DataFrame:
    """One row per symbol."""
    return symbols.select("repo", "rel_path", F.explode("symbols").alias("s")).select("repo", "rel_path", "s.*")


def symbol_weight(kind: Column) -> Column:
    weight = F.lit(1.0)
    for name, value in KIND_WEIGHTS.items():
        weight = F.when(F.lower(F.trim(kind)) == name, value).otherwise(weight)
    return weight
