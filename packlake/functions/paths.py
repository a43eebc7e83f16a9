"""Columns over POSIX paths, with the semantics of a path library: a leading or closing dot makes no suffix."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a fixed table, null where the key is not listed."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def parent(path: Column) -> Column:
    """The directory of a path, empty for a file at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def suffix(path: Column) -> Column:
    """The last ending with its dot, lower case; empty for ``.env`` and ``a.``."""
    return F.lower(F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", "")


def parts(path: Column) -> Column:
    return F.split(path, "/")


def directories(path: Column) -> Column:
    """The directory names of a path, outermost first."""
    return F.when(F.contains(path, F.lit("/")), F.split(parent(path), "/")).otherwise(F.array().cast("array<string>"))


def walk_key(path: Column) -> Column:
    """A key that sorts files as a walk meets them: the files of a directory before its sub-directories."""
    dirs = F.transform(directories(path), lambda d: F.concat(F.lit("1"), d))
    return F.concat(dirs, F.array(F.concat(F.lit("0"), name(path))))


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression over the whole string; ``*`` also crosses ``/``."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[at + 1 :]:
            end = pattern.index("]", at + 1)
            inside = pattern[at:end].replace("\\", "\\\\")
            at = end + 1
            out += f"[{'^' + inside[1:] if inside[0] == '!' else inside}]"
        else:
            out += re.escape(c)
    return f"(?s)^{out}$"


def ignored_by(path: Column, patterns: list[str]) -> Column:
    """Whether an ignore file's patterns cover a path: whole path, base name, or, with a ``/`` inside, any depth.

    One alternation for all patterns keeps the test inside a single expression instead of a join.
    """
    kept = [p.strip() for p in patterns]
    kept = [p.rstrip("/") for p in kept if p and not p.startswith(("#", "!"))]
    if not kept:
        return F.lit(False)
    whole = [glob_regex(p) for p in kept] + [glob_regex(f"**/{p}") for p in kept if "/" in p]
    by_path = path.rlike("|".join(f"(?:{x})" for x in whole))
    by_name = name(path).rlike("|".join(f"(?:{glob_regex(p)})" for p in kept))
    return by_path | by_name


def is_test(path: Column) -> Column:
    """Test files by name or by a part of their path."""
    slashed = F.regexp_replace(path, r"\\", "/")
    base = name(slashed)
    return base.startswith("test_") | base.endswith("_test.py") | F.arrays_overlap(parts(slashed), F.array(*map(F.lit, ("tests", "test", "__tests__", "spec"))))
