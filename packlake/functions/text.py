"""Columns over text: tokens, keywords, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packlake.dims import STOPWORDS

#: A word, or one sign that is neither word nor white space, in Unicode terms.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x1c-\x1f\x0b]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
WORD = "[a-zA-Z][a-zA-Z0-9_]*"
FRAGMENT = "[a-z]+|[A-Z][a-z]*|[0-9]+"


def token_count(text: Column) -> Column:
    """Tokens of a text by the fallback counter."""
    return F.regexp_count(text, F.lit(TOKEN))


def bytes_to_tokens(n_bytes: Column) -> Column:
    """Estimated tokens of a number of bytes, never negative."""
    return F.greatest(F.lit(0).cast("bigint"), (n_bytes / F.lit(3.5)).cast("bigint"))


def line_count(text: Column) -> Column:
    """Lines as a universal line splitter counts them: a closing break adds none."""
    breaks = F.regexp_count(text, F.lit(LINE_BREAK))
    return breaks + F.when((text == "") | text.rlike(f"(?:{LINE_BREAK})\\z"), 0).otherwise(1)


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK)


def head_lines(text: Column, n: int) -> Column:
    """The first ``n`` lines, joined by line feeds."""
    return F.array_join(F.slice(lines(text), 1, n), "\n")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def tokens(text: Column) -> Column:
    """The set of identifiers of a text in lower case; snake_case stays whole."""
    return F.array_distinct(words(F.lower(text)))


def stop_array() -> Column:
    return F.array(*map(F.lit, STOPWORDS))


def keywords(task: Column) -> Column:
    """The meaningful words of a task and their camelCase fragments, sorted."""
    found = words(task)
    fragments = F.filter(F.flatten(F.transform(found, lambda w: F.regexp_extract_all(w, F.lit(FRAGMENT), 0))), lambda p: F.length(p) >= 3)
    lowered = F.transform(F.concat(found, fragments), F.lower)
    return F.array_sort(F.array_except(F.array_distinct(F.filter(lowered, lambda w: F.length(w) >= 3)), stop_array()))


def identifier_parts(identifier: Column) -> Column:
    """The parts of an identifier at ``_``, ``-`` and case boundaries, longer than one letter, lower case, sorted."""
    cut = F.split(identifier, r"[_\-]|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
    return F.array_sort(F.array_distinct(F.transform(F.filter(cut, lambda p: F.length(p) > 1), F.lower)))


def mentioned_paths(text: Column) -> Column:
    """Paths in back ticks or double quotes that end in an ending of 1 to 10 letters, sorted."""
    ticked = F.regexp_extract_all(text, F.lit(r"`([^`]+\.[a-zA-Z]{1,10})`"), 1)
    quoted = F.regexp_extract_all(text, F.lit(r'"([^"]+\.[a-zA-Z]{1,10})"'), 1)
    return F.array_sort(F.array_distinct(F.concat(ticked, quoted)))


def holds_secret(text: Column) -> Column:
    """Whether a note seems to hold a credential and must not be stored."""
    named = text.rlike(r"(?i)(?:password|secret|api[_\-.]?key|access[_\-.]?token|bearer|private[_\-.]?key)\s*[=:]\s*\S{4,}")
    return named | text.rlike("[0-9a-fA-F]{40,}") | text.rlike("[A-Za-z0-9+/]{60,}={0,2}")


def trimmed(text: Column, limit: int) -> Column:
    """A text cut at its last line break within ``limit`` characters, with a mark."""
    cut = F.regexp_replace(F.left(text, F.lit(limit)), r"\n[^\n]*\z", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("\n\n*[trimmed for token budget]*")))
