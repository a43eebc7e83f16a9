"""Fragments of the SQL that results are compared with."""

from __future__ import annotations

from packlake import dims


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def array(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def case_of(key: str, table: dict) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v) if isinstance(v, str) else v}" for k, v in table.items()) + " END"


def name(p: str) -> str:
    return f"regexp_extract({p}, '([^/]*)$', 1)"


def parent(p: str) -> str:
    return f"regexp_extract({p}, '^(.*)/[^/]*$', 1)"


def suffix(p: str) -> str:
    return f"lower(regexp_extract({name(p)}, '^.+(\\.[^.]+)$', 1))"


def stem(p: str) -> str:
    return f"CASE WHEN regexp_matches({name(p)}, '^.+\\.[^.]+$') THEN regexp_replace({name(p)}, '\\.[^.]+$', '') ELSE {name(p)} END"


def dirs(p: str) -> str:
    return f"CASE WHEN contains({p}, '/') THEN string_split({parent(p)}, '/') ELSE []::VARCHAR[] END"


def language(p: str) -> str:
    return f"coalesce({case_of(f'lower({name(p)})', dims.LANGUAGE_BY_NAME)}, {case_of(suffix(p), dims.LANGUAGE_BY_SUFFIX)}, 'Unknown')"


def purpose(p: str, lang: str) -> str:
    low_dirs = f"list_transform({dirs(p)}, lambda d: lower(d))"
    return (
        f"coalesce({case_of(f'lower({name(p)})', dims.PURPOSE_BY_NAME)}, CASE WHEN list_has_any({low_dirs}, {array(dims.TEST_DIRS)}) THEN 'test file' WHEN list_has_any({low_dirs}, {array(dims.DOCS_DIRS)}) THEN 'documentation' "
        f"WHEN regexp_matches(lower({stem(p)}), '^test_|_test$|_spec$') THEN 'test file' END, {case_of(f'lower({stem(p)})', dims.PURPOSE_BY_STEM)}, {case_of(lang, dims.PURPOSE_BY_LANGUAGE)}, 'source file')"
    )


TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x1c-\x1f\x0b]"
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def token_count(t: str) -> str:
    return f"len(regexp_extract_all({t}, '{TOKEN}'))"


def line_count(t: str) -> str:
    return f"(len(regexp_extract_all({t}, '{BREAK}')) + CASE WHEN {t} = '' OR regexp_matches({t}, '(?:{BREAK})\\z') THEN 0 ELSE 1 END)"


def head_lines(t: str, n: int) -> str:
    return f"array_to_string(regexp_split_to_array(regexp_replace({t}, '(?:{BREAK})\\z', ''), '{BREAK}')[1:{n}], chr(10))"


def words(t: str) -> str:
    return f"regexp_extract_all({t}, '[a-zA-Z][a-zA-Z0-9_]*')"


def tokens(t: str) -> str:
    return f"list_distinct({words(f'lower({t})')})"


def keywords(t: str) -> str:
    frags = f"list_filter(flatten(list_transform({words(t)}, lambda w: regexp_extract_all(w, '[a-z]+|[A-Z][a-z]*|[0-9]+'))), lambda p: length(p) >= 3)"
    return f"list_sort(list_filter(list_distinct(list_transform(list_concat({words(t)}, {frags}), lambda w: lower(w))), lambda w: length(w) >= 3 AND NOT list_contains({array(dims.STOPWORDS)}, w)))"


def is_secret(p: str) -> str:
    low = f"lower({name(p)})"
    return f"({low} NOT IN {in_list(dims.SAFE_ENV_NAMES)} AND regexp_matches({low}, {quoted(dims.SECRET_NAMES)}))"


def redact(t: str) -> str:
    from packlake.functions.redaction import PATTERNS

    for _, pattern, placeholder in PATTERNS:
        t = f"regexp_replace({t}, {quoted(pattern)}, {quoted(placeholder.replace('$', chr(92)))}, 'g')"
    return t


def summary_text() -> str:
    line = lambda label, value: f"CASE WHEN coalesce({value}, '') <> '' THEN '- **{label}:** ' || {value} END"
    some = lambda c, n: f"coalesce({c}, [])[1:{n}]"
    ticked = f"array_to_string(list_transform({some('exports', 8)}, lambda e: '`' || e || '`'), ', ')"
    items = ", ".join(
        [
            "'### `' || rel_path || '` (' || coalesce(language, '') || ', summary)'",
            "''",
            line("Purpose", "purpose"),
            line("Exports", ticked),
            line("Symbols", f"array_to_string({some('symbols', 8)}, ', ')"),
            line("Imports", f"array_to_string({some('imports', 8)}, ', ')"),
            line("Doc", "left(docstring, 200)"),
            "''",
        ]
    )
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), chr(10))"


#: One row per file of ``summaries``.
SUMMARIES = "summaries_1 AS (SELECT * FROM summaries QUALIFY row_number() OVER (PARTITION BY repo, rel_path ORDER BY file_id) = 1)"
