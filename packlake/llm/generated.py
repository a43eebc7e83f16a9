"""Generated, minified, vendored and data files among source files (problem 5).

Method: thresholds on layout statistics, tuned per language: longest and mean line, white-space share, alphanumeric share,
density of numeric literals and the share of long encoded runs. Beside them stand what layout cannot show: copies of upstream files, by
five-word shingles against the index of known files, the notice a generator or the authors of other people's code leave in the first or last comment, forms
only tools write (compiled modules, descriptors), and names and directories. ``reason`` tells which of these a file is classed by, layout
first, and ``reasons`` all that hold, so what each adds can be counted.

Every file is compared with the index by all its shingles. An index of up to ``INDEX_BYTES`` goes to the workers with the function;
a larger one is met in an equi-join on shingles.

Defined results: null or empty content has no layout and is judged by its path alone; ``size`` and ``line_count`` are recorded wrongly
at times and only taken for content that is missing; a null path is judged by content with the default thresholds; a file of fewer than
``COPY_SHINGLES`` shingles is a copy if its words are those of an index file; repeated rows give equal answers; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Content of an index of upstream files that may travel inside the function.
INDEX_BYTES = 8_000_000
#: Share of the smaller file's five-word shingles found in the other that makes a copy.
COPY_SHARE = 0.8
#: Shingles that a file must have to be compared.
COPY_SHINGLES = 15
#: Words of a shingle.
WORDS = 5
# Words of the notices that tools write into the files they make.
GENERATED_NOTICE = re.compile(
    r"""(?imx)
    \b(auto-?\s?generated|machine-(written|generated|made)|automatically\ (generated|created|produced))\b
    | @generated\b
    | \bcode\ generated\ by\b
    | \bgenerated\ (by|from|with|using|automatically)\b
    | \bdo\ not\ (edit|modify|change)\ (by\ hand|this\ file|manually)\b
    | \bcreated\ with\ \S+\ \(v?\d[\w.]*\)
    | \b(do\ not\ edit)\s*[.!*/-]*\s*$
    | \bproduced\ by\b.{0,60}\bregenerate\b
    | \bregenerate\ instead\ of\b
    | ^\W*\S+\ output,\ source:\ \S+
    | \bautomatisch\ (erzeugt|generiert|erstellt|gegenereerd|aangemaakt)\b | \bnicht\ (von\ hand|manuell)\ (bearbeiten|ändern)\b
    | \bfichier\ (produit|généré|créé)\b | \bgénéré\ (automatiquement|par)\b | \bne\ pas\ (modifier|éditer)\b
    | \bgenerado\ (automáticamente|por)\b | \bno\ (editar|modificar)\b | \bgerado\ (automaticamente|por)\b | \bnão\ (editar|edite|modificar)\b
    | \bgenerato\ (automaticamente|da)\b | \bnon\ modificare\b | \bniet\ (handmatig\ )?(bewerken|wijzigen)\b
    | \bautomatiskt\ genererad\b | \bautogenererad\b | \bwygenerowan[yo]\ automatycznie\b | \bnie\ edytować\b | \bсоздан\ автоматически\b | \bне\ редактировать\b
    | \b(manual\ edits|your\ changes)\b.{0,20}\b(overwritten|lost)\b
    """
)
# Notices of authors outside the repository.
UPSTREAM_NOTICE = re.compile(
    r"""(?imx)
    @license\ \S+\ v?\d
    | @preserve\b
    | \(c\)\ the\ \S+\ (authors|contributors|developers)\b
    | \bcopyright\ (\(c\)\ )?(\d{4}[-,\d\ ]*)?(by\ )?the\ \S+\ (authors|contributors|developers)\b
    | \bsee\ licen[cs]e\ in\ the\ upstream\b
    | \b(see\ its|in\ the)\ upstream\ archive\b
    | \bbundled\ copy\ of\ \S+\ v?\d
    | \bimported\ unchanged\b
    | \breleased\ under\ the\ .{1,40}\ licen[cs]e\b
    | ^\W*[\w.@/-]+\ v?\d+(\.\d+)+\ \|\ .{2,40}\ licen[cs]e\b
    """
)
# Directories that hold other people's code.
UPSTREAM_DIRECTORY = r"(?i)(^|/)(vendor|vendored|third[_-]?party|3rdparty|node_modules|bower_components|extern|externals?|contrib|bundled|deps|libraries)/"
# Names that only tools write.
TOOL_NAME = (
    r"(?i)(^|/)(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|poetry\.lock|cargo\.lock|pipfile\.lock|composer\.lock|gemfile\.lock|go\.sum)$"
    r"|[.-]lock\.(json|ya?ml|toml)$|\.lock$|\.map$|_pb2(_grpc)?\.pyi?$|\.pb\.go$|(^|/)migrations/\d{4}_auto_\d+(_\d+)?\.py$|(^|/)(parsetab|lextab)\.py$"
)

#: Per language: longest line, mean line, and the white-space share below which long lines mean minified code.
MINIFIED = {"js": (200, 70, 0.10), "css": (200, 70, 0.08), "json": (2000, 400, 0.03), "default": (400, 120, 0.10)}
#: Per language: share of characters in numeric literals, in encoded runs, and of letters and digits, that makes a file data.
DATA = {
    "js": (0.30, 0.65, 0.90), "py": (0.30, 0.65, 0.90), "go": (0.30, 0.65, 0.90), "sql": (0.30, 0.65, 0.90), "json": (0.55, 0.65, 0.93), "css": (0.45, 0.65, 0.93), "default": (0.45, 0.65, 0.93),
}
#: White space below which, and encoded runs from which, a text of letters and digits means encoded data.
ENCODED_BLANKS, ENCODED_RUNS = 0.06, 0.3
#: Languages that are prose or settings, where long lines and values are written by hand.
PROSE = {"md", "rst", "txt", "env", "local", "example"}
#: Data below this many characters is a hand-kept table.
DATA_CHARS = 700
#: Different signs in an encoded run at least; a filler of few letters is none.
RUN_SIGNS = 12
#: Rows of one statement or of literals alike that make a dump.
DUMP_ROWS = 20

_COMMENT = re.compile(r"\s*(#|//|/\*|\*|--|<!--|;|\"\"\")")
_NUMBER = re.compile(r"(?<![\w.#])(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?)(?![\w.])")
_RUN = re.compile(r"[A-Za-z0-9+/=]{48,}|(?:\\x[0-9a-fA-F]{2}){12,}")
_INSERT = re.compile(r"(?im)^\s*insert\s+into\s+\S+.{0,80}?values")
_PAIRS = re.compile(r"[\[{(,]\s*(?:\d+|'[^'\n]*'|\"[^\"\n]*\")\s*:\s*(?:\d[\d.]*|'[^'\n]*'|\"[^\"\n]*\")\s*(?=[,}])")
_COMPILED = re.compile(r"Object\.defineProperty\(exports,\s*['\"]__esModule['\"]|__webpack_require__|//# sourceMappingURL=|\bexports\.\w+ = void 0;")
_DESCRIPTOR = re.compile(r"(?m)^\s*DESCRIPTOR = .*\\x[0-9a-f]{2}")
_QUOTED = re.compile(r"(?m)^\s*[\"'].*$")
_BLANKS = b" \t\r\n\x0b\x0c"
_DIGITS = b"0123456789"
_ALNUM = bytes(b for b in range(128) if chr(b).isalnum())
_WORD = re.compile(r"\w+")
_CLOSED = re.compile(r"^(?:/\*.*?\*/\s*)+")
_RULE = re.compile(r"([^\w\s]{8})[^\w\s]+([^\w\s])")
_GAP = re.compile(r"\s{9,}")

STATS = (
    "chars int, n_lines int, longest_line int, mean_line double, blank_share double, alnum_share double, number_share double, "
    "run_share double, code_longest int, packed_share double, n_inserts int, pair_share double, notice boolean, upstream boolean, tool_form boolean, copied_from string, copy_share double"
)
STAT_NAMES = [part.strip().split(" ")[0] for part in STATS.split(",")]


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def shingles(text: str) -> np.ndarray:
    """Hashes of the runs of ``WORDS`` words, in order; they hold within a process."""
    words = _WORD.findall(text)
    if len(words) < WORDS:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    n = len(words) - WORDS + 1
    out = hashed[:n] * _MIX[0]
    for k in range(1, WORDS):
        out ^= out >> np.uint64(29)
        out = (out + hashed[k : n + k]) * _MIX[k]
    return out


def words_of(text: str) -> int:
    """A hash of all words of a text in order."""
    return hash(tuple(_WORD.findall(text)))


class UpstreamIndex:
    """Known upstream files by their shingles; those too short for that by all their words."""

    def __init__(self, files: list[tuple[str, str]]):
        self.names = [name for name, _ in files]
        sets = [np.unique(shingles(content)) for _, content in files]
        self.sizes = np.array([len(x) for x in sets])
        self.known = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *sets]))
        self.held = np.array([np.isin(self.known, x) for x in sets]).reshape(len(sets), len(self.known))  # bounded by INDEX_BYTES
        self.seen = np.zeros(1 << 16, dtype=bool)
        self.seen[(self.known >> np.uint64(48)).astype(np.int64)] = True
        self.short = {words_of(content): name for name, content in files if _WORD.search(content)}

    def copy_of(self, text: str) -> tuple[str | None, float]:
        """The upstream file that ``text`` is a copy of, and the larger share of shingles in common."""
        own = shingles(text)
        if len(own) < COPY_SHINGLES:
            name = self.short.get(words_of(text))
            return (name, 1.0) if name is not None else (None, 0.0)
        hits = own[self.seen[(own >> np.uint64(48)).astype(np.int64)]]
        if len(hits) < COPY_SHARE * COPY_SHINGLES:
            return None, 0.0
        common = np.isin(self.known, hits)
        if np.count_nonzero(common) < COPY_SHARE * COPY_SHINGLES:  # too few for any file of the index
            return None, 0.0
        n_own = len(np.unique(own))
        shares = self.held[:, common].sum(axis=1) / np.maximum(1, np.minimum(n_own, self.sizes))
        shares[np.minimum(n_own, self.sizes) < COPY_SHINGLES] = 0.0
        best = int(np.argmax(shares))
        return (self.names[best], float(shares[best])) if shares[best] > 0 else (None, 0.0)


def _comment_text(lines: Iterable[str], forward: bool) -> str:
    """The lines up to the first that is code, as one text; lines within a block comment are none, with or without a star.

    Lines without a word are left out, and long rules and gaps cut short, so that patterns take linear time over comments of any length.
    """
    kept, inside, lines, mark = [], False, list(lines), "*/" if forward else "/*"
    last = max((at for at, line in enumerate(lines) if mark in line), default=-1)
    for at, line in enumerate(lines):
        told, code_follows = line.strip(), False
        if inside:
            if mark in told:
                inside, code_follows = False, not (told.endswith("*/") if forward else told.startswith("/*"))
                told = (told[: told.index("*/")] if forward else told[told.rindex("/*") :]) if code_follows else told
        elif told:
            block = told.startswith("/*") and "*/" not in told if forward else told.endswith("*/") and "/*" not in told
            inside = block and at < last
            rest = _CLOSED.sub("", told)
            code_follows = rest != told and rest != "" and not _COMMENT.match(rest)
            if not inside and not _COMMENT.match(line) or code_follows and not forward:
                break
            told = told[: len(told) - len(rest)] if code_follows else told
        if _WORD.search(told):
            kept.append(_GAP.sub(" " * 8, _RULE.sub(r"\1\2", told)))
        if code_follows:
            break
    return "\n".join(kept)


def closing_comment(text: str) -> str:
    """The comment lines a file ends with, from the last, as one text."""
    return _comment_text(reversed(text.rstrip().split("\n")), False)


def leading_comment(text: str) -> str:
    """The comment lines a file begins with, as one text; an opening shebang and blank lines belong to it."""
    return _comment_text(text.split("\n"), True)


def layout(text: str | None, index: UpstreamIndex) -> tuple:
    """The statistics of one content, in the order of ``STATS``."""
    if not text:
        return (0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 0.0, 0, 0.0, False, False, False, None, 0.0)
    lines = text.split("\n")
    stripped = [line.strip() for line in lines]
    n = len(text)
    raw = text.encode("ascii", "replace")
    blank = n - len(raw.translate(None, _BLANKS))
    digits = n - len(raw.translate(None, _DIGITS))
    alnum = n - len(raw.translate(None, _ALNUM))
    longest = max(map(len, lines))
    # a long line counts as code only if it is neither comment nor one long word or literal
    code_longest = packed = 0
    if longest > 150:
        for line in lines:
            if len(line) > 150 and not _COMMENT.match(line) and sum(map(line.count, "{}();,=")) > len(line) / 25:
                code_longest = max(code_longest, len(line))
    for line in stripped:  # lines that pack several statements without blanks around operators
        if len(line) > 30 and line.count(" ") * 14 < len(line) and sum(map(line.count, ";{}(),")) * 9 > len(line):
            packed += len(line)
    numbers = sum(map(len, _NUMBER.findall(text))) if digits * 8 > n else 0
    runs = sum(len(r) for r in _RUN.findall(text) if r[0] == "\\" or len(set(r)) >= RUN_SIGNS) if n > 400 else 0
    inserts = len(_INSERT.findall(text)) if "insert" in text.lower() else 0
    pairs = sum(map(len, _PAIRS.findall(text))) if ":" in text and digits * 20 > n and longest > 400 else 0
    head = leading_comment(text)
    copied, share = index.copy_of(text)
    return (
        n,
        len(lines),
        longest,
        n / len(lines),
        blank / n,
        alnum / n,
        numbers / n,
        runs / n,
        code_longest,
        packed / n,
        inserts,
        pairs / n,
        bool(GENERATED_NOTICE.search(_QUOTED.sub("", head)) or GENERATED_NOTICE.search(_QUOTED.sub("", closing_comment(text)))),
        bool(UPSTREAM_NOTICE.search(head)),
        bool(_COMPILED.search(text) or _DESCRIPTOR.search(text)),
        copied,
        share,
    )


def layout_stats(content: Column, index: list[tuple[str, str]]) -> Column:
    """A struct of the layout statistics of a content column."""

    @F.pandas_udf(STATS)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = UpstreamIndex(index)
        for contents in batches:
            yield pd.DataFrame([layout(text, known) for text in contents], columns=STAT_NAMES)

    return measure(content)


def upstream_files(vendor_index: DataFrame) -> list[tuple[str, str]] | None:
    """The index of known upstream files for the function; None if it is too large to go with it."""
    held = vendor_index.where(F.col("content").isNotNull())
    size = held.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    if size > INDEX_BYTES:
        return None
    rows = held.select(_upstream_name().alias("name"), "content").collect()  # bounded by the check above
    return sorted((r["name"], r["content"]) for r in rows)


def _upstream_name() -> Column:
    return F.trim(F.concat_ws(" ", F.coalesce("package", F.lit("")), F.coalesce("version", F.lit(""))))


def _shingle_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, shingle): the different shingles of each content as hashes, and their number; a short content has one, of all its words."""
    words = F.regexp_extract_all("content", F.lit(r"(?U)\w+"), 0)
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - (WORDS - 1)), lambda i: F.xxhash64(F.slice("words", i, F.lit(WORDS))))
    whole = F.array(F.xxhash64(F.lit("whole"), "words"))
    found = rows.select(*keys, words.alias("words")).where(F.size("words") > 0)
    short = F.size("words") < COPY_SHINGLES + WORDS - 1
    found = found.select(*keys, F.when(short, whole).otherwise(F.array_distinct(runs)).alias("all"), F.when(short, whole).otherwise(F.array_append(F.array_distinct(runs), whole[0])).alias("with_whole"))
    return found.select(*keys, F.size("all").alias("n"), F.col("with_whole").alias("all"))


def copies_by_join(files: DataFrame, vendor_index: DataFrame) -> DataFrame:
    """(file_id, copied_from, copy_share) of files that share shingles with an index of any size, by an equi-join.

    Index files that hold the same shingles are one group per shingle, so a notice that thousands of them share makes one row and not thousands;
    counts are taken per file and group before the groups are opened.
    """
    index = _shingle_rows(vendor_index.where(F.col("content").isNotNull()).select(_upstream_name().alias("name"), "content"), "name")
    sizes = index.groupBy("name").agg(F.max("n").alias("n_theirs"))
    holders = index.select("name", F.explode("all").alias("shingle")).groupBy("shingle").agg(F.sort_array(F.collect_set("name")).alias("names"))
    own = _shingle_rows(files.where(F.col("content").isNotNull()).select("file_id", "content"), "file_id").dropDuplicates(["file_id"])
    met = own.select("file_id", "n", F.explode("all").alias("shingle")).join(holders, "shingle")
    grouped = met.groupBy("file_id", "n", "names").agg(F.count(F.lit(1)).alias("common"))
    counted = grouped.select("file_id", "n", "common", F.explode("names").alias("name")).groupBy("file_id", "n", "name").agg(F.sum("common").alias("common"))
    least = F.least("n", "n_theirs")
    share = F.when((least >= COPY_SHINGLES) | (F.col("n") == F.col("n_theirs")), F.least(F.lit(1.0), F.col("common") / least)).otherwise(0.0)
    shares = counted.join(sizes, "name").withColumn("share", share).where("share > 0")
    best = shares.groupBy("file_id").agg(F.max(F.struct("share", "name")).alias("best"))
    return best.select("file_id", F.col("best.name").alias("copied_from"), F.col("best.share").alias("copy_share"))


def _by_language(table: dict, position: int, language: Column) -> Column:
    value = F.lit(table["default"][position])
    for name, values in table.items():
        if name != "default":
            value = F.when(language == name, F.lit(values[position])).otherwise(value)
    return value


def classify(files: DataFrame, vendor_index: DataFrame) -> DataFrame:
    """``files`` (file_id, repo, rel_path) with its layout statistics, ``origin`` (generated, minified, vendored, data or written), ``reasons`` and the first of them as ``reason``."""
    path = F.regexp_replace(F.coalesce("rel_path", F.lit("")), r"\\", "/")
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    language = F.when(ext.isin("js", "mjs", "cjs", "ts", "tsx", "jsx"), "js").otherwise(ext)
    prose = language.isin(*sorted(PROSE))
    index = upstream_files(vendor_index)
    stats = layout_stats(F.col("content"), index or [])
    s = files.select("file_id", "repo", "rel_path", path.alias("_path"), language.alias("_language"), stats.alias("stat"))
    if index is None:
        s = s.join(copies_by_join(files, vendor_index), "file_id", "left")
        s = s.withColumn("stat", F.col("stat").withField("copied_from", F.col("copied_from")).withField("copy_share", F.coalesce("copy_share", F.lit(0.0))))
    stat = lambda name: F.col(f"stat.{name}")
    lang = F.col("_language")
    minified = (
        (stat("code_longest") >= _by_language(MINIFIED, 0, lang))
        & (stat("mean_line") >= _by_language(MINIFIED, 1, lang))
        & (stat("blank_share") <= _by_language(MINIFIED, 2, lang))
    ) | ((stat("packed_share") > 0.5) & (stat("blank_share") <= 0.10) & lang.isin("js", "css"))
    named_min = F.col("_path").rlike(r"(?i)[.-]min\.(js|css|mjs)$")
    numeric = stat("number_share") >= _by_language(DATA, 0, lang)
    encoded = (stat("run_share") >= _by_language(DATA, 1, lang)) | ((stat("alnum_share") >= _by_language(DATA, 2, lang)) & (stat("run_share") >= ENCODED_RUNS) & (stat("blank_share") < ENCODED_BLANKS))
    dump = (stat("n_inserts") >= DUMP_ROWS) & (stat("n_inserts") >= 0.6 * stat("n_lines"))
    table = (stat("pair_share") >= 0.6) & (stat("longest_line") > 1000)
    data = ((stat("chars") >= DATA_CHARS) & (numeric | encoded | table)) | dump
    tool_name = F.col("_path").rlike(TOOL_NAME) & ~prose
    upstream = F.col("_path").rlike(UPSTREAM_DIRECTORY)
    # (reason, origin, condition): layout first, then comparison, then what files say of themselves and what they are called
    rules = [
        ("layout", "minified", ~prose & minified),
        ("layout", "data", ~prose & data),
        ("copy", "vendored", stat("copy_share") >= COPY_SHARE),
        ("form", "generated", stat("tool_form") & ~prose),
        ("notice", "vendored", stat("upstream")),
        ("notice", "generated", stat("notice") & ~prose),
        ("name", "generated", tool_name),
        ("name", "vendored", upstream),
        ("name", "minified", ~prose & named_min),
    ]
    reasons = F.array_distinct(F.array_compact(F.array(*[F.when(holds, F.lit(reason)) for reason, _, holds in rules])))
    # whose file it is stands before how it looks, and what made it before both
    order = ["name generated", "copy vendored", "notice vendored", "name vendored", "notice generated", "form generated", "layout minified", "name minified", "layout data"]
    holds_of = {f"{reason} {origin}": (origin, holds) for reason, origin, holds in rules}
    origin = F.coalesce(*[F.when(holds_of[key][1], F.lit(holds_of[key][0])) for key in order], F.lit("written"))
    return s.select("file_id", "repo", "rel_path", "stat", origin.alias("origin"), reasons.alias("reasons")).withColumn("reason", F.get("reasons", F.lit(0)))


def origin_rates(classified: DataFrame) -> DataFrame:
    """Files per repository, origin and reason."""
    return classified.groupBy("repo", "origin", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("stat.chars").alias("n_chars"))
