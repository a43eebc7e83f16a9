"""Cutting oversized items at natural boundaries (problem 3).

Method: dynamic programming over boundary positions. A cut costs the penalty of its boundary (symbol, paragraph,
line, blank, character) and a piece costs the squared difference of its length from the ideal one; the
cheapest chain of cuts is taken in which no piece exceeds the limit and each piece begins the overlap before the end of the last.

Boundaries of lines, paragraphs and symbols are all offered; blanks and characters only between lines that lie too far apart, characters at every
``1 / GRID`` of the room a piece has. Against the same search over every character the cost is at most 1 % higher (measured in the tests).

Sizes are UTF-8 bytes. Where the overlap would begin inside a character the piece begins at that character, so the shared
part is at most 3 bytes longer than asked; where that leaves no room to go on, it begins behind the character and shares up to 3 bytes less.

Defined results: items within the limit, null and empty ones give no pieces; repeated rows of one ``result_id`` are one item, and each row
without an id is an item of its own; a null or unlisted kind takes the limits of 'other'; symbols with null, swapped or shifted lines are used as
far as a line of that number exists; a null or negative overlap is none; every overlap below the limit is kept, one of the limit or more is an error, as is a
limit below 4 bytes; content without any boundary is cut between characters; where the limit exceeds the overlap by less than the characters there are
wide, the overlap is shorter by the bytes missing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Penalties of a cut, by the boundary it falls on.
SYMBOL, PARAGRAPH, LINE, BLANK, CHARACTER = 0.0, 0.15, 0.5, 4.0, 12.0
NAMES = {SYMBOL: "symbol", PARAGRAPH: "paragraph", LINE: "line", BLANK: "blank", CHARACTER: "character"}
#: Parts of the room of a piece at which characters are offered as cuts.
GRID = 64
#: Limits that travel as a literal table at most; more of them are joined.
LIMIT_ROWS = 1000
PIECES = "result_id long, piece_no int, n_pieces int, start_byte int, end_byte int, boundary string, piece string"

_NEWLINE = re.compile(rb"\r\n|\n|\r")
_BLANK = re.compile(rb"[ \t]+")


def boundaries(data: bytes, symbol_lines: set[int], reach: int, grid: int = GRID) -> tuple[np.ndarray, np.ndarray]:
    """Positions where ``data`` may be cut, ascending, with their penalties; never more than ``reach`` bytes apart.

    Blanks and characters are offered only where lines alone lie too far apart.
    """
    ends = [m.end() for m in _NEWLINE.finditer(data)]
    places: dict[int, float] = {}
    begin = 0
    was_empty = False
    for number, end in enumerate([*ends, len(data)], start=1):  # lines count from 1
        empty = not data[begin:end].strip()
        if 0 < begin < len(data):
            if number in symbol_lines:
                places[begin] = SYMBOL
            elif was_empty and not empty:
                places[begin] = PARAGRAPH
            else:
                places[begin] = LINE
        begin, was_empty = end, empty
    step = max(1, reach // grid)
    known = [0, *sorted(places), len(data)]
    for a, b in zip(known, known[1:]):
        if b - a <= max(1, reach // 4):
            continue
        inner = [a, *(m.end() for m in _BLANK.finditer(data, a, b) if a < m.end() < b), b]
        places.update((p, BLANK) for p in inner[1:-1])
        for c, d in zip(inner, inner[1:]):
            for p in range(c + step, d, step):
                p = character_start(data, p)
                if p > c:
                    places.setdefault(p, CHARACTER)
    places.pop(0, None)
    at = np.array(sorted(places), dtype=np.int64)
    return at, np.array([places[p] for p in at.tolist()], dtype=np.float64)


def character_start(data: bytes, at: int) -> int:
    """The start of the character that byte ``at`` belongs to."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def character_end(data: bytes, at: int) -> int:
    """``at``, or the end of the character that has begun before it."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def cut(data: bytes, limit: int, overlap: int, symbol_lines: set[int] = frozenset(), grid: int = GRID) -> list[tuple[int, int, float]]:
    """(start, end, penalty of the end) of the pieces of ``data``; the last piece ends at no boundary and costs 0."""
    n = len(data)
    overlap = max(0, overlap or 0)
    if limit < 4 or overlap >= limit:
        raise ValueError(f"no pieces of {limit} bytes with {overlap} of them shared")
    if n <= limit:
        return [(0, n, SYMBOL)]
    reach = limit - overlap - 4  # a piece advances by this much at least where every byte may be cut
    at, penalty = boundaries(data, symbol_lines, max(4, reach), grid)
    for shorter in (0, None, 4):  # begin before a cut character, behind it, or with as much less shared as a character takes
        pieces = _cheapest(data, at, penalty, limit, overlap if shorter is None else min(overlap, limit - shorter), shorter is None)
        if pieces:
            return pieces
    if grid < reach:  # lines that only just fit leave no way on at this grid
        return cut(data, limit, overlap, symbol_lines, reach)
    raise ValueError("no chain of cuts")  # cannot be: with 4 bytes to go on every character fits


def _cheapest(data: bytes, at: np.ndarray, penalty: np.ndarray, limit: int, overlap: int, behind: bool) -> list[tuple[int, int, float]] | None:
    """The cheapest chain of pieces over the cuts ``at``; none if some gap is too wide."""
    n = len(data)
    end = np.append(at, n)
    cost_of = np.append(penalty, 0.0)
    first_of = character_end if behind else character_start
    begin = np.array([0, *(first_of(data, max(0, p - overlap)) for p in at.tolist())], dtype=np.int64)  # begin[k + 1] follows a cut at end[k]
    pieces = max(2, -(-(n - overlap) // max(1, limit - overlap)))
    ideal = (n + (pieces - 1) * overlap) / pieces
    best = np.full(len(end) + 1, np.inf)
    best[0] = 0.0
    back = np.zeros(len(end) + 1, dtype=np.int64)
    low = 0
    for k, e in enumerate(end.tolist()):
        while low <= k and e - begin[low] > limit:
            low += 1
        if low > k:
            return None
        # a piece from begin[j] to e; it must bring something new: the cut before it lies below e by construction
        length = e - begin[low : k + 1]
        total = best[low : k + 1] + ((length - ideal) / ideal) ** 2
        j = int(np.argmin(total))
        best[k + 1], back[k + 1] = total[j] + cost_of[k] + 0.05, low + j
    if not np.isfinite(best[-1]):
        return None
    out, k = [], len(end)
    while k:
        j = int(back[k])
        out.append((int(begin[j]), int(end[k - 1]), float(cost_of[k - 1])))
        k = j
    return out[::-1]


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for row in rows.itertuples():
            data = row.content.encode("utf-8")
            lines = {int(x) for x in row.lines} if row.lines is not None else set()
            pieces = cut(data, int(row.max_size), int(row.overlap_size or 0), lines)
            for number, (start, end, penalty) in enumerate(pieces, start=1):
                boundary = "end" if number == len(pieces) else NAMES[penalty]
                out.append((row.result_id, number, len(pieces), start, end, boundary, data[start:end].decode("utf-8")))
        yield pd.DataFrame(out, columns=["result_id", "piece_no", "n_pieces", "start_byte", "end_byte", "boundary", "piece"])


def limits_for(limits: DataFrame, use_case: str) -> DataFrame:
    """(kind_key, max_size, overlap_size) of a use case, one row a kind."""
    rows = limits.where((F.lower(F.trim("use_case")) == use_case) & F.col("max_size").isNotNull())
    kind = F.lower(F.regexp_replace(F.coalesce("kind", F.lit("")), r"^\s+|\s+$", ""))
    return rows.groupBy(kind.alias("kind_key")).agg(F.min(F.struct("max_size", "overlap_size")).alias("size"))


def with_limit(items: DataFrame, limits: DataFrame) -> DataFrame:
    """``items`` with the limit of their kind; unlisted and null kinds take the row 'other'.

    A table of at most ``LIMIT_ROWS`` kinds is a literal map; a longer one is joined, and the planner weighs its size.
    """
    known = limits_for(limits, "split")
    rows = known.limit(LIMIT_ROWS + 1).collect()
    keyed = items.withColumn("kind_key", F.lower(F.regexp_replace("kind", r"^\s+|\s+$", "")))
    none = F.lit(None).cast("struct<max_size:int,overlap_size:int>")
    if len(rows) > LIMIT_ROWS:
        other = known.where("kind_key = 'other'").first()
        rest = F.struct(F.lit(other["size"]["max_size"]).alias("max_size"), F.lit(other["size"]["overlap_size"]).alias("overlap_size")) if other else none
        sized = keyed.join(known, "kind_key", "left").withColumn("size", F.coalesce("size", rest))
    elif rows:
        pairs = [x for r in rows for x in (F.lit(r["kind_key"]), F.struct(F.lit(r["size"]["max_size"]).alias("max_size"), F.lit(r["size"]["overlap_size"]).alias("overlap_size")))]
        table = F.create_map(*pairs)
        sized = keyed.withColumn("size", F.coalesce(table[F.col("kind_key")], table[F.lit("other")], none))
    else:
        sized = keyed.withColumn("size", none)
    return sized.select("result_id", "file_id", "kind_key", "content", F.coalesce("size.overlap_size", F.lit(0)).alias("overlap_size"), F.col("size.max_size").alias("max_size"))


def split_oversized(items: DataFrame, limits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Numbered pieces of every item above the limit of its kind.

    Sizes are compared before anything is shuffled, so only oversized content moves; symbol lines are gathered per
    file for the files of those items alone. Lines of a whole file and of its first lines are lines of the content as well;
    a rendered summary has none.
    """
    slim = items.select("result_id", "file_id", "kind", "content").where(F.col("content").isNotNull())
    large = with_limit(slim, limits).where(F.octet_length("content") > F.col("max_size"))
    large = large.withColumn("unnamed", F.when(F.col("result_id").isNull(), F.monotonically_increasing_id())).dropDuplicates(["result_id", "unnamed"])
    wanted = symbols.where(F.col("file_id").isNotNull()).select("file_id", F.explode(F.array("start_line", F.col("end_line") + 1)).alias("line"))
    wanted = wanted.where(F.col("line") > 1).join(large.select("file_id").distinct(), "file_id", "left_semi")
    lines = wanted.groupBy("file_id").agg(F.collect_set("line").alias("lines"))
    ready = large.join(lines, "file_id", "left").withColumn("lines", F.when(F.col("kind_key") != "summary", F.col("lines")))
    return ready.select("result_id", "content", "lines", "max_size", "overlap_size").mapInPandas(_split, PIECES)
