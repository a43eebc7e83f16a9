"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

Method: prefix dynamic programming. Every byte prefix of a pre-token has one valid encoding, so one last token
describes it: ``last[i]`` is the token ending at byte ``i`` such that the encoding of the prefix before it may be
followed by it. Appending bytes extends the table and never changes what it holds, which makes appends exact;
an edit re-encodes from the pre-tokens beside it up to the first boundary both texts share.

Two tokens may stand side by side if undoing their merges, latest first, never meets a pair that BPE would
have merged across the border earlier.

Defined results: a null or empty text has an empty list; the strings of special tokens are ordinary text;
lone surrogates cannot occur in Spark strings; texts of any length are encoded whole; repeated texts get equal lists.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark import SparkContext, SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: White space by the Unicode property; Python's own class also holds the four information separators.
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The published pre-token pattern of the vocabulary.
PRE_TOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
#: Pre-tokens remembered by a worker before it starts again.
CACHE_ENTRIES = 200_000
#: Longer pre-tokens are encoded without being remembered.
CACHE_LENGTH = 64


class Bpe:
    """A byte-level BPE given as ranks; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int]] = {}
        self._beside: dict[tuple[int, int], bool] = {}
        self._cache: dict[str, list[int]] = {}

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge gave this one; a single byte is (itself, itself)."""
        known = self._halves.get(token)
        if known is None:
            text = self.bytes_of[token]
            if len(text) == 1:
                known = (token, token)
            else:  # the merge is the one cut whose sides are tokens that may stand together below this rank
                known = self._merge_of(text, token)
            self._halves[token] = known
        return known

    def _merge_of(self, text: bytes, token: int) -> tuple[int, int]:
        parts = [self.ranks[text[i : i + 1]] for i in range(len(text))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(self.bytes_of[parts[i]] + self.bytes_of[parts[i + 1]], 1 << 60))
            merged = self.ranks.get(self.bytes_of[parts[best]] + self.bytes_of[parts[best + 1]], 1 << 60)
            if merged >= token:
                raise ValueError(f"token {token} cannot be reached by merges")
            parts[best : best + 2] = [merged]
        return parts[0], parts[1]

    def beside(self, left: int, right: int) -> bool:
        """Whether an encoding may hold ``left`` followed by ``right``."""
        key = (left, right)
        known = self._beside.get(key)
        if known is None:
            if len(self._beside) > 4 * CACHE_ENTRIES:
                self._beside.clear()
            known = self._beside[key] = self._may_stand(left, right)
        return known

    def _may_stand(self, left: int, right: int) -> bool:
        below = 1 << 60  # the merge across the border counts only if it came before the merges already undone
        while True:
            merged = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if merged is not None and merged < below:
                return False
            # undo the later merge of the two; equal ranks are taken from the right, where the left-most pair merges first
            for side in ("left", "right") if left > right else ("right", "left"):
                if side == "left":
                    first, second = self.halves(left)
                    if first == left:
                        continue
                    below, left = left, second
                else:
                    first, _ = self.halves(right)
                    if first == right:
                        continue
                    below, right = right + 1, first
                break
            else:
                return True

    def extend(self, text: bytes, last: list[int]) -> list[int]:
        """Fill ``last`` (its entry i belongs to the prefix of i + 1 bytes) up to the whole text, keeping what it holds."""
        ranks, beside, longest = self.ranks, self.beside, self.longest
        for end in range(len(last) + 1, len(text) + 1):
            for start in range(max(0, end - longest), end):
                token = ranks.get(text[start:end])
                if token is not None and (start == 0 or beside(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")
        return last

    def read_back(self, last: list[int]) -> list[int]:
        """The token ids of the whole text a table describes."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        out.reverse()
        return out

    def encode_piece(self, piece: str) -> list[int]:
        ids = self._cache.get(piece)
        if ids is None:
            data = piece.encode("utf-8")
            token = self.ranks.get(data)
            ids = [token] if token is not None else self.read_back(self.extend(data, []))
            if len(piece) <= CACHE_LENGTH:
                if len(self._cache) >= CACHE_ENTRIES:
                    self._cache.clear()
                self._cache[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; empty for an empty or null text."""
        ids: list[int] = []
        for piece in PRE_TOKEN.findall(text or ""):
            ids += self.encode_piece(piece)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", errors="replace")


class EncodedText:
    """A text with its prefix tables, for exact appends and re-encoding near edits."""

    def __init__(self, bpe: Bpe, text: str = ""):
        self.bpe, self.text = bpe, text
        self.starts: list[int] = []
        self.tables: list[list[int]] = []
        self.reused = 0  # bytes whose table entries the last change kept
        for m in PRE_TOKEN.finditer(text):
            self.starts.append(m.start())
            self.tables.append(bpe.extend(m[0].encode(), []))

    @property
    def ids(self) -> list[int]:
        return [i for table in self.tables for i in self.bpe.read_back(table)]

    def _restart(self, at: int) -> int:
        """Index of a pre-token before ``at`` whose start no change at ``at`` can move: three back, and not inside white space."""
        keep = len(self.starts)
        while keep and self.starts[keep - 1] >= at:
            keep -= 1
        keep = max(0, keep - 3)
        while keep and self.text[self.starts[keep]].isspace():
            keep -= 1
        return keep

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Replace the characters [start, end) and re-encode only what the change can reach."""
        keep = self._restart(start)
        begin = self.starts[keep] if keep < len(self.starts) else len(self.text)
        if keep == 0:
            begin = 0
        shift = len(new) - (end - start)
        text = self.text[:start] + new + self.text[end:]
        old = {s + shift: i for i, s in enumerate(self.starts) if s >= end}
        starts, tables, self.reused = self.starts[:keep], self.tables[:keep], 0
        for m in PRE_TOKEN.finditer(text, begin):
            i = old.get(m.start())
            if i is not None and m.start() >= start + len(new):  # from a shared boundary on both texts are equal
                starts += [s + shift for s in self.starts[i:]]
                tables += self.tables[i:]
                break
            piece, table = m[0].encode(), []
            if len(starts) < len(self.starts) and self.starts[len(starts)] == m.start():  # same place: the common prefix keeps its entries
                before = self.bpe
                known = self.tables[len(starts)]
                was = b"".join(before.bytes_of[t] for t in before.read_back(known))
                same = next((k for k, (x, y) in enumerate(zip(was, piece)) if x != y), min(len(was), len(piece)))
                table = known[:same]
                self.reused += same
            starts.append(m.start())
            tables.append(self.bpe.extend(piece, table))
        self.text, self.starts, self.tables = text, starts, tables


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    """The vocabulary of a worker process, read once: the file sent along with the job, or the one at ``path``."""
    sent = SparkFiles.get(os.path.basename(path))
    return Bpe.load(sent if os.path.exists(sent) else path)


def ship(path: str) -> None:
    """Send a vocabulary to all workers, once a session, so that it need not lie on their machines."""
    context = SparkContext._active_spark_context
    if context is not None and os.path.basename(path) not in {os.path.basename(known) for known in context.listFiles}:
        context.addFile(path)


def token_ids(text: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """Ids of a text column."""
    ship(path)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = vocabulary(path)
        for texts in batches:
            yield pd.Series([bpe.encode(t) for t in texts], dtype=object)

    return encode(text)


def token_count(text: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """Number of ids of a text column, without shipping them."""
    ship(path)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = vocabulary(path)
        for texts in batches:
            yield pd.Series([len(bpe.encode(t)) for t in texts], dtype="int32")

    return count(text)


def decoded(ids: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """The text of a column of ids; null where it is null."""
    ship(path)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = vocabulary(path)
        for rows in batches:
            yield pd.Series([None if row is None else bpe.decode(row) for row in rows], dtype=object)

    return decode(ids)


def encode_corpus(documents: DataFrame, path: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row; the id column is passed through as it is, also null or repeated."""
    return documents.select(id_col, token_ids(F.col(text_col), path).alias("ids"))
