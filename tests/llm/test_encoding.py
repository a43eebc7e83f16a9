"""Encoding, packing and splitting."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from packlake.llm import bpe, packing, splitting

VOCABULARY = bpe.DEFAULT_VOCABULARY
needs_vocabulary = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary")
SIGNS = "abc  \n\t'sreltd1٣é漢🚀\x1c\x1f\x85\u00a0 .,!<|endoftext|>"


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe.load(VOCABULARY)


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    made.encode_special_tokens = True
    return made


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randrange(60))) for _ in range(n)]


@needs_vocabulary
def test_ids_equal_the_public_library(coder, public):
    held = [*texts(3000, 1), "", "a" * 5000, " " * 3000, "ab" * 3000, "é" * 2000, "\r\n\r\n", "don't we'll"]
    for text, want in zip(held, public.encode_batch(held, add_special_tokens=False)):
        assert coder.encode(text) == want.ids
        assert coder.decode(want.ids) == text


@needs_vocabulary
def test_appends_and_edits_equal_encoding_anew(coder):
    rng = random.Random(2)
    for text in texts(400, 3):
        held = bpe.EncodedText(coder, text)
        for _ in range(3):
            start = rng.randrange(len(held.text) + 1)
            end = min(len(held.text), start + rng.randrange(5))
            new = "".join(rng.choice(SIGNS) for _ in range(rng.randrange(6)))
            held.append(new) if rng.random() < 0.3 else held.replace(start, end, new)
            assert held.ids == coder.encode(held.text)


@needs_vocabulary
def test_an_append_keeps_the_table(coder):
    held = bpe.EncodedText(coder, "word " * 50 + "a" * 400)
    held.append("a")
    assert held.reused >= 400 and held.ids == coder.encode(held.text)


@needs_vocabulary
def test_corpus(spark):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (None, "a", "x")]
    out = bpe.encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids string"))
    assert sorted((tuple(r["ids"]) for r in out.collect())) == [(), (), (), (64,), (31373, 995)]
    assert bpe.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packing_is_valid_and_tight():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 200) for _ in range(5000)]
    where = packing.pack(sizes, 500)
    used: dict[int, int] = {}
    for size, container in zip(sizes, where):
        used[container] = used.get(container, 0) + size
    assert max(used.values()) <= 500
    assert sum(sizes) / (len(used) * 500) > 0.97
    assert packing.pack([500, 500], 500) == [0, 1] and packing.pack([], 5) == []


def test_least_sum_of_squares_is_chosen():
    levels = packing.LevelArray(10)
    rng = random.Random(6)
    for _ in range(300):
        size = rng.randrange(1, 10)
        before = levels.count.copy()
        levels.place(size)

        def squares(level, size=size, before=before):
            after = before.copy()
            if level:
                after[level] -= 1
            if level + size < 10:
                after[level + size] += 1
            return int((after[1:10] ** 2).sum())

        best = min(squares(h) for h in range(10 - size + 1) if h == 0 or before[h])
        assert int((levels.count[1:10] ** 2).sum()) == best


def test_containers(spark):
    rows = [(1, 5), (2, 10), (3, 23), (4, 0), (5, 7), (6, 3), (6, 3)]
    placed = packing.fill_containers(spark.createDataFrame(rows, "doc_id long, n_tokens int"), 10, 2)
    got = placed.collect()
    assert sorted((r["doc_id"], r["part_no"], r["start_token"], r["n_tokens"]) for r in got) == [(1, 0, 0, 5), (2, 0, 0, 10), (3, 0, 0, 10), (3, 1, 10, 10), (3, 2, 20, 3), (4, 0, 0, 0), (5, 0, 0, 7), (6, 0, 0, 3), (6, 0, 0, 3)]
    assert [r["container_id"] for r in got if r["doc_id"] == 4] == [None]
    assert packing.container_fill(placed, 10).where("used > 10").count() == 0
    with pytest.raises(ValueError, match="capacity"):
        packing.fill_containers(spark.createDataFrame(rows, "doc_id long, n_tokens int"), 0, 2)


def brute_cost(data, limit, overlap, symbol_lines):
    """The least cost over all chains of boundaries, by plain recursion over positions."""
    at, penalty = splitting.boundaries(data, symbol_lines, max(4, limit - overlap - 4))
    n = len(data)
    ends, costs = [*at.tolist(), n], [*penalty.tolist(), 0.0]
    pieces = max(2, -(-(n - overlap) // max(1, limit - overlap)))
    ideal = (n + (pieces - 1) * overlap) / pieces
    best = {}
    for k, e in enumerate(ends):
        options = []
        for j in range(-1, k):
            start = 0 if j < 0 else splitting.character_start(data, max(0, ends[j] - overlap))
            if e - start <= limit and (j < 0 or j in best):
                options.append((0.0 if j < 0 else best[j]) + ((e - start - ideal) / ideal) ** 2)
        if options:
            best[k] = min(options) + costs[k] + 0.05
    return best[len(ends) - 1]


def cost_of(data, pieces, limit, overlap):
    count = max(2, -(-(len(data) - overlap) // max(1, limit - overlap)))
    ideal = (len(data) + (count - 1) * overlap) / count
    return sum(((e - s - ideal) / ideal) ** 2 + p + 0.05 for s, e, p in pieces)


def check_pieces(data, pieces, limit, overlap, slack=0):
    covered = 0
    for n, (start, end, _) in enumerate(pieces):
        assert start <= covered < end and end - start <= limit
        data[start:end].decode("utf-8")
        if n:
            assert overlap - slack <= covered - start <= overlap + 3
        covered = end
    assert covered == len(data)


def test_cuts_are_valid_and_least():
    rng = random.Random(8)
    for _ in range(60):
        lines = ["".join(rng.choice("abc é漢 ") for _ in range(rng.choice([0, 0, 5, 20, 90]))) for _ in range(rng.randrange(3, 25))]
        data = rng.choice(["\n", "\r\n"]).join(lines).encode()
        limit, overlap = rng.randrange(40, 200), rng.randrange(0, 30)
        symbols = {rng.randrange(1, 25) for _ in range(3)}
        pieces = splitting.cut(data, limit, overlap, symbols)
        if len(data) <= limit:
            assert len(pieces) == 1
            continue
        check_pieces(data, pieces, limit, overlap)
        assert cost_of(data, pieces, limit, overlap) == pytest.approx(brute_cost(data, limit, overlap, symbols))


def test_cuts_without_boundaries():
    for data in (b"x" * 5000, ("漢" * 3000).encode(), b"\n" * 3000, b" " * 999):
        pieces = splitting.cut(data, 256, 32)
        check_pieces(data, pieces, 256, 32)


def test_every_overlap_below_the_limit_is_kept():
    for data in (b"word and more words\n" * 60, b"x" * 700, ("\u6f22" * 300).encode(), ("\U0001f600" * 200).encode()):
        for limit, overlap in ((100, 0), (100, 50), (100, 60), (100, 80), (100, 90), (100, 99), (9, 5), (4, 0)):
            wide = max(len(c.encode()) for c in data.decode())
            check_pieces(data, splitting.cut(data, limit, overlap), limit, overlap, 0 if wide == 1 else 3 if limit - overlap >= wide + 3 else 4)
    for limit, overlap in ((100, 100), (100, 140), (3, 0)):
        with pytest.raises(ValueError, match="no pieces"):
            splitting.cut(b"x" * 500, limit, overlap)


def test_what_the_grid_of_characters_costs():
    """Characters offered at a grid make the chain at most 1 % dearer than every character would."""
    rng = random.Random(9)
    for _ in range(12):
        data = "".join(rng.choice("abc\u00e9 ") if rng.random() < 0.3 else rng.choice("xyz") for _ in range(rng.randrange(900, 2500))).replace(" ", "" if rng.random() < 0.5 else " ").encode()
        limit, overlap = rng.randrange(250, 500), rng.randrange(0, 60)
        on_grid, all_of_them = splitting.cut(data, limit, overlap), splitting.cut(data, limit, overlap, grid=10**6)
        assert cost_of(data, on_grid, limit, overlap) <= 1.01 * cost_of(data, all_of_them, limit, overlap)


def test_many_limits_are_joined(spark, monkeypatch):
    limits = spark.createDataFrame([("split", "full", 40, 8), ("split", "other", 20, 4)], "use_case string, kind string, max_size int, overlap_size int")
    items = spark.createDataFrame([(1, 7, "full", "x" * 50), (2, 7, "odd", "y" * 50), (None, 7, "full", "z" * 50), (None, 7, "full", "w" * 50)], "result_id long, file_id long, kind string, content string")
    symbols = spark.createDataFrame([], "file_id long, start_line int, end_line int")
    few = sorted(map(str, splitting.split_oversized(items, limits, symbols).collect()))
    monkeypatch.setattr(splitting, "LIMIT_ROWS", 1)
    assert sorted(map(str, splitting.split_oversized(items, limits, symbols).collect())) == few
    assert sum("piece_no=1," in row for row in few) == 4


def test_splitting(spark):
    limits = spark.createDataFrame([("split", "Full ", "byte", 40, 8), ("split", "other", "byte", 20, 4), ("fill", "window", "token", 9, 0)], "use_case string, kind string, unit string, max_size int, overlap_size int")
    long = "\n".join(f"line {n}" for n in range(12))
    rows = [(1, 7, "full", long, "x"), (1, 7, "full", long, "x"), (2, 7, " FULL", "short", "x"), (3, 8, None, long, "x"), (4, None, "odd", None, "x"), (5, 7, "full", "", "x")]
    items = spark.createDataFrame(rows, "result_id long, file_id long, kind string, content string, max_size string")
    symbols = spark.createDataFrame([(7, 3, 5), (7, None, None), (7, 9, 2), (99, 1, 2), (None, 1, 1)], "file_id long, start_line int, end_line int")
    got = splitting.split_oversized(items, limits, symbols).orderBy("result_id", "piece_no").collect()
    assert {r["result_id"] for r in got} == {1, 3}
    for rid, limit, overlap in ((1, 40, 8), (3, 20, 4)):
        pieces = [(r["start_byte"], r["end_byte"], 0) for r in got if r["result_id"] == rid]
        check_pieces(long.encode(), pieces, limit, overlap)
    assert splitting.split_oversized(items.limit(0), limits, symbols).count() == 0
