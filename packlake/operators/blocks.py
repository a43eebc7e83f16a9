"""Ranking and selection of many tasks at once, in blocks of a repository's files by a run of tasks.

The rows of many tasks are tasks times files, many times what is read. So nothing of that size is shuffled or kept: what is moved is one row a file
(token sets, bonuses, imports, token counts), gathered by repository; the tasks go to every worker, and a block lives in memory only while it is worked on.
Results that hold a row for every task and file leave a block as runs, (file, score, reasons, the tasks they hold for), and are exploded where they are written.
A repository with many files is repeated for a few runs of tasks, so it does not hold up one worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlake.dims import WEIGHTS
from packlake.functions import text

#: Files times tasks of a block, and of the least share of a repository that is worth another copy of its rows.
CELLS, SHARE = 500_000, 4_000_000
SIGNALS = {"path": WEIGHTS["path"], "symbol": WEIGHTS["symbol"], "purpose": WEIGHTS["keyword"], "imports": WEIGHTS["import"]}
#: Hits of a file are bits of so many to a word.
BITS = 62
#: Positions of a ranking that all tasks of a block walk at once; behind them each task looks for what still fits.
ABREAST = 256
NONE = 2**31 - 1
KINDS = ("full", "snippet", "summary")
CELLS_OF = "task_id bigint, repo string, rel_path string, score double, reasons string"
RUNS = "repo string, rel_path string, score double, reasons string, task_ids array<bigint>"


class Tasks:
    """Tasks by id with their words: ``of[w]`` has the places of the tasks that hold word ``w`` of the sorted ``words``."""

    def __init__(self, tasks: DataFrame):
        rows = tasks.where(F.col("task").isNotNull()).select("task_id", text.keywords(F.col("task")).alias("words"), *[c for c in ("budget",) if c in tasks.columns])
        rows = sorted(rows.dropDuplicates(["task_id"]).collect(), key=lambda r: r["task_id"])
        self.ids = np.array([r["task_id"] for r in rows], np.int64)
        self.budgets = np.array([r["budget"] for r in rows] if "budget" in tasks.columns else [0] * len(rows), np.int64)
        held: dict[str, list[int]] = {}
        for at, row in enumerate(rows):
            for word in set(row["words"]):
                held.setdefault(word, []).append(at)
        self.words = sorted(held)
        self.of = [np.array(held[w], np.int64) for w in self.words]

    def among(self, word: int, first: int, last: int) -> np.ndarray:
        """The tasks from ``first`` up to ``last`` that hold ``word``, counted from ``first``."""
        of = self.of[word]
        return of[np.searchsorted(of, first) : np.searchsorted(of, last)] - first


def lists(column: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, place among the column's values) of the values of a list column that are among ``words``."""
    found = pc.index_in(pc.list_flatten(column), value_set=words)
    kept = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
    return pc.list_parent_indices(column).to_numpy(zero_copy_only=False)[kept], found.fill_null(-1).to_numpy(zero_copy_only=False)[kept], kept


def grouped(keys: list[str], work: Callable[[tuple, pa.Table], Iterator[pa.RecordBatch]]) -> Callable:
    """``work`` over each group of rows that come sorted by ``keys``; batches may end anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            cuts = [0, *[i for i in range(1, len(at)) if at[i] != at[i - 1]], len(at)]
            for first, last in zip(cuts, cuts[1:]):
                if held and at[first] != group:
                    yield from work(group, pa.Table.from_batches(held).combine_chunks())
                    held = []
                group = at[first]
                held.append(batch.slice(first, last - first))
        if held:
            yield from work(group, pa.Table.from_batches(held).combine_chunks())

    return run


def _column(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


class Repository:
    """The files of a repository in order of their paths, as arrays; imports and tests as pairs of places."""

    def __init__(self, repo: str | None, table: pa.Table, words: list[str]):
        self.repo, self.paths, self.words = repo, _column(table, "rel_path"), words
        self.n, names = table.num_rows, self.paths.to_pylist()
        self.names = [p.rsplit("/", 1)[-1] for p in names]
        at = {p: i for i, p in enumerate(names)}
        known = pa.array(words, pa.string())
        found = [lists(_column(table, f"tokens_{name}"), known)[:2] for name in SIGNALS]
        rows, tokens = np.concatenate([f[0] for f in found]).astype(np.int64), np.concatenate([f[1] for f in found]).astype(np.int64)
        signals = np.repeat(np.arange(len(SIGNALS)), [len(f[0]) for f in found])
        order = np.lexsort((tokens, signals, rows))
        rows, tokens, signals = rows[order], tokens[order], signals[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)  # of a hit among those its file may have, by signal and word
        self.depth = int(place.max() // BITS) + 1 if len(rows) else 1
        self.starts, self.tokens, self.signals = np.searchsorted(rows, np.arange(self.n + 1)), tokens, signals
        bits = np.int64(1) << (place % BITS)
        self.of_signal = np.zeros((self.depth, len(SIGNALS), self.n), np.int64)
        np.bitwise_or.at(self.of_signal, (place // BITS, signals, rows), bits)
        self.hits = []  # (word, depth, files, bits): a file has at most one bit in each
        order = np.lexsort((rows, signals, place // BITS, tokens))
        key = (tokens * self.depth + place // BITS) * len(SIGNALS) + signals
        for some in np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else []:
            self.hits.append((int(tokens[some[0]]), int(place[some[0]] // BITS), rows[some], bits[some]))
        flags = {c: _column(table, c).to_numpy(zero_copy_only=False) for c in ("priority", "mentioned", "commits")}
        self.commits = flags["commits"].astype(np.int64)
        self.bonuses = [np.where(flags["priority"].astype(bool), WEIGHTS["priority"], 0.0), np.where(flags["mentioned"].astype(bool), WEIGHTS["memory"], 0.0), np.where(self.commits > 0, np.minimum(self.commits, 5) * WEIGHTS["churn"], 0.0)]
        self.sizes = [np.where((v := _column(table, c)).is_valid().to_numpy(zero_copy_only=False), v.fill_null(0).to_numpy(zero_copy_only=False), NONE).astype(np.int64) for c in ("full_tok", "snip_tok", "sum_tok") if c in table.column_names]
        linked = [(i, at[e["target"]], e["ord"]) for i, es in enumerate(table.column("imports_of").to_pylist() if "imports_of" in table.column_names else []) for e in es or () if e["target"] in at]
        self.imports = np.array(linked, np.int64).reshape(-1, 3)
        tests = [(i, at[p], n) for i, ps in enumerate(table.column("tests_of").to_pylist() if "tests_of" in table.column_names else []) for n, p in enumerate(ps) if p in at]
        self.tests = np.array(tests, np.int64).reshape(-1, 3)
        if repo is None:  # equal to no other, so nothing leads
            self.imports, self.tests = self.imports[:0], self.tests[:0]

    def told(self, file: int, bits: tuple[int, ...]) -> str:
        """The reasons of a file with these hits, without boosts."""
        by: dict[int, list[str]] = {}
        first = self.starts[file]
        for depth, word in enumerate(bits):
            while word:
                low = word & -word
                at = first + depth * BITS + low.bit_length() - 1
                by.setdefault(int(self.signals[at]), []).append(self.words[self.tokens[at]])
                word ^= low
        out = [f"{name}:{','.join(by[n][:4])}" for n, name in enumerate(SIGNALS) if n in by]
        if self.bonuses[0][file]:
            out.append("priority:readme/config")
        if self.bonuses[1][file]:
            out.append("memory:mentioned")
        if self.commits[file] > 0:
            out.append(f"churn:{self.commits[file]}commits")
        return "; ".join(out)


class Block:
    """A run of tasks over the files of a repository: scores as arrays of tasks by files, boosts as lists of (task, file, reason)."""

    def __init__(self, files: Repository, tasks: Tasks, first: int, last: int):
        self.files, self.ids, self.budgets = files, tasks.ids[first:last], tasks.budgets[first:last]
        self.bits = [np.zeros((last - first, files.n), np.int64) for _ in range(files.depth)]
        for word, depth, rows, bits in files.hits:
            holders = tasks.among(word, first, last)
            if len(holders):
                self.bits[depth][np.ix_(holders, rows)] |= bits
        self.hit = reduce(np.logical_or, [b != 0 for b in self.bits])
        self.boosted: dict[int, list[str]] = {}
        score = np.zeros((last - first, files.n))
        at = np.nonzero(self.hit)
        part = np.zeros(len(at[0]))
        for n, weight in enumerate(SIGNALS.values()):
            part = part + sum(np.bitwise_count(b[at] & files.of_signal[d, n][at[1]]).astype(np.int64) for d, b in enumerate(self.bits)) * weight
        score[at] = part
        for bonus in files.bonuses:
            score += bonus
        self.score = score

    def _leading(self, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(task, place in ``sources``) where the source leads: a positive score of at least a share of its repository's best."""
        least = self.score.max(axis=1, keepdims=True) * WEIGHTS["share"]
        return np.nonzero(((self.score > 0) & (self.score >= least))[:, sources])

    def _tell(self, tasks, files, reasons) -> None:
        for key, reason in zip((tasks * self.files.n + files).tolist(), reasons):
            self.boosted.setdefault(key, []).append(reason)

    def expand(self) -> Block:
        """Boosts along imports, added by the importer's score, path and order of its imports."""
        source, target, ord_ = self.files.imports.T
        if len(source):
            t, e = self._leading(source)
            from_ = self.score[t, source[e]]
            order = np.lexsort((ord_[e], source[e], -from_, target[e], t))
            t, e, from_ = t[order], e[order], from_[order]
            scores = self.score.copy()
            np.add.at(scores, (t, target[e]), from_ * WEIGHTS["dep"])
            self.score = scores
            self._tell(t, target[e], (f"dep:{self.files.names[s]}" for s in source[e].tolist()))
        return self

    def pair(self) -> Block:
        """Boosts of tests, added by the path and place of what they test."""
        source, target, _ = self.files.tests.T
        self.paired = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(source):
            t, e = self._leading(source)
            scores = self.score.copy()
            np.add.at(scores, (t, target[e]), WEIGHTS["pair"])
            self.score = scores
            self._tell(t, target[e], (f"test_pair:{self.files.names[s]}" for s in source[e].tolist()))
            self.paired = np.unravel_index(np.unique(t * self.files.n + target[e]), self.score.shape)
        return self

    def order(self) -> np.ndarray:
        """Files of each task, score descending, then path."""
        return np.argsort(-self.score, axis=1, kind="stable")

    def reasons(self, t: np.ndarray, f: np.ndarray) -> pa.Array:
        """The reasons of these cells; words are put together once for each file and set of hits."""
        words = [b[t, f] for b in self.bits]
        order = np.lexsort((*words, f))
        new = np.ones(len(f), bool)
        if len(f):
            new[1:] = reduce(np.logical_or, [np.diff(c[order]) != 0 for c in (f, *words)])
        at = np.empty(len(f), np.int64)
        at[order] = np.cumsum(new) - 1
        firsts = order[new]
        pool = [self.files.told(file, bits) for file, bits in zip(f[firsts].tolist(), zip(*[w[firsts].tolist() for w in words]))]
        if self.boosted:
            keys = t * self.files.n + f
            for i in np.flatnonzero(np.isin(keys, np.fromiter(self.boosted, np.int64, len(self.boosted)))).tolist():
                pool.append("; ".join([*([pool[at[i]]] if pool[at[i]] else []), *self.boosted[int(keys[i])]]))
                at[i] = len(pool) - 1
        return pa.array(pool, pa.string()).take(pa.array(at))

    def cells(self, t: np.ndarray, f: np.ndarray, **more: pa.Array) -> Iterator[pa.RecordBatch]:
        """A row for each cell."""
        if len(t):
            columns = {"task_id": pa.array(self.ids[t]), "repo": self._repo(len(t)), "rel_path": self.files.paths.take(pa.array(f)), "score": pa.array(np.round(self.score[t, f], 6)), "reasons": self.reasons(t, f)}
            yield pa.RecordBatch.from_pydict(columns | more)

    def runs(self) -> Iterator[pa.RecordBatch]:
        """Every cell, as runs of tasks with the same score and reasons of a file."""
        single = self.hit.copy()
        single.ravel()[np.fromiter(self.boosted, np.int64, len(self.boosted))] = True
        f, t = np.nonzero(~single.T)
        if len(f):
            starts = np.flatnonzero(np.r_[True, np.diff(f) != 0])
            yield self._run(t, f, starts)
        f, t = np.nonzero(single.T)
        if len(f):
            boost = np.isin(t * self.files.n + f, np.fromiter(self.boosted, np.int64, len(self.boosted)))
            own = np.where(boost, np.arange(1, len(f) + 1), 0)  # a cell with boosts is a run of its own
            words = [b[t, f] for b in self.bits]
            order = np.lexsort((t, own, *words, f))
            new = np.r_[True, reduce(np.logical_or, [np.diff(c[order]) != 0 for c in (f, own, *words)])]
            yield self._run(t[order], f[order], np.flatnonzero(new))

    def _run(self, t: np.ndarray, f: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        a, b = t[starts], f[starts]
        return pa.RecordBatch.from_pydict(
            {"repo": self._repo(len(b)), "rel_path": self.files.paths.take(pa.array(b)), "score": pa.array(np.round(self.score[a, b], 6)), "reasons": self.reasons(a, b), "task_ids": self._ids(t, starts)}
        )

    def _ids(self, t: np.ndarray, starts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(t)], pa.int32()), pa.array(self.ids[t]))

    def _repo(self, n: int) -> pa.Array:
        return pa.array([self.files.repo] * n, pa.string())

    def select(self) -> tuple[np.ndarray, ...]:
        """(task, file, kind, tokens, number) of what a greedy pass in rank order takes within each task's budget."""
        order, left = self.order(), self.budgets.copy()
        sizes = np.stack(self.files.sizes)
        least = sizes.min(axis=0)
        out = []
        for at in range(min(self.files.n, ABREAST)):
            f = order[:, at]
            t = np.flatnonzero((left > 0) & (least[f] <= left))
            if len(t):
                f = f[t]
                kind = np.argmax(sizes[:, f] <= left[t], axis=0)
                tokens = sizes[kind, f]
                left[t] -= tokens
                out.append((t, f, kind, tokens))
        for t in np.flatnonzero(left > 0).tolist() if self.files.n > ABREAST else []:
            rest, have, taken = order[t, ABREAST:], int(left[t]), []
            for f in rest[least[rest] <= have].tolist():
                if have <= 0:
                    break
                for kind in range(len(KINDS)):
                    tokens = int(sizes[kind, f])
                    if tokens <= have:
                        have -= tokens
                        taken.append((t, f, kind, tokens))
                        break
            left[t] = have
            if taken:
                out.append(tuple(np.array(taken, np.int64).T))
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(5))
        t, f, kind, tokens = (np.concatenate(c) for c in zip(*out))
        by = np.argsort(t, kind="stable")
        t, f, kind, tokens = t[by], f[by], kind[by], tokens[by]
        return t, f, kind, tokens, np.arange(len(t)) - np.searchsorted(t, t) + 1


def expanded(block: Block) -> Iterator[pa.RecordBatch]:
    """Every file with its boosts along imports, as runs of tasks."""
    yield from block.expand().runs()


def paired(block: Block) -> Iterator[pa.RecordBatch]:
    """The files that are boosted as tests."""
    yield from block.expand().pair().cells(*block.paired)


def top(n: int) -> Callable[[Block], Iterator[pa.RecordBatch]]:
    """The first ``n`` files of each task, with their ``rank``."""

    def work(block: Block) -> Iterator[pa.RecordBatch]:
        files = block.expand().pair().order()[:, :n]
        ranks = np.tile(np.arange(1, files.shape[1] + 1, dtype=np.int32), len(files))
        yield from block.cells(np.repeat(np.arange(len(files)), files.shape[1]), files.ravel(), rank=pa.array(ranks))

    return work


def selected(block: Block) -> Iterator[pa.RecordBatch]:
    """What each task shows within its budget: ``kind``, ``tokens``, ``select_no``."""
    t, f, kind, tokens, number = block.expand().pair().select()
    yield from block.cells(t, f, kind=pa.array(KINDS).take(pa.array(kind)), tokens=pa.array(tokens, pa.int32()), select_no=pa.array(number, pa.int32()))


def left(block: Block) -> Iterator[pa.RecordBatch]:
    """What each task has no room for, as runs of tasks."""
    t, f, *_ = block.expand().pair().select()
    over = np.ones(block.score.shape, bool)
    over[t, f] = False
    f, t = np.nonzero(over.T)
    if len(f):
        starts = np.flatnonzero(np.r_[True, np.diff(f) != 0])
        yield pa.RecordBatch.from_pydict({"repo": block._repo(len(starts)), "rel_path": block.files.paths.take(pa.array(f[starts])), "task_ids": block._ids(t, starts)})


def used(block: Block) -> Iterator[pa.RecordBatch]:
    """Tokens that each task takes of its budget: one row with a list of tasks and one of tokens."""
    t, _, _, tokens, _ = block.expand().pair().select()
    sums = np.bincount(t, tokens, len(block.ids)).astype(np.int64)
    yield pa.RecordBatch.from_pydict({"repo": block._repo(1), "task_ids": pa.array([block.ids], pa.list_(pa.int64())), "used": pa.array([sums], pa.list_(pa.int64()))})


def over_blocks(files: DataFrame, parts_of: DataFrame, tasks: Tasks, schema: str, work: Callable[[Block], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``work`` over all blocks of ``files`` (one row a file: see :func:`packlake.operators.rank.file_rows`); repositories are sized by the few columns of ``parts_of``."""
    workers = max(files.sparkSession.sparkContext.defaultParallelism, 2)
    sizes = parts_of.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    total, n_tasks = parts_of.count() or 1, len(tasks.ids)
    large = sizes.where((F.col("n") * (4 * workers) > total) & (F.col("n") * F.lit(n_tasks) > SHARE)).collect()
    split = {r["repo"]: max(1, min(-(-4 * workers * r["n"] // total), -(-r["n"] * n_tasks // SHARE), n_tasks)) for r in large if r["repo"] is not None}
    parts = reduce(lambda c, r: F.when(F.col("repo") == r, split[r]).otherwise(c), split, F.lit(1))
    names = [f.name for f in files.schema]

    def run(group: tuple, table: pa.Table) -> Iterator[pa.RecordBatch]:
        repo, part = group
        of = split.get(repo, 1)
        held = Repository(repo, table, tasks.words)
        first, end = n_tasks * part // of, n_tasks * (part + 1) // of
        step = max(1, CELLS // (held.n * held.depth))
        for at in range(first, end, step):
            yield from work(Block(held, tasks, at, min(at + step, end)))

    laid = files.select(*names, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).repartition(4 * workers, "repo", "part").sortWithinPartitions("repo", "part", "rel_path")
    return laid.mapInArrow(grouped(["repo", "part"], run), schema)


def symbol_runs(files: DataFrame, tasks: Tasks) -> DataFrame:
    """(repo, rel_path, score, task_ids) of ``files`` (repo, rel_path, named, parts, weights): the weights of the parts each task asks for, as runs of tasks with one score.

    A file without a named symbol has no score.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_tasks = pa.array(tasks.words, pa.string()), len(tasks.ids)
        step = max(1, CELLS // max(n_tasks, 1))
        for batch in batches:
            for at in range(0, batch.num_rows if n_tasks else 0, step):
                part = batch.slice(at, step)
                rows, words, places = lists(part.column("parts"), known)
                cells, of = np.unique(rows.astype(np.int64) + words.astype(np.int64) * part.num_rows, return_inverse=True)
                weights = np.bincount(of, pc.list_flatten(part.column("weights")).to_numpy(zero_copy_only=False)[places], len(cells))
                words, rows = np.divmod(cells, part.num_rows)
                score = np.zeros((part.num_rows, n_tasks))
                for some in np.split(np.arange(len(cells)), np.flatnonzero(np.diff(words)) + 1) if len(cells) else []:
                    score[np.ix_(rows[some], tasks.of[words[some[0]]])] += weights[some, None]
                order = np.argsort(score, axis=1, kind="stable")
                score = np.take_along_axis(score, order, axis=1)
                starts = np.flatnonzero(np.c_[np.ones(part.num_rows, bool), np.diff(score, axis=1) != 0])
                files = starts // n_tasks
                ids = pa.ListArray.from_arrays(pa.array(np.r_[starts, score.size], pa.int32()), pa.array(tasks.ids[order.ravel()]))
                named = part.column("named").to_numpy(zero_copy_only=False).astype(bool)
                taken = pa.array(files)
                yield pa.RecordBatch.from_pydict({"repo": part.column("repo").take(taken), "rel_path": part.column("rel_path").take(taken), "score": pa.array(score.ravel()[starts], mask=~named[files]), "task_ids": ids})

    return files.mapInArrow(run, "repo string, rel_path string, score double, task_ids array<bigint>")
