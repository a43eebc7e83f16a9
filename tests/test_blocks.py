"""Blocks of many tasks over a repository: nothing as large as tasks times files is moved or kept, and results are those of brute force."""

import os
from datetime import datetime

import pyarrow as pa
import pytest

from packlake.operators import blocks, budget
from packlake.plans import catalogue
from tests.test_whole import SUMMARY

N_TASKS, WORDS = 120, ("ledger", "basket", "rates", "store", "view")
PATHS = [f"pkg{n % 4}/{WORDS[n % 5]}_{n}.py" for n in range(40)] + [f"web/{WORDS[n % 5]}{n}.js" for n in range(30)] + ["tests/test_ledger_0.py", "secret.key"]


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Few files, many tasks: rows of the results outnumber those of the tables by far."""
    at = str(tmp_path_factory.mktemp("wide"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    put("files", [("r", p, f"import pkg{n % 4}.ledger_0\n" if p.endswith(".py") else "import a from './ledger0'\n" if n < 43 else "b\n") for n, p in enumerate(PATHS)], "repo string, rel_path string, content string")
    put("summaries", [("r", p, "Python", WORDS[n % 3], [], [WORDS[n % 4]], [], "", n, "", n) for n, p in enumerate(PATHS)], SUMMARY)
    put("tasks", [(n, f"the {WORDS[n % 5]} of {WORDS[n % 3]}", 20 + n) for n in range(N_TASKS)], "task_id long, task string, budget int")
    put("file_snapshots", [("r", PATHS[0], datetime(2026, 1, 1))], "repo string, rel_path string, loaded_at timestamp")
    put("symbols", [(n, "r", p, f"read{WORDS[n % 5].title()}", "function", 1, 2, None) for n, p in enumerate(PATHS)], "file_id long, repo string, rel_path string, name string, kind string, start_line int, end_line int, parent string")
    return at


def moved(spark, run) -> tuple[int, int]:
    """Rows shuffled and bytes checkpointed while ``run`` runs."""
    context = spark.sparkContext._jsc.sc()
    folder = context.getCheckpointDir().get().removeprefix("file:") if not context.getCheckpointDir().isEmpty() else None

    def now():
        context.listenerBus().waitUntilEmpty(30_000)
        jobs = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        kept = sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names) if folder else 0
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (jobs.apply(i) for i in range(jobs.size()))}, kept

    (before, kept), _ = now(), run()
    after, kept_after = now()
    return sum(n for key, n in after.items() if key not in before), kept_after - kept


def check_moves_little(spark, wide, name, least_rows=N_TASKS):
    found, key = [], "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")  # these tables are small enough to be broadcast; large ones are not
    try:
        shuffled, kept = moved(spark, lambda: found.extend(catalogue.QUERIES[name](spark, wide).collect()))
    finally:
        spark.conf.set(key, before)
    assert len(found) >= least_rows
    assert shuffled < N_TASKS * len(PATHS) / 2
    assert kept == 0


def test_score_signals_moves_little(spark, wide):
    """F1"""
    check_moves_little(spark, wide, "score_signals", N_TASKS * (len(PATHS) - 1))


def test_symbol_score_moves_little(spark, wide):
    """F2"""
    check_moves_little(spark, wide, "symbol_score", N_TASKS * len(PATHS))


@pytest.mark.parametrize(
    "name",
    [
        "budget_excluded",  # F3
        "budget_select_scripts",  # F4
        "rank_topk",  # F5
        "savings_scripts",  # F6
        "budget_excluded_scripts",  # F7
        "dep_expand",  # F8
        "rank_topk_scripts",  # F9
        "test_pairs",  # F10
        "budget_select",  # F11
        "dep_expand_scripts",  # F12
        "savings",  # F13
        "test_pairs_scripts",  # F14
    ],
)
def test_rankings_move_little(spark, wide, name):
    check_moves_little(spark, wide, name, 24)


def test_what_is_left_out_is_labelled_once_a_file(spark):
    """labels are made below the explode of tasks, not for each of its rows."""
    summaries = spark.createDataFrame([("r", "a.py"), ("r", "my_secret.py")], "repo string, rel_path string")
    left = spark.createDataFrame([("r", "a.py", [1, 2]), ("r", "my_secret.py", [2])], "repo string, rel_path string, task_ids array<bigint>")
    found = budget.excluded(summaries, left, spark.createDataFrame([(1,), (2,)], "task_id long"))
    over = {(r["task_id"], r["rel_path"], r["note"]) for r in found.where("cause = 'budget'").collect()}
    assert over == {(1, "a.py", "over budget"), (2, "a.py", "over budget"), (2, "my_secret.py", "secret/credential file")}
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(n for n, line in enumerate(plan) if "Generate explode(task_ids" in line)
    assert "over budget" not in plan[at - 1] and "over budget" in plan[at + 1]


def test_large_repositories_come_in_parts(spark):
    """Every task once over a repository that is laid out several times; paths in order, whatever batches they come in."""
    tasks = tasks_of(spark, [(n, "word", 9) for n in range(7)])
    held = blocks.Repository("r", repository(["a", "b", "c"], [["word"], [], ["word"]]), tasks.words)
    runs = [r for first, last in ((0, 3), (3, 7)) for b in blocks.Block(held, tasks, first, last).runs() for r in b.to_pylist()]
    assert sorted((t, r["rel_path"], r["score"]) for r in runs for t in r["task_ids"]) == [(t, p, 2.0 * (p != "b")) for t in range(7) for p in "abc"]
    rows = pa.table({"repo": ["q"] * 3 + ["r"] * 4, "x": list(range(7))})
    for size in (1, 2, 3, 7):
        groups = []
        list(blocks.grouped(["repo"], lambda g, t: iter([groups.append((g, t.column("x").to_pylist()))]))(iter(rows.to_batches(size))))
        assert groups == [(("q",), [0, 1, 2]), (("r",), [3, 4, 5, 6])]


def test_selection_is_the_greedy_fold(spark):
    """Also behind the positions that all tasks walk at once, with files of no tokens and forms that are not there."""
    n = 3 * blocks.ABREAST
    sizes = [(None if at % 11 == 0 else 0 if at % 97 == 0 else at * 37 % 90 + 1, None if at % 5 == 0 else at % 31 + 2, at % 7 + 3) for at in range(n)]
    tasks = tasks_of(spark, [(at, "word", left) for at, left in enumerate((0, 1, 5, 60, 700, 3000, 9000, 100_000))])
    held = blocks.Repository("r", repository([f"f{at:04}" for at in range(n)], [["word"] if at % 3 else [] for at in range(n)], sizes), tasks.words)
    block = blocks.Block(held, tasks, 0, len(tasks.ids))
    order = sorted(range(n), key=lambda at: (at % 3 == 0, at))
    assert block.order().tolist() == [order] * len(tasks.ids)
    t, f, kind, tokens, number = (c.tolist() for c in block.select())
    for at, left in enumerate(tasks.budgets.tolist()):
        taken, _ = budget.fold([sizes[f] for f in order], left)
        want = [(order[place], kind, sizes[order[place]][budget.KINDS.index(kind)], no) for no, (place, kind) in enumerate(taken, start=1)]
        assert [(f[i], blocks.KINDS[kind[i]], tokens[i], number[i]) for i in range(len(t)) if t[i] == at] == want


def repository(paths, tokens, sizes=None):
    """A :class:`blocks.Repository` of files with path tokens; no other signals."""
    n = len(paths)
    none = pa.array([[]] * n, pa.list_(pa.string()))
    columns = {"rel_path": pa.array(paths), "tokens_path": pa.array(tokens, pa.list_(pa.string())), "tokens_symbol": none, "tokens_purpose": none, "tokens_imports": none}
    columns |= {"priority": pa.array([False] * n), "mentioned": pa.array([False] * n), "commits": pa.array([0] * n)}
    if sizes:
        columns |= {c: pa.array([s[at] for s in sizes], pa.int32()) for at, c in enumerate(("full_tok", "snip_tok", "sum_tok"))}
    return pa.table(columns)


def tasks_of(spark, rows):
    return blocks.Tasks(spark.createDataFrame(rows, "task_id long, task string, budget int"))


def test_more_hits_than_a_word_has_bits(spark):
    words = [f"word{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in range(150)]
    tasks = tasks_of(spark, [(1, " ".join(words), 9), (2, words[149], 9), (3, "other", 9)])
    held = blocks.Repository("r", repository(["a", "b"], [words, words[140:]]), tasks.words)
    assert held.depth == 3
    runs = [r for b in blocks.Block(held, tasks, 0, 3).runs() for r in b.to_pylist()]
    got = {(t, r["rel_path"]): (r["score"], r["reasons"]) for r in runs for t in r["task_ids"]}
    n_of = {(1, "a"): 150, (1, "b"): 10}
    assert {k: v[0] for k, v in got.items()} == {(t, p): 2.0 * n_of.get((t, p), t == 2) for t in (1, 2, 3) for p in "ab"}
    assert got[1, "a"][1] == "path:" + ",".join(words[:4]) and got[2, "b"][1] == f"path:{words[149]}" and got[3, "a"][1] == ""
