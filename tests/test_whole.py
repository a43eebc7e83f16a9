"""The queries over all languages and all tasks, against brute force on a small data directory."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from packlake import dims
from packlake.operators import budget, graph, rank
from packlake.plans import catalogue, corpus, rank_queries

SUMMARY = "repo string, rel_path string, language string, purpose string, imports array<string>, exports array<string>, symbols array<string>, docstring string, line_count int, content_hash string, file_id long"
FILES = {
    ("r", "pkg/ledger.py"): "from pkg import store\nimport pkg.rates\n",
    ("r", "pkg/store.py"): "x = 1\n",
    ("r", "pkg/rates.py"): "y = 2\n",
    ("r", "pkg/__init__.py"): "",
    ("r", "tests/test_ledger.py"): "import pkg.ledger\n",
    ("r", "web/ledger.js"): "import a from './view'\n",
    ("r", "web/view.js"): "const a = 'basket'\n",
    ("q", "basket.py"): "import store\n",
    ("q", "store.py"): "z = 3\n" * 30,
    ("q", "readme.md"): "# Basket\n",
    ("q", "secret.key"): "k\n",
}
LOCAL = [("r", "pkg/ledger.py", "pkg/__init__.py"), ("r", "pkg/ledger.py", "pkg/rates.py"), ("r", "tests/test_ledger.py", "pkg/ledger.py"), ("r", "web/ledger.js", "web/view.js"), ("q", "basket.py", "store.py")]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("small"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    put("files", [(*key, body) for key, body in FILES.items()], "repo string, rel_path string, content string")
    put("summaries", [(repo, path, "Python", "", [], [], [], "", body.count("\n"), "", n) for n, ((repo, path), body) in enumerate(FILES.items())], SUMMARY)
    put("tasks", [(1, "the ledger", 60), (2, "basket view", 25), (3, "rates of the store", None), (4, None, 50), (5, "", 30)], "task_id long, task string, budget int")
    put("file_snapshots", [("r", "pkg/store.py", datetime(2026, 1, 1))], "repo string, rel_path string, loaded_at timestamp")
    put("selected", [("r", "pkg/ledger.py"), ("r", "pkg/rates.py"), ("q", "store.py"), ("q", "basket.py")], "repo string, rel_path string")
    put("symbols", [(1, "r", "pkg/store.py", "readRates", "function"), (2, "r", "pkg/store.py", "Ledger", "class"), (3, "q", "basket.py", None, "class"), (4, "q", "store.py", "x", "method")], "file_id long, repo string, rel_path string, name string, kind string")
    return at


def rows_of(spark, small, name):
    return [r.asDict() for r in catalogue.QUERIES[name](spark, small).collect()]


def test_python_imports_count(spark, small):
    assert {(r["repo"], r["target"]): r["n_dependents"] for r in rows_of(spark, small, "in_degree")} == {(repo, target): 1 for repo, _, target in LOCAL}
    assert {(r["repo"], r["rel_path"]): r["note"] for r in rows_of(spark, small, "dependency_notes")} == {
        ("r", "pkg/ledger.py"): "→ imports `pkg/__init__.py`, `pkg/rates.py`", ("r", "pkg/rates.py"): "← imported by `pkg/ledger.py`",
        ("q", "basket.py"): "→ imports `store.py`", ("q", "store.py"): "← imported by `basket.py`",
    }


def test_python_imports_boost(spark, small):
    got = {r["rel_path"]: (r["score"], r["reasons"]) for r in rows_of(spark, small, "dep_expand") if r["repo"] == "r" and r.get("task_id", 1) == 1}
    assert got["pkg/rates.py"] == (0.8, "dep:ledger.py") and got["web/view.js"] == (0.8, "dep:ledger.js")
    assert any(r["rel_path"] == "pkg/rates.py" and "dep:ledger.py" in r["reasons"] for r in rows_of(spark, small, "rank_topk"))


def each_task(spark, small):
    """(task_id, budget, ranking of that task alone, by the operators for one task)."""
    for row in spark.read.parquet(f"{small}/tasks.parquet").where("task IS NOT NULL").orderBy("task_id").collect():
        found = spark.range(1).select(corpus.text.keywords(F.lit(row["task"])).alias("k")).first()["k"]
        keywords = F.array(*map(F.lit, found)) if found else F.array().cast("array<string>")
        edges = graph.graph_edges(corpus.files(spark, small))
        yield row["task_id"], row["budget"] or dims.DEFAULT_BUDGET, rank.rank_files(corpus.summaries(spark, small), edges, keywords, corpus.churn_counts(spark, small), rank_queries._memory())


def test_every_task_is_ranked_and_gets_its_own_budget(spark, small):
    sizes = {(r["repo"], r["rel_path"]): (r["full_tok"], r["snip_tok"], r["sum_tok"]) for r in budget.forms(corpus.summaries(spark, small), corpus.files(spark, small)).collect()}
    top, chosen, left, used = set(), set(), set(), {}
    for task, tokens, ranking in each_task(spark, small):
        scores = [(r["repo"], r["rel_path"], r["score"], "; ".join(r["reasons"])) for r in ranking.collect()]
        left.add((task, "q", "secret.key", "secret"))
        for repo in ("r", "q"):
            mine = sorted((s for s in scores if s[0] == repo), key=lambda s: (-s[2], s[1]))
            top |= {(task, repo, path, n, round(score, 6), why) for n, (_, path, score, why) in enumerate(mine[:20], start=1)}
            taken, over = budget.fold([sizes[s[:2]] for s in mine], tokens)
            chosen |= {(task, repo, mine[at][1], kind, sizes[mine[at][:2]][budget.KINDS.index(kind)], n) for n, (at, kind) in enumerate(taken, start=1)}
            left |= {(task, repo, s[1], "budget") for s in mine} - {(task, repo, mine[at][1], "budget") for at, _ in taken}
            used[task, repo] = tokens - over
    assert {task for task, *_ in top} == {1, 2, 3, 5}
    assert {(r["task_id"], r["repo"], r["rel_path"], r["rank"], r["score"], r["reasons"]) for r in rows_of(spark, small, "rank_topk")} == top
    got = {(r["task_id"], r["repo"], r["rel_path"], r["kind"], r["tokens"], r["select_no"]) for r in rows_of(spark, small, "budget_select")}
    assert got == chosen
    assert {(r["task_id"], r["repo"], r["rel_path"], r["cause"]) for r in rows_of(spark, small, "budget_excluded")} == left
    assert {(r["task_id"], r["repo"]): r["used_tokens"] for r in rows_of(spark, small, "savings")} == used


def test_symbols_are_scored_for_every_task(spark, small):
    got = {(r["task_id"], r["repo"], r["rel_path"]): r["score"] for r in rows_of(spark, small, "symbol_score")}
    assert got == {(t, *p): s for t in (1, 2, 3, 5) for p, s in {("r", "pkg/store.py"): {1: 1.0, 3: 2.0}.get(t, 0.0), ("q", "basket.py"): None, ("q", "store.py"): 0.0}.items()}
