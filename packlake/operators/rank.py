"""Ranking of files for a task: set-overlap signals, bonuses, boosts along imports and to tests.

Each repository is ranked for itself; its rows are never gathered in one place, all steps are joins and grouped aggregates.
Scores that carry a ``task_id`` are ranked for each task and repository.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlake.dims import WEIGHTS
from packlake.functions import paths, text
from packlake.operators import blocks
from packlake.operators.classify import is_priority, is_secret_file
from packlake.session import checkpointed


def _group(scores: DataFrame) -> list[str]:
    """What is ranked for itself: a repository, or a repository for a task."""
    return [c for c in ("task_id", "repo") if c in scores.columns]


def _array(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def signal_tokens() -> dict[str, Column]:
    """The token sets of a summary row that a task's keywords are held against, by signal."""
    described = F.concat_ws(" ", F.coalesce("purpose", F.lit("")), F.coalesce("docstring", F.lit("")))
    return {
        "path": text.tokens(F.col("rel_path")),
        "symbol": F.array_distinct(F.transform(F.concat(_array("exports"), _array("symbols")), F.lower)),
        "purpose": text.tokens(described),
        "imports": F.array_distinct(F.transform(_array("imports"), lambda i: F.split(F.lower(i), r"\.")[0])),
    }


WEIGHT_OF = {"path": WEIGHTS["path"], "symbol": WEIGHTS["symbol"], "purpose": WEIGHTS["keyword"], "imports": WEIGHTS["import"]}


def signal_hits(summaries: DataFrame, keywords: Column) -> DataFrame:
    """``summaries`` with the sorted hits of each signal as ``hits_<signal>``."""
    hits = {f"hits_{name}": F.array_sort(F.array_intersect(keywords, tokens)) for name, tokens in signal_tokens().items()}
    return summaries.withColumns(hits)


def scored(summaries: DataFrame, keywords: Column, churn: DataFrame | None = None, memory_paths: Column | None = None) -> DataFrame:
    """(repo, rel_path, score, reasons) of every file but those with secret names.

    Null arrays and texts count as empty; of repeated rows of a file one stands.
    """
    rows = _with_bonuses(summaries, churn, memory_paths)
    rows = signal_hits(rows, keywords)
    return rows.select("repo", "rel_path", *_score_and_reasons())


def _with_bonuses(summaries: DataFrame, churn: DataFrame | None, memory_paths: Column | None) -> DataFrame:
    """One row a file, without secret names, with what every task adds alike: ``priority``, ``mentioned``, ``commits``."""
    rows = summaries.where(~is_secret_file(F.col("rel_path")) & F.col("rel_path").isNotNull()).dropDuplicates(["repo", "rel_path"])
    if churn is not None:
        rows = rows.join(churn.select("repo", "rel_path", "commits"), ["repo", "rel_path"], "left")
    commits = F.coalesce(F.col("commits"), F.lit(0)) if churn is not None else F.lit(0)
    mentioned = (F.array_contains(memory_paths, F.col("rel_path")) | F.array_contains(memory_paths, paths.name(F.col("rel_path")))) if memory_paths is not None else F.lit(False)
    return rows.withColumns({"priority": is_priority(F.col("rel_path")), "mentioned": mentioned, "commits": commits})


def _score_and_reasons() -> tuple[Column, Column]:
    """Over ``hits_<signal>`` (null where a file has none) and the bonuses; sums are taken in one order everywhere."""
    score, reasons = F.lit(0.0), []
    for name, weight in WEIGHT_OF.items():
        hits = F.coalesce(F.col(f"hits_{name}"), F.array().cast("array<string>"))
        score = score + F.size(hits) * F.lit(weight)
        reasons.append(F.when(F.size(hits) > 0, F.concat(F.lit(f"{name}:"), F.array_join(F.slice(hits, 1, 4), ","))))
    commits = F.col("commits")
    for on, weight, told in (
        (F.col("priority"), F.lit(WEIGHTS["priority"]), F.lit("priority:readme/config")),
        (F.col("mentioned"), F.lit(WEIGHTS["memory"]), F.lit("memory:mentioned")),
        (commits > 0, F.least(commits, F.lit(5)) * WEIGHTS["churn"], F.concat(F.lit("churn:"), commits.cast("string"), F.lit("commits"))),
    ):
        score = score + F.when(on, weight).otherwise(0.0)
        reasons.append(F.when(on, told))
    return score.alias("score"), F.array_compact(F.array(*reasons)).alias("reasons")


def file_rows(summaries: DataFrame, churn: DataFrame | None = None, memory_paths: Column | None = None, edges: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """One row a file, without secret names, with what :mod:`packlake.operators.blocks` ranks by: token sets, bonuses, imports of ``edges`` and where tests may be, tokens of ``sizes``."""
    tokens = [c.alias(f"tokens_{name}") for name, c in signal_tokens().items()]
    rows = _with_bonuses(summaries, churn, memory_paths).select("repo", "rel_path", "priority", "mentioned", "commits", *tokens)
    if edges is not None:
        local = edges.where("kind = 'local'").groupBy("repo", F.col("source").alias("rel_path")).agg(F.collect_list(F.struct("target", "ord")).alias("imports_of"))
        rows = rows.join(local, ["repo", "rel_path"], "left").withColumn("tests_of", test_candidates(F.col("rel_path")))
    if sizes is not None:
        rows = rows.join(sizes, ["repo", "rel_path"], "left")
    return rows


def scored_runs(summaries: DataFrame, tasks: DataFrame, churn: DataFrame | None = None, memory_paths: Column | None = None) -> DataFrame:
    """(repo, rel_path, score, reasons, task_ids): what :func:`scored` gives of every file for every task with a text, as runs of tasks that score it alike.

    Scores are rounded to 6 places, reasons joined. The rows are tasks times files, so they come out where ``task_ids`` are exploded and nowhere else.
    """
    return blocks.over_blocks(file_rows(summaries, churn, memory_paths), _unhidden(summaries), blocks.Tasks(tasks), blocks.RUNS, lambda b: b.runs())


def over_tasks(summaries: DataFrame, edges: DataFrame, tasks: DataFrame, churn: DataFrame | None, memory_paths: Column | None, schema: str, work: Callable, sizes: DataFrame | None = None) -> DataFrame:
    """``work`` over the blocks of a ranking along ``edges`` (:class:`packlake.operators.blocks.Block`): the steps of :func:`rank_files` for every task with a text."""
    return blocks.over_blocks(file_rows(summaries, churn, memory_paths, edges, sizes), _unhidden(summaries), blocks.Tasks(tasks), schema, work)


def _unhidden(summaries: DataFrame) -> DataFrame:
    return summaries.where(~is_secret_file(F.col("rel_path")) & F.col("rel_path").isNotNull()).select("repo")


def _leaders(scores: DataFrame) -> DataFrame:
    """Rows with a positive score of at least a share of their repository's best, for their task."""
    best = scores.groupBy(*_group(scores)).agg(F.max("score").alias("best"))
    return scores.join(best, _group(scores)).where((F.col("score") > 0) & (F.col("score") >= F.col("best") * WEIGHTS["share"])).drop("best")


def _boosted(scores: DataFrame, boosts: DataFrame) -> DataFrame:
    """``scores`` plus (repo, rel_path, place, amount, reason) boosts, added in order of ``place`` so sums come out alike every time."""
    keys = [*_group(scores), "rel_path"]
    gathered = boosts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "amount", "reason"))).alias("boosts"))
    joined = scores.join(gathered, keys, "left")
    total = F.aggregate("boosts", F.col("score"), lambda s, b: s + b["amount"])
    told = F.concat("reasons", F.transform("boosts", lambda b: b["reason"]))
    return joined.select(*keys, F.coalesce(total, F.col("score")).alias("score"), F.coalesce(told, F.col("reasons")).alias("reasons"))


def expand_dependencies(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that leading files import gain a share of the importer's score; one hop, from the scores as they came in."""
    local = edges.where("kind = 'local'").select("repo", F.col("source").alias("rel_path"), "target", "ord")
    from_leaders = _leaders(scores).select(*_group(scores), "rel_path", "score").join(local, ["repo", "rel_path"])
    boosts = from_leaders.select(
        *_group(scores),
        F.col("target").alias("rel_path"),
        F.struct((-F.col("score")).alias("s"), F.col("rel_path").alias("p"), "ord").alias("place"),
        (F.col("score") * WEIGHTS["dep"]).alias("amount"),
        F.concat(F.lit("dep:"), paths.name(F.col("rel_path"))).alias("reason"),
    )
    return _boosted(scores, boosts)


def test_candidates(path: Column) -> Column:
    """Where the tests of a file may be; a path may be named twice and then counts twice."""
    up, base = paths.parent(path), paths.stem(path)
    inside = F.when(up != "", F.concat(up, F.lit("/"))).otherwise("")
    test = F.concat(F.lit("test_"), base, F.lit(".py"))
    return F.array(
        F.concat(inside, test), F.concat(inside, base, F.lit("_test.py")), F.concat(F.lit("tests/"), test), F.concat(F.lit("tests/"), inside, test), F.concat(F.lit("test/"), test)
    )


def pair_tests(scores: DataFrame) -> DataFrame:
    """Tests of leading files gain a bonus for each candidate place that names them."""
    leaders = _leaders(scores).select(*_group(scores), F.col("rel_path").alias("source"), F.posexplode(test_candidates(F.col("rel_path"))).alias("ord", "rel_path"))
    boosts = leaders.select(
        *_group(scores),
        "rel_path",
        F.struct(F.col("source").alias("p"), "ord").alias("place"),
        F.lit(WEIGHTS["pair"]).alias("amount"),
        F.concat(F.lit("test_pair:"), paths.name(F.col("source"))).alias("reason"),
    )
    return _boosted(scores, boosts)


def ranked(scores: DataFrame, min_score: float = 0.0) -> DataFrame:
    """Rows of at least ``min_score``; the order is score descending, then path, and is taken where rows are read in order."""
    return scores.where(F.col("score") >= min_score)


def rank_files(summaries: DataFrame, edges: DataFrame, keywords: Column, churn: DataFrame | None = None, memory_paths: Column | None = None, min_score: float = 0.0) -> DataFrame:
    """The whole ranking of each repository for one task.

    A step reads the scores before it several times (best of a repository, leaders, all rows), so they are kept once in between: a few
    numbers and words a file, instead of token sets made over and over.
    """
    return _boosts(scored(summaries, keywords, churn, memory_paths), edges, min_score)


def _boosts(scores: DataFrame, edges: DataFrame, min_score: float) -> DataFrame:
    return ranked(pair_tests(checkpointed(expand_dependencies(checkpointed(scores), edges))), min_score)


def top_files(ranking: DataFrame, n: int) -> DataFrame:
    """The first ``n`` of each repository; each partition keeps at most ``n`` of a repository before anything moves."""
    order = Window.partitionBy(*_group(ranking)).orderBy(F.desc("score"), "rel_path")
    return ranking.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def task_hits(summaries: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, repo, rel_path, score, reasons) of many tasks at once, for files with at least one keyword hit.

    An inverted index instead of a product: summary tokens and task keywords meet in an equi-join on the token, and hits are
    counted per task, file and signal. Files without a hit differ by no task and are left to the caller.
    """
    per_file, score, reasons = _hits_of_tasks(summaries, tasks), F.lit(0.0), []
    for name in WEIGHT_OF:
        score = score + F.size(f"hits_{name}") * F.lit(WEIGHT_OF[name])
        reasons.append(F.when(F.size(f"hits_{name}") > 0, F.concat(F.lit(f"{name}:"), F.array_join(F.slice(f"hits_{name}", 1, 4), ","))))
    return per_file.select("task_id", "repo", "rel_path", score.alias("score"), F.array_compact(F.array(*reasons)).alias("reasons"))


def _hits_of_tasks(summaries: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, repo, rel_path, hits_<signal>): sorted hits of files that have any."""
    words = tasks.where(F.col("task").isNotNull()).select("task_id", F.explode(text.keywords(F.col("task"))).alias("token")).distinct()
    rows = summaries.where(~is_secret_file(F.col("rel_path"))).dropDuplicates(["repo", "rel_path"])

    def tag(n: int, tokens: Column) -> Column:
        return F.transform(tokens, lambda t: F.struct(F.lit(n).alias("signal"), t.alias("token")))

    tagged = F.array(*[tag(n, tokens) for n, tokens in enumerate(signal_tokens().values())])
    postings = rows.select("repo", "rel_path", F.explode(F.flatten(tagged)).alias("p")).select("repo", "rel_path", "p.signal", "p.token")
    wanted = words.select("token").distinct()
    hits = postings.join(wanted, "token", "left_semi").join(words, "token")  # only tokens some task asks for go on
    names = list(WEIGHT_OF)
    return hits.groupBy("task_id", "repo", "rel_path").agg(*[F.array_sort(F.collect_set(F.when(F.col("signal") == n, F.col("token")))).alias(f"hits_{name}") for n, name in enumerate(names)])
