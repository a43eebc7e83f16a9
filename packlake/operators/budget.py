"""Greedy selection of ranked files within a token budget, with a ladder of ever shorter forms."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlake import dims
from packlake.functions import paths, text
from packlake.functions.redaction import redact

KINDS = ("full", "snippet", "summary")


def summary_text() -> Column:
    """A summary row as Markdown."""
    some = lambda name, n: F.slice(F.coalesce(F.col(name), F.array().cast("array<string>")), 1, n)
    ticked = F.array_join(F.transform(some("exports", 8), lambda e: F.concat(F.lit("`"), e, F.lit("`"))), ", ")
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"- **{label}:** "), value))
    return F.array_join(
        F.array_compact(
            F.array(
                F.concat(F.lit("### `"), F.col("rel_path"), F.lit("` ("), F.coalesce("language", F.lit("")), F.lit(", summary)")),
                F.lit(""),
                line("Purpose", F.col("purpose")),
                line("Exports", ticked),
                line("Symbols", F.array_join(some("symbols", 8), ", ")),
                line("Imports", F.array_join(some("imports", 8), ", ")),
                line("Doc", F.left("docstring", F.lit(200))),
                F.lit(""),
            )
        ),
        "\n",
    )


def wrapped(path: Column, content: Column, note: Column | None = None) -> Column:
    """A content in a fenced block under its path."""
    ending = F.regexp_replace(F.regexp_extract(paths.name(path), r"^.+\.([^.]+)$", 1), r"^\.+", "")
    fence = F.when(ending != "", ending).otherwise("text")
    head = F.concat(F.lit("### `"), path, F.lit("`"), F.coalesce(F.concat(F.lit(" ("), note, F.lit(")")), F.lit("")) if note is not None else F.lit(""))
    return F.concat(head, F.lit("\n```"), fence, F.lit("\n"), content, F.lit("\n```\n"))


def forms(summaries: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, rel_path, full_tok, snip_tok, sum_tok): tokens of each form, redacted before counting; null where a form is not there.

    Texts stay behind, and are counted before anything moves: ranking and selection carry three numbers a file, and only what is selected is joined to its text again.
    """
    shown = files.select("repo", "rel_path", redact(F.col("content")).alias("shown"))
    counted = shown.select("repo", "rel_path", text.token_count(F.col("shown")).alias("full_tok"), text.token_count(text.head_lines(F.col("shown"), dims.SNIPPET_LINES)).alias("snip_tok"))
    rows = summaries.select("repo", "rel_path", text.token_count(summary_text()).alias("sum_tok"))
    joined = rows.dropDuplicates(["repo", "rel_path"]).join(counted.dropDuplicates(["repo", "rel_path"]), ["repo", "rel_path"], "left")
    return joined.select("repo", "rel_path", "full_tok", "snip_tok", "sum_tok")


def fold(rows: list[tuple], remaining: int) -> tuple[list[tuple[int, str]], int]:
    """Greedy choice over (full, snippet, summary) token triples in rank order: (position, kind) of what is taken, and the tokens left.

    A row that does not fit is passed over and later, smaller ones may still fit.
    """
    taken = []
    for at, sizes in enumerate(rows):
        if remaining <= 0:
            break
        for kind, tokens in zip(KINDS, sizes):
            if tokens is not None and tokens <= remaining:
                taken.append((at, kind))
                remaining -= tokens
                break
    return taken, remaining


def select_within(ranking: DataFrame, keys: list[str], budget: Column | int = dims.DEFAULT_BUDGET) -> DataFrame:
    """The rows of ``ranking`` (keys, rel_path, score, full_tok, snip_tok, sum_tok) that a greedy pass in rank order takes.

    Adds ``kind``, ``tokens`` and ``select_no``. No group is read as a whole, and nothing loops. Tokens left only ever fall, so of the rows whose
    smallest form has ``s`` tokens those taken are the first ones in rank order, ``budget / s`` at most: one window per group and smallest form cuts
    each group to at most budget x ln(budget) rows, however many it has, and one sorted pass folds them with three numbers of state.
    Files of no tokens cost nothing and may be any number: they are taken if they stand before the row that used the last token.
    A null or missing form is not there; a budget of 0 or less takes nothing.
    """
    kept = [c for c in ("reasons",) if c in ranking.columns]
    least = F.least(*[F.coalesce(F.col(c), F.lit(2**31 - 1)) for c in ("full_tok", "snip_tok", "sum_tok")])
    rows = ranking.withColumns({"_budget": (budget if isinstance(budget, Column) else F.lit(budget)).cast("int"), "_least": least}).where((F.col("_budget") > 0) & (F.col("_least") <= F.col("_budget")))
    order = Window.partitionBy(*keys, "_least").orderBy(F.desc("score"), "rel_path")
    cut = rows.where("full_tok IS NULL OR full_tok > 0").withColumn("_n", F.row_number().over(order)).where(F.col("_n") * F.col("_least") <= F.col("_budget"))
    folded = cut.repartition(*keys).sortWithinPartitions(*keys, F.desc("score"), "rel_path")
    types = dict(ranking.dtypes)
    columns = [*keys, "rel_path", "score", *kept]
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in columns], "kind string", "tokens int", "_end boolean"])
    picked = folded.select(*columns, "full_tok", "snip_tok", "sum_tok", "_budget").mapInArrow(_fold_groups(keys, columns), schema)
    # the row that used the last token of a group; rows of no tokens behind it are not taken
    ends = picked.where("_end").select(*keys, F.col("score").alias("_score"), F.col("rel_path").alias("_path"))
    empty = rows.where("full_tok = 0").join(ends, keys, "left")
    empty = empty.where(F.col("_score").isNull() | (F.col("score") > F.col("_score")) | ((F.col("score") == F.col("_score")) & (F.col("rel_path") < F.col("_path"))))
    chosen = picked.select(*columns, "kind", "tokens").unionByName(empty.select(*columns, F.lit("full").alias("kind"), F.lit(0).alias("tokens")))
    return chosen.withColumn("select_no", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "rel_path")))


def _fold_groups(keys: list[str], columns: list[str]):
    """The greedy pass over rows sorted by group and rank, group after group; batches may end anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, left = None, 0
        for batch in batches:
            key_columns = [batch.column(k).to_pylist() for k in keys]
            sizes = zip(*[batch.column(c).to_pylist() for c in ("full_tok", "snip_tok", "sum_tok")])
            budgets = batch.column("_budget").to_pylist()
            taken, kinds, tokens, ends = [], [], [], []
            for at, (key, forms_of) in enumerate(zip(zip(*key_columns), sizes)):
                if key != group:
                    group, left = key, budgets[at]
                if left <= 0:
                    continue
                for kind, size in zip(KINDS, forms_of):
                    if size is not None and size <= left:
                        left -= size
                        taken.append(at)
                        kinds.append(kind)
                        tokens.append(size)
                        ends.append(left == 0)
                        break
            rows = batch.select(columns).take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(kinds, pa.string()), pa.array(tokens, pa.int32()), pa.array(ends, pa.bool_())], [*columns, "kind", "tokens", "_end"])

    return run


def with_texts(selected: DataFrame, summaries: DataFrame, files: DataFrame) -> DataFrame:
    """``selected`` (repo, rel_path, kind, ...) with the text of its form; contents are joined for selected files alone."""
    keys = ["repo", "rel_path"]
    shown = files.join(selected.where("kind <> 'summary'").select(*keys).distinct(), keys, "left_semi").select(*keys, redact(F.col("content")).alias("shown")).dropDuplicates(keys)
    told = summaries.join(selected.where("kind = 'summary'").select(*keys).distinct(), keys, "left_semi").dropDuplicates(keys).select(*keys, summary_text().alias("told"))
    joined = selected.join(shown, keys, "left").join(told, keys, "left")
    lines = text.line_count(F.col("shown"))
    note = F.concat(F.lit("snippet: first "), F.least(lines, F.lit(dims.SNIPPET_LINES)).cast("string"), F.lit(" of "), lines.cast("string"), F.lit(" lines"))
    path = F.col("rel_path")
    content = (
        F.when(F.col("kind") == "full", wrapped(path, F.col("shown")))
        .when(F.col("kind") == "snippet", wrapped(path, text.head_lines(F.col("shown"), dims.SNIPPET_LINES), note))
        .otherwise(F.col("told"))
    )
    return joined.withColumn("content", content).drop("shown", "told")


def excluded(summaries: DataFrame, left: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, repo, rel_path, cause, note): for each task the files with secret names, then ranked ones that found no room (``left``: repo, rel_path, task_ids)."""
    from packlake.operators.classify import exclusion_label, is_secret_file

    keys = ["task_id", "repo", "rel_path", "cause", "note"]
    secret = summaries.where(is_secret_file(F.col("rel_path"))).select("repo", "rel_path").distinct().withColumns({"cause": F.lit("secret"), "note": exclusion_label(F.col("rel_path"))})
    # a select of its own: beside the explode, Spark would work the label out again for every task
    labelled = left.withColumns({"cause": F.lit("budget"), "note": exclusion_label(F.col("rel_path"))})
    over = labelled.select("repo", "rel_path", "cause", "note", F.explode("task_ids").alias("task_id"))
    return secret.crossJoin(tasks.select("task_id").distinct()).select(*keys).unionByName(over.select(*keys))


def savings(summaries: DataFrame, used: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, repo, repo_total_tokens, used_tokens, saved_tokens, saved_pct) per repository and task; totals count every file, secret ones too.

    ``used`` (repo, task_ids, used) has tokens used by runs of tasks, which stay runs until the totals are joined.
    """
    from packlake.operators.classify import is_secret_file

    ranked = F.max(F.col("repo").isNotNull() & F.col("rel_path").isNotNull() & ~is_secret_file(F.col("rel_path"))).alias("ranked")
    total = summaries.dropDuplicates(["repo", "rel_path"]).groupBy("repo").agg(F.sum(F.coalesce("line_count", F.lit(0)).cast("bigint") * 15).alias("repo_total_tokens"), ranked)
    some = total.join(used, "repo").select("repo", "repo_total_tokens", F.explode(F.arrays_zip("task_ids", "used")).alias("u")).select("repo", "repo_total_tokens", "u.task_ids", "u.used")
    none = total.where(~F.coalesce("ranked", F.lit(False))).select("repo", "repo_total_tokens").crossJoin(tasks.select("task_id").distinct())  # nothing but secrets
    rows = some.withColumnsRenamed({"task_ids": "task_id", "used": "used_tokens"}).unionByName(none.withColumn("used_tokens", F.lit(0).cast("bigint")))
    saved = F.greatest(F.lit(0).cast("bigint"), F.col("repo_total_tokens") - F.col("used_tokens"))
    pct = F.when(F.col("repo_total_tokens") > 0, (saved / F.col("repo_total_tokens") * 100).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return rows.select("task_id", "repo", "repo_total_tokens", "used_tokens", saved.alias("saved_tokens"), pct.alias("saved_pct"))
