"""Queries of ranking, budgets, churn and savings, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from packlake import dims
from packlake.operators import blocks, budget, classify, graph, rank
from packlake.operators.churn import churn_score, churn_top
from packlake.functions import paths, text
from packlake.plans import corpus, sql
from packlake.session import table

QUERIES, ORACLES = {}, {}
#: Paths that the corpus queries take as mentioned in the project's notes.
MENTIONED = ("README.md", "conftest.py", "core/ledger.py")


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def _memory():
    return F.array(*map(F.lit, MENTIONED))


def _js_edges(spark, sf_dir):
    """Edges that SQL can follow as well: those of JavaScript and TypeScript."""
    return graph.javascript_edges(corpus.files(spark, sf_dir))


def _all_edges(spark, sf_dir):
    return graph.graph_edges(corpus.files(spark, sf_dir))


def _joined(scores, *names):
    return scores.select("repo", "rel_path", F.round("score", 6).alias("score"), F.array_join("reasons", "; ").alias("reasons"), *names)


W = dims.WEIGHTS
_PLAIN = "nullif(array_to_string(list_filter(string_split(replace(trim(rel_path), '\\', '/'), '/'), lambda x: x <> '' AND x <> '.'), '/'), '')"
_CHURN = f"""churn AS (SELECT repo, path AS rel_path, count(*) AS commits FROM (SELECT repo, {_PLAIN} AS path FROM file_snapshots WHERE loaded_at >= (SELECT max(loaded_at) FROM file_snapshots) - INTERVAL {corpus.CHURN_DAYS} DAY)
  WHERE path IS NOT NULL GROUP BY 1, 2)"""
_TASK = f"task_kw AS (SELECT task_id, coalesce(budget, {dims.DEFAULT_BUDGET}) AS budget, {sql.keywords('task')} AS kw FROM tasks WHERE task IS NOT NULL)"


def _hits(expr: str) -> str:
    return f"list_sort(list_intersect(kw, {expr}))"


_DESC = "coalesce(purpose, '') || ' ' || coalesce(docstring, '')"
_SIGNALS = f"""signals AS (
  SELECT task_id, repo, rel_path, {_hits(sql.tokens('rel_path'))} AS h0, {_hits("list_distinct(list_transform(list_concat(coalesce(exports, []), coalesce(symbols, [])), lambda s: lower(s)))")} AS h1,
    {_hits(sql.tokens(_DESC))} AS h2, {_hits("list_distinct(list_transform(coalesce(imports, []), lambda i: string_split(lower(i), '.')[1]))")} AS h3
  FROM summaries_1, task_kw WHERE NOT {sql.is_secret('rel_path')})"""
_SCORES = f"""scored AS (
  SELECT s.task_id, s.repo, s.rel_path,
    len(h0) * {W['path']} + len(h1) * {W['symbol']} + len(h2) * {W['keyword']} + len(h3) * {W['import']}
    + CASE WHEN lower({sql.name('s.rel_path')}) IN {sql.in_list(dims.PRIORITY_NAMES)} THEN {W['priority']}::DOUBLE ELSE 0.0 END
    + CASE WHEN s.rel_path IN {sql.in_list(MENTIONED)} OR {sql.name('s.rel_path')} IN {sql.in_list(MENTIONED)} THEN {W['memory']}::DOUBLE ELSE 0.0 END
    + CASE WHEN coalesce(commits, 0) > 0 THEN least(commits, 5) * {W['churn']}::DOUBLE ELSE 0.0 END AS score,
    list_filter([CASE WHEN len(h0) > 0 THEN 'path:' || array_to_string(h0[1:4], ',') END, CASE WHEN len(h1) > 0 THEN 'symbol:' || array_to_string(h1[1:4], ',') END,
      CASE WHEN len(h2) > 0 THEN 'purpose:' || array_to_string(h2[1:4], ',') END, CASE WHEN len(h3) > 0 THEN 'imports:' || array_to_string(h3[1:4], ',') END,
      CASE WHEN lower({sql.name('s.rel_path')}) IN {sql.in_list(dims.PRIORITY_NAMES)} THEN 'priority:readme/config' END,
      CASE WHEN s.rel_path IN {sql.in_list(MENTIONED)} OR {sql.name('s.rel_path')} IN {sql.in_list(MENTIONED)} THEN 'memory:mentioned' END,
      CASE WHEN coalesce(commits, 0) > 0 THEN 'churn:' || commits || 'commits' END], lambda x: x IS NOT NULL) AS reasons
  FROM signals s LEFT JOIN churn c ON s.repo = c.repo AND s.rel_path = c.rel_path)"""
_FROM = r"""import\s+(?:type\s+)?(?:[^''";\n]*?from\s+)?[''"]([^''"]+)[''"]"""
_REQUIRE = r"""\brequire\s*\(\s*[''"]([^''"]+)[''"]\s*\)"""
_NORMAL = """list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter(string_split({p}, '/'), lambda s: s <> '' AND s <> '.'), lambda s: [s])),
      lambda done, s: CASE WHEN s[1] = '..' AND len(done) > 0 AND done[-1] <> '..' THEN done[1:len(done) - 1] ELSE list_concat(done, s) END)"""
_ENDS = ["", *dims.JS_SUFFIXES, *[f"/index{s}" for s in dims.JS_SUFFIXES]]
JS_EDGES = f"""
  js_found AS (
    SELECT repo, rel_path, unnest(list_concat(regexp_extract_all(content, '{_FROM}'), regexp_extract_all(content, '{_REQUIRE}'))) AS raw,
      unnest(list_concat(regexp_extract_all(content, '{_FROM}', 1), regexp_extract_all(content, '{_REQUIRE}', 1))) AS module,
      unnest(range(len(list_concat(regexp_extract_all(content, '{_FROM}', 1), regexp_extract_all(content, '{_REQUIRE}', 1))))) AS ord
    FROM files WHERE {sql.language('rel_path')} IN ('JavaScript', 'TypeScript')),
  js_based AS (
    SELECT *, starts_with(module, '.') OR starts_with(module, '/') AS relative,
      CASE WHEN starts_with(module, '/') THEN regexp_replace(module, '^/+', '')
        ELSE array_to_string({_NORMAL.format(p=f"CASE WHEN {sql.parent('rel_path')} <> '' THEN {sql.parent('rel_path')} || '/' || module ELSE module END")}, '/') END AS base
    FROM js_found),
  js_tried AS (SELECT b.repo, b.rel_path, b.ord, place, base || e AS candidate FROM js_based b, (SELECT unnest({sql.array(_ENDS)}) AS e, unnest(range({len(_ENDS)})) AS place) WHERE relative),
  js_hit AS (SELECT t.repo, t.rel_path, t.ord, arg_min(candidate, place) AS target FROM js_tried t WHERE EXISTS (SELECT 1 FROM files f WHERE f.repo = t.repo AND f.rel_path = t.candidate) GROUP BY 1, 2, 3),
  js_edges AS (
    SELECT b.repo, b.rel_path AS source, coalesce(h.target, CASE WHEN relative THEN module ELSE string_split(module, '/')[1] END) AS target,
      CASE WHEN h.target IS NOT NULL THEN 'local' WHEN relative THEN 'unresolved' ELSE 'package' END AS kind, left(raw, 120) AS raw_import, b.ord::INT AS ord
    FROM js_based b LEFT JOIN js_hit h ON b.repo = h.repo AND b.rel_path = h.rel_path AND b.ord = h.ord
    WHERE coalesce(h.target, CASE WHEN relative THEN module ELSE string_split(module, '/')[1] END) <> ''
    QUALIFY row_number() OVER (PARTITION BY b.repo, b.rel_path, kind = 'unresolved', module ORDER BY b.ord) = 1 OR kind = 'unresolved')"""
_EXPANDED = f"""
  best AS (SELECT task_id, repo, max(score) AS best FROM scored GROUP BY 1, 2),
  leaders AS (SELECT s.* FROM scored s JOIN best b ON s.task_id = b.task_id AND s.repo = b.repo WHERE score > 0 AND score >= best * {W['share']}::DOUBLE),
  dep_boost AS (SELECT l.task_id, e.repo, e.target AS rel_path, list(l.score * {W['dep']}::DOUBLE ORDER BY l.score DESC, l.rel_path, e.ord) AS amounts, list('dep:' || {sql.name('l.rel_path')} ORDER BY l.score DESC, l.rel_path, e.ord) AS told
    FROM leaders l JOIN js_edges e ON l.repo = e.repo AND l.rel_path = e.source AND e.kind = 'local' GROUP BY 1, 2, 3),
  expanded AS (SELECT s.task_id, s.repo, s.rel_path, CASE WHEN d.repo IS NULL THEN s.score ELSE list_reduce(list_prepend(s.score, d.amounts), lambda a, b: a + b) END AS score, list_concat(s.reasons, coalesce(d.told, [])) AS reasons
    FROM scored s LEFT JOIN dep_boost d ON s.task_id = d.task_id AND s.repo = d.repo AND s.rel_path = d.rel_path)"""
_INSIDE = f"CASE WHEN {sql.parent('l.rel_path')} <> '' THEN {sql.parent('l.rel_path')} || '/' ELSE '' END"
_STEM = f"({sql.stem('l.rel_path')})"
_PAIRED = f"""
  best2 AS (SELECT task_id, repo, max(score) AS best FROM expanded GROUP BY 1, 2),
  leaders2 AS (SELECT s.* FROM expanded s JOIN best2 b ON s.task_id = b.task_id AND s.repo = b.repo WHERE score > 0 AND score >= best * {W['share']}::DOUBLE),
  places AS (SELECT l.task_id, l.repo, l.rel_path AS source, unnest([{_INSIDE} || 'test_' || {_STEM} || '.py', {_INSIDE} || {_STEM} || '_test.py', 'tests/test_' || {_STEM} || '.py', 'tests/' || {_INSIDE} || 'test_' || {_STEM} || '.py', 'test/test_' || {_STEM} || '.py']) AS rel_path,
    unnest([0, 1, 2, 3, 4]) AS ord FROM leaders2 l),
  pair_boost AS (SELECT task_id, repo, rel_path, list({W['pair']}::DOUBLE ORDER BY source, ord) AS amounts, list('test_pair:' || {sql.name('source')} ORDER BY source, ord) AS told FROM places GROUP BY 1, 2, 3),
  ranking AS (SELECT s.task_id, s.repo, s.rel_path, CASE WHEN d.repo IS NULL THEN s.score ELSE list_reduce(list_prepend(s.score, d.amounts), lambda a, b: a + b) END AS score, list_concat(s.reasons, coalesce(d.told, [])) AS reasons
    FROM expanded s LEFT JOIN pair_boost d ON s.task_id = d.task_id AND s.repo = d.repo AND s.rel_path = d.rel_path)"""
_BASE = f"WITH RECURSIVE {sql.SUMMARIES}, {_TASK}, {_CHURN}, {_SIGNALS}, {_SCORES}"
_RANKING = f"{_BASE}, {JS_EDGES}, {_EXPANDED}, {_PAIRED}"
_TOLD = "round(score, 6) AS score, array_to_string(reasons, '; ') AS reasons"
_FORMS = f"""
  forms AS (SELECT r.task_id, r.repo, r.rel_path, r.score, r.reasons, row_number() OVER (PARTITION BY r.task_id, r.repo ORDER BY score DESC, r.rel_path) AS rank,
    {sql.token_count('shown')} AS full_tok, {sql.token_count(sql.head_lines('shown', dims.SNIPPET_LINES))} AS snip_tok, {sql.token_count('told')} AS sum_tok
    FROM ranking r JOIN (SELECT repo, rel_path, {sql.summary_text()} AS told FROM summaries_1) t ON r.repo = t.repo AND r.rel_path = t.rel_path
    LEFT JOIN (SELECT repo, rel_path, {sql.redact('content')} AS shown FROM files) f ON r.repo = f.repo AND r.rel_path = f.rel_path),
  walk AS (
    SELECT task_id, repo, 0::BIGINT AS rank, '' AS rel_path, NULL::VARCHAR AS kind, NULL::BIGINT AS tokens, budget::BIGINT AS remaining FROM (SELECT DISTINCT task_id, repo FROM forms) JOIN task_kw USING (task_id)
    UNION ALL
    SELECT f.task_id, f.repo, f.rank, f.rel_path,
      CASE WHEN w.remaining <= 0 THEN NULL WHEN full_tok <= w.remaining THEN 'full' WHEN snip_tok <= w.remaining THEN 'snippet' WHEN sum_tok <= w.remaining THEN 'summary' END,
      CASE WHEN w.remaining <= 0 THEN NULL WHEN full_tok <= w.remaining THEN full_tok WHEN snip_tok <= w.remaining THEN snip_tok WHEN sum_tok <= w.remaining THEN sum_tok END,
      w.remaining - coalesce(CASE WHEN w.remaining <= 0 THEN NULL WHEN full_tok <= w.remaining THEN full_tok WHEN snip_tok <= w.remaining THEN snip_tok WHEN sum_tok <= w.remaining THEN sum_tok END, 0)
    FROM walk w JOIN forms f ON f.task_id = w.task_id AND f.repo = w.repo AND f.rank = w.rank + 1),
  selected AS (SELECT w.task_id, w.repo, w.rel_path, w.kind, w.tokens::INT AS tokens, row_number() OVER (PARTITION BY w.task_id, w.repo ORDER BY w.rank)::INT AS select_no, f.score, f.reasons FROM walk w JOIN forms f ON w.task_id = f.task_id AND w.repo = f.repo AND w.rank = f.rank WHERE w.kind IS NOT NULL)"""


_RANKED = "SELECT *, row_number() OVER (PARTITION BY task_id, repo ORDER BY score DESC, rel_path)::INT AS rank FROM ranking"
_LEFT_OUT = f"""SELECT task_id, repo, rel_path, cause, CASE WHEN starts_with(lower({sql.name('rel_path')}), '.env') OR regexp_matches(lower({sql.name('rel_path')}), 'secret|credential|password') THEN 'secret/credential file' ELSE 'over budget' END AS note
FROM (SELECT task_id, repo, rel_path, 'secret' AS cause FROM summaries_1, task_kw WHERE {sql.is_secret('rel_path')} UNION ALL
  SELECT r.task_id, r.repo, r.rel_path, 'budget' FROM ranking r WHERE NOT EXISTS (SELECT 1 FROM selected s WHERE s.task_id = r.task_id AND s.repo = r.repo AND s.rel_path = r.rel_path))"""
_SAVED = """t AS (SELECT task_id, repo, sum(coalesce(line_count, 0)::BIGINT * 15)::BIGINT AS total FROM summaries_1, task_kw GROUP BY 1, 2), u AS (SELECT task_id, repo, sum(tokens)::BIGINT AS used FROM selected GROUP BY 1, 2)
SELECT t.task_id, t.repo, total AS repo_total_tokens, coalesce(used, 0)::BIGINT AS used_tokens, greatest(0, total - coalesce(used, 0))::BIGINT AS saved_tokens,
  CASE WHEN total > 0 THEN trunc(greatest(0, total - coalesce(used, 0)) / total * 100)::BIGINT ELSE 0 END AS saved_pct FROM t LEFT JOIN u ON t.task_id = u.task_id AND t.repo = u.repo"""


# Every task is ranked over every file, along the imports of all languages, and selects within its own budget. Imports of Python come from its
# parser, which SQL cannot do: the queries that follow imports are tested against brute force. Beside each stands the same operator over the edges of
# JavaScript and TypeScript (``_scripts``), which SQL can follow, for the comparison with SQL.


def _exploded(runs, *names):
    """Runs of tasks as a row for each."""
    return runs.select(*names, F.explode("task_ids").alias("task_id"))


def _over_tasks(spark, sf_dir, edges_of, schema, work, sized=False):
    """``work`` over the whole ranking; with the tokens of each form where it selects."""
    summaries = corpus.summaries(spark, sf_dir)
    sizes = budget.forms(summaries, corpus.files(spark, sf_dir)) if sized else None
    return rank.over_tasks(summaries, edges_of(spark, sf_dir), corpus.tasks(spark, sf_dir), corpus.churn_counts(spark, sf_dir), _memory(), schema, work, sizes)


@query(_BASE + f" SELECT task_id, repo, rel_path, {_TOLD} FROM scored")
def score_signals(spark, sf_dir):
    """The scores of every file for every task."""
    runs = rank.scored_runs(corpus.summaries(spark, sf_dir), corpus.tasks(spark, sf_dir), corpus.churn_counts(spark, sf_dir), _memory())
    return _exploded(runs, "repo", "rel_path", "score", "reasons")


def _dep_expand(spark, sf_dir, edges_of):
    return _exploded(_over_tasks(spark, sf_dir, edges_of, blocks.RUNS, blocks.expanded), "repo", "rel_path", "score", "reasons")


def _test_pairs(spark, sf_dir, edges_of):
    return _over_tasks(spark, sf_dir, edges_of, blocks.CELLS_OF, blocks.paired)


def _rank_topk(spark, sf_dir, edges_of):
    return _over_tasks(spark, sf_dir, edges_of, f"{blocks.CELLS_OF}, rank int", blocks.top(20))


def _budget_select(spark, sf_dir, edges_of):
    """The flagship: for every task, the files each repository shows within the task's budget."""
    return _over_tasks(spark, sf_dir, edges_of, f"{blocks.CELLS_OF}, kind string, tokens int, select_no int", blocks.selected, sized=True)


def _budget_excluded(spark, sf_dir, edges_of):
    left = _over_tasks(spark, sf_dir, edges_of, "repo string, rel_path string, task_ids array<bigint>", blocks.left, sized=True)
    return budget.excluded(corpus.summaries(spark, sf_dir), left, corpus.tasks(spark, sf_dir))


def _savings(spark, sf_dir, edges_of):
    used = _over_tasks(spark, sf_dir, edges_of, "repo string, task_ids array<bigint>, used array<bigint>", blocks.used, sized=True)
    return budget.savings(corpus.summaries(spark, sf_dir), used, corpus.tasks(spark, sf_dir))


def _both(name, run, oracle):
    """``name`` over the imports of all languages, and ``name``_scripts over those SQL can follow."""
    QUERIES[name] = partial(run, edges_of=_all_edges)
    QUERIES[f"{name}_scripts"] = partial(run, edges_of=_js_edges)
    ORACLES[f"{name}_scripts"] = oracle


_both("dep_expand", _dep_expand, f"{_BASE}, {JS_EDGES}, {_EXPANDED} SELECT task_id, repo, rel_path, {_TOLD} FROM expanded")
_both("test_pairs", _test_pairs, _RANKING + f" SELECT task_id, repo, rel_path, {_TOLD} FROM ranking WHERE list_has_any(list_transform(reasons, lambda x: x[1:10]), ['test_pair:'])")
_both("rank_topk", _rank_topk, _RANKING + f" SELECT task_id, repo, rel_path, rank, {_TOLD} FROM ({_RANKED}) WHERE rank <= 20")
_both("budget_select", _budget_select, f"{_RANKING}, {_FORMS} SELECT task_id, repo, rel_path, kind, tokens, select_no, {_TOLD} FROM selected")
_both("budget_excluded", _budget_excluded, f"{_RANKING}, {_FORMS} {_LEFT_OUT}")
_both("savings", _savings, f"{_RANKING}, {_FORMS}, {_SAVED}")


_MANY = f"""WITH {sql.SUMMARIES}, k AS (SELECT DISTINCT task_id, unnest({sql.keywords('task')}) AS token FROM tasks),
  p AS (SELECT repo, rel_path, 0 AS s, unnest({sql.tokens('rel_path')}) AS token FROM summaries_1 WHERE NOT {sql.is_secret('rel_path')}
    UNION ALL SELECT repo, rel_path, 1, unnest(list_distinct(list_transform(list_concat(coalesce(exports, []), coalesce(symbols, [])), lambda s: lower(s)))) FROM summaries_1 WHERE NOT {sql.is_secret('rel_path')}
    UNION ALL SELECT repo, rel_path, 2, unnest({sql.tokens(_DESC)}) FROM summaries_1 WHERE NOT {sql.is_secret('rel_path')}
    UNION ALL SELECT repo, rel_path, 3, unnest(list_distinct(list_transform(coalesce(imports, []), lambda i: string_split(lower(i), '.')[1]))) FROM summaries_1 WHERE NOT {sql.is_secret('rel_path')}),
  h AS (SELECT task_id, repo, rel_path, s, list_sort(list(DISTINCT p.token)) AS hits FROM p JOIN k ON p.token = k.token GROUP BY 1, 2, 3, 4)
SELECT task_id, repo, rel_path, round(sum(len(hits) * CASE s WHEN 0 THEN {W['path']} WHEN 1 THEN {W['symbol']} WHEN 2 THEN {W['keyword']} ELSE {W['import']} END), 6)::DOUBLE AS score,
  string_agg(CASE s WHEN 0 THEN 'path:' WHEN 1 THEN 'symbol:' WHEN 2 THEN 'purpose:' ELSE 'imports:' END || array_to_string(hits[1:4], ','), '; ' ORDER BY s) AS reasons FROM h GROUP BY 1, 2, 3"""


@query(_MANY)
def task_hits(spark, sf_dir):
    """All tasks at once, through the inverted index."""
    scores = rank.task_hits(corpus.summaries(spark, sf_dir), table(spark, sf_dir, "tasks"))
    return _joined(scores, "task_id")


@query(f"WITH {_CHURN} SELECT repo, rel_path, commits, round(least(commits, 5) * {W['churn']}, 6)::DOUBLE AS churn_score FROM churn")
def churn_scores(spark, sf_dir):
    return corpus.churn_counts(spark, sf_dir).select("repo", "rel_path", "commits", F.round(churn_score(F.col("commits")), 6).alias("churn_score"))


@query(f"WITH {_CHURN} SELECT repo, rel_path, commits FROM churn ORDER BY commits DESC, repo, rel_path LIMIT 50")
def churn_report(spark, sf_dir):
    return churn_top(corpus.churn_counts(spark, sf_dir), 50)


_EVENTS = "SELECT user_id::VARCHAR AS user_id, event_type AS rel_path, count(*) AS commits FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY AND event_type IS NOT NULL GROUP BY 1, 2"


@query(_EVENTS)
def churn_of_events(spark, sf_dir):
    """Churn over an event log, one path per kind of event."""
    from packlake.operators.churn import churn

    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("path"), "ts")
    return churn(log, 7, key="user_id")


@query(f"""WITH {sql.SUMMARIES} SELECT repo, rel_path FROM summaries_1 WHERE NOT (starts_with({sql.name('rel_path')}, 'test_') OR ends_with({sql.name('rel_path')}, '_test.py') OR list_has_any(string_split(rel_path, '/'), ['tests', 'test', '__tests__', 'spec'])) AND NOT {sql.is_secret('rel_path')}""")
def without_tests(spark, sf_dir):
    """The rows ranking starts from when tests are left out."""
    rows = corpus.summaries(spark, sf_dir).where(~paths.is_test(F.col("rel_path")) & ~classify.is_secret_file(F.col("rel_path")))
    return rows.select("repo", "rel_path").distinct()


@query(f"WITH {sql.SUMMARIES} SELECT repo, rel_path, {sql.summary_text()} AS summary_text, {sql.token_count(sql.summary_text())}::BIGINT AS n_tokens FROM summaries_1")
def summary_texts(spark, sf_dir):
    rows = corpus.summaries(spark, sf_dir).dropDuplicates(["repo", "rel_path"])
    return rows.select("repo", "rel_path", budget.summary_text().alias("summary_text")).withColumn("n_tokens", text.token_count(F.col("summary_text")).cast("bigint"))
