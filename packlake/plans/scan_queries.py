"""Queries of scanning, classifying and text columns, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from packlake import dims
from packlake.functions import paths, text
from packlake.functions.redaction import PATTERNS, redact, redaction_counts
from packlake.operators import blocks, classify
from packlake.operators.symbols import symbol_weight
from packlake.plans import corpus, sql
from packlake.session import spread, table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return keep


_IGNORED = "(" + " OR ".join(
    [
        "regexp_matches({p}, '(?s)^.*\\.map$')", "regexp_matches({n}, '(?s)^.*\\.map$')",
        "{p} = 'fixtures'", "{n} = 'fixtures'",
        "regexp_matches({p}, '(?s)^static/.*\\.css$')", "regexp_matches({n}, '(?s)^static/.*\\.css$')", "regexp_matches({p}, '(?s)^.*.*/static/.*\\.css$')",
        "regexp_matches({p}, '(?s)^docs/.*.*/draft_.\\.md$')", "regexp_matches({p}, '(?s)^.*.*/docs/.*.*/draft_.\\.md$')",
        "regexp_matches({p}, '(?s)^.*-lock\\.json$')", "regexp_matches({n}, '(?s)^.*-lock\\.json$')",
        "{p} = '/rooted.py'", "{n} = '/rooted.py'",
    ]
) + ")"
_GITIGNORED = _IGNORED.format(p="rel_path", n=sql.name("rel_path"))
_SCANNED = f"""
WITH scanned AS (
  SELECT repo, rel_path, content, strlen(content)::BIGINT AS size,
    CASE WHEN regexp_matches({sql.name('rel_path')}, '\\.ipynb$|\\.min\\.css$|\\.min\\.js$') THEN 'ignored' WHEN {_GITIGNORED} THEN 'gitignore'
         WHEN coalesce(strlen(content), 0) > {dims.MAX_FILE_BYTES} THEN 'too_large' WHEN content IS NULL THEN 'permission_error'
         WHEN contains(content[1:{dims.BINARY_BYTES}], chr(0)) THEN 'binary' END AS reason
  FROM files WHERE NOT list_has_any({sql.dirs('rel_path')}, {sql.array(dims.EXCLUDED_DIRS)}))
"""


@query(_SCANNED + f"SELECT repo, rel_path, {sql.suffix('rel_path')} AS extension, size, {sql.line_count('content')}::BIGINT AS line_count, {sql.language('rel_path')} AS language, sha256(content) AS content_hash FROM scanned WHERE reason IS NULL")
def accepted_files(spark, sf_dir):
    return classify.accepted(corpus.scanned(spark, sf_dir)).drop("content")


@query(_SCANNED + "SELECT repo, rel_path, reason FROM scanned WHERE reason IS NOT NULL")
def skipped_files(spark, sf_dir):
    return corpus.scanned(spark, sf_dir).where(F.col("reason").isNotNull()).select("repo", "rel_path", "reason")


@query(_SCANNED + "SELECT reason, count(*) AS n_files FROM scanned WHERE reason IS NOT NULL GROUP BY reason ORDER BY reason")
def skip_counts(spark, sf_dir):
    return corpus.scanned(spark, sf_dir).where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n_files")).orderBy("reason")


@query(_SCANNED + f"SELECT {sql.language('rel_path')} AS language, count(*) AS n_files FROM scanned WHERE reason IS NULL GROUP BY 1 ORDER BY 2 DESC, 1")
def language_counts(spark, sf_dir):
    return classify.accepted(corpus.scanned(spark, sf_dir)).groupBy("language").agg(F.count(F.lit(1)).alias("n_files")).orderBy(F.desc("n_files"), "language")


@query(_SCANNED + "SELECT repo, sum(size)::BIGINT AS n_bytes, greatest(0, trunc(sum(size) / 3.5))::BIGINT AS est_tokens FROM scanned WHERE reason IS NULL GROUP BY repo")
def token_estimate(spark, sf_dir):
    total = classify.accepted(corpus.scanned(spark, sf_dir)).groupBy("repo").agg(F.sum("size").alias("n_bytes"))
    return total.select("repo", "n_bytes", text.bytes_to_tokens(F.col("n_bytes")).alias("est_tokens"))


@query(_SCANNED + f"""SELECT repo, rel_path, walk_no FROM (
  SELECT repo, rel_path, row_number() OVER (PARTITION BY repo ORDER BY list_append(list_transform({sql.dirs('rel_path')}, lambda d: '1' || d), '0' || {sql.name('rel_path')})) AS walk_no
  FROM scanned WHERE reason IS NULL) WHERE walk_no <= 25""")
def walk_order_cut(spark, sf_dir):
    return classify.first_files(classify.accepted(corpus.scanned(spark, sf_dir)), 25).select("repo", "rel_path", "walk_no")


@query(f"SELECT repo, rel_path FROM files WHERE {_GITIGNORED}")
def gitignore_match(spark, sf_dir):
    return table(spark, sf_dir, "files").where(paths.ignored_by(F.col("rel_path"), list(corpus.IGNORE_PATTERNS))).select("repo", "rel_path")


@query(f"SELECT doc_id, {sql.token_count('text')}::BIGINT AS n_tokens FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.token_count(F.col("text")).cast("bigint").alias("n_tokens"))


@query(f"SELECT doc_id, {sql.line_count('text')}::BIGINT AS n_lines, sha256(text) AS content_hash FROM documents")
def line_count_and_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.line_count(F.col("text")).cast("bigint").alias("n_lines"), F.sha2("text", 256).alias("content_hash"))


@query(f"SELECT task_id, unnest({sql.keywords('task')}) AS keyword FROM tasks")
def task_keywords(spark, sf_dir):
    return table(spark, sf_dir, "tasks").select("task_id", F.explode(text.keywords(F.col("task"))).alias("keyword"))


@query(f"SELECT token, count(*) AS n_files FROM (SELECT unnest({sql.tokens('rel_path')}) AS token FROM files) GROUP BY token")
def path_tokens(spark, sf_dir):
    return table(spark, sf_dir, "files").select(F.explode(text.tokens(F.col("rel_path"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n_files"))


_PARTS = (
    "list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '[_-]'), "
    "lambda p: length(p) > 1), lambda p: lower(p))))"
)


@query(f"SELECT DISTINCT name, array_to_string({_PARTS}, ' ') AS parts FROM symbols WHERE name IS NOT NULL")
def identifier_parts(spark, sf_dir):
    return table(spark, sf_dir, "symbols").where(F.col("name").isNotNull()).select("name", F.array_join(text.identifier_parts(F.col("name")), " ").alias("parts")).distinct()


@query(f"""WITH k AS (SELECT task_id, {sql.keywords('task')} AS kw FROM tasks WHERE task IS NOT NULL)
SELECT task_id, repo, rel_path, round(sum(CASE lower(trim(kind)) WHEN 'function' THEN 2.0 WHEN 'method' THEN 1.5 WHEN 'class' THEN 1.0 ELSE 1.0 END * len(list_intersect({_PARTS}, k.kw))), 6) AS score
FROM (SELECT DISTINCT file_id, repo, rel_path, name, kind, start_line, end_line, parent FROM symbols) s, k GROUP BY task_id, repo, rel_path""")
def symbol_score(spark, sf_dir):
    """The symbols of every file against every task; files without a hit score 0. One row a file is moved, and scores leave as runs of tasks."""
    rows = table(spark, sf_dir, "symbols").repartition("repo", "rel_path").distinct()  # repeated rows lie in one file, so this shuffle serves the files too
    parts = F.transform(text.identifier_parts(F.col("name")), lambda p: F.struct(p.alias("part"), symbol_weight(F.col("kind")).alias("weight")))
    files = rows.groupBy("repo", "rel_path").agg(F.max(F.col("name").isNotNull()).alias("named"), F.flatten(F.collect_list(parts)).alias("parts"))
    files = files.select("repo", "rel_path", "named", F.col("parts.part").alias("parts"), F.col("parts.weight").alias("weights"))
    runs = blocks.symbol_runs(files, blocks.Tasks(corpus.tasks(spark, sf_dir)))
    return runs.select("repo", "rel_path", F.round("score", 6).alias("score"), F.explode("task_ids").alias("task_id"))


@query("""SELECT repo, rel_path, unnest(list_sort(list_distinct(list_concat(regexp_extract_all(content, '`([^`]+\\.[a-zA-Z]{1,10})`', 1), regexp_extract_all(content, '"([^"]+\\.[a-zA-Z]{1,10})"', 1))))) AS path
FROM files""")
def memory_paths(spark, sf_dir):
    return table(spark, sf_dir, "files").select("repo", "rel_path", F.explode(text.mentioned_paths(F.col("content"))).alias("path"))


_GUARD = r"regexp_matches(text, '(?i)(?:password|secret|api[_\-.]?key|access[_\-.]?token|bearer|private[_\-.]?key)[\s\x0b]*[=:][\s\x0b]*[^\s\x0b]{4,}') OR regexp_matches(text, '[0-9a-fA-F]{40,}') OR regexp_matches(text, '[A-Za-z0-9+/]{60,}={0,2}')"


@query(f"SELECT doc_id, ({_GUARD}) AS rejected FROM documents WHERE text IS NOT NULL")
def memory_guard(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", text.holds_secret(F.col("text")).alias("rejected"))


_LOW = f"lower({sql.name('rel_path')})"


@query(f"""SELECT repo, rel_path,
  (starts_with({sql.name('rel_path')}, 'test_') OR ends_with({sql.name('rel_path')}, '_test.py') OR list_has_any(string_split(rel_path, '/'), ['tests', 'test', '__tests__', 'spec'])) AS is_test,
  {sql.is_secret('rel_path')} AS is_secret, CASE WHEN starts_with({_LOW}, '.env') OR regexp_matches({_LOW}, 'secret|credential|password') THEN 'secret/credential file' ELSE 'over budget' END AS label,
  {_LOW} IN {sql.in_list(dims.PRIORITY_NAMES)} AS is_priority, {_LOW} IN {sql.in_list(dims.CONFIG_NAMES)} OR (starts_with(rel_path, '.github/workflows/') AND regexp_matches(rel_path, '\\.ya?ml$')) AS is_config,
  {_LOW} IN {sql.in_list(dims.ENTRYPOINT_NAMES)} AS is_entrypoint
FROM files""")
def file_roles(spark, sf_dir):
    p = F.col("rel_path")
    return table(spark, sf_dir, "files").select(
        "repo", p, paths.is_test(p).alias("is_test"), classify.is_secret_file(p).alias("is_secret"), classify.exclusion_label(p).alias("label"),
        classify.is_priority(p).alias("is_priority"), classify.is_config(p).alias("is_config"), classify.is_entrypoint_name(p).alias("is_entrypoint"),
    )


@query(f"SELECT repo, rel_path, language, {sql.purpose('rel_path', 'language')} AS purpose FROM (SELECT repo, rel_path, {sql.language('rel_path')} AS language FROM files)")
def file_purposes(spark, sf_dir):
    return corpus.files(spark, sf_dir).select("repo", "rel_path", "language", classify.purpose(F.col("rel_path"), F.col("language")).alias("purpose"))


@query(f"SELECT file_id, sha256({sql.redact('content')}) AS redacted_hash FROM files WHERE content IS NOT NULL")
def redacted_files(spark, sf_dir):
    return spread(table(spark, sf_dir, "files").where(F.col("content").isNotNull()).select("file_id", "content")).select("file_id", F.sha2(redact(F.col("content")), 256).alias("redacted_hash"))


def _counts_sql() -> str:
    steps, source = [], "files"
    for n, (_, pattern, placeholder) in enumerate(PATTERNS):
        repl = sql.quoted(placeholder.replace("$", chr(92)))
        before = "".join(f", c{k}" for k in range(n))
        steps.append(f"s{n} AS (SELECT file_id, regexp_replace(content, {sql.quoted(pattern)}, {repl}, 'g') AS content{before}, len(regexp_extract_all(content, {sql.quoted(pattern)})) AS c{n} FROM {source}{' WHERE content IS NOT NULL' if n == 0 else ''})")
        source = f"s{n}"
    union = " UNION ALL ".join(f"SELECT '{name}' AS pattern, sum(c{n})::BIGINT AS n_found, count(*) FILTER (c{n} > 0) AS n_files FROM {source}" for n, (name, _, _) in enumerate(PATTERNS))
    return "WITH " + ", ".join(steps) + " " + union


@query(_counts_sql())
def redaction_totals(spark, sf_dir):
    counted = spread(table(spark, sf_dir, "files").where(F.col("content").isNotNull()).select("content")).select(redaction_counts(F.col("content")).alias("c"))
    names = [name for name, _, _ in PATTERNS]
    totals = counted.agg(*[F.sum(f"c.{n}").alias(f"{n}_n") for n in names], *[F.sum((F.col(f"c.{n}") > 0).cast("bigint")).alias(f"{n}_f") for n in names])
    rows = F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(f"{n}_n").alias("n_found"), F.col(f"{n}_f").alias("n_files")) for n in names])
    return totals.select(F.explode(rows).alias("r")).select("r.*")
