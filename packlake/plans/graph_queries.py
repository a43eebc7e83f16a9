"""Queries of extraction, the import graph and the repository index, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from packlake import dims
from packlake.operators import extract, graph, index, symbols
from packlake.plans import corpus, sql
from packlake.plans.rank_queries import JS_EDGES
from packlake.session import table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return keep


_LINES = f"list_transform(regexp_split_to_array(regexp_replace(content, '(?:{sql.BREAK})\\z', ''), '{sql.BREAK}'), lambda s: regexp_replace(s, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g'))"


def _of(language: str) -> str:
    return f"files WHERE {sql.language('rel_path')} = '{language}' AND content IS NOT NULL"


def _read(spark, sf_dir, *languages):
    return corpus.files(spark, sf_dir).where(F.col("language").isin(*languages) & F.col("content").isNotNull())


def _flat(rows, found, *names):
    rows = rows.withColumn("found", found)
    return rows.select("repo", "rel_path", *[F.array_join(f"found.{n}", "|").alias(n) if n != "docstring" else F.col("found.docstring").alias(n) for n in names])


def _joined(expr: str) -> str:
    return f"array_to_string({expr}, '|')"


_TOLD = "list_filter(rows, lambda s: s <> '' AND (NOT starts_with(s, '#') OR regexp_replace(s, '^#+[\\s\\x0b]*', '') <> ''))"


@query(f"""SELECT repo, rel_path, CASE WHEN starts_with(told[1], '#') THEN {_joined("list_transform(list_filter(told, lambda s: starts_with(s, '#')), lambda s: regexp_replace(s, '^#+[\\s\\x0b]*', ''))[1:30]")} ELSE '' END AS symbols,
  coalesce(CASE WHEN starts_with(told[1], '#') THEN regexp_replace(told[1], '^#+[\\s\\x0b]*', '') ELSE told[1] END, '') AS docstring
FROM (SELECT repo, rel_path, {_TOLD} AS told FROM (SELECT repo, rel_path, {_LINES} AS rows FROM {_of('Markdown')}))""")
def markdown_headings(spark, sf_dir):
    return _flat(_read(spark, sf_dir, "Markdown"), extract.markdown(F.col("content")), "symbols", "docstring")


@query(f"""SELECT repo, rel_path, {_joined("list_distinct_ordered[1:20]")} AS symbols FROM (
  SELECT repo, rel_path, list_filter(keys, lambda k, i: list_position(keys, k) = i) AS list_distinct_ordered FROM (
    SELECT repo, rel_path, regexp_extract_all(content, '(?m)^([a-zA-Z_][a-zA-Z0-9_-]*)[\\s\\x0b]*:', 1) AS keys FROM {_of('YAML')}))""")
def yaml_top_keys(spark, sf_dir):
    return _flat(_read(spark, sf_dir, "YAML"), extract.yaml_keys(F.col("content")), "symbols")


@query(f"""SELECT repo, rel_path, {_joined("CASE WHEN json_type(j) = 'OBJECT' THEN list_filter(json_keys(j), lambda k, i: list_position(json_keys(j), k) = i)[1:20] WHEN json_type(j) = 'ARRAY' THEN list_transform(range(least(5, json_array_length(j)::BIGINT)), lambda i: '[' || i || ']') ELSE [] END")} AS symbols
FROM (SELECT repo, rel_path, CASE WHEN json_valid(content) AND NOT regexp_matches(content, ',[ \n\r\t]*[}}\\]]') THEN content::JSON END AS j FROM {_of('JSON')}) WHERE json_type(j) IN ('OBJECT', 'ARRAY')""")
def json_top_keys(spark, sf_dir):
    """Keys of the files whose JSON is a valid object or list."""
    rows = _read(spark, sf_dir, "JSON").where(F.try_parse_json("content").isNotNull())
    return _flat(rows, extract.json_keys(F.col("content"), F.col("rel_path")), "symbols")


_FUNCS = "list_filter(regexp_extract_all(content, '(?m)^(?:function[\\s\\x0b]+)?(\\w+)[\\s\\x0b]*\\([\\s\\x0b]*\\)[\\s\\x0b]*\\{', 1), lambda s: s NOT IN ('if', 'while', 'for', 'do', 'then', 'else', 'fi', 'case', 'esac', 'in'))"
_VARS = "regexp_extract_all(content, '(?m)^(?:export[\\s\\x0b]+)?([A-Z_][A-Z0-9_]{1,})[\\s\\x0b]*=', 1)"
_SYMS = f"list_concat(list_transform({_FUNCS}, lambda s: 'function ' || s), {_VARS})"
_SOURCED = "list_filter(list_transform(regexp_extract_all(content, '(?m)^(?:source[\\s\\x0b]+|[.][\\s\\x0b]+)([^\\s\\x0b$#;]+)', 1), lambda s: regexp_replace(s, '^[\"'']+|[\"'']+$', '', 'g')), lambda s: s <> '')"


@query(f"""SELECT repo, rel_path, {_joined(f"list_sort(list_distinct({_SOURCED}))")} AS imports, {_joined(f"list_filter({_SYMS}, lambda k, i: list_position({_SYMS}, k) = i)[1:30]")} AS symbols FROM {_of('Shell')}""")
def shell_symbols(spark, sf_dir):
    return _flat(_read(spark, sf_dir, "Shell"), extract.shell(F.col("content")), "imports", "symbols")


_S = "[\\s\\x0b]"


def _sorted(*parts: str) -> str:
    return f"list_sort(list_distinct({parts[0] if len(parts) == 1 else 'list_concat(' + ', '.join(parts) + ')'}))"


def _found(pattern: str) -> str:
    return f"regexp_extract_all(content, '{pattern}', 1)"


_JS_IMPORTS = [_found(rf"\bimport\b[^(].*?from{_S}+[''\"]([^''\"]+)[''\"]"), _found(rf"\bimport{_S}+[''\"]([^''\"]+)[''\"]"), _found(rf"\brequire{_S}*\({_S}*[''\"]([^''\"]+)[''\"]{_S}*\)")]
_JS_EXPORTS = {
    "function": _found(rf"(?m)^export{_S}+(?:default{_S}+)?(?:async{_S}+)?function{_S}+(\w+)"),
    "class": _found(rf"(?m)^export{_S}+(?:default{_S}+)?class{_S}+(\w+)"),
    "const": _found(rf"(?m)^export{_S}+(?:const|let|var){_S}+(\w+)"),
    "type": _found(rf"(?m)^export{_S}+(?:type|interface){_S}+(\w+)"),
}
_JS_INNER = [_found(rf"(?m)^(?:async{_S}+)?function{_S}+(\w+){_S}*[\(<]"), _found(rf"(?m)^class{_S}+(\w+)"), _found(rf"(?m)^(?:const|let|var){_S}+([A-Z][A-Z0-9_]{{1,}}){_S}*=")]


@query(f"""SELECT repo, rel_path, {_joined(_sorted(*_JS_IMPORTS))} AS imports, {_joined(_sorted(*[f"list_transform({e}, lambda n: '{k} ' || n)" for k, e in _JS_EXPORTS.items()]))} AS exports,
  {_joined(_sorted(*_JS_EXPORTS.values(), *_JS_INNER))} AS symbols
FROM files WHERE {sql.language('rel_path')} IN ('JavaScript', 'TypeScript') AND content IS NOT NULL""")
def javascript_symbols(spark, sf_dir):
    return _flat(_read(spark, sf_dir, "JavaScript", "TypeScript"), extract.javascript(F.col("content")), "imports", "exports", "symbols")


@query(f"""SELECT repo, rel_path, {_joined(_sorted(_found(rf"(?m)^import{_S}+([\w.]+)"), _found(rf"(?m)^from{_S}+([\w.]+){_S}+import")))} AS imports, {_joined(_sorted(_found(rf"(?m)^(?:def|class|async{_S}+def){_S}+(\w+)")))} AS symbols FROM {_of('Python')}""")
def python_by_pattern(spark, sf_dir):
    return _flat(_read(spark, sf_dir, "Python"), extract.python_by_pattern(F.col("content")), "imports", "symbols")


@query()
def symbol_rows(spark, sf_dir):
    """Definitions with their line ranges, read from the sources themselves."""
    return symbols.symbol_rows(symbols.file_symbols(corpus.files(spark, sf_dir)))


@query()
def file_summaries(spark, sf_dir):
    """The summary of every accepted file; Python and TOML are read by their own parsers, which SQL cannot do."""
    from packlake.operators.classify import accepted

    return extract.summaries(accepted(corpus.scanned(spark, sf_dir)))


_HASH = "nullif(regexp_replace(regexp_replace(lower(s.content_hash), '\\s+', '', 'g'), '^sha-?256[:=-]', ''), '')"


@query(f"""SELECT f.repo, f.rel_path, EXISTS (SELECT 1 FROM summaries s WHERE s.repo = f.repo AND s.rel_path = f.rel_path AND s.content_hash = f.content_hash) AS cached
FROM (SELECT repo, rel_path, sha256(content) AS content_hash FROM files WHERE content IS NOT NULL) f""")
def incremental_cache(spark, sf_dir):
    """Which files a refresh reads again: those whose path and content hash no earlier summary has."""
    from packlake.operators.classify import language
    from packlake.functions.text import line_count

    known = corpus.files(spark, sf_dir).where(F.col("content").isNotNull())
    known = known.select("repo", "rel_path", language(F.col("rel_path")).alias("language"), "content", line_count(F.col("content")).alias("line_count"), F.sha2("content", 256).alias("content_hash"))
    return extract.refreshed(known, corpus.summaries(spark, sf_dir)).select("repo", "rel_path", "cached")


@query(f"WITH {JS_EDGES.strip()} SELECT repo, source, target, kind, raw_import, ord FROM js_edges")
def javascript_edges(spark, sf_dir):
    return graph.javascript_edges(corpus.files(spark, sf_dir))


@query()
def import_edges(spark, sf_dir):
    """Edges of all languages; Python's imports come from its parser."""
    return graph.graph_edges(corpus.files(spark, sf_dir))


@query()
def import_cycles(spark, sf_dir):
    return graph.cycles(graph.graph_edges(corpus.files(spark, sf_dir))).select("repo", F.array_join("cycle", " -> ").alias("cycle"))


@query(f"WITH {JS_EDGES.strip()} SELECT repo, target, count(*) AS n_dependents FROM js_edges WHERE kind = 'local' GROUP BY 1, 2")
def in_degree_scripts(spark, sf_dir):
    return graph.in_degree(graph.javascript_edges(corpus.files(spark, sf_dir)))


@query(f"""WITH {JS_EDGES.strip()}, chosen AS (SELECT DISTINCT repo, rel_path FROM selected),
  fwd AS (SELECT e.* FROM js_edges e JOIN chosen c ON e.repo = c.repo AND e.source = c.rel_path WHERE kind = 'local'),
  imports AS (SELECT repo, source AS rel_path, '→ imports ' || array_to_string(list_transform(list_sort(list(target))[1:6], lambda n: '`' || n || '`'), ', ') AS note FROM fwd GROUP BY 1, 2),
  imported AS (SELECT f.repo, f.target AS rel_path, '← imported by ' || array_to_string(list_transform(list_sort(list(f.source))[1:6], lambda n: '`' || n || '`'), ', ') AS note
    FROM fwd f JOIN chosen c ON f.repo = c.repo AND f.target = c.rel_path GROUP BY 1, 2)
SELECT * FROM imports UNION ALL SELECT * FROM imported i WHERE NOT EXISTS (SELECT 1 FROM imports x WHERE x.repo = i.repo AND x.rel_path = i.rel_path)""")
def dependency_notes_scripts(spark, sf_dir):
    edges = graph.javascript_edges(corpus.files(spark, sf_dir))
    return graph.dependency_notes(table(spark, sf_dir, "selected").select("repo", "rel_path"), edges)


@query()
def in_degree(spark, sf_dir):
    """Dependents by the imports of all languages; Python's come from its parser, which SQL cannot do."""
    return graph.in_degree(graph.graph_edges(corpus.files(spark, sf_dir)))


@query()
def dependency_notes(spark, sf_dir):
    """Notes by the imports of all languages."""
    return graph.dependency_notes(table(spark, sf_dir, "selected").select("repo", "rel_path"), graph.graph_edges(corpus.files(spark, sf_dir)))


@query(f"""SELECT repo, directory, n_files, place, coalesce({sql.case_of('lower(directory)', dims.DIR_PURPOSES)}, '') AS purpose FROM (
  SELECT repo, string_split(rel_path, '/')[1] AS directory, count(*) AS n_files, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, string_split(rel_path, '/')[1])::INT AS place
  FROM files WHERE contains(rel_path, '/') GROUP BY 1, 2) WHERE place <= {index.TOP_DIRS}""")
def directory_histogram(spark, sf_dir):
    return index.directory_histogram(corpus.files(spark, sf_dir))


_ENTRIES = f"""entries AS (SELECT repo, rel_path, row_number() OVER (PARTITION BY repo ORDER BY rel_path)::INT AS place FROM (
  SELECT repo, rel_path FROM files WHERE lower({sql.name('rel_path')}) IN {sql.in_list(dims.ENTRYPOINT_NAMES)} UNION SELECT repo, rel_path FROM summaries WHERE purpose = 'application entry point') QUALIFY place <= {index.TOP_NAMES})"""


@query(f"WITH {_ENTRIES} SELECT repo, rel_path, place FROM entries")
def entrypoints(spark, sf_dir):
    return index.entrypoints(corpus.files(spark, sf_dir), corpus.summaries(spark, sf_dir))


@query(f"""SELECT repo, directory, place FROM (SELECT repo, directory, row_number() OVER (PARTITION BY repo ORDER BY directory)::INT AS place FROM (
  SELECT repo, array_to_string(d[1:i], '/') AS directory FROM (SELECT repo, d, unnest(range(1, len(d) + 1)) AS i FROM (SELECT repo, {sql.dirs('rel_path')} AS d FROM files)) WHERE lower(d[i]) IN {sql.in_list(dims.TEST_DIRS)}
  UNION SELECT repo, string_split(rel_path, '/')[1] FROM summaries WHERE purpose = 'test file' AND contains(rel_path, '/'))) WHERE place <= {index.TOP_NAMES}""")
def test_directories(spark, sf_dir):
    return index.test_directories(corpus.files(spark, sf_dir), corpus.summaries(spark, sf_dir))


test_directories.__test__ = False


@query(f"""SELECT repo, manager, min(ord)::INT AS ord FROM (SELECT repo, {sql.case_of('rel_path', dict(dims.PACKAGE_MARKERS))} AS manager, {sql.case_of('rel_path', {n: i for i, (n, _) in enumerate(dims.PACKAGE_MARKERS)})} AS ord FROM files) WHERE manager IS NOT NULL GROUP BY 1, 2""")
def package_managers(spark, sf_dir):
    return index.package_managers(corpus.files(spark, sf_dir))


@query(f"""SELECT DISTINCT repo, framework FROM (SELECT repo, {sql.case_of("regexp_extract(lower(i), '^([^./]*)', 1)", dims.FRAMEWORK_IMPORTS)} AS framework FROM (SELECT repo, unnest(imports) AS i FROM summaries)
  UNION ALL SELECT repo, {sql.case_of('rel_path', dims.FRAMEWORK_FILES)} FROM files) WHERE framework IS NOT NULL""")
def frameworks(spark, sf_dir):
    return index.frameworks(corpus.files(spark, sf_dir), corpus.summaries(spark, sf_dir))


@query(f"SELECT DISTINCT repo, rel_path FROM files WHERE lower({sql.name('rel_path')}) IN {sql.in_list(dims.CONFIG_NAMES)} OR (starts_with(rel_path, '.github/workflows/') AND regexp_matches(rel_path, '\\.ya?ml$'))")
def config_files(spark, sf_dir):
    return index.config_files(corpus.files(spark, sf_dir))


@query(f"""WITH {sql.SUMMARIES}, {_ENTRIES} SELECT repo, rel_path, score, place FROM (
  SELECT s.repo, s.rel_path, (CASE WHEN e.repo IS NOT NULL THEN 10.0 ELSE 0.0 END + len(coalesce(exports, [])) * 1.0 + len(coalesce(symbols, [])) * 0.5 + len(coalesce(imports, [])) * 0.3)::DOUBLE AS score,
    row_number() OVER (PARTITION BY s.repo ORDER BY (CASE WHEN e.repo IS NOT NULL THEN 10.0 ELSE 0.0 END + len(coalesce(exports, [])) * 1.0 + len(coalesce(symbols, [])) * 0.5 + len(coalesce(imports, [])) * 0.3)::DOUBLE DESC, s.rel_path)::INT AS place
  FROM summaries_1 s LEFT JOIN entries e ON s.repo = e.repo AND s.rel_path = e.rel_path) WHERE place <= {index.TOP_FILES}""")
def key_files(spark, sf_dir):
    summaries = corpus.summaries(spark, sf_dir)
    return index.key_files(summaries, index.entrypoints(corpus.files(spark, sf_dir), summaries)).select("repo", "rel_path", F.round("score", 9).alias("score"), "place")


@query()
def repository_index(spark, sf_dir):
    return index.repository_index(corpus.files(spark, sf_dir), corpus.summaries(spark, sf_dir))
