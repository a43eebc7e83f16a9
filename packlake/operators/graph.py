"""The import graph: edges, resolution by joins, cycles and dependency notes."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlake import dims
from packlake.functions import paths
from packlake.session import checkpointed

RAW_CHARS = 120
PYTHON_IMPORTS = "array<struct<level:int,module:string,name:string,raw:string>>"


def normal_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; leading ``..`` that lead outside stay."""
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when((s == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(s))),
    )
    return F.array_join(folded, "/")


def _read_imports(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The top-level imports of Python sources, in order; none where a source does not parse."""
    for contents in batches:
        out = []
        for content in contents:
            found: list[dict] = []
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    body = ast.parse(content or "").body
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                body = []
            for node in body:
                if isinstance(node, ast.Import):
                    found += [{"level": 0, "module": a.name, "name": None, "raw": f"import {a.name}"} for a in node.names]
                elif isinstance(node, ast.ImportFrom):
                    dots = "." * node.level
                    if node.module or not node.level:
                        found.append({"level": node.level, "module": node.module or "", "name": None, "raw": f"from {dots}{node.module or ''} import ..."})
                    else:
                        found += [{"level": node.level, "module": "", "name": a.name, "raw": f"from {dots} import {a.name}"} for a in node.names]
            out.append(found)
        yield pd.Series(out, dtype=object)


def python_imports(content: Column) -> Column:
    """The top-level imports of Python sources, in order; none where a source does not parse."""
    return F.pandas_udf(_read_imports, PYTHON_IMPORTS)(content)


def _resolved(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """``wanted`` with ``target``: the first of its ``candidates`` that is a file of the repository, by an equi-join on exploded candidates."""
    known = files.select("repo", F.col("rel_path").alias("candidate")).distinct()
    tried = wanted.select("repo", "rel_path", "ord", F.posexplode("candidates").alias("place", "candidate"))
    hits = tried.join(known, ["repo", "candidate"]).groupBy("repo", "rel_path", "ord").agg(F.min_by("candidate", "place").alias("target"))
    return wanted.drop("candidates").join(hits, ["repo", "rel_path", "ord"], "left")


def _edges(resolved: DataFrame, package: Column, key: Column) -> DataFrame:
    """Edges and unresolved imports; of several imports with one ``key`` in a file the first stands."""
    kind = F.when(F.col("target").isNotNull(), "local").when(F.col("relative"), "unresolved").otherwise("package")
    target = F.when(F.col("target").isNotNull(), F.col("target")).when(F.col("relative"), F.col("module")).otherwise(package)
    rows = resolved.where(~(F.col("quiet") & F.col("target").isNull())).withColumn("kind", kind).withColumn("to", target).where(F.col("to") != "")
    first = Window.partitionBy("repo", "rel_path", F.col("kind") == "unresolved", key).orderBy("ord")
    return rows.withColumn("n", F.row_number().over(first)).where((F.col("n") == 1) | (F.col("kind") == "unresolved")).select(
        "repo", F.col("rel_path").alias("source"), F.col("to").alias("target"), "kind", F.left("raw", F.lit(RAW_CHARS)).alias("raw_import"), "ord"
    )


def python_edges(files: DataFrame) -> DataFrame:
    """Edges of Python files: (repo, source, target, kind local|package|unresolved, raw_import, ord)."""
    sources = files.where(F.col("language") == "Python")
    found = sources.select("repo", "rel_path", F.posexplode(python_imports(F.col("content"))).alias("ord", "i")).select("repo", "rel_path", "ord", "i.*")
    here = F.split("rel_path", "/")
    above = F.array_join(F.slice(here, F.lit(1), F.greatest(F.size(here) - F.col("level"), F.lit(0))), "/")
    inner = F.translate(F.when(F.col("module") != "", F.col("module")).otherwise(F.coalesce("name", F.lit(""))), ".", "/")
    base = F.when(F.col("level") == 0, inner).otherwise(F.concat_ws("/", F.when(above != "", above), F.when(inner != "", inner)))
    wanted = found.select(
        "repo",
        "rel_path",
        "ord",
        "raw",
        (F.col("level") > 0).alias("relative"),
        F.col("name").isNotNull().alias("quiet"),
        F.concat(F.repeat(F.lit("."), F.col("level")), F.col("module")).alias("module"),
        F.when((F.col("level") > 0) | (F.col("module") != ""), F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))).otherwise(F.array().cast("array<string>")).alias("candidates"),
    )
    return _edges(_resolved(wanted, files), F.split("module", r"\.")[0], F.col("to"))


def javascript_edges(files: DataFrame) -> DataFrame:
    """Edges of JavaScript and TypeScript files; the module an import names, once per file."""
    sources = files.where(F.col("language").isin("JavaScript", "TypeScript"))
    patterns = (r"import\s+(?:type\s+)?(?:[^'\";\n]*?from\s+)?['\"]([^'\"]+)['\"]", r"\brequire\s*\(\s*['\"]([^'\"]+)['\"]\s*\)")
    raws = F.concat(*[F.regexp_extract_all("content", F.lit(p), 0) for p in patterns])
    modules = F.concat(*[F.regexp_extract_all("content", F.lit(p), 1) for p in patterns])
    found = sources.select("repo", "rel_path", F.posexplode(F.arrays_zip(raws.alias("raw"), modules.alias("module"))).alias("ord", "i")).select("repo", "rel_path", "ord", "i.raw", "i.module")
    inside = F.concat_ws("/", F.when(paths.parent(F.col("rel_path")) != "", paths.parent(F.col("rel_path"))), F.col("module"))
    base = F.when(F.col("module").startswith("/"), F.regexp_replace("module", "^/+", "")).otherwise(F.regexp_replace(normal_path(inside), "^/+", ""))
    ends = ["", *dims.JS_SUFFIXES, *[f"/index{s}" for s in dims.JS_SUFFIXES]]
    relative = F.col("module").startswith(".") | F.col("module").startswith("/")
    wanted = found.select(
        "repo",
        "rel_path",
        "ord",
        "raw",
        "module",
        relative.alias("relative"),
        F.lit(False).alias("quiet"),
        F.when(relative, F.array(*[F.concat(base, F.lit(e)) for e in ends])).otherwise(F.array().cast("array<string>")).alias("candidates"),
    )
    # several specifiers may lead to one file: the specifier counts, not the file
    return _edges(_resolved(wanted, files), F.split("module", "/")[0], F.col("module"))


def graph_edges(files: DataFrame) -> DataFrame:
    """All edges of (repo, rel_path, language, content)."""
    return python_edges(files).unionByName(javascript_edges(files))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.where("kind = 'local'").groupBy("repo", "target").agg(F.count(F.lit(1)).alias("n_dependents"))


def find_cycles(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Cycles met by a depth-first walk from sorted nodes over sorted neighbours, one per set of nodes; the walk keeps its own stack."""
    follow: dict[str, list[str]] = {}
    for a, b in edges:
        follow.setdefault(a, []).append(b)
    nodes = sorted(set(follow) | {b for _, b in edges})
    done: set[str] = set()
    known: set[frozenset] = set()
    out: list[list[str]] = []
    for root in nodes:
        if root in done:
            continue
        trail, place, walks = [root], {root: 0}, [iter(sorted(follow.get(root, [])))]
        done.add(root)
        while walks:
            after = next(walks[-1], None)
            if after is None:
                walks.pop()
                del place[trail.pop()]
            elif after in place:
                ring = [*trail[place[after] :], after]
                if frozenset(ring) not in known:
                    known.add(frozenset(ring))
                    out.append(ring)
            elif after not in done:
                done.add(after)
                place[after] = len(trail)
                trail.append(after)
                walks.append(iter(sorted(follow.get(after, []))))
    return out


def cyclic_core(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Local edges that may lead to a cycle: edges into files that import nothing local are peeled off in rounds.

    A walk that looks for cycles learns nothing from such files, so what it finds is the same with or without them, and few edges of an
    import graph are left. Each round is one semi-join on the repository and file.
    """
    left = checkpointed(edges.where("kind = 'local'").select("repo", "source", "target").distinct())  # read twice a round
    for _ in range(rounds):
        going = left.select("repo", F.col("source").alias("target")).distinct()
        left = left.join(going, ["repo", "target"], "left_semi")
    return left.select("repo", "source", "target")


def cycles(edges: DataFrame) -> DataFrame:
    """(repo, cycle): cycles of local imports, first and last node equal; per repository the walk sees only edges that may lead to one."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        found = find_cycles(list(zip(rows["source"], rows["target"])))
        return pd.DataFrame({"repo": [rows["repo"].iloc[0]] * len(found), "cycle": found})

    return cyclic_core(edges).groupBy("repo").applyInPandas(walk, "repo string, cycle array<string>")


def dependency_notes(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, rel_path, note): what a selected file imports, or, if nothing, which selected files import it; six names at most."""
    chosen = selected.select("repo", "rel_path").distinct()
    local = edges.where("kind = 'local'").select("repo", "source", "target")
    forward = local.join(chosen.withColumnRenamed("rel_path", "source"), ["repo", "source"], "left_semi")
    backward = forward.join(chosen.withColumnRenamed("rel_path", "target"), ["repo", "target"], "left_semi")

    def named(rows: DataFrame, key: str, other: str, told: str) -> DataFrame:
        """The first six names of each file; the limit goes below the shuffle, so a file that everything imports gathers no more either."""
        order = Window.partitionBy("repo", key).orderBy(other)
        first = rows.select("repo", key, other).withColumn("n", F.row_number().over(order)).where("n <= 6")
        ticked = F.array_join(F.transform(F.array_sort(F.collect_list(other)), lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")
        return first.groupBy("repo", F.col(key).alias("rel_path")).agg(F.concat(F.lit(told), ticked).alias("note"))

    imports, imported = named(forward, "source", "target", "→ imports "), named(backward, "target", "source", "← imported by ")
    return imports.unionByName(imported.join(imports, ["repo", "rel_path"], "left_anti"))
