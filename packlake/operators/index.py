"""The repository index: independent aggregates over files and summaries, one row per repository."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packlake import dims
from packlake.functions import paths
from packlake.operators.classify import is_config, is_entrypoint_name

TOP_DIRS, TOP_FILES, TOP_NAMES = 15, 12, 10


def _first(rows: DataFrame, n: int, *order) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(*order))).where(F.col("place") <= n)


def directory_histogram(files: DataFrame) -> DataFrame:
    """(repo, directory, n_files, purpose, place): top directories by files; ties in walk order."""
    nested = files.where(F.contains("rel_path", F.lit("/")))
    counted = nested.groupBy("repo", paths.parts(F.col("rel_path"))[0].alias("directory")).agg(F.count(F.lit(1)).alias("n_files"))
    ranked = _first(counted, TOP_DIRS, F.desc("n_files"), "directory")
    return ranked.withColumn("purpose", F.coalesce(paths.lookup(dims.DIR_PURPOSES, F.lower("directory")), F.lit("")))


def entrypoints(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """(repo, rel_path, place): files named like an entry point or summarised as one; ten a repository."""
    named = files.where(is_entrypoint_name(F.col("rel_path"))).select("repo", "rel_path")
    told = summaries.where("purpose = 'application entry point'").select("repo", "rel_path")
    return _first(named.unionByName(told).distinct(), TOP_NAMES, "rel_path")


def test_directories(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """(repo, directory, place): directories named for tests at any depth, and top directories of files told to be tests."""
    dirs = paths.directories(F.col("rel_path"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size(dirs)), lambda i: F.struct(F.lower(F.element_at(dirs, i)).alias("last"), F.array_join(F.slice(dirs, F.lit(1), i), "/").alias("directory")))
    within = files.where(F.contains("rel_path", F.lit("/"))).select("repo", F.explode(prefixes).alias("p")).where(F.col("p.last").isin(dims.TEST_DIRS)).select("repo", "p.directory")
    told = summaries.where((F.col("purpose") == "test file") & F.contains("rel_path", F.lit("/"))).select("repo", paths.parts(F.col("rel_path"))[0].alias("directory"))
    return _first(within.unionByName(told).distinct(), TOP_NAMES, "directory")


def config_files(files: DataFrame) -> DataFrame:
    return files.where(is_config(F.col("rel_path"))).select("repo", "rel_path").distinct()


def package_managers(files: DataFrame) -> DataFrame:
    """(repo, manager, ord): labels of marker files at the root, once each, in table order."""
    order = {name: str(n) for n, (name, _) in enumerate(dims.PACKAGE_MARKERS)}
    found = files.select("repo", paths.lookup(dict(dims.PACKAGE_MARKERS), F.col("rel_path")).alias("manager"), paths.lookup(order, F.col("rel_path")).cast("int").alias("ord"))
    return found.where(F.col("manager").isNotNull()).groupBy("repo", "manager").agg(F.min("ord").alias("ord"))


def frameworks(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """(repo, framework): by imports, whole or as a prefix before ``.`` or ``/``, and by settings files at the root.

    No listed prefix holds a dot or slash but scoped names, whose first part is the prefix, so the test is a lookup of the first part.
    """
    imported = summaries.select("repo", F.explode("imports").alias("i")).select("repo", paths.lookup(dims.FRAMEWORK_IMPORTS, F.regexp_extract(F.lower("i"), r"^([^./]*)", 1)).alias("framework"))
    by_file = files.select("repo", paths.lookup(dims.FRAMEWORK_FILES, F.col("rel_path")).alias("framework"))
    return imported.unionByName(by_file).where(F.col("framework").isNotNull()).distinct()


def key_files(summaries: DataFrame, entries: DataFrame, n: int = TOP_FILES) -> DataFrame:
    """(repo, rel_path, language, purpose, exports, score, place): the files that say most about a repository."""
    size = lambda name: F.size(F.coalesce(F.col(name), F.array().cast("array<string>")))
    rows = summaries.dropDuplicates(["repo", "rel_path"]).join(entries.select("repo", "rel_path", F.lit(True).alias("entry")), ["repo", "rel_path"], "left")
    score = F.when(F.col("entry"), 10.0).otherwise(0.0) + size("exports") * 1.0 + size("symbols") * 0.5 + size("imports") * 0.3
    scored = rows.select("repo", "rel_path", "language", "purpose", "exports", score.alias("score"))
    return _first(scored, n, F.desc("score"), "rel_path")


def _names_in_toml(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for contents, tables in batches:
        found = []
        for content, table in zip(contents, tables):
            try:
                name = tomllib.loads(content or "").get(table, {}).get("name")
            except (tomllib.TOMLDecodeError, AttributeError, RecursionError):
                name = None
            found.append(name if isinstance(name, str) else None)
        yield pd.Series(found, dtype=object)


def project_names(files: DataFrame) -> DataFrame:
    """(repo, project_name): the name in a manifest at the root, by order of manifests, else the repository's own.

    Manifests are read by parsers; one that is not valid or has no name is passed over.
    """
    path = F.col("rel_path")
    manifests = files.where(path.isin("pyproject.toml", "package.json", "Cargo.toml")).select(
        "repo", F.when(path == "pyproject.toml", 0).when(path == "package.json", 1).otherwise(2).alias("ord"), F.when(path == "pyproject.toml", "project").otherwise("package").alias("table"), "content"
    )
    named = F.pandas_udf(_names_in_toml, "string")("content", "table")
    toml = manifests.where("ord <> 1").select("repo", "ord", named.alias("name"))
    of_json = F.from_json("content", "struct<name:string>")["name"]
    found = toml.unionByName(manifests.where("ord = 1").select("repo", "ord", of_json.alias("name"))).where(F.trim(F.coalesce("name", F.lit(""))) != "")
    best = found.groupBy("repo").agg(F.min_by("name", "ord").alias("found"))
    return files.select("repo").distinct().join(best, "repo", "left").select("repo", F.coalesce("found", "repo").alias("project_name"))


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_files"))


def repository_index(files: DataFrame, summaries: DataFrame) -> DataFrame:
    """One row per repository with the parts of the index that are of bounded length; settings files are rows of their own (``config_files``)."""
    def gathered(rows: DataFrame, name: str, order: str, *cols: str) -> DataFrame:
        item = F.struct(F.col(order).alias("_o"), *cols)
        strip = (lambda x: x[cols[0]]) if len(cols) == 1 else (lambda x: F.struct(*[x[c].alias(c) for c in cols]))
        return rows.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(item)), strip).alias(name))

    entries = entrypoints(files, summaries)
    languages = language_counts(files).withColumn("place", F.struct(-F.col("n_files"), "language"))
    out = project_names(files)
    for part in (
        gathered(languages, "languages", "place", "language", "n_files"),
        gathered(package_managers(files), "package_managers", "ord", "manager"),
        gathered(frameworks(files, summaries).withColumn("o", F.col("framework")), "frameworks", "o", "framework"),
        gathered(directory_histogram(files), "directories", "place", "directory", "n_files", "purpose"),
        gathered(entries, "entrypoints", "place", "rel_path"),
        gathered(test_directories(files, summaries), "test_dirs", "place", "directory"),
        gathered(key_files(summaries, entries), "key_files", "place", "rel_path", "language", "purpose", "exports"),
    ):
        out = out.join(part, "repo", "left")
    return out
