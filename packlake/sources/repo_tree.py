"""A directory tree as a Spark source.

The built-in file sources leave out names that begin with a dot or an underscore, which a repository is full of; this
source walks the tree itself, prunes directories before it enters them, and reads one sub-tree per partition.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from packlake import dims

SCHEMA = "rel_path string, size long, is_symlink boolean, symlink_ok boolean, readable boolean, bytes binary"
#: Directories a partition is made of.
DIRECTORIES = 64


class SubTree(InputPartition):
    """Directories whose own files one task reads."""

    def __init__(self, directories: list[str]):
        self.directories = directories


class RepoTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.abspath(options.get("path", "."))
        if not os.path.isdir(self.root):
            raise ValueError(f"not a directory: {self.root}")
        self.max_bytes = int(options.get("maxBytes", dims.MAX_FILE_BYTES))
        self.pruned = {*dims.EXCLUDED_DIRS, *filter(None, options.get("exclude", "").split(","))}
        self.patterns = load_ignore_patterns(self.root) if options.get("respectIgnore", "true").lower() == "true" else []

    def _enters(self, rel: str) -> bool:
        return os.path.basename(rel) not in self.pruned and not ignored(rel, self.patterns)

    def partitions(self) -> list[SubTree]:
        found = []
        for at, dirs, _ in os.walk(self.root, followlinks=False):
            rel = os.path.relpath(at, self.root)
            rel = "" if rel == "." else Path(rel).as_posix()
            dirs[:] = sorted(d for d in dirs if self._enters(f"{rel}/{d}" if rel else d) and not os.path.islink(os.path.join(at, d)))
            found.append(rel)
        return [SubTree(found[i : i + DIRECTORIES]) for i in range(0, len(found), DIRECTORIES)]

    def read(self, partition: SubTree) -> Iterator[tuple]:
        for rel_dir in partition.directories:
            at = os.path.join(self.root, rel_dir)
            try:
                names = sorted(os.listdir(at))
            except OSError:
                continue
            for name in names:
                path = os.path.join(at, name)
                link = os.path.islink(path)
                if not link and os.path.isdir(path):
                    continue
                yield self._row(f"{rel_dir}/{name}" if rel_dir else name, path, link)

    def _row(self, rel: str, path: str, link: bool) -> tuple:
        safe = not link or inside(path, self.root)
        size = data = None
        readable = False
        if safe:
            try:
                info = os.stat(path)
                if stat.S_ISREG(info.st_mode):
                    size = info.st_size
                    if size <= self.max_bytes:
                        data = Path(path).read_bytes()
                    readable = True
            except OSError:
                pass
        return rel, size, link, safe, readable, data


class RepoTree(DataSource):
    """``spark.read.format("repo_tree").option("path", root)``; options: maxBytes, exclude (comma list), respectIgnore."""

    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RepoTreeReader:
        return RepoTreeReader(self.options)


def inside(path: str, root: str) -> bool:
    """Whether a link leads to something inside the root; broken links do not."""
    try:
        target = Path(path).resolve(strict=True)
    except (OSError, RuntimeError):
        return False
    return target.is_relative_to(Path(root).resolve())


def load_ignore_patterns(root: str) -> list[str]:
    """Patterns of the ignore file at the root, without comments, blanks and negations."""
    try:
        lines = Path(root, ".gitignore").read_text(encoding="utf-8", errors="replace").splitlines()
    except OSError:
        return []
    kept = (line.strip() for line in lines)
    return [line for line in kept if line and line[0] not in "#!"]


def ignored(rel: str, patterns: list[str]) -> bool:
    """The driver's form of the ignore test, for directories."""
    import re

    from packlake.functions.paths import glob_regex

    base = rel.rsplit("/", 1)[-1]
    for pattern in patterns:
        clean = pattern.rstrip("/")
        tests = [(rel, clean), (base, clean)] + ([(rel, f"**/{clean}")] if "/" in clean else [])
        if any(re.search(glob_regex(glob).replace("$", r"\Z"), text) for text, glob in tests):
            return True
    return False


def read_tree(spark: SparkSession, root: str, max_bytes: int = dims.MAX_FILE_BYTES, exclude: tuple[str, ...] = (), respect_ignore: bool = True) -> DataFrame:
    """Every file below ``root`` that a walk meets, with its bytes where it is not too large."""
    spark.dataSource.register(RepoTree)
    return (
        spark.read.format("repo_tree")
        .option("path", str(root))
        .option("maxBytes", str(max_bytes))
        .option("exclude", ",".join(exclude))
        .option("respectIgnore", str(respect_ignore).lower())
        .load()
    )


def scan_tree(spark: SparkSession, root: str, max_bytes: int = dims.MAX_FILE_BYTES, max_files: int | None = None, exclude: tuple[str, ...] = (), respect_ignore: bool = True) -> tuple[DataFrame, DataFrame]:
    """(files, skipped) of a tree: accepted files with content, and the others with the first reason to skip them."""
    from pyspark.sql import functions as F

    from packlake.functions import paths, text
    from packlake.operators import classify

    patterns = load_ignore_patterns(os.path.abspath(root)) if respect_ignore else []
    raw = read_tree(spark, root, max_bytes, exclude, respect_ignore)
    path = F.col("rel_path")
    reason = classify.skip_reason(path, F.col("size"), F.coalesce(F.col("bytes"), F.when(F.col("size") > max_bytes, F.lit(b""))), patterns, F.col("symlink_ok"), max_bytes)
    judged = raw.withColumn("reason", reason)
    content = F.try_validate_utf8("bytes")
    files = judged.where(F.col("reason").isNull()).select(
        F.lit(Path(root).resolve().name).alias("repo"),
        "rel_path",
        paths.suffix(path).alias("extension"),
        "size",
        text.line_count(content).cast("int").alias("line_count"),
        classify.language(path).alias("language"),
        F.sha2("bytes", 256).alias("content_hash"),
        content.alias("content"),
    )
    if max_files is not None:
        files = files.orderBy(paths.walk_key(path)).limit(max_files)
    return files, judged.where(F.col("reason").isNotNull()).select("rel_path", "reason")
