"""Scan-side columns: why a file is skipped, its language, purpose and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlake import dims
from packlake.functions import paths, text

REASONS = ("ignored", "gitignore", "symlink_unsafe", "permission_error", "too_large", "binary", "encoding_error")


def in_excluded_dir(path: Column, extra: tuple[str, ...] = ()) -> Column:
    """Whether a directory of the path is never entered."""
    return F.arrays_overlap(paths.directories(path), F.array(*map(F.lit, [*dims.EXCLUDED_DIRS, *extra])))


def is_generated(path: Column) -> Column:
    return paths.name(path).rlike("|".join(paths.glob_regex(g) for g in dims.GENERATED_GLOBS))


def skip_reason(path: Column, size: Column, content: Column, patterns: list[str] = (), symlink_ok: Column | None = None, max_bytes: int = dims.MAX_FILE_BYTES) -> Column:
    """The first reason to skip a file, null for an accepted one. ``content`` is binary; null means it could not be read.

    Cheap tests on the name come first, so content is looked at only where they pass.
    """
    return (
        F.when(is_generated(path), "ignored")
        .when(paths.ignored_by(path, list(patterns)), "gitignore")
        .when(~(symlink_ok if symlink_ok is not None else F.lit(True)), "symlink_unsafe")
        .when(size.isNull(), "permission_error")
        .when(size > max_bytes, "too_large")
        .when(content.isNull(), "permission_error")
        .when(F.contains(F.substring(content, 1, dims.BINARY_BYTES), F.lit(bytearray(b"\0"))), "binary")
        .when(~F.is_valid_utf8(content), "encoding_error")
    )


def language(path: Column) -> Column:
    """The language by file name, else by ending, else Unknown."""
    by_name = paths.lookup(dims.LANGUAGE_BY_NAME, F.lower(paths.name(path)))
    return F.coalesce(by_name, paths.lookup(dims.LANGUAGE_BY_SUFFIX, paths.suffix(path)), F.lit("Unknown"))


def purpose(path: Column, lang: Column) -> Column:
    """What a file is for, judged by its path and language alone."""
    dirs = F.transform(paths.directories(path), F.lower)
    low_stem = F.lower(paths.stem(path))
    return F.coalesce(
        paths.lookup(dims.PURPOSE_BY_NAME, F.lower(paths.name(path))),
        F.when(F.arrays_overlap(dirs, F.array(*map(F.lit, dims.TEST_DIRS))), "test file"),
        F.when(F.arrays_overlap(dirs, F.array(*map(F.lit, dims.DOCS_DIRS))), "documentation"),
        F.when(low_stem.rlike("^test_|_test$|_spec$"), "test file"),
        paths.lookup(dims.PURPOSE_BY_STEM, low_stem),
        paths.lookup(dims.PURPOSE_BY_LANGUAGE, lang),
        F.lit("source file"),
    )


def is_secret_file(path: Column) -> Column:
    """Files whose content is never shown, by name."""
    low = F.lower(paths.name(path))
    return ~low.isin(dims.SAFE_ENV_NAMES) & low.rlike(dims.SECRET_NAMES)


def exclusion_label(path: Column) -> Column:
    """The note beside an excluded file; a coarse look at the name, so templates count as secret here."""
    low = F.lower(paths.name(path))
    return F.when(low.startswith(".env") | low.rlike("secret|credential|password"), "secret/credential file").otherwise("over budget")


def is_priority(path: Column) -> Column:
    return F.lower(paths.name(path)).isin(dims.PRIORITY_NAMES)


def is_config(path: Column) -> Column:
    workflow = path.startswith(".github/workflows/") & (path.endswith(".yml") | path.endswith(".yaml"))
    return F.lower(paths.name(path)).isin(dims.CONFIG_NAMES) | workflow


def is_entrypoint_name(path: Column) -> Column:
    return F.lower(paths.name(path)).isin(dims.ENTRYPOINT_NAMES)


def classified(files: DataFrame, patterns: list[str] = ()) -> DataFrame:
    """``files`` (repo, rel_path, content) as the scanner records them; files below excluded directories vanish, skipped ones keep a reason."""
    seen = files.where(~in_excluded_dir(F.col("rel_path")))
    raw = F.encode("content", "UTF-8")
    size = F.octet_length("content").cast("bigint")
    reason = skip_reason(F.col("rel_path"), F.coalesce(size, F.lit(0)), raw, patterns)
    lang = language(F.col("rel_path"))
    return seen.select(
        "repo",
        "rel_path",
        paths.suffix(F.col("rel_path")).alias("extension"),
        size.alias("size"),
        text.line_count(F.col("content")).cast("bigint").alias("line_count"),
        lang.alias("language"),
        F.sha2(raw, 256).alias("content_hash"),
        reason.alias("reason"),
        "content",
    )


def accepted(files: DataFrame) -> DataFrame:
    return files.where(F.col("reason").isNull()).drop("reason")


def first_files(files: DataFrame, n: int) -> DataFrame:
    """The first ``n`` accepted files of each repository in walk order."""
    from pyspark.sql import Window

    order = Window.partitionBy("repo").orderBy(paths.walk_key(F.col("rel_path")))
    return files.withColumn("walk_no", F.row_number().over(order)).where(F.col("walk_no") <= n)
