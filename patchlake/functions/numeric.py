"""Numeric features of a patch record as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patchlake.functions.paths import is_ignored, is_source, is_test

PATCH_NUMERICS = [
    "added", "removed", "total_changes", "change_balance", "files_changed", "source_files", "test_files", "ignored_files",
    "avg_added", "avg_removed", "avg_changed", "source_ratio", "test_ratio", "patch_length", "patch_line_count",
]


def number(value: Column) -> Column:
    """Double, with anything missing or unreadable as zero."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def line_numerics(added: Column, removed: Column, stat_added: Column | None = None, stat_removed: Column | None = None) -> dict[str, Column]:
    """Added, removed, total and balance; diff statistics stand in for missing counts."""
    plus = number(added if stat_added is None else F.coalesce(added.cast("string"), stat_added.cast("string")))
    minus = number(removed if stat_removed is None else F.coalesce(removed.cast("string"), stat_removed.cast("string")))
    return {
        "added": plus,
        "removed": minus,
        "total_changes": plus + minus,
        "change_balance": plus - minus,
    }


_COUNTS = ("files", "source_files", "test_files", "ignored_files")


def file_counts(changes: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """One row per commit with the struct ``file_counts``; a commit may have any number of files."""
    p = F.col(path)
    counts = changes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(is_source(p)).alias("source_files"),
        F.count_if(is_test(p)).alias("test_files"),
        F.count_if(is_ignored(p)).alias("ignored_files"),
    )
    return counts.select(*keys, F.struct(*_COUNTS).alias("file_counts"))


def listed_counts(changed_files: Column) -> Column:
    """The same struct from a record's own array of structs with path, is_source and ignored."""

    def count(test) -> Column:
        return F.coalesce(F.size(F.filter(changed_files, lambda f: F.coalesce(test(f), F.lit(False)))), F.lit(0))

    return F.struct(
        F.coalesce(F.size(changed_files), F.lit(0)).alias("files"),
        count(lambda f: f["is_source"]).alias("source_files"),
        count(lambda f: is_test(f["path"])).alias("test_files"),
        count(lambda f: f["ignored"]).alias("ignored_files"),
    )


def with_patch_numerics(
    df: DataFrame,
    patch: Column,
    files: Column | None,
    added: Column,
    removed: Column,
    stat_added: Column,
    stat_removed: Column,
    stat_files: Column,
) -> DataFrame:
    """Adds the fifteen numerics of a record.

    ``files`` is a struct of counts, from :func:`file_counts` or
    :func:`listed_counts`; without it a record has no known files. Averages and
    shares are worked out from the counts in a second step.
    """

    def count(name: str) -> Column:
        return F.lit(0.0) if files is None else F.coalesce(files[name].cast("double"), F.lit(0.0))

    stated = number(stat_files)
    text = F.coalesce(patch, F.lit(""))
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    counted = df.withColumns(
        {
            **line_numerics(added, removed, stat_added, stat_removed),
            "files_changed": F.when(stated > 0, stated).otherwise(count("files")),
            "source_files": count("source_files"),
            "test_files": count("test_files"),
            "ignored_files": count("ignored_files"),
            "patch_length": F.length(text).cast("double"),
            "patch_line_count": F.when(text == "", F.lit(0.0)).otherwise((newlines + 1).cast("double")),
        }
    )
    per_file = F.greatest(F.col("files_changed"), F.lit(1.0))
    return counted.withColumns(
        {
            "avg_added": F.col("added") / per_file,
            "avg_removed": F.col("removed") / per_file,
            "avg_changed": F.col("total_changes") / per_file,
            "source_ratio": F.col("source_files") / per_file,
            "test_ratio": F.col("test_files") / per_file,
        }
    )
