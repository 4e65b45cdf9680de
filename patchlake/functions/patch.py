"""Patch text and diff facts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from patchlake import rules
from patchlake.functions.text import normalise

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def clip(patch: Column, limit: int | None = None) -> Column:
    """The stored form of a patch with a flag: all of it, or at most ``limit`` characters."""
    if limit is None:
        return F.struct(patch.alias("patch"), F.lit(False).alias("patch_truncated"))
    return F.struct(
        F.substring(patch, 1, limit).alias("patch"),
        (F.length(patch) > limit).alias("patch_truncated"),
    )


def lines(patch: Column) -> Column:
    return F.split(F.coalesce(patch, F.lit("")), LINE_BREAK)


def marked_lines(patch: Column, mark: str, strict_headers: bool = False) -> Column:
    """Lines that begin with ``mark``, without it.

    File headers are left out. By default every line with the mark three times
    counts as a header, so a content line such as ``++x`` is lost as well;
    ``strict_headers`` takes only ``+++ `` and ``--- `` lines for headers.
    """
    header = mark * 3 + (" " if strict_headers else "")
    kept = F.filter(lines(patch), lambda l: l.startswith(mark) & ~l.startswith(header))
    return F.transform(kept, lambda l: F.substring(l, 2, 2147483647))


def line_changes(patch: Column, strict_headers: bool = False) -> Column:
    """Added and removed lines of a unified diff with their counts."""
    added = marked_lines(patch, "+", strict_headers)
    removed = marked_lines(patch, "-", strict_headers)
    return F.struct(
        added.alias("added_lines"),
        removed.alias("removed_lines"),
        F.size(added).alias("added_line_count"),
        F.size(removed).alias("removed_line_count"),
    )


def change_type(added: Column, deleted: Column, renamed: Column) -> Column:
    """One name for the change; the first flag that is set decides."""
    return (
        F.when(added, F.lit("added"))
        .when(deleted, F.lit("deleted"))
        .when(renamed, F.lit("renamed"))
        .otherwise(F.lit("modified"))
    )


def fingerprint(patch: Column) -> Column:
    """SHA-256 of the normalised patch; a missing patch counts as empty."""
    return F.sha2(normalise(F.coalesce(patch, F.lit(""))), 256)


def commit_key(repo: Column, commit_hash: Column) -> Column:
    return F.concat(F.coalesce(repo, F.lit("")), F.lit(":"), F.coalesce(commit_hash, F.lit("")))


def size_verdict(files: Column, added: Column, deleted: Column, patch_chars: Column, limits: dict | None = None) -> Column:
    """First structural objection to a diff, or null if there is none."""
    limit = {**rules.DIFF_LIMITS, **(limits or {})}
    return (
        F.when(F.coalesce(files, F.lit(0)) == 0, F.lit("no_source_files"))
        .when(files > limit["max_files"], F.lit("too_many_changed_files"))
        .when(added > limit["max_added"], F.lit("too_many_added_lines"))
        .when(deleted > limit["max_deleted"], F.lit("too_many_deleted_lines"))
        .when(patch_chars > limit["max_patch_chars"], F.lit("patch_too_large"))
        .when(added + deleted == 0, F.lit("no_line_changes"))
    )
