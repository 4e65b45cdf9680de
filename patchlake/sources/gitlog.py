"""Text output of version-control commands as commit and change tables.

A log has records that end in 0x1e and fields that are separated by 0x1f: hash,
parents, author, date, subject, body. Line counts are tab-separated: added,
deleted, path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patchlake.functions import paths
from patchlake.functions.patch import change_type, clip, line_changes

RECORD_END, FIELD_END = "\x1e", "\x1f"
LOG_FIELDS = 6


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def read_commit_log(spark: SparkSession, path: str, repo_id: str | Column | None = None) -> DataFrame:
    """Commits of one log file, or of a folder of them.

    Records with fewer than six fields are left out. ``repo_id`` defaults to the
    file name without its suffix.
    """
    raw = spark.read.option("lineSep", RECORD_END).text(path).select("value", F.col("_metadata.file_name").alias("file"))
    fields = F.split("value", FIELD_END)
    repo = F.regexp_replace("file", r"\.[^.]*\z", "") if repo_id is None else (F.lit(repo_id) if isinstance(repo_id, str) else repo_id)

    def field(i: int) -> Column:
        return _stripped(F.get(F.col("fields"), F.lit(i)))

    parents = F.filter(F.split(field(1), r"\s+"), lambda p: p != "")
    return (
        raw.filter(_stripped(F.col("value")) != "")
        .select(repo.alias("repo_id"), fields.alias("fields"))
        .filter(F.size("fields") >= LOG_FIELDS)
        .select(
            "repo_id",
            field(0).alias("commit_hash"),
            F.coalesce(F.get(parents, F.lit(0)), F.lit("")).alias("parent"),
            F.size(parents).alias("parent_count"),
            field(2).alias("author"),
            field(3).alias("date"),
            F.try_to_timestamp(field(3)).alias("ts"),
            field(4).alias("subject"),
            field(5).alias("body"),
        )
    )


def first_commits(commits: DataFrame, order: list, limit: int | None) -> DataFrame:
    """The first commits in ``order``; all of them without a limit."""
    return commits if limit is None else commits.orderBy(*order).limit(limit)


def parse_numstat(lines: DataFrame, value: str = "value", keys: tuple[str, ...] = ("repo_id", "commit_hash")) -> DataFrame:
    """Line counts per commit and file from lines that carry their commit's key.

    Binary files and counts that are not numbers are left out.
    """
    parts = F.split(value, "\t")
    return (
        lines.select(*keys, parts.alias("parts"))
        .filter(F.size("parts") >= 3)
        .select(*keys, *[F.col("parts")[i].alias(n) for i, n in enumerate(["added", "deleted", "path"])])
        .filter(F.col("added").rlike(r"\A\s*[0-9]+\s*\z") & F.col("deleted").rlike(r"\A\s*[0-9]+\s*\z"))
        .select(
            *keys,
            "path",
            F.trim("added").cast("bigint").alias("added_lines"),
            F.trim("deleted").cast("bigint").alias("deleted_lines"),
            paths.is_source(F.col("path")).alias("is_source"),
            paths.is_ignored(F.col("path")).alias("ignored"),
        )
    )


def read_numstat(spark: SparkSession, path: str) -> DataFrame:
    """Line-count files laid out as ``repo_id=…/commit_hash.txt`` or with both as partitions."""
    rows = spark.read.text(path)
    if "commit_hash" not in rows.columns:
        rows = rows.withColumn("commit_hash", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*\z", ""))
    if "repo_id" not in rows.columns:
        rows = rows.withColumn("repo_id", F.lit(None).cast("string"))
    return parse_numstat(rows)


def _keyed_lines(spark: SparkSession, path: str, fields: int) -> DataFrame:
    """Tab-separated lines that begin with repository and commit; ``parts`` has the rest, at least ``fields`` of them."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(parts.alias("all")).filter(F.size("all") >= fields + 2)
    return rows.select(
        F.col("all")[0].alias("repo_id"), F.col("all")[1].alias("commit_hash"), F.slice("all", 3, F.size("all") - 2).alias("parts")
    )


def read_keyed_numstat(spark: SparkSession, path: str) -> DataFrame:
    """Line counts of many commits in few files: repository, commit, added, deleted, path."""
    return parse_numstat(_keyed_lines(spark, path, 3).withColumn("value", F.array_join("parts", "\t")))


def read_name_status(spark: SparkSession, path: str) -> DataFrame:
    """Changed names of many commits: repository, commit, status, path and, for a rename, the new path.

    The status begins with A, D, R or M; a rename may carry its likeness.
    """
    letter = F.substring(F.col("parts")[0], 1, 1)
    name, to = F.col("parts")[1], F.get("parts", F.lit(2))
    return _keyed_lines(spark, path, 2).select(
        "repo_id",
        "commit_hash",
        F.when(letter != "A", name).alias("old_path"),
        F.when(letter == "R", to).when(letter != "D", name).alias("new_path"),
        (letter == "A").alias("added"),
        (letter == "D").alias("deleted"),
        (letter == "R").alias("renamed"),
    )


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """File patches as records like those of the log: repository, commit, status, old path, new path, patch text.

    An empty path is null; records with fewer fields are left out. A patch may
    hold any text but the two separators.
    """
    fields = F.split("value", FIELD_END, 6)
    raw = spark.read.option("lineSep", RECORD_END).text(path).select(fields.alias("f")).filter(F.size("f") == 6)
    letter = F.substring(F.col("f")[2], 1, 1)
    return raw.select(
        F.trim(F.col("f")[0]).alias("repo_id"),
        F.col("f")[1].alias("commit_hash"),
        F.nullif(F.col("f")[3], F.lit("")).alias("old_path"),
        F.nullif(F.col("f")[4], F.lit("")).alias("new_path"),
        (letter == "A").alias("added"),
        (letter == "D").alias("deleted"),
        (letter == "R").alias("renamed"),
        F.col("f")[5].alias("patch"),
    )


def commit_totals(commits: DataFrame, numstat: DataFrame, keys: list[str]) -> DataFrame:
    """Commits with files, insertions and deletions; zero for commits without files."""
    sums = numstat.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("files_changed"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions")
    )
    totals = ["files_changed", "insertions", "deletions"]
    return commits.join(sums, keys, "left").withColumns({t: F.coalesce(t, F.lit(0)) for t in totals})


def file_change_history(commits: DataFrame, names: DataFrame, numstat: DataFrame, keys: list[str]) -> DataFrame:
    """One row per file of each commit that has a parent, against its first parent.

    ``names`` has old_path, new_path and the flags added, deleted, renamed;
    ``numstat`` has path, insertions, deletions. Counts are looked up by the new
    path; files the counts do not name, such as most renames, get zero.
    """
    path = F.coalesce(F.nullif("new_path", F.lit("")), F.nullif("old_path", F.lit("")))
    counts = numstat.select(*keys, F.col("path").alias("file_path"), "insertions", "deletions")
    return (
        names.withColumn("file_path", path)
        .filter("file_path is not null")
        .join(commits.filter("parent_count > 0"), keys)
        .join(counts, [*keys, "file_path"], "left")
        .withColumns(
            {
                "insertions": F.coalesce("insertions", F.lit(0)),
                "deletions": F.coalesce("deletions", F.lit(0)),
                "change_type": change_type(F.col("added"), F.col("deleted"), F.col("renamed")),
            }
        )
        .withColumn("total_changes", F.col("insertions") + F.col("deletions"))
        .drop("added", "deleted", "renamed")
    )


def file_patch_history(commits: DataFrame, diffs: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """As above with patch text and its line changes, cut to ``limit`` characters if one is given.

    ``diffs`` has old_path, new_path, the three flags and patch; rows with no
    patch text (binary files) are left out.
    """
    path = F.coalesce(F.nullif("new_path", F.lit("")), F.nullif("old_path", F.lit("")))
    return (
        diffs.filter("patch is not null")
        .withColumn("file_path", path)
        .filter("file_path is not null")
        .withColumn("change_type", change_type(F.col("added"), F.col("deleted"), F.col("renamed")))
        .withColumn("clipped", clip(F.col("patch"), limit))
        .withColumn("changes", line_changes(F.col("clipped.patch")))
        .drop("patch", "added", "deleted", "renamed")
        .join(commits.filter("parent_count > 0"), keys)
        .select("*", "clipped.*", "changes.*")
        .drop("clipped", "changes")
    )
