"""Upkeep of the repository manifest: one row per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchlake import rules
from patchlake.functions import paths
from patchlake.schemas import REPOSITORY

COUNTERS = ["commit_count", "source_file_count", "diff_record_count", "bug_fix_record_count"]


def new_records(rows: DataFrame, source: str = "manual") -> DataFrame:
    """Full manifest rows from rows with at least repo_id; the rest gets its default."""
    default: dict[str, Column] = {
        "language": F.lit("python"),
        "stars": F.lit(0),
        "forks": F.lit(0),
        "open_issues": F.lit(0),
        "is_fork": F.lit(False),
        "archived": F.lit(False),
        "collection_status": F.lit("pending"),
        "added_to_manifest_at": F.current_timestamp(),
        "dataset_version": F.lit("v1"),
        "quality_status": F.lit("unknown"),
        "quality_notes": F.array(),
    }
    # Nothing is known about the collection of a new repository, whatever the rows say.
    fixed = {
        "collection_status", "collection_error", "last_collected_at", "added_to_manifest_at", "dataset_version",
        "quality_status", "quality_notes", *COUNTERS,
    }
    columns = []
    for field in REPOSITORY:
        name = field.name
        if name == "provenance":
            url = F.col("clone_url") if "clone_url" in rows.columns else F.lit(None)
            value = F.struct(F.lit(source).alias("source"), url.cast("string").alias("source_url"))
        elif name in rows.columns and name not in fixed:
            value = F.coalesce(F.col(name), default[name]) if name in default else F.col(name)
        else:
            value = default.get(name, F.lit(None))
        columns.append(value.cast(field.dataType).alias(name))
    return rows.select(*columns)


def add_missing(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Manifest with those rows added whose repo_id it lacks; ``rows`` has unique ids."""
    return manifest.unionByName(rows.join(manifest.select("repo_id"), "repo_id", "left_anti"), allowMissingColumns=True)


def addition_counts(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    known = manifest.select("repo_id", F.lit(True).alias("known"))
    return rows.join(known, "repo_id", "left").agg(
        F.count_if(F.col("known").isNull()).alias("added"), F.count_if(F.col("known")).alias("skipped")
    )


def update(manifest: DataFrame, changes: DataFrame) -> DataFrame:
    """Manifest with the columns of ``changes`` (one row per repo_id) set, nulls included.

    Ids that the manifest lacks change nothing.
    """
    names = [c for c in changes.columns if c != "repo_id"]
    packed = changes.select("repo_id", F.struct(*names).alias("__new"))
    joined = manifest.join(packed, "repo_id", "left")
    for name in names:
        old = F.col(name) if name in manifest.columns else F.lit(None)
        joined = joined.withColumn(name, F.when(F.col("__new").isNotNull(), F.col(f"__new.{name}")).otherwise(old))
    return joined.drop("__new")


def apply_events(manifest: DataFrame, events: DataFrame) -> DataFrame:
    """Collection status after the events of each repository.

    ``events`` has repo_id, at, event ("started", "complete" or "failed"), error
    and the counters. Status and error come from the latest event; the counters
    and the time of collection from the latest completion, whose unset counters
    become null.
    """
    at = F.col("at")
    done = F.col("event") == "complete"
    facts = F.struct(*[F.col(c) for c in COUNTERS], at.alias("last_collected_at"))
    state = events.groupBy("repo_id").agg(
        F.max_by(F.struct("event", "error"), at).alias("latest"), F.max_by(facts, F.when(done, at)).alias("facts")
    )
    status = (
        F.when(F.col("latest.event") == "started", "collecting")
        .when(F.col("latest.event") == "complete", "complete")
        .when(F.col("latest.event") == "failed", "failed")
    )
    joined = manifest.join(state, "repo_id", "left")
    touched, completed = F.col("latest").isNotNull(), F.col("facts.last_collected_at").isNotNull()
    new = {
        "collection_status": F.when(touched, status).otherwise(F.col("collection_status")),
        "collection_error": F.when(
            touched, F.when(F.col("latest.event") == "failed", F.col("latest.error"))
        ).otherwise(F.col("collection_error")),
    }
    for name in [*COUNTERS, "last_collected_at"]:
        new[name] = F.when(completed, F.col(f"facts.{name}")).otherwise(F.col(name))
    return joined.withColumns(new).drop("latest", "facts")


def verdicts(manifest: DataFrame) -> DataFrame:
    """repo_id with quality status, score out of ten and notes."""
    complete = F.coalesce(F.col("collection_status") == "complete", F.lit(False))
    fork, archived = F.coalesce("is_fork", F.lit(False)), F.coalesce("archived", F.lit(False))
    commits, files = F.col("commit_count"), F.col("source_file_count")
    enough_commits = F.coalesce(commits >= rules.MIN_COMMITS, F.lit(False))
    enough_files = F.coalesce(files >= rules.MIN_PYTHON_FILES, F.lit(False))
    python = F.coalesce(F.lower("language") == "python", F.lit(False))
    licensed = F.coalesce(F.col("license").isin(rules.APPROVED_LICENSES), F.lit(False))

    def points(test: Column, n: int) -> Column:
        return F.when(test, n).otherwise(0)

    def shown(column: str) -> Column:
        return F.coalesce(column, F.lit("None"))

    score = (
        F.lit(1)
        + points(~fork, 1)
        + points(~archived, 1)
        + points(enough_commits, 2)
        + points(enough_files, 2)
        + points(python, 1)
        + points(licensed, 2)
    )
    notes = F.array_compact(
        F.array(
            F.when(fork, "repository is a fork"),
            F.when(archived, "repository is archived"),
            F.when(commits.isNull(), F.lit("commit count unavailable")).when(
                ~enough_commits, F.concat(F.lit("too few commits: "), commits)
            ),
            F.when(files.isNull(), F.lit("source file count unavailable")).when(
                ~enough_files, F.concat(F.lit("too few Python files: "), files)
            ),
            F.when(~python, F.concat(F.lit("unexpected language: "), shown("language"))),
            F.when(~licensed, F.concat(F.lit("license not approved or unknown: "), shown("license"))),
        )
    )
    passed = F.when(F.size(notes) > 0, notes).otherwise(F.array(F.lit("repository passed all quality checks")))
    status = (
        F.when(~complete | fork | archived | ~enough_commits | ~enough_files, "rejected")
        .when(score >= 9, "high_quality")
        .when(score >= 7, "accepted")
        .otherwise("review")
    )
    return manifest.select(
        "repo_id",
        status.alias("status"),
        F.when(complete, score).otherwise(0).alias("score"),
        F.when(complete, passed).otherwise(F.array(F.lit("repository collection is not complete"))).alias("notes"),
    )


def record_verdicts(manifest: DataFrame, judged: DataFrame) -> DataFrame:
    """Manifest with quality status set and a note added, unless it is the last one already."""
    note = F.concat(F.lit("quality_score="), "score", F.lit("; "), F.array_join("notes", "; "))
    joined = manifest.join(judged.select("repo_id", "status", note.alias("note")), "repo_id", "left")
    old = F.coalesce("quality_notes", F.array().cast("array<string>"))
    same = F.try_element_at(old, F.lit(-1)).eqNullSafe(F.col("note"))
    return joined.withColumns(
        {
            "quality_status": F.coalesce("status", "quality_status"),
            "quality_notes": F.when(F.col("note").isNull() | same, old).otherwise(F.array_append(old, F.col("note"))),
        }
    ).drop("status", "note")


def verdict_counts(judged: DataFrame) -> DataFrame:
    return judged.agg(
        F.count_if(F.col("status").isin("accepted", "high_quality")).alias("accepted"),
        F.count_if(F.col("status") == "review").alias("review"),
        F.count_if(F.col("status") == "rejected").alias("rejected"),
    )


def status_counts(manifest: DataFrame) -> DataFrame:
    """Rows per collection status and per quality status, from one pass."""
    named = manifest.select(*[F.coalesce(c, F.lit("unknown")).alias(c) for c in ("collection_status", "quality_status")])
    sets = named.groupingSets([["collection_status"], ["quality_status"]], "collection_status", "quality_status").agg(
        F.grouping("collection_status").alias("g"), F.count(F.lit(1)).alias("repositories")
    )
    return sets.select(
        F.when(F.col("g") == 0, "collection").otherwise("quality").alias("kind"),
        F.coalesce("collection_status", "quality_status").alias("status"),
        "repositories",
    )


def repository_counts(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Commits and Python files per repository."""
    n_commits = commits.groupBy("repo_id").agg(F.count(F.lit(1)).alias("commit_count"))
    is_python = paths.is_source(F.col("file_path"), rules.PYTHON_EXTENSIONS)
    n_files = files.groupBy("repo_id").agg(F.count_if(is_python).alias("source_file_count"))
    return n_commits.join(n_files, "repo_id", "full").select(
        "repo_id", F.coalesce("commit_count", F.lit(0)).alias("commit_count"), F.coalesce("source_file_count", F.lit(0)).alias("source_file_count")
    )
