"""Positive and negative commit candidates from commits, line counts and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchlake import rules
from patchlake.functions import paths, text
from patchlake.functions.patch import commit_key, size_verdict
from patchlake.session import stored

COMMIT_URL = "https://github.com/"

# Counters of the extraction report, by the disposition of a commit.
POSITIVE_COUNTERS = {
    "no_parent": ["no_parent"],
    "merge_commits": ["merge"],
    "no_source_diff": ["no_source_files"],
    "accepted": ["accepted"],
}
NEGATIVE_COUNTERS = {
    **POSITIVE_COUNTERS,
    "already_positive": ["already_positive"],
    "bug_signal": ["explicit_intent"],
    "routine_signal_zero": ["no_routine_signal"],
}
_NOT_EXAMINED = ["no_parent", "merge", "already_positive", "explicit_intent", "no_routine_signal", "weak_signal"]


# What tells that the paths of changes have been looked at.
_USEFUL = ("is_source", "ignored")


def useful_changes(changes: DataFrame, path: str = "path") -> DataFrame:
    """Changes of source files that are not generated, vendored or lock files.

    Their marks stay beside them; changes that come with marks are not tested again.
    """
    if set(_USEFUL) <= set(changes.columns):
        return changes.filter("is_source and not ignored")
    useful = changes.filter(paths.is_source(F.col(path)) & ~paths.is_ignored(F.col(path)))
    return useful.withColumns({"is_source": F.lit(True), "ignored": F.lit(False)})


def diff_stats(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Files, Python files and line counts per commit over the useful changes."""
    return (
        useful_changes(changes)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("files_changed"),
            F.sum("added_lines").alias("added_lines"),
            F.sum("deleted_lines").alias("deleted_lines"),
            F.count_if(paths.is_source(F.col("path"), rules.PYTHON_EXTENSIONS)).alias("python_files"),
        )
    )


def _commit_columns(df: DataFrame) -> list[str]:
    """The key of a commit in ``df``; a source may name a commit by its hash alone."""
    return [c for c in ("repo_id", "commit_hash") if c in df.columns]


def file_lists(changes: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """Useful changes of the accepted commits as one array per commit, by path.

    The arrays are short: an accepted commit has at most the allowed number of
    files, and commits beyond it are gone before anything is collected.
    """
    item = F.struct(
        "path",
        "added_lines",
        "deleted_lines",
        *_USEFUL,
    )
    return (
        useful_changes(changes)
        .join(accepted.select(*keys), keys, "left_semi")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(item)).alias("changed_files"))
    )


# Parts that a repository is ranked in before the parts meet.
_CAP_PARTS = 64


# What a commit and its patch share, unless a source keeps patches under a key of their own.
PATCH_KEY = ("repo_id", "commit_hash")


def sized_commits(
    commits: DataFrame, changes: DataFrame, patches: DataFrame | None = None, patch_key: tuple[str, ...] = PATCH_KEY
) -> DataFrame:
    """Commits with the size of their diff and of their patch, which the verdicts of both classes need.

    ``changes`` has one row per path, or :func:`diff_stats` in their place.
    """
    keys = _commit_columns(changes)
    stats = changes if "files_changed" in changes.columns else diff_stats(changes, keys)
    sized = commits.join(stats, keys, "left")
    if patches is None:
        return sized.withColumn("patch_chars", F.lit(0))
    return sized.join(patch_sizes(patches, patch_key), [*patch_key], "left")


def _disposition(before: Column, limits: dict | None) -> Column:
    """``before`` where it is set, else the verdict on the diff."""
    verdict = size_verdict(
        F.col("files_changed"), F.col("added_lines"), F.col("deleted_lines"), F.coalesce("patch_chars", F.lit(0)), limits
    )
    return F.coalesce(before, verdict, F.lit("accepted"))


def patch_sizes(patches: DataFrame, patch_key: tuple[str, ...] = PATCH_KEY) -> DataFrame:
    """Lengths per patch; a source that has them beside the text gives ``patch_chars`` and never moves the text.

    Whether a patch is blank goes along if it is known.
    """
    chars = F.col("patch_chars") if "patch_chars" in patches.columns else F.length("patch").alias("patch_chars")
    return patches.select(*patch_key, chars, *[c for c in ["patch_blank"] if c in patches.columns])


def positive_verdicts(sized: DataFrame, limits: dict | None = None, min_score: int = rules.MIN_SIGNAL_SCORE) -> DataFrame:
    """Commits of :func:`sized_commits` with their signal and disposition as positives, row by row."""
    before = (
        F.when(F.col("parent_count") == 0, F.lit("no_parent"))
        .when(F.col("parent_count") > 1, F.lit("merge"))
        .when(F.col("bug_signal.score") < min_score, F.lit("weak_signal"))
    )
    return text.with_fix_signal(sized).withColumn("disposition", _disposition(before, limits))


def with_known(judged: DataFrame) -> DataFrame:
    """Commits with verdicts as positives, ready to be judged as negatives without a join."""
    return judged.withColumn("known", F.col("disposition") == "accepted").drop("disposition", "bug_signal")


def judge_positives(
    commits: DataFrame,
    changes: DataFrame | None = None,
    patches: DataFrame | None = None,
    limits: dict | None = None,
    min_score: int = rules.MIN_SIGNAL_SCORE,
    patch_key: tuple[str, ...] = PATCH_KEY,
) -> DataFrame:
    """Every commit with its signal and what became of it, stored, since a filter would work out the signal again.

    ``commits`` has repo_id, commit_hash, parent_count, subject, body; ``changes``
    repo_id, commit_hash, path, added_lines, deleted_lines; ``patches`` repo_id,
    commit_hash, patch, or other columns ``patch_key`` of the commits in their
    place. Commits of :func:`sized_commits` need neither.
    """
    sized = commits if changes is None else sized_commits(commits, changes, patches, patch_key)
    return stored(positive_verdicts(sized, limits, min_score), "judged")


def judge_negatives(
    commits: DataFrame,
    changes: DataFrame | None = None,
    positive_ids: DataFrame | None = None,
    patches: DataFrame | None = None,
    limits: dict | None = None,
    patch_key: tuple[str, ...] = PATCH_KEY,
) -> DataFrame:
    """As for positives, for ordinary work. ``positive_ids`` has a column record_id.

    Without ``positive_ids`` the commits say in a column ``known`` whether they are
    positives, so that no join has to find out. The signal decides nothing here, so
    it is worked out last, on the rows that are asked for.
    """
    sized = commits if changes is None else sized_commits(commits, changes, patches, patch_key)
    if positive_ids is not None:
        known = positive_ids.select("record_id").distinct().withColumn("known", F.lit(True))
        sized = sized.withColumn("record_id", commit_key(F.col("repo_id"), F.col("commit_hash"))).join(known, "record_id", "left").drop("record_id")
    subject, body = F.col("subject"), F.col("body")
    before = (
        F.when(F.col("parent_count") == 0, F.lit("no_parent"))
        .when(F.col("parent_count") > 1, F.lit("merge"))
        .when(F.col("known"), F.lit("already_positive"))
        .when(text.has_explicit_intent(subject, body), F.lit("explicit_intent"))
        .when(text.routine_score(subject, body) == 0, F.lit("no_routine_signal"))
    )
    judged = stored(sized.withColumn("disposition", _disposition(before, limits)).drop("known"), "judged")
    return text.with_plain_signal(judged)


def _unmerged(commits: DataFrame) -> DataFrame:
    """Commits that are neither a first one nor a merge."""
    return commits.filter("parent_count is null or parent_count != 0 and parent_count <= 1")


def accepted_positives(
    commits: DataFrame,
    changes: DataFrame,
    patches: DataFrame | None = None,
    limits: dict | None = None,
    min_score: int = rules.MIN_SIGNAL_SCORE,
    patch_key: tuple[str, ...] = PATCH_KEY,
) -> DataFrame:
    """The accepted rows of :func:`judge_positives`, for those who ask for no others.

    Messages are judged where the commits are read, and only commits that pass are
    joined. The signal is exploded from an array that is empty if it is too weak: a
    filter beside it would work it out twice.
    """
    single = text.with_fix_signal(_unmerged(commits), out="__signal")
    strong = F.filter(F.array("__signal"), lambda s: ~F.coalesce(s["score"] < min_score, F.lit(False)))
    scored = single.select(*commits.columns, F.explode(strong).alias("bug_signal"))
    sized = sized_commits(scored, changes, patches, patch_key)
    return sized.withColumn("disposition", _disposition(F.lit(None).cast("string"), limits)).filter("disposition = 'accepted'")


def accepted_negatives(
    commits: DataFrame,
    changes: DataFrame,
    patches: DataFrame | None = None,
    limits: dict | None = None,
    positive_limits: dict | None = None,
    min_score: int = rules.MIN_SIGNAL_SCORE,
    patch_key: tuple[str, ...] = PATCH_KEY,
) -> DataFrame:
    """The accepted rows of :func:`judge_negatives` where the positives are those of the same commits.

    The tests of the message come first; what both verdicts need is joined once to
    the commits that pass them.
    """
    subject, body = F.col("subject"), F.col("body")
    routine = _unmerged(commits).filter(
        F.coalesce(~text.has_explicit_intent(subject, body), F.lit(True)) & F.coalesce(text.routine_score(subject, body) != 0, F.lit(True))
    )
    sized = sized_commits(routine, changes, patches, patch_key)
    fit = sized.withColumn("disposition", _disposition(F.lit(None).cast("string"), limits)).filter("disposition = 'accepted'")
    judged = with_known(positive_verdicts(fit.drop("disposition"), positive_limits, min_score)).filter("not known").drop("known")
    return text.with_plain_signal(judged).withColumn("disposition", F.lit("accepted"))


# What a patch leaves in a record: its text, or facts of it in its place (see quality.patch_facts).
PATCH_COLUMNS = ["patch", "patch_blank", "patch_sha256", "patch_md5"]


def records(
    judged: DataFrame,
    changes: DataFrame | None,
    patches: DataFrame | None,
    repositories: DataFrame,
    negative: bool = False,
    patch_key: tuple[str, ...] = PATCH_KEY,
) -> DataFrame:
    """Nested candidate records of the accepted commits.

    Patch text is joined here only, after everything that can drop a commit. If
    ``patches`` has facts in place of the text, they stand in the record instead,
    and no text moves; what the commits carry already is not joined. Without
    ``changes`` the number of Python files stands in the place of the list of files.
    """
    about = repositories.select("repo_id", "name", "owner", "language", "clone_url")
    full = judged.filter(F.col("disposition") == "accepted")
    if changes is not None:
        # Two joins need them.
        accepted, keys = stored(full, "accepted"), _commit_columns(changes)
        full = accepted.join(file_lists(changes, accepted, keys), keys)
    joined = [] if patches is None else [c for c in PATCH_COLUMNS if c in patches.columns and c not in judged.columns]
    if joined:
        full = full.join(patches.select(*patch_key, *joined), [*patch_key], "left")
    full = full.join(about, "repo_id", "left")
    carried = [c for c in PATCH_COLUMNS if c in full.columns]
    columns = [
        commit_key(F.col("repo_id"), F.col("commit_hash")).alias("record_id"),
        F.col("repo_id"),
        F.col("name").alias("repository"),
        F.col("owner"),
        F.col("language"),
        F.struct(
            F.col("commit_hash").alias("hash"), "parent", "author", F.col("ts").alias("date"), "subject", "body"
        ).alias("commit"),
        F.col("bug_signal"),
        F.col("python_files" if changes is None else "changed_files"),
        F.struct("files_changed", "added_lines", "deleted_lines").alias("diff_stats"),
        *carried,
        F.struct(
            F.lit("high_quality").alias("status"), F.array().cast("array<string>").alias("reasons")
        ).alias("quality"),
        F.struct(
            F.lit("git_history").alias("source"),
            F.col("clone_url").alias("repository_url"),
            F.concat(F.lit(COMMIT_URL), "repo_id", F.lit("/commit/"), "commit_hash").alias("commit_url"),
        ).alias("provenance"),
    ]
    if negative:
        reasons = [
            "no_explicit_bug_fix_intent",
            "routine_development_signal",
            "source_code_change",
            "structurally_valid_diff",
        ]
        columns += [
            F.lit(0).alias("label"),
            F.struct(
                F.lit("negative_v2").alias("version"), F.lit(4).alias("score"), F.array(*[F.lit(r) for r in reasons]).alias("reasons")
            ).alias("dataset_quality"),
        ]
    return full.select(*columns)


def cap_per_repository(
    rows: DataFrame,
    order: list[str],
    per_repo: int = rules.MAX_NEGATIVES_PER_REPO,
    total: int = rules.TARGET_NEGATIVES,
    repo_position: str = "repo_id",
) -> DataFrame:
    """The first rows of each repository, then the first rows over all repositories.

    Rows are ranked in parts of a repository first; of each part at most
    ``per_repo`` rows go on to the rank within the repository. So no task sorts a
    whole repository, whatever the limit. Pass narrow rows and join back.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(_CAP_PARTS))
    inside = F.row_number().over(Window.partitionBy("repo_id", "__part").orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(*order))
    rows = rows.withColumn("__part", part).withColumn("__inside", inside).filter(F.col("__inside") <= per_repo).drop("__part", "__inside")
    return rows.withColumn("repo_rank", rank).filter(F.col("repo_rank") <= per_repo).orderBy(repo_position, "repo_rank").limit(total)


def extraction_stats(judged: DataFrame, negative: bool = False) -> DataFrame:
    """Counters per repository, and in total where repo_id is null.

    One commit may feed several counters: it is seen, perhaps examined, and a
    diff with no source file is also a rejected one.
    """
    named = NEGATIVE_COUNTERS if negative else POSITIVE_COUNTERS
    disposition = F.col("disposition")
    examined = ~disposition.isin(_NOT_EXAMINED)
    return judged.rollup("repo_id").agg(
        F.count(F.lit(1)).alias("commits_seen"),
        F.count_if(examined).alias("eligible" if negative else "bug_candidates"),
        F.count_if(examined & (disposition != "accepted")).alias("rejected"),
        *[F.count_if(disposition.isin(values)).alias(name) for name, values in named.items()],
    )


def mine_fixes(file_patches: DataFrame) -> DataFrame:
    """File patches whose message reads like a fix, with a string label."""
    return file_patches.filter(text.is_fix_message(F.col("message"))).select(
        "commit_hash", "timestamp", "author_name", "message", "file_path", "change_type", "patch",
        "added_lines", "removed_lines", "added_line_count", "removed_line_count", F.lit("bug_fix").alias("label"),
    )
