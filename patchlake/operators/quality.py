"""Evidence score, accept-or-reject verdict and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patchlake import rules
from patchlake.functions import paths, text
from patchlake.functions.patch import commit_key, fingerprint


def python_files(changed_files: Column) -> Column:
    return F.size(F.filter(changed_files, lambda f: paths.is_source(f["path"], rules.PYTHON_EXTENSIONS)))


def evidence(message: Column, original_score: Column) -> Column:
    """Score, reasons and the count of strong words found in a normalised message."""
    counts = F.struct(
        text.count_patterns(message, rules.STRONG_EVIDENCE_PATTERNS).alias("strong"),
        text.count_patterns(message, rules.SUPPORTING_PATTERNS).alias("support"),
        text.mentions_test_word(message).alias("tested"),
        F.coalesce(original_score, F.lit(0)).alias("original"),
    )

    def judged(c: Column) -> Column:
        strong, support, tested, original = (c[n] for n in ("strong", "support", "tested", "original"))
        points = (
            F.when(strong >= 3, 5).when(strong == 2, 4).when(strong == 1, 2).otherwise(0)
            + F.when(support >= 2, 3).when(support == 1, 1).otherwise(0)
            + F.when(tested, 1).otherwise(0)
            + F.when(original >= 5, 2).when(original >= 3, 1).otherwise(0)
        )
        reasons = text.named_hits(
            {
                "multiple_strong_bug_signals": strong >= 3,
                "two_strong_bug_signals": strong == 2,
                "strong_bug_signal": strong == 1,
                "multiple_supporting_signals": support >= 2,
                "supporting_signal": support == 1,
                "test_related": tested,
                "strong_original_signal": original >= 5,
                "moderate_original_signal": (original >= 3) & (original < 5),
            }
        )
        return F.struct(points.alias("score"), reasons.alias("reasons"), strong.alias("strong"))

    return text.let(counts, judged)


def _is_blank(patch: str) -> Column:
    return ~F.coalesce(F.col(patch).rlike(text.UNICODE + r"[^\s\x1c-\x1f]"), F.lit(False))


def patch_facts(patches: DataFrame) -> DataFrame:
    """``patches`` with what the verdict and the dedup need of a text, in the place of the text.

    Facts are worked out once per patch, where the text is; commits that share one
    do not repeat it.
    """
    return patches.withColumns({"patch_blank": _is_blank("patch"), "patch_sha256": fingerprint(F.col("patch"))}).drop("patch")


def judge(records: DataFrame, limits: dict | None = None) -> DataFrame:
    """Candidate records with ``accepted``, ``score`` and ``reasons``.

    Needs language, repo_id, commit, bug_signal, changed_files, diff_stats and
    patch as in the candidate schema, or the facts of :func:`patch_facts` and ``python_files`` in place of the list. The
    first failing test decides; a record turned down for its score keeps the reasons of that score.
    """
    limit = {**rules.QUALITY_LIMITS, **(limits or {})}
    changed = F.coalesce("diff_stats.added_lines", F.lit(0)) + F.coalesce("diff_stats.deleted_lines", F.lit(0))
    blank_patch = F.coalesce("patch_blank", F.lit(True)) if "patch_blank" in records.columns else _is_blank("patch")

    listed = "changed_files" in records.columns
    python = python_files(F.col("changed_files")) if listed else F.col("python_files")
    files = F.size("changed_files") if listed else F.col("diff_stats.files_changed")

    def objection(message: Column) -> Column:
        return (
            F.when(F.lower(F.coalesce("language", F.lit(""))) != "python", "non_python_repository")
            .when(F.coalesce("commit.hash", F.lit("")) == "", "missing_commit_hash")
            .when(message == "", "empty_commit_message")
            .when(text.any_match(message, rules.REJECT_PATTERNS), "reject_message_pattern")
            .when(F.coalesce(python, F.lit(0)) <= 0, "no_python_source_change")
            .when(changed < limit["min_lines"], "empty_change")
            .when(changed > limit["max_lines"], "patch_too_large")
            .when(files > limit["max_files"], "too_many_changed_files")
            .when(blank_patch, "empty_patch")
        )

    def verdict(found: Column) -> Column:
        stopped, proof = found["objection"].isNotNull(), found["evidence"]
        doubt = F.when(proof["score"] < limit["min_score"], "insufficient_bug_evidence").when(proof["strong"] == 0, "no_explicit_bug_signal")
        return F.struct(
            (~stopped & doubt.isNull()).alias("accepted"),
            F.when(stopped, 0).otherwise(proof["score"]).alias("score"),
            F.when(stopped, F.array(found["objection"]))
            .otherwise(F.concat(proof["reasons"], F.array_remove(F.array(F.coalesce(doubt, F.lit(""))), "")))
            .alias("reasons"),
        )

    message = text.message(F.col("commit.subject"), F.col("commit.body"))

    def looked_at(t: Column) -> Column:
        # Evidence is looked for only where nothing objects.
        return text.let(
            F.struct(t.alias("message"), objection(t).alias("objection")),
            lambda o: F.struct(o["objection"], F.when(o["objection"].isNull(), evidence(o["message"], F.col("bug_signal.score"))).alias("evidence")),
        )

    found = text.let(message, looked_at)
    judged = records.withColumn("__verdict", text.let(found, verdict))
    return judged.withColumns({n: F.col(f"__verdict.{n}") for n in ("accepted", "score", "reasons")}).drop("__verdict")


def accepted_records(judged: DataFrame) -> DataFrame:
    """Accepted records with their evidence as ``dataset_quality``."""
    return (
        judged.filter("accepted")
        .withColumn("dataset_quality", F.struct(F.lit("v2").alias("version"), "score", "reasons"))
        .drop("accepted", "score", "reasons")
    )


def top_rejections(judged: DataFrame, limit: int = 15) -> DataFrame:
    """The most common reasons of rejected records.

    Rejected records are counted by their whole list of reasons, not filtered: a
    filter would move below the verdict and judge every record a second time. So
    would the one that a plain explode implies.
    """
    lists = judged.groupBy("reasons").agg(F.count_if(~F.col("accepted")).alias("n")).filter("n > 0")
    return (
        lists.select(F.explode_outer("reasons").alias("reason"), "n")
        .filter(F.col("reason").isNotNull())
        .groupBy("reason")
        .agg(F.sum("n").alias("records"))
        .orderBy(F.desc("records"), "reason")
        .limit(limit)
    )


def score_histogram(judged: DataFrame) -> DataFrame:
    """Accepted records by score, counted without a filter for the same reason."""
    return judged.groupBy("score").agg(F.count_if("accepted").alias("records")).filter("records > 0")


def dedup_keys(records: DataFrame, order: str = "record_id") -> DataFrame:
    """Narrow rows for the two-key dedup: order key, commit key and patch fingerprint."""
    known = "patch_sha256" in records.columns
    return records.select(
        F.col(order).alias("order_key"),
        commit_key(F.col("repo_id"), F.col("commit.hash")).alias("key_a"),
        (F.coalesce("patch_sha256", fingerprint(F.lit(""))) if known else fingerprint(F.col("patch"))).alias("key_b"),
    )
