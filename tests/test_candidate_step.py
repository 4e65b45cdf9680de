"""The candidate step behind the quality reports and the candidates: what is read, stored and joined, and that the short ways equal the long ones."""

import pytest
from pyspark.sql import functions as F

from patchlake.functions import text
from patchlake.operators import candidates, quality
from patchlake.plans import bindings, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture
def steps(monkeypatch):
    """Names of what is stored, and of the bindings that are asked for, while a query is built."""
    seen = []
    for module in (candidates, queries):
        real = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name="table", real=real: seen.append(name) or real(df, name))
    for name in ("commit_changes", "patch_texts"):
        real = getattr(bindings, name)
        monkeypatch.setattr(bindings, name, lambda *given, name=name, real=real: seen.append(name) or real(*given))
    return seen


def commits(spark):
    """The given commits, and some with odd parents and messages."""
    given = bindings.patched_commits(spark, SF)
    odd = given.limit(60).withColumns(
        {"commit_hash": F.concat(F.lit("x"), "commit_hash"), "parent_count": F.lit(None).cast("int"), "subject": F.lit(None).cast("string")}
    )
    return given.unionByName(odd)


def test_histogram_moves_no_lists_and_reads_changes_once(spark, steps):
    queries.QUERIES["q_score_histogram"](spark, SF)
    assert sorted(steps) == ["commit_changes", "facts", "patch_texts"]


def test_rejections_read_texts_once(spark, steps):
    plan = queries.QUERIES["q_reject_top15"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert steps.count("patch_texts") == 1 and "collect_list" not in plan


def test_counts_of_files_serve_as_their_list(spark):
    changes, texts = bindings.commit_changes(spark, SF), bindings.patch_texts(spark, SF)
    about = bindings.repository_info(spark, SF)
    judged = candidates.judge_positives(commits(spark), changes, texts, patch_key=queries.PATCH_KEY)
    columns = ["record_id", "accepted", "score", "reasons"]
    with_lists, without = (
        quality.judge(candidates.records(judged, c, texts, about, patch_key=queries.PATCH_KEY), queries.SMALL_RECORDS).select(columns)
        for c in (changes, None)
    )
    assert sorted(with_lists.collect()) == sorted(without.collect()) and without.count() > 0


@pytest.mark.parametrize("limits", [None, queries.SMALL_DIFFS])
def test_accepted_positives_are_those_of_all_verdicts(spark, limits):
    given = commits(spark), bindings.commit_changes(spark, SF), bindings.patch_texts(spark, SF), limits
    short = candidates.accepted_positives(*given, patch_key=queries.PATCH_KEY)
    whole = candidates.judge_positives(*given, patch_key=queries.PATCH_KEY).filter("disposition = 'accepted'").select(short.columns)
    assert sorted(map(str, short.collect())) == sorted(map(str, whole.collect())) and short.count() > 0


def test_one_search_finds_what_each_pattern_finds(spark):
    patterns = [r"^\s*merge\b", r"\bbump version\b", r"#\d+", r"\bfix(?:ed)?\s+.*\bwrong\b"]
    rows = [(t,) for t in ("Merge it", " merge", "no merge", "merged", "bump version 2", "rebump version", "see #12", "# 12", "Fixed what was wrong", "", None)]
    df = spark.createDataFrame(rows, "t string")
    got = df.select(text.any_match(F.col("t"), patterns), F.when(F.col("t").isNotNull(), text.first_match(F.col("t"), patterns).isNotNull())).collect()
    assert [r[0] for r in got] == [r[1] for r in got]


def test_blank_patches(spark):
    df = spark.createDataFrame([("",), (" \t\n \x1c",), ("​",), (" + ",), (None,)], "patch string")
    assert [r[0] for r in df.select(quality._is_blank("patch")).collect()] == [True, True, False, False, True]


@pytest.mark.parametrize("positive_limits", [None, queries.SMALL_DIFFS])
def test_accepted_negatives_are_those_of_all_verdicts(spark, positive_limits):
    rows, changes, texts = commits(spark), bindings.commit_changes(spark, SF), bindings.patch_texts(spark, SF)
    short = candidates.accepted_negatives(rows, changes, texts, queries.SMALL_DIFFS, positive_limits, patch_key=queries.PATCH_KEY)
    positives = candidates.judge_positives(rows, changes, texts, positive_limits, patch_key=queries.PATCH_KEY).filter("disposition = 'accepted'")
    ids = positives.select(candidates.commit_key(F.col("repo_id"), F.col("commit_hash")).alias("record_id"))
    whole = candidates.judge_negatives(rows, changes, ids, texts, queries.SMALL_DIFFS, queries.PATCH_KEY).filter("disposition = 'accepted'")
    assert sorted(map(str, short.collect())) == sorted(map(str, whole.select(short.columns).collect())) and short.count() > 0


def test_negatives_are_judged_once_and_carry_no_text(spark, steps):
    plan = queries.QUERIES["q_candidates_neg"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(steps) == ["accepted", "changes", "commit_changes", "facts", "patch_texts"] and "text#" not in plan


def test_a_filter_on_the_signal_makes_no_second_message(spark):
    df = spark.createDataFrame([("Fix crash #3", None), ("docs: typo", "b")], "subject string, body string")
    strong = text.with_fix_signal(df).filter("bug_signal.score > 3")
    plan = strong._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and "lambdafunction" not in plan
    assert [tuple(r) for r in strong.select("subject", "bug_signal.*").collect()] == [("Fix crash #3", 6, ["crash", "fix", "issue_or_pr_reference"])]
