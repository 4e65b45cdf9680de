"""Steps that grew faster than their input: patch text in the candidate chain, verdicts, changes read again, stream state, label counts."""

import json
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from patchlake.operators import quality
from patchlake.plans import bindings, queries
from patchlake.streaming import history as arrival

SF = "/root/testdata/sf0.001"


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_facts_of_a_patch_serve_as_its_text(spark):
    texts = spark.createDataFrame([(1, " A\tb "), (2, "a b"), (3, " \n"), (4, None)], "patch_id int, patch string")
    facts = quality.patch_facts(texts)
    assert "patch" not in facts.columns
    commit = F.struct(F.col("patch_id").cast("string").alias("hash"))
    keyed = [quality.dedup_keys(df.select("*", F.lit("r").alias("repo_id"), commit.alias("commit")), "patch_id") for df in (texts, facts)]
    assert sorted(keyed[0].collect()) == sorted(keyed[1].collect())
    assert [r.patch_blank for r in facts.orderBy("patch_id").collect()] == [False, False, True, True]


def test_chain_and_verdicts_move_no_text(spark):
    records = queries._judged_records(spark, SF)
    assert "patch" not in records.columns
    changes = queries._useful_changes(spark, SF)
    texts = queries._records(spark, SF, queries._positives(spark, SF, changes, None), changes, bindings.patch_texts(spark, SF))
    want = quality.judge(texts, queries.SMALL_RECORDS).select("record_id", "accepted", "score", "reasons")
    assert sorted(records.select(*want.columns).collect()) == sorted(want.collect())


def test_reports_judge_each_record_once(spark):
    judged = queries._judged_records(spark, SF)
    for report in (quality.score_histogram(judged), quality.top_rejections(judged)):
        assert optimised(report).count("reject_message_pattern") == 1


def test_changes_are_made_once_for_both_classes(spark, monkeypatch):
    made, real = [], bindings.commit_changes
    monkeypatch.setattr(bindings, "commit_changes", lambda *given: made.append(1) or real(*given))
    for name in ("q_candidates_pos", "q_candidates_neg"):
        made.clear()
        assert "l_partkey" not in optimised(queries.QUERIES[name](spark, SF)) and len(made) == 1


class State:
    """A state of one key, as the stream would hand it over."""

    exists, get, timeout = False, None, None

    def __init__(self, watermark_ms):
        self.watermark_ms = watermark_ms

    def getCurrentWatermarkMs(self):
        return self.watermark_ms

    def update(self, values):
        self.exists, self.get = True, values

    def setTimeoutTimestamp(self, ms):
        self.timeout = ms


def test_many_instants_of_one_path_take_linear_time():
    n = 80_000
    us = np.repeat(np.arange(n // 2) * 1000, 2)
    pdf = pd.DataFrame(
        {"us": us, "request_id": [f"r{i}" for i in range(n)], "changes": 1, "fixes": us // 1000 % 2, "plus": 3, "minus": 1, "author": [f"a{i % 7}" for i in range(n)]}
    )
    state, start = State(10**9), time.process_time()
    (got,) = arrival._answer(("p",), iter([pdf.sample(frac=1, random_state=1)]), state)
    assert time.process_time() - start < 5
    got = got.sort_values("us", kind="stable")
    assert len(got) == n and (got["commits"] == us // 1000 * 2).all() and (got["plus"] == 3 * got["commits"]).all()
    assert got["authors"].tolist()[:10] == [0, 0, 2, 2, 4, 4, 6, 6, 7, 7] and got["last"].isna().sum() == 2
    assert state.get[0] == n and state.get[4] == us[-1] and json.loads(state.get[5]) == [f"a{i}" for i in range(7)]


def test_state_goes_on_with_late_and_waiting_events():
    def batch(*rows):
        return pd.DataFrame(rows, columns=arrival._EVENT)

    state = State(1)
    assert list(arrival._answer(("p",), iter([batch([5000, "a", 1, 1, 2, 3, "x"], [2000, None, 0, None, None, None, None])]), state)) == []
    state.watermark_ms = 7
    (got,) = arrival._answer(("p",), iter([batch([4000, "late", 1, 0, 1, 1, None], [9000, "z", 1, 0, 0, 0, "y"])]), state)
    assert got.astype(object).where(got.notna(), None).values.tolist() == [
        ["p", "late", 4000, 0, 0, 0, 0, 0, None], ["p", "a", 5000, 1, 0, 1, 1, 0, 4000]
    ]
    state.watermark_ms = 20
    (got,) = arrival._answer(("p",), iter([]), state)
    assert got.values.tolist() == [["p", "z", 9000, 2, 1, 3, 4, 1, 5000]]


def test_no_batch_of_the_stream_is_written_by_one_task(spark, monkeypatch):
    single, real = [], type(spark.range(1)).coalesce
    monkeypatch.setattr(type(spark.range(1)), "coalesce", lambda df, n: single.append(df.count()) or real(df, n))
    assert queries.QUERIES["q_stream_history"](spark, SF).count() > 5000 and all(rows <= 1 for rows in single)


def test_label_stats_reads_the_changes_once(spark):
    plan = optimised(queries.QUERIES["q_label_stats"](spark, SF))
    assert "Join LeftOuter" not in plan and "l_partkey" not in plan
