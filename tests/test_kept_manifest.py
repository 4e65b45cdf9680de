"""The stored manifest: versions, lost races, repeated and late batches."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from patchlake.operators import manifest
from patchlake.operators.kept_manifest import Conflict, KeptManifest

EVENTS = "repo_id string, at timestamp, event string, error string, " + ", ".join(f"{c} bigint" for c in manifest.COUNTERS)
SHOWN = ["repo_id", "collection_status", "collection_error", *manifest.COUNTERS, "last_collected_at"]


def repositories(spark, *ids):
    return manifest.new_records(spark.createDataFrame([(i,) for i in ids], "repo_id string"))


def shown(df):
    return sorted((tuple(r) for r in df.select(*SHOWN).collect()), key=str)


def test_two_writers_one_loses(spark, tmp_path):
    kept = KeptManifest(spark, str(tmp_path / "m"))
    assert kept.version() == 0
    assert kept.create(repositories(spark, "a")) == 1
    with pytest.raises(Conflict):
        kept.create(repositories(spark, "z"))
    base, start = kept.version(), kept.read()
    first = manifest.update(start, spark.createDataFrame([("a", 7)], "repo_id string, stars bigint"))
    second = manifest.update(start, spark.createDataFrame([("a", 9)], "repo_id string, stars bigint"))
    assert kept.commit(first, base) == 2
    with pytest.raises(Conflict):
        kept.commit(second, base)
    assert [r.stars for r in kept.read().collect()] == [7]
    assert sorted(os.listdir(tmp_path / "m")) == ["v0000000001", "v0000000002"]
    assert [r.stars for r in kept.read(1).collect()] == [0]


def test_a_lost_race_is_run_again_from_the_winner(spark, tmp_path):
    kept = KeptManifest(spark, str(tmp_path / "m"))
    kept.create(repositories(spark, "a"))
    raced = []

    def step(rows):
        if not raced:
            raced.append(kept.add(repositories(spark, "b")))
        return rows.withColumn("stars", F.col("stars") + 1)

    assert kept.change(step) == 3
    assert sorted((r.repo_id, r.stars) for r in kept.read().collect()) == [("a", 1), ("b", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order_equal_all_events_at_once(spark, tmp_path, seed):
    rng = random.Random(seed)
    ids = ["a", "b", "c", "d"]
    moments = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i) for i in range(24)]
    rows = [
        (rng.choice(["a", "a", "b", "c", "gone"]), at, rng.choice(["started", "complete", "failed"]), rng.choice([None, "broken"]), i, None, 2 * i, 3)
        for i, at in enumerate(moments)
    ]
    events = spark.createDataFrame(rows, EVENTS)
    want = shown(manifest.apply_events(repositories(spark, *ids), events))
    kept = KeptManifest(spark, str(tmp_path / "m"))
    kept.create(repositories(spark, *ids))
    rng.shuffle(rows)
    batches = [rows[i::3] for i in range(3)]
    for batch in batches:
        version = kept.apply(spark.createDataFrame(batch, EVENTS))
        assert kept.apply(spark.createDataFrame(batch, EVENTS)) == version
    assert shown(kept.read()) == want
    version = kept.version()
    for batch in batches[::-1]:
        kept.apply(spark.createDataFrame(batch, EVENTS))
    kept.apply(spark.createDataFrame([("a", None, "failed", "no time", 1, 1, 1, 1), (None, moments[0], "failed", None, 1, 1, 1, 1)], EVENTS))
    kept.apply(spark.createDataFrame([], EVENTS))
    assert kept.version() == version and shown(kept.read()) == want


def test_additions_and_notes_repeat_without_a_version(spark, tmp_path):
    kept = KeptManifest(spark, str(tmp_path / "m"))
    kept.create(repositories(spark, "a"))
    assert kept.add(repositories(spark, "a", "b")) == 2
    assert kept.add(repositories(spark, "b", "a")) == 2
    judged = spark.createDataFrame([("b", "accepted", 8, ["few files"])], "repo_id string, status string, score int, notes array<string>")
    assert kept.record(judged) == 3 and kept.record(judged) == 3
    assert {r.repo_id: (r.quality_status, len(r.quality_notes)) for r in kept.read().collect()} == {"a": ("unknown", 0), "b": ("accepted", 1)}
    assert kept.update(spark.createDataFrame([("b", 4)], "repo_id string, forks bigint")) == 4
    assert kept.prune(keep=1) == 3 and kept.versions() == [4]
    assert kept.read().count() == 2
