"""Fits proved by their slopes, training in steps with a choice, history features in a stream, numbered lines, long chains."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from patchlake import rules
from patchlake.operators import bpe, dedup, features, history, models, structure, tfidf, training
from patchlake.plans import source_queries
from patchlake.sources import tables
from patchlake.streaming import history as arrival


def records(spark, n: int = 90):
    rng = random.Random(4)
    words = ["guard", "raise", "none", "docs", "style", "rename", "x", "y"]
    rows = []
    for i in range(n):
        label = int(rng.random() < 0.4)
        text = " ".join(rng.choice(words[:3] if rng.random() < 0.3 + 0.4 * label else words[3:]) for _ in range(rng.randrange(1, 15)))
        rows.append((str(i), label, text if i % 11 else None, rng.randrange(9) + 3 * label, rng.randrange(5), "modified" if i % 3 else "added", "a.py" if i % 4 else "b.js"))
    columns = "record_id string, label int, patch string, added_line_count int, removed_line_count int, change_type string, file_path string"
    df = spark.createDataFrame(rows, columns)
    return features.change_columns(df).withColumn("model_text", features.model_text(None, F.col("patch")))


BLOCKS = {"numerics": features.CHANGE_NUMERICS, "categories": features.CATEGORIES, "text_pattern": tfidf.WORD, "min_docs": 1, "max_share": 1.0}


def matrix(classifier, df):
    rows = sorted(classifier.inputs(df).select("record_id", "label", "features").collect(), key=lambda r: int(r[0]))
    return np.array([r.features.toArray() for r in rows]), np.array([float(r.label) for r in rows])


def test_slopes_of_every_place(spark):
    df = records(spark)
    fitted = models.train(df, 500, **BLOCKS)
    x, y = matrix(fitted, df)
    weights, n = features.balanced_weights(df)
    w = np.array([weights[int(v)] for v in y])

    def slope(beta, intercept):
        error = w * (1 / (1 + np.exp(-(x @ beta + intercept))) - y) / n
        return np.append(x.T @ error + beta / n, error.sum())

    blank = fitted.with_model(models.Linear(np.zeros(x.shape[1]), 0.0))
    for classifier in (fitted, blank):
        found = sorted(models.gradient(classifier, df).collect(), key=lambda r: (r.slot < 0, r.slot))
        want = slope(classifier.model.coefficients.toArray(), classifier.model.intercept)
        assert [r.gradient for r in found] == pytest.approx(want.tolist(), abs=1e-9)
        assert [r.start for r in found] == pytest.approx(slope(np.zeros(x.shape[1]), 0.0).tolist(), abs=1e-9)
    steepest = max(abs(r.start) for r in found)
    # The proof tells a fitted model from one that never saw a row.
    assert max(abs(r.gradient) for r in models.gradient(fitted, df).collect()) < 0.005 * steepest
    assert max(abs(r.gradient) for r in found) == pytest.approx(steepest)


def test_coefficients_of_all_blocks(spark):
    fitted = models.train(records(spark), 500, **BLOCKS)
    named = models.coefficients(fitted).collect()
    values = fitted.model.coefficients.toArray()
    assert len(named) == len(values) == fitted.size()
    assert [abs(r.coefficient) for r in named] == sorted((abs(v) for v in values), reverse=True)
    assert {"guard", "docs style", "added", "total_changes", ".py", "modified"} <= {r.feature for r in named}
    assert all((r.coefficient > 0) == (r.direction == "bug-risk") for r in named)


def sequential(x, y, vx, vy, strengths, iterations, max_steps, patience):
    n = len(y)
    share = {c: n / (2 * (y == c).sum()) for c in (0.0, 1.0)}
    w, vw = np.array([share[v] for v in y]), np.array([share[v] for v in vy])
    x1, v1 = np.column_stack([x, np.ones(n)]), np.column_stack([vx, np.ones(len(vy))])
    start, out = np.zeros(x1.shape[1]), []
    for run, c in enumerate(sorted(strengths)):
        keep = np.append(np.full(x.shape[1], 1 / (c * n)), 0.0)
        rate = 1 / (0.25 * (w * (x1**2).sum(axis=1)).sum() / n + 1 / (c * n))
        now = before = start
        best, without, done = (-1.0, float("inf")), 0, 0
        for step in range(1, max_steps + 1):
            for _ in range(iterations):
                ahead = now + done / (done + 3) * (now - before)
                slope = x1.T @ (w * (1 / (1 + np.exp(-x1 @ ahead)) - y)) / n + keep * ahead
                before, now, done = now, ahead - rate * slope, done + 1
            m = v1 @ now
            loss = (vw * (np.logaddexp(0, m) - vy * m)).sum() / vw.sum()
            tp, fp, fn = ((m > 0) & (vy == 1)).sum(), ((m > 0) & (vy == 0)).sum(), ((m <= 0) & (vy == 1)).sum()
            f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
            gain = f1 > best[0] or (f1 == best[0] and loss < best[1])
            if gain:
                best, without, start = (f1, loss), 0, now
            else:
                without += 1
            out.append((run, step, c, loss, f1, gain, without >= patience, now))
            if without >= patience:
                break
    chosen = min(range(len(out)), key=lambda i: (-out[i][4], out[i][3], i))
    return out, chosen


def test_choice_on_validation_equals_a_loop(spark, tmp_path):
    df = records(spark)
    train, validation = df.where("record_id < 60"), df.where("record_id >= 60")
    blocks, _ = models.fit_blocks(train, **BLOCKS)
    options = ((50.0, 0.02), 2, 7, 2)
    choice = training.choose(train, validation, blocks, *options)
    want, best = sequential(*matrix(blocks, train), *matrix(blocks, validation), *options)
    got = sorted(choice.history.collect(), key=lambda r: (r.run, r.step))
    assert [(r.run, r.step, r.c, r.gain, r.stopped) for r in got] == [(r, s, c, bool(g), bool(e)) for r, s, c, _, _, g, e, _ in want]
    assert [v for r in got for v in (r.loss, r.f1)] == pytest.approx([v for r in want for v in r[3:5]], abs=1e-9)
    assert [r.chosen for r in got].index(True) == best and sum(r.chosen for r in got) == 1
    assert any(r.stopped for r in got)  # the rule that ends a run early is met
    linear = choice.classifier.model
    assert np.append(linear.weights, linear.intercept).tolist() == pytest.approx(want[best][7].tolist(), abs=1e-9)
    choice.classifier.save(str(tmp_path / "model"))
    loaded = models.Classifier.load(spark, str(tmp_path / "model"))
    scores = lambda m: {r.record_id: r.probability_bug_fix for r in m.score(validation).collect()}
    assert scores(loaded) == pytest.approx(scores(choice.classifier)) and len(scores(loaded)) == 30


# --- streamed history


def test_history_at_arrival_equals_the_batch(spark, tmp_path):
    rng = random.Random(6)
    day = history.DAY_US
    changes = [(f"p{rng.randrange(4)}", rng.randrange(100) * day // 2 + 10**15, f"r{i}", f"dev{rng.randrange(3)}" if i % 5 else None, rng.randrange(2), i % 7, i % 3) for i in range(300)]
    schema = "path string, us bigint, request_id string, author string, fixes bigint, plus bigint, minus bigint"
    rows = spark.createDataFrame(changes, schema).withColumn("changes", F.lit(1).cast("bigint"))
    late = spark.createDataFrame([("p0", 10**15, "late", "dev9", 1, 1, 1)], schema).withColumn("changes", F.lit(1).cast("bigint"))
    asked = spark.createDataFrame([("p0", 10**15 + 20 * day, "question", None, 0, 0, 0), ("new", 10**15 + 20 * day, "first", None, 0, 0, 0)], schema)
    asked = asked.withColumn("changes", F.lit(0).cast("bigint"))
    end = spark.createDataFrame([("end", 10**15 + 9000 * day, None, None, 0, 0, 0)], schema).withColumn("changes", F.lit(0).cast("bigint"))
    order = sorted(changes, key=lambda c: c[1] + rng.randrange(8) * day)  # rows come up to eight days late
    names = [c[2] for c in order]
    for part in range(4):
        chosen = names[part * 75 : (part + 1) * 75]
        batch = rows.where(F.col("request_id").isin(chosen))
        (batch.unionByName(asked) if part == 1 else batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # far behind the watermark
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    answers = arrival.history_at_arrival(events.withColumn("event_time", F.timestamp_micros("us")), "10 days")
    running = answers.writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    running.awaitTermination()
    got = {r.request_id: tuple(r)[3:] for r in spark.table("answers").collect()}
    past = rows.select("path", "us", "author", F.col("changes").alias("commits"), "fixes", "plus", "minus")
    probes = rows.select("path", "us", "request_id").unionByName(asked.select("path", "us", "request_id"))
    batch = history.asof_features(past, probes).withColumnsRenamed({"path": "p", "us": "u"})
    want = {r.request_id: tuple(r)[5:] for r in probes.join(batch, (F.col("path") == F.col("p")) & (F.col("us") == F.col("u"))).select("path", "us", "request_id", "p", "u", *rules.HISTORY_FEATURES).collect()}
    assert got == want and len(got) == 302
    assert "late" not in got
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in map(dict_of, running.recentProgress)) == 1
    labelled = spark.table("answers").withColumn("label", F.pmod(F.crc32("request_id"), F.lit(2)).cast("int"))
    shaped = labelled.withColumn("historical_features", F.struct(*rules.HISTORY_FEATURES))
    classifier = models.train_history_only(shaped)
    scored = {r.request_id: r.probability_bug_fix for r in arrival.score_at_arrival(spark.table("answers"), classifier, None).collect()}
    assert scored == pytest.approx({r.request_id: r.probability_bug_fix for r in classifier.score(features.history_columns(shaped, missing_days=0.0)).collect()})


def test_kept_history_equals_the_full_one(spark, tmp_path):
    rng = random.Random(12)
    day = history.DAY_US
    data = [(f"p{rng.randrange(3)}", rng.randrange(60) * day, f"dev{rng.randrange(5)}" if i % 7 else None, 1, rng.randrange(2), i % 9, i % 4) for i in range(200)]
    schema = "path string, us bigint, author string, commits bigint, fixes bigint, plus bigint, minus bigint"
    kept = history.KeptHistory(str(tmp_path / "kept"))
    for i in range(4):  # the rows come in any order, so authors turn up earlier than known
        part = spark.createDataFrame(data[i * 50 : (i + 1) * 50], schema)
        kept.add(part, i + 1)
        if i == 1:
            kept.add(part, i + 1)  # once more
    rows = spark.createDataFrame(data, schema)
    probes = rows.select("path", "us").distinct()
    want = sorted(map(tuple, history.asof_features(rows, probes).collect()))
    assert sorted(map(tuple, kept.features(probes).collect())) == want
    folded = kept.compact(spark, str(tmp_path / "folded"))
    assert sorted(map(tuple, folded.features(probes).collect())) == want
    folded.add(spark.createDataFrame([("p0", -day, "dev0", 1, 1, 1, 1)], schema), 1)
    extra = rows.unionByName(spark.createDataFrame([("p0", -day, "dev0", 1, 1, 1, 1)], schema))
    assert sorted(map(tuple, folded.features(probes).collect())) == sorted(map(tuple, history.asof_features(extra, probes).collect()))


def dict_of(progress):
    return progress if isinstance(progress, dict) else __import__("json").loads(progress.json)


# --- numbered lines and chains


def test_bad_lines_have_their_numbers(spark, tmp_path):
    schema = StructType([StructField("a", LongType())])
    want = set()
    for name, n in (("x.jsonl", 5000), ("y.jsonl", 40)):
        lines = []
        for i in range(n):
            lines.append('{"a": %d}' % i if i % 97 else ["", "  ", "{broken", "[1]", "7"][i // 97 % 5])
        (tmp_path / name).write_text("\r\n".join(lines) + ("\n" if n > 100 else ""))
        want |= {(name, i + 1, line) for i, line in enumerate(lines) if line.strip() and not line.startswith('{"a"')}
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        bad = tables.bad_lines(spark, str(tmp_path), schema)
        assert {(r.file.rsplit("/", 1)[1], r.line_no, r.line) for r in bad.collect()} == want
        assert spark.read.text(str(tmp_path)).select("_metadata.file_block_start").distinct().count() > 5
        with pytest.raises(ValueError, match=r"x\.jsonl:195: .*broken"):
            tables.require_objects(spark, str(tmp_path), schema)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n')
    (tmp_path / "y.jsonl").write_text("")
    tables.require_objects(spark, str(tmp_path), schema)


def one_pass(rows):
    seen_a, seen_b, kept = set(), set(), []
    for order, a, b in sorted(rows):
        if a not in seen_a and b not in seen_b:
            seen_a.add(a)
            seen_b.add(b)
            kept.append(order)
    return kept


@pytest.mark.parametrize("rounds,component_rows", [(1, 1000), (4, 5)])
def test_two_keys_by_rounds_and_components(spark, rounds, component_rows):
    rng = random.Random(8)
    rows = [(i, f"a{rng.randrange(30)}", f"b{rng.randrange(30)}") for i in range(60)]
    rows += [(1000 + i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(12)]
    df = spark.createDataFrame(rows, "order_key bigint, key_a string, key_b string")
    assert sorted(r[0] for r in dedup.first_per_two_keys(df, rounds, component_rows).collect()) == one_pass(rows)


def test_two_keys_of_a_long_chain(spark, monkeypatch):
    n, calls = 10_000, []
    rows = spark.range(n).selectExpr("id as order_key", "concat('c', id div 2) as key_a", "concat('d', (id + 1) div 2) as key_b")
    whole = dedup._round
    monkeypatch.setattr(dedup, "_round", lambda df: calls.append(1) or whole(df))
    got = sorted(r[0] for r in dedup.first_per_two_keys(rows).collect())
    assert got == one_pass([(i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(n)])
    assert len(calls) < 30


def test_rounds_do_not_swell_the_size_that_plans_expect(spark):
    df = spark.range(40).selectExpr("id as order_key", "concat('c', id div 2) as key_a", "concat('d', (id + 1) div 2) as key_b")
    for _ in range(3):
        _, df = dedup._round(df)
    named = dedup.components(df.selectExpr("hash(key_a) as a", "hash(key_b) as b"))
    for frame in (df, named):
        assert frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64


def test_components_of_edges(spark):
    edges = [(1, 2), (2, 3), (5, 5), (9, 7), (7, 8), (4, 9)]
    found = dedup.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.node: r.component for r in found.collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 4: 4, 7: 4, 8: 4, 9: 4}


def test_a_fit_of_rare_terms_ends_in_few_passes(spark, monkeypatch):
    df = records(spark)
    passes, real = [], models.sums
    monkeypatch.setattr(models, "sums", lambda *given: passes.append(1) or real(*given))
    fitted = models.train(df, 4000, **BLOCKS)
    assert len(passes) < 200
    # No task carries the names of all places of the vector.
    assert fitted.inputs(df).schema["features"].metadata == {}


def test_terms_of_documents_that_share_an_id(spark):
    rows = [(1, "b a b"), (1, "a  b"), (2, ""), (3, None), (4, "A b a b")]
    df = spark.createDataFrame(rows, "id int, text string")
    counts = {(r.doc, r.term): r.tf for r in tfidf.term_counts(df, "id", "text").collect()}
    assert counts == {
        (1, "a"): 2, (1, "b"): 3, (1, "a b"): 2, (1, "b a"): 1,
        (4, "a"): 2, (4, "b"): 2, (4, "a b"): 2, (4, "b a"): 1,
    }
    fitted = tfidf.fit(df, "id", "text", min_docs=1, max_share=1.0)
    weighed = fitted.weights(df, "id", "text")
    assert {(r.doc, r.term): r.tf for r in weighed.collect()} == counts
    whole = [sum(r.weight**2 for r in weighed.collect() if r.doc == doc) for doc in (1, 4)]
    assert max(abs(w - 1.0) for w in whole) < 1e-12
    # Terms stay where the text is: neither counts nor weights are shuffled or sorted by term and document.
    plan = weighed._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan


def test_sources_of_one_block_are_parsed_by_many_tasks(spark):
    code = "def f(a):\n    a.b.c()\n    g()\n    h()().k.m()\n    x[0].y()\n    (lambda: 0)()\n    z()[1]()\n"
    rows = [(f"p{i}.py", code if i % 5 else "def broken(:") for i in range(400)]
    items = structure.extract_structure(spark.createDataFrame(rows, "file_path string, code string").coalesce(1))
    assert len({r[0] for r in items.select(F.spark_partition_id()).collect()}) >= 4
    assert items.filter("parsed").count() == 320
    calls = [r.calls for r in items.filter("parsed").select(F.expr("functions[0].calls").alias("calls")).distinct().collect()]
    assert [sorted(c) for c in calls] == [["a.b.c", "g", "h", "h()().k.m", "x[0].y", "z"]]


def test_numbered_lines_of_a_group_are_written_by_many_tasks(spark, monkeypatch):
    import compare

    sf_dir, paths = "/root/testdata/sf0.001", []
    real = source_queries.scratch_path
    monkeypatch.setattr(source_queries, "scratch_path", lambda *given: paths.append(real(*given)) or paths[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = compare.bag(source_queries.QUERIES["q_jsonl_line_numbers"](spark, sf_dir).toArrow())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = compare.bag(compare.duck(sf_dir).execute(source_queries.ORACLE["q_jsonl_line_numbers"]).to_arrow_table())
    assert got == want
    lines = spark.read.text(paths[0])
    assert len(lines.inputFiles()) > lines.select("lang").distinct().count()


def test_subword_ids_move_no_pre_token(spark):
    import public_tokenizers

    df = spark.createDataFrame([(1, "the cat the cat"), (1, "dog"), (2, None)], "id int, patch string")
    found = bpe.subword_ids(df, public_tokenizers.path("byte_bpe_50k.json"), "id")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r.id, len(r.ids) > 0) for r in found.collect()) == [(1, True), (1, True), (2, False)]
