"""Operators against plain loops on random and hand-made rows."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from patchlake import rules
from patchlake.operators import bpe, candidates, codegraph, dedup, features, history, manifest, metrics, models, quality, ranking, splits, structure
from patchlake.plans import bindings, queries
from patchlake.sources import gitlog, tables, tree
from patchlake.streaming import scoring

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- ranks ------------------------------------------------------------------


def test_hash_ranks_equal_a_sort_and_spread_one_group(spark):
    # One group holds most rows, one has no name.
    data = [("hot" if i % 10 else ("cold" if i % 20 else None), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, i int")
    ranked = ranking.hash_ranks(df, ["g"], ranking.shuffle_key(42, "i"), ["i"])
    expected = {}
    for group in {g for g, _ in data}:
        ids = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for g, i in data if g == group)
        expected.update({i: (group, rank, len(ids)) for rank, (_, i) in enumerate(ids, 1)})
    assert {i: (g, r, n) for g, i, r, n in rows_of(ranked.select("g", "i", "rank", "group_size"))} == expected
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "__slice" in next(l for l in plan.splitlines() if "Window [row_number" in l)


def test_sorted_ranks_are_positions(spark):
    values = [(random.Random(i).randrange(20), i) for i in range(500)]
    df = spark.createDataFrame(values, "v int, i int").repartition(7)
    got = sorted(rows_of(ranking.sorted_ranks(df, ["v", "i"]).select("rank", "v", "i")))
    assert got == [(k, *pair) for k, pair in enumerate(sorted(values))]


# --- history ----------------------------------------------------------------


def loop_features(changes, path, at):
    before = sorted((c for c in changes if c["file_path"] == path and c["timestamp"] < at), key=lambda c: c["timestamp"])
    if not path or not before:
        return (0, 0, 0, 0, 0, 0, -1, 0.0, 0.0)
    plus, minus = sum(c["insertions"] for c in before), sum(c["deletions"] for c in before)
    fixes = sum(any(w in c["message"].lower() for w in rules.HISTORY_SUBSTRINGS) for c in before)
    authors = {c["author_email"] or c["author_name"] for c in before} - {None, ""}
    n = len(before)
    return (n, fixes, plus, minus, plus + minus, len(authors), (at - before[-1]["timestamp"]).days, round(fixes / n, 6), round((plus + minus) / n, 6))


def test_history_equals_a_loop(spark):
    rng = random.Random(5)
    # Most changes hit one path; times collide; buckets of two days split the path.
    changes = [
        {
            "file_path": rng.choice(["hot.py"] * 6 + ["b.py", "c.py"]), "timestamp": START + dt.timedelta(hours=6 * rng.randrange(90)),
            "author_email": rng.choice([None, "", "x@e", "y@e"]), "author_name": rng.choice([None, "n1", "n2"]),
            "message": rng.choice(["Fix it", "prefix", "docs", ""]), "insertions": rng.randrange(9), "deletions": rng.randrange(9),
        }
        for _ in range(400)
    ]
    schema = "file_path string, timestamp timestamp, author_email string, author_name string, message string, insertions int, deletions int"
    probes = [(i, rng.choice(["hot.py", "b.py", "none.py", "", None]), START + dt.timedelta(hours=3 * rng.randrange(220))) for i in range(300)]
    table = spark.createDataFrame([tuple(c.values()) for c in changes], schema)
    asked = spark.createDataFrame([*probes, (999, "hot.py", None)], "i int, file_path string, timestamp timestamp")
    got = history.enrich(asked, history.history_rows(table), bucket_days=2).select("i", "historical_features.*")
    assert {r[0]: r[1:] for r in rows_of(got)} == {i: loop_features(changes, p, t) for i, p, t in probes}
    own = history.enrich(table, history.history_rows(table), bucket_days=3, same_rows=True).select("file_path", "timestamp", "historical_features.*")
    for path, at, *values in rows_of(own):
        assert tuple(values) == loop_features(changes, path, at.replace(tzinfo=dt.timezone.utc))


# --- dedup, samples, splits ---------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_two_key_dedup_equals_a_pass(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"a{rng.randrange(40)}", "same" if rng.random() < 0.3 else f"b{rng.randrange(40)}") for i in range(250)]
    seen_a, seen_b, kept = set(), set(), []
    for i, a, b in rows:
        if a not in seen_a and b not in seen_b:
            kept.append(i)
            seen_a.add(a)
            seen_b.add(b)
    df = spark.createDataFrame(rows, "order_key int, key_a string, key_b string")
    assert sorted(r[0] for r in rows_of(dedup.first_per_two_keys(df))) == kept


def test_first_per_key_keeps_unkeyed_rows(spark):
    df = spark.createDataFrame([("x", 2), ("x", 1), (None, 3), (None, 4), ("", 5)], "k string, o int")
    assert sorted(r[1] for r in rows_of(dedup.first_per_key(df, "k", ["o"]))) == [1, 3, 4, 5]


def test_split_sizes_round_down(spark):
    data = [(g, f"{g}-{i}") for g, n in {"g9": 9, "g10": 10, "g11": 11, "g15": 15}.items() for i in range(n)]
    df = spark.createDataFrame(data, "g string, id string")
    counts = {(g, s): n for g, s, n in rows_of(splits.split_groups(df, ["g"], ["id"]).groupBy("g", "split").count())}
    assert counts == {
        ("g9", "train"): 9, ("g10", "train"): 8, ("g10", "validation"): 1, ("g10", "test"): 1, ("g11", "train"): 8, ("g11", "validation"): 1,
        ("g11", "test"): 2, ("g15", "train"): 12, ("g15", "validation"): 1, ("g15", "test"): 2,
    }


def test_temporal_split_keeps_commits_whole(spark):
    rng = random.Random(3)
    rows = [(f"c{rng.randrange(40)}", i, START + dt.timedelta(days=rng.randrange(100))) for i in range(300)]
    df = spark.createDataFrame([*rows, (None, 300, START)], "commit_hash string, i int, timestamp timestamp")
    placed = splits.temporal_split(df)
    first = {}
    for c, _, t in rows:
        first[c] = min(first.get(c, t), t)
    order = sorted(first, key=lambda c: (first[c], c))
    n = len(order)
    want = {c: "train" if k < int(n * 0.7) else "validation" if k < int(n * 0.85) else "test" for k, c in enumerate(order)}
    assert {(c, i, s) for c, i, s in rows_of(placed.select("commit_hash", "i", "split"))} == {(c, i, want[c]) for c, i, _ in rows}
    assert rows_of(splits.leakage(placed, "commit_hash")) == [(0, 0, 0)]
    assert splits.require_no_leakage(placed, "commit_hash") is placed


def test_checks_raise(spark):
    df = spark.createDataFrame([("a", 1, "train"), ("a", 1, "test")], "record_id string, label int, split string")
    with pytest.raises(ValueError, match="shared"):
        splits.require_no_leakage(df, "record_id")
    with pytest.raises(ValueError, match="has_negatives"):
        splits.require_integrity(df)
    with pytest.raises(ValueError, match="sum to 1"):
        splits.check_ratios((0.5, 0.2, 0.2))
    with pytest.raises(ValueError, match="label"):
        features.require_labels(spark.createDataFrame([(2,)], "label int"))


# --- quality ------------------------------------------------------------------


def record(language="Python", commit_hash="h", subject="Fix crash #1", files=1, added=5, patch="+x", score=6):
    changed = [(f"a{i}.py", added, 0, True, False) for i in range(files)]
    return (
        "r:h", "r", language, ("p", commit_hash, subject, ""), (score,), changed, (files, added, 0), patch,
    )


SCHEMA = (
    "record_id string, repo_id string, language string, commit struct<parent:string,hash:string,subject:string,body:string>, "
    "bug_signal struct<score:int>, changed_files array<struct<path:string,added_lines:bigint,deleted_lines:bigint,is_source:boolean,ignored:boolean>>, "
    "diff_stats struct<files_changed:bigint,added_lines:bigint,deleted_lines:bigint>, patch string"
)


def test_quality_bounds(spark):
    cases = [
        (record(), True), (record(language=None), "non_python_repository"), (record(commit_hash=""), "missing_commit_hash"),
        (record(subject=" "), "empty_commit_message"), (record(subject="Merge fix"), "reject_message_pattern"),
        (record(files=0), "no_python_source_change"), (record(added=0), "empty_change"), (record(added=1000), True),
        (record(added=1001), "patch_too_large"), (record(files=20), True), (record(files=21), "too_many_changed_files"),
        (record(patch=" \n"), "empty_patch"), (record(patch=None), "empty_patch"), (record(subject="fix", score=0), "insufficient_bug_evidence"),
        (record(subject="test issue #3 pr 4", score=9), "no_explicit_bug_signal"),
    ]
    judged = rows_of(quality.judge(spark.createDataFrame([c for c, _ in cases], SCHEMA)).select("accepted", "score", "reasons"))
    for (_, want), (accepted, score, reasons) in zip(cases, judged):
        assert accepted is (want is True)
        if want is not True:
            assert reasons[-1] == want
    assert judged[0][1:] == (7, ["two_strong_bug_signals", "supporting_signal", "strong_original_signal"])


# --- manifest -------------------------------------------------------------------


def test_verdict_rows(spark):
    base = dict(repo_id="a", language="Python", license="MIT", is_fork=False, archived=False, collection_status="complete", commit_count=100, source_file_count=20)
    cases = [
        ({}, ("high_quality", 10)), ({"license": "GPL-3.0"}, ("accepted", 8)), ({"commit_count": 99}, ("rejected", 8)),
        ({"collection_status": "failed"}, ("rejected", 0)), ({"language": None}, ("high_quality", 9)), ({"is_fork": True}, ("rejected", 9)),
        ({"language": None, "license": None}, ("accepted", 7)),
    ]
    schema = "repo_id string, language string, license string, is_fork boolean, archived boolean, collection_status string, commit_count bigint, source_file_count bigint"
    df = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], schema)
    got = rows_of(manifest.verdicts(df).select("status", "score", "notes"))
    assert [g[:2] for g in got] == [w for _, w in cases]
    assert got[0][2] == ["repository passed all quality checks"] and got[4][2] == ["unexpected language: None"]


# --- code graph -------------------------------------------------------------------

CODE = '''from ..wire import Frame as F
import zlib, json as j
def squash(data, level=6):
    return zlib.compress(data, level)
class Ledger:
    limit = 3
    class Entry(Row):
        def total(self):
            return squash(self.lines)
    @cached(maxsize=limit)
    def post(self, entry, *rest, dry=False):
        """Keep it."""
        self.check(entry)
        return j.dumps(entry)
    async def check(self, entry):
        raise ValueError
'''


@pytest.fixture(scope="module")
def items(spark):
    sources = spark.createDataFrame([("src/books/ledger.py", CODE), ("bad.py", "def ("), ("gone.py", None)], "file_path string, code string")
    return structure.extract_structure(sources).cache()


def test_structure(spark, items):
    functions = {r.qualified_name: r for r in structure.function_table(items).collect()}
    assert list(functions) == ["squash", "Entry.total", "Ledger.post", "Ledger.check"]
    post = functions["Ledger.post"]
    assert (post.parameters, post.decorators, post.docstring, post.line_start, post.line_end) == (
        ["self", "entry"], ["cached(maxsize=limit)"], "Keep it.", 11, 14,
    )
    assert post.calls == ["cached", "self.check", "j.dumps"] and post.source_code.startswith("def post")
    assert functions["Ledger.check"].is_async and functions["squash"].function_type == "function"
    assert rows_of(structure.import_table(items).select("kind", "module", "name", "alias", "level")) == [
        ("from", "wire", "Frame", "F", 2), ("import", "zlib", None, None, 0), ("import", "json", None, "j", 0),
    ]
    assert structure.summary(items, items).first().asDict() == {
        "parsed_files": 1, "failed_files": 2, "functions": 4, "classes": 2, "imports": 3, "source_files": 3,
    }


def test_plain_call_graph(spark, items):
    functions = structure.function_table(items)
    calls = structure.call_table(items).withColumn("caller_id", codegraph.function_id())
    resolved = codegraph.plain_call_graph(calls, functions)
    assert dict(rows_of(codegraph.histogram(resolved, "disposition"))) == {"resolved": 2, "unresolved": 3}


def test_import_resolution(spark):
    paths = ["lib/ocean/__init__.py", "lib/ocean/tide.py", "lib/ocean/deep/__init__.py", "lib/ocean/deep/whale.py", "harbour.py"]
    modules = codegraph.module_map(spark.createDataFrame([(p,) for p in paths], "file_path string"))
    rows = [
        ("import", "ocean.tide.Moon", None, 0, "lib/ocean/tide.py"), ("import", "ocean.wreck", None, 0, "lib/ocean/__init__.py"),
        ("import", "zlib", None, 0, None), ("from", "ocean.deep", "whale", 0, "lib/ocean/deep/__init__.py"),
        ("from", "harbour", "crane", 0, "harbour.py"), ("from", None, "song", 1, None), ("from", "whale", "sing", 1, None),
    ]
    df = spark.createDataFrame(
        [("lib/ocean/deep/squid.py", *r) for r in rows],
        "file_path string, kind string, module string, name string, level int, want string",
    )
    assert all(t == w for t, w in rows_of(codegraph.resolve_imports(df, modules).select("target_path", "want")))
    relative = codegraph.resolve_imports(df.filter("level = 1"), modules, resolve_relative=True)
    assert sorted(rows_of(relative.select("name", "target_path"))) == [
        ("sing", "lib/ocean/deep/whale.py"), ("song", "lib/ocean/deep/__init__.py"),
    ]


def test_ambiguous_in_the_file_stays_ambiguous(spark):
    functions = spark.createDataFrame(
        [("a.py", "go", "A.go", "A", 1), ("a.py", "go", "B.go", "B", 9), ("b.py", "go2", "go2", None, 1), ("c.py", "go", "x.go", None, 3)],
        "file_path string, name string, qualified_name string, parent_class string, line_start int",
    )
    calls = spark.createDataFrame([("a.py", None, "x.go", "k1"), ("a.py", None, "go2", "k2"), ("a.py", "A", "self.go", "k3"), ("a.py", None, "b.go2", "k4")],
                                  "file_path string, parent_class string, call string, caller_id string")
    imports = spark.createDataFrame([("a.py", "import", "b", None, None, 0, 1)], "file_path string, kind string, module string, name string, alias string, level int, position int")
    modules = codegraph.module_map(spark.createDataFrame([("a.py",), ("b.py",)], "file_path string"))
    got = codegraph.resolve_calls(calls, functions, imports, modules, "position").select("caller_id", "target_id", "resolution", "disposition")
    assert sorted(rows_of(got)) == [
        ("k1", None, None, "ambiguous"), ("k2", "b.py::go2::L1", "direct", "resolved"), ("k3", "a.py::A.go::L1", "same_file", "resolved"),
        ("k4", "b.py::go2::L1", "import", "resolved"),
    ]


# --- features, models, metrics ------------------------------------------------------


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    row = metrics.metrics(metrics.confusion(df)).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (1.0, 0.0, 0.0, 0.0)
    empty = metrics.metrics(metrics.confusion(df.filter("label = 5"))).first()
    assert (empty.accuracy, empty.f1) == (0.0, 0.0)


def test_published_metrics_follow_from_their_matrix(spark):
    counts = spark.createDataFrame([(1122, 260, 420, 177)], "tp bigint, fp bigint, tn bigint, fn bigint")
    row = metrics.metrics(counts).first()
    assert [round(100 * row[c], 2) for c in ("accuracy", "precision", "recall", "f1")] == [77.92, 81.19, 86.37, 83.7]


def test_subword_ids_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rng = random.Random(8)
    pieces = ["aaab", " don't", "\t", "  \n   x", "x+=1;", " été", "日本", "🙂", "+++", "-def f(a, b):", " 12345", "\u00a0", "<|endoftext|>", "\r\n", "_y_"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(80)))) for i in range(40)] + [(40, None), (41, ""), (42, "   ")]
    got = bpe.subword_ids(spark.createDataFrame(rows, "record_id int, patch string"), path)
    assert {r.record_id: r.ids for r in got.collect()} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}


def test_classifier_learns_and_scores(spark):
    rng = random.Random(1)
    words = {1: ["raise", "guard", "none"], 0: ["docs", "rename", "style"]}
    data = [
        (str(i), i % 2, " ".join(rng.choice(words[i % 2] + ["x", "y"]) for _ in range(12)), "msg", 3 + 5 * (i % 2), 1, "modified", "a.py" if i % 3 else "b.c")
        for i in range(60)
    ]
    df = spark.createDataFrame(data, "record_id string, label int, patch string, message string, added_line_count int, removed_line_count int, change_type string, file_path string")
    classifier = models.train_hybrid(df)
    # A category that training has not seen must not fail.
    unseen = df.withColumn("file_path", F.when(F.col("record_id") == "1", "z.rs").otherwise(F.col("file_path")))
    ready = features.change_columns(unseen).withColumn("model_text", features.model_text(None, F.col("patch")))
    scored = classifier.score(ready).cache()
    assert scored.count() == 60
    row = metrics.metrics(metrics.confusion(scored)).first()
    assert row.accuracy > 0.95
    assert scored.filter("abs(probability_bug_fix + probability_non_bug_fix - 1) > 1e-9").count() == 0
    assert models.coefficients(classifier).first().direction == "bug-risk"


def test_shared_folder_is_required_on_a_cluster(spark):
    from patchlake import session

    class Away:
        class sparkContext:
            master = "spark://somewhere"
            getConf = staticmethod(dict)
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Away)
    assert not session.is_one_process("local-cluster[3,2,1000]") and session.is_one_process("local[8]")
    path = session.scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    session.release(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


def test_classifier_is_saved_and_loaded(spark, tmp_path):
    rows = [
        (str(i), "+ fix crash\n" if i % 2 else "- add feature\n", "m.py" if i % 3 else "n.js", "modified", i % 5 + 3 * (i % 2), i % 4, i % 2)
        for i in range(60)
    ]
    columns = "record_id string, patch string, file_path string, change_type string, added_line_count int, removed_line_count int, label int"
    df = spark.createDataFrame(rows, columns)
    trained = models.train_hybrid(df, min_docs=1, max_share=1.0)
    trained.save(str(tmp_path / "model"))
    loaded = models.Classifier.load(spark, str(tmp_path / "model"))
    ready = features.change_columns(df).withColumn("model_text", features.model_text(None, F.col("patch")))
    want = {r.record_id: r.probability_bug_fix for r in trained.score(ready).collect()}
    assert {r.record_id: r.probability_bug_fix for r in loaded.score(ready).collect()} == pytest.approx(want)
    slopes = models.gradient(loaded, ready).collect()
    assert all(abs(r.gradient) < 1e-2 * max(abs(r.start) for r in slopes) for r in slopes)
    assert {r.block for r in slopes} == {"term", "numeric", "change_type", "extension", "intercept"}


# --- sources ------------------------------------------------------------------------


def test_jsonl_and_json(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"record_id": "a", "patch": "é"}\n\n[1]\nnot json\n', encoding="utf-8")
    schema = tables_schema()
    with pytest.raises(Exception):
        tables.read_jsonl(spark, str(path), schema).collect()
    good, bad = tables.read_jsonl_lax(spark, str(path), schema)
    assert rows_of(good.select("record_id")) == [("a",)]
    assert sorted(r[1] for r in rows_of(bad)) == ["[1]", "not json"]
    tables.write_jsonl(good, str(tmp_path / "out"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("*.json"))
    assert json.loads(text) == {"record_id": "a", "patch": "é"} and "é" in text
    nulls = spark.createDataFrame([(1, None)], "a int, b string")
    tables.write_jsonl(nulls, str(tmp_path / "nulls"))
    assert "".join(p.read_text() for p in (tmp_path / "nulls").glob("*.json")) == '{"a":1,"b":null}\n'
    array = tmp_path / "a.json"
    array.write_text(json.dumps([{"record_id": "b"}, {"record_id": "c"}]))
    assert tables.read_json_array(spark, str(array), schema).count() == 2
    assert tables.read_json_array(spark, str(tmp_path / "none.json"), schema).count() == 0


def tables_schema():
    from patchlake.schemas import SCORE_REQUEST

    return type(SCORE_REQUEST)(SCORE_REQUEST.fields[:2])


def test_commit_log_and_numstat(spark, tmp_path):
    fields = ["h1", "p1 p2", "Ann", "2024-01-02T03:04:05+02:00", " subject ", "two\nlines\n"]
    log = "\x1f".join(fields) + "\x1e\n" + "\x1f".join(["h2", "", "Bob", "2024-01-01T00:00:00+00:00", "s", ""]) + "\x1e\n" + "a\x1fb\x1fc\x1fd\x1fe\x1e"
    (tmp_path / "repo1.log").write_text(log)
    got = gitlog.read_commit_log(spark, str(tmp_path)).orderBy("commit_hash").collect()
    assert [(r.repo_id, r.commit_hash, r.parent, r.parent_count, r.subject, r.body) for r in got] == [
        ("repo1", "h1", "p1", 2, "subject", "two\nlines"), ("repo1", "h2", "", 0, "s", ""),
    ]
    assert got[0].ts == dt.datetime(2024, 1, 2, 1, 4, 5)
    lines = spark.createDataFrame([("r", "h", l) for l in ("-\t-\tlogo.png", "3\t1\ta.py", "1\t2", "x\t1\tb.py", "4\t0\tyarn.lock")], "repo_id string, commit_hash string, value string")
    assert rows_of(gitlog.parse_numstat(lines).drop("repo_id", "commit_hash")) == [("a.py", 3, 1, True, False), ("yarn.lock", 4, 0, False, True)]


def test_source_tree(spark, tmp_path):
    for name, data in {"src/a.py": b"x = '\xff'\n", "src/b.js": b"1", "build/c.py": b"", "readme.md": b"", "d.PY": b"y = 1"}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(data)
    files = tree.scan_tree(spark, str(tmp_path), content=True)
    assert sorted(rows_of(files.select("file_path", "language", "size_bytes"))) == [("d.PY", "python", 5), ("src/a.py", "python", 8), ("src/b.js", "javascript", 1)]
    assert dict(rows_of(tree.source_text(files))) == {"src/a.py": "x = ''\n", "d.PY": "y = 1"}


def test_source_tree_below_its_own_name(spark, tmp_path):
    root = tmp_path / "src"
    for name in ("src/a.py", f"pkg{root}/c.py", f"vendor{root}/b.py"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes("x = '\ufffd' ".encode() + b"\xff\n")
    files = tree.scan_tree(spark, str(root), content=True)
    assert sorted(r[0] for r in rows_of(files.select("file_path"))) == sorted([f"pkg{root}/c.py", "src/a.py"])
    assert {r[0] for r in rows_of(tree.source_text(files).select("code"))} == {"x = '\ufffd' \n"}


def test_stream_keeps_going_after_bad_lines(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"record_id": "a", "patch": "-x\\n+y", "added_line_count": 1, "removed_line_count": 1}\nbroken\n{"record_id": "no patch"}\n')
    args = [str(tmp_path / n) for n in ("out", "bad", "state")]
    score = lambda df: scoring.responses(df, queries._stored_probability(), 0.51)
    for more in ("", '{"record_id": "b", "patch": "+z"}\n'):
        if more:
            (source / "2.json").write_text(more)
        scoring.start_scoring(scoring.read_requests(spark, str(source)), score, *args, availableNow=True).awaitTermination()
    out = spark.read.parquet(args[0])
    assert sorted(r.record_id for r in out.collect()) == ["a", "b"]
    assert out.filter("prediction not in ('bug_fix', 'non_bug_fix') or bug_fix_probability not between 0 and 1").count() == 0
    assert spark.read.parquet(args[1]).count() == 2


def test_candidate_record_shape(spark):
    sf_dir = "/root/testdata/sf0.001"
    commits = bindings.commits(spark, sf_dir).withColumn("parent", F.lit("p"))
    changes, texts = bindings.commit_changes(spark, sf_dir), bindings.commit_patches(spark, sf_dir)
    judged = candidates.judge_positives(commits, changes, texts)
    rows = candidates.records(judged, changes, texts, bindings.repository_info(spark, sf_dir))
    assert rows.select(F.max(F.size("changed_files"))).first()[0] <= rules.DIFF_LIMITS["max_files"]
    assert rows.select("record_id").distinct().count() == rows.count() > 0
