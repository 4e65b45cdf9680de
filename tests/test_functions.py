"""Expressions row by row, one case per peculiarity."""

from pyspark.sql import functions as F

from patchlake import rules
from patchlake.functions import encode, numeric, patch, paths, text


def one(spark, values, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(values, schema).select(*columns).collect()]


def test_normalise_and_whole_words(spark):
    rows = [("A   b\n",), ("éfix",), ("fixé",), ("re_fix",), ("prefix",), ("a fix.",), (None,)]
    got = one(spark, rows, "t string", text.normalise(F.col("t")), text.is_fix_message(F.col("t")), text.is_fix_like(F.col("t")))
    assert got[0][0] == "a b"
    assert [g[1] for g in got] == [False, False, False, False, False, True, False]
    assert [g[2] for g in got] == [False, True, True, True, True, True, False]


def scores(spark, with_signal, *subjects):
    df = spark.createDataFrame([(s, None) for s in subjects], "subject string, body string")
    return [(r.bug_signal.score, r.bug_signal.signals) for r in with_signal(df).collect()]


def test_signal_scores(spark):
    assert scores(spark, text.with_fix_signal, "bug fix", "latest fix", "typo fix", "see PR 12") == [
        (6, ["bug", "bug fix", "fix"]),
        (4, ["bug_related_test", "fix"]),
        (-1, ["fix", "negative:typo"]),
        (2, ["issue_or_pr_reference"]),
    ]
    assert [s for s, _ in scores(spark, text.with_plain_signal, "bug fix", "latest fix", "typo fix", "tests fix")] == [6, 2, 2, 4]


def test_intent_and_routine(spark):
    rows = [("Fix the crash in parser", ""), ("fix typo", ""), ("add type hints and tests", None)]
    got = one(
        spark, rows, "s string, b string",
        text.has_explicit_intent(F.col("s"), F.col("b")), text.routine_score(F.col("s"), F.col("b")),
    )
    assert got == [(True, 0), (False, 0), (False, 3)]


def test_reject_patterns_keep_list_order(spark):
    rows = [("merge branch x",), ("a release and typo",), ("fine",)]
    got = one(spark, rows, "t string", text.first_match(F.col("t"), rules.REJECT_PATTERNS), text.count_patterns(F.col("t"), rules.REJECT_PATTERNS))
    assert got == [(r"^\s*merge\b", 2), (r"\brelease\b", 2), (None, 0)]


def test_paths(spark):
    names = ["a/.bashrc", "a.", "x/y.PY", "Makefile", "", "a.tar.gz", "web/Yarn.lock", "xbuild/a.c", "build/a.c", "test_a.js", "a/tests/b.go", "latest/x.go"]
    got = one(
        spark, [(n,) for n in names], "p string",
        paths.extension(F.col("p")), paths.is_source(F.col("p")), paths.is_ignored(F.col("p")), paths.is_test(F.col("p")),
    )
    assert [g[0] for g in got] == [
        "no_extension", "no_extension", ".py", "no_extension", "unknown", ".gz", ".lock", ".c", ".c", ".js", ".go", ".go",
    ]
    assert [g[1] for g in got] == [False, False, True, False, False, False, False, True, True, True, True, True]
    assert [n for n, g in zip(names, got) if g[2]] == ["web/Yarn.lock", "build/a.c"]
    assert [n for n, g in zip(names, got) if g[3]] == ["test_a.js", "a/tests/b.go"]


def test_module_names(spark):
    cases = {
        "src/pkg/cli.py": "pkg.cli", "src/pkg/__init__.py": "pkg", "tests/test_cli.py": "tests.test_cli", "lib/a.py": "a",
        "src/__init__.py": None, "__init__.py": None, "docs/a.md": "docs.a.md", "src": None,
    }
    got = one(spark, [(p,) for p in cases], "p string", paths.module_name(F.col("p")))
    assert [g[0] for g in got] == list(cases.values())


def test_line_changes(spark):
    text_ = "--- a/x\r\n+++ b/x\n@@ -1 +1 @@\n-old\n+new\r\n+++x\n+\n same"
    rows = [(text_,), (None,), ("",)]
    got = one(spark, rows, "p string", patch.line_changes(F.col("p")), patch.line_changes(F.col("p"), strict_headers=True))
    assert got[0][0].added_lines == ["new", ""] and got[0][0].removed_lines == ["old"]
    assert got[0][1].added_lines == ["new", "++x", ""]
    assert (got[1][0].added_line_count, got[2][0].removed_line_count) == (0, 0)


def test_clip_counts_characters(spark):
    rows = [("é" * 10,), ("é" * 11,), (None,)]
    got = one(spark, rows, "p string", patch.clip(F.col("p"), 10))
    assert [(g[0].patch, g[0].patch_truncated) for g in got] == [("é" * 10, False), ("é" * 10, True), (None, None)]


def test_size_verdict_bounds(spark):
    rows = [(0, 0, 0, 0), (31, 1, 1, 1), (30, 1501, 0, 1), (30, 1500, 1501, 1), (1, 1, 1, 80001), (1, 0, 0, 5), (30, 1500, 1500, 80000), (None, None, None, None)]
    got = one(spark, rows, "f int, a int, d int, c int", patch.size_verdict(*[F.col(c) for c in "fadc"]))
    assert [g[0] for g in got] == [
        "no_source_files", "too_many_changed_files", "too_many_added_lines", "too_many_deleted_lines", "patch_too_large",
        "no_line_changes", None, "no_source_files",
    ]


def test_fixed_length_encoding(spark):
    rows = [(list(range(10, 10 + n)),) for n in (0, 2, 3, 4, 6)]
    got = one(spark, rows, "i array<int>", encode.head_and_tail(F.col("i"), 5), encode.head_only(F.col("i"), 5))
    assert [g[0].input_ids for g in got] == [
        [2, 3, 0, 0, 0], [2, 10, 11, 3, 0], [2, 10, 11, 12, 3], [2, 10, 12, 13, 3], [2, 10, 14, 15, 3],
    ]
    assert got[1][0].attention_mask == [1, 1, 1, 1, 0]
    assert [g[1].input_ids for g in got][3:] == [[2, 10, 11, 12, 3], [2, 10, 11, 12, 3]]


def test_file_counts_of_large_commits(spark):
    names = [f"src/m{i}.py" for i in range(31)] + [f"tests/test_m{i}.py" for i in range(9)] + ["yarn.lock", "a.md"]
    df = spark.createDataFrame([("c", n) for n in names], "commit_hash string, path string")
    got = numeric.file_counts(df, ["commit_hash"]).first().file_counts
    assert (got.files, got.source_files, got.test_files, got.ignored_files) == (42, 40, 9, 1)


def test_numerics_fall_back(spark):
    files = "array<struct<path:string,is_source:boolean,ignored:boolean>>"
    rows = [
        ("a\nb", [("tests/x.py", True, False), ("y.lock", None, True)], None, "bad", 4, 7, 0),
        (None, None, 3, None, 4, 7, 4),
    ]
    df = spark.createDataFrame(rows, f"p string, f {files}, a int, r string, sa int, sr int, n int")
    full = numeric.with_patch_numerics(df, F.col("p"), numeric.listed_counts(F.col("f")), *[F.col(c) for c in ("a", "r", "sa", "sr", "n")]).collect()
    first, second = (r.asDict() for r in full)
    assert (first["added"], first["removed"], first["files_changed"], first["test_files"], first["source_files"]) == (4, 0, 2, 1, 1)
    assert (first["ignored_files"], first["avg_added"], first["patch_length"], first["patch_line_count"]) == (1, 2, 3, 2)
    assert (second["added"], second["removed"], second["files_changed"], second["patch_line_count"]) == (3, 7, 4, 0)
