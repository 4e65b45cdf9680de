"""The registered queries: operators applied to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from patchlake import rules
from patchlake.functions import encode, numeric, patch, paths, text
from patchlake.operators import (
    bpe, candidates, codegraph, dedup, features, history, manifest, metrics, models, quality, splits, structure, tfidf, training,
)
from patchlake.operators.kept_manifest import KeptManifest
from patchlake.plans import bindings as b
from patchlake.session import scratch_path, stored
from patchlake.sources import gitlog
from patchlake.streaming import history as arrival, scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[f"q_{fn.__name__}"] = fn
    return fn


# --- history --------------------------------------------------------------


@query
def history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = b.file_changes(spark, sf_dir).filter("parent_count > 0")
    enriched = history.enrich(
        changes.select("commit_hash", "file_path", "timestamp"), history.history_rows(changes), same_rows=True
    )
    return enriched.select("commit_hash", "file_path", "historical_features.*")


@query
def history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").cast("string").alias("user"), "event_type", F.floor("value").alias("whole")
    )
    rows = history.history_rows(
        events.withColumn("none", F.lit(None).cast("string")).withColumn("zero", F.lit(0)),
        path="user", ts="ts", email="none", name="event_type", insertions="whole", deletions="zero",
        bug_like=F.col("event_type") == "error",
    )
    enriched = history.enrich(events.select("event_id", "user", "ts"), rows, path="user", ts="ts")
    return enriched.select("event_id", "user", "historical_features.*")


@query
def commit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = gitlog.commit_totals(b.commits(spark, sf_dir), b.numstat(spark, sf_dir), ["commit_hash"])
    return totals.select("commit_hash", "repo_id", "parent_count", "files_changed", "insertions", "deletions")


@query
def file_change_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = b.numstat(spark, sf_dir)
    renamed, deleted = F.col("flag") == "R", (F.col("flag") == "N") & (F.col("deletions") > F.col("insertions"))
    names = lines.select(
        "commit_hash", F.concat(F.lit("old/"), "file_path").alias("old_path"),
        F.when(~deleted, F.col("file_path")).alias("new_path"),
        (F.col("flag") == "A").alias("added"), deleted.alias("deleted"), renamed.alias("renamed"),
    )
    counts = lines.filter(~renamed).withColumnRenamed("file_path", "path")
    changes = gitlog.file_change_history(b.commits(spark, sf_dir), names, counts, ["commit_hash"])
    return changes.select("commit_hash", "author", "file_path", "old_path", "change_type", "insertions", "deletions", "total_changes")


def _file_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = b.commits(spark, sf_dir).select(
        "commit_hash", "parent_count", F.col("ts").alias("timestamp"), F.col("author").alias("author_name"), F.col("subject").alias("message")
    )
    return gitlog.file_patch_history(commits, b.documents_as_file_patches(spark, sf_dir), ["commit_hash"])


@query
def file_patch_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _file_patches(spark, sf_dir).select(
        "commit_hash", "file_path", "change_type", "patch_truncated", "added_line_count", "removed_line_count",
        F.md5("patch").alias("patch_md5"), F.md5(F.array_join("removed_lines", "\n")).alias("removed_md5"),
    )


@query
def fix_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.mine_fixes(_file_patches(spark, sf_dir)).select(
        "commit_hash", "author_name", "message", "file_path", "change_type", "added_line_count", "removed_line_count", "label"
    )


# --- messages and paths ---------------------------------------------------


def _signals(spark: SparkSession, sf_dir: str, with_signal) -> DataFrame:
    scored = with_signal(b.commits(spark, sf_dir))
    return scored.select("commit_hash", "bug_signal.score", F.array_join("bug_signal.signals", ",").alias("signals"))


@query
def signal_score_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir, text.with_fix_signal)


@query
def signal_score_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir, text.with_plain_signal)


@query
def intent_routine(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject, body = F.col("subject"), F.col("body")
    return b.commits(spark, sf_dir).select(
        "commit_hash", text.has_explicit_intent(subject, body).alias("explicit"), text.routine_score(subject, body).alias("routine")
    )


@query
def keyword_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.commits(spark, sf_dir).select("commit_hash", text.is_fix_message(F.col("subject")).cast("int").alias("label"))


@query
def keyword_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.commits(spark, sf_dir).select("commit_hash", text.is_fix_like(F.col("subject")).alias("fix_like"))


# A rule list in the form of the message rules, over words the documents use.
DOCUMENT_PATTERNS = [r"^\s*the\b", r"\blicense\b", r"\bthe\b", r"\bla\b", r"\bund\b", r"\bof the\b", r"#\d+"]


@query
def doc_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents").select("doc_id", text.normalise(F.col("text")).alias("t"))
    return docs.select(
        "doc_id", text.first_match(F.col("t"), DOCUMENT_PATTERNS).alias("first_pattern"),
        text.count_patterns(F.col("t"), DOCUMENT_PATTERNS).alias("patterns"), F.length("t").alias("chars"),
    )


@query
def path_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("file_path")
    return b.numstat(spark, sf_dir).select(
        "commit_hash", path, paths.is_ignored(path).alias("ignored"), paths.is_source(path).alias("source"),
        paths.is_source(path, rules.PYTHON_EXTENSIONS).alias("python"), paths.extension(path).alias("extension"),
        paths.is_test(path).alias("test"),
    )


@query
def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = b.numstat(spark, sf_dir).groupBy("file_path").agg(F.sum("insertions").alias("size_bytes"))
    return structure.language_histogram(structure.code_files(tree))


# --- patches --------------------------------------------------------------


@query
def stored_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored form of a patch, cut at its limit."""
    cut = b.patches(spark, sf_dir).select("doc_id", patch.clip(F.col("patch"), rules.STORED_PATCH_CHARS).alias("c"))
    return cut.select("doc_id", "c.patch_truncated", F.length("c.patch").alias("chars"), F.md5("c.patch").alias("patch_md5"))


@query
def patch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = b.patches(spark, sf_dir).select("doc_id", patch.line_changes(F.col("patch")).alias("l"))
    return changes.select(
        "doc_id", "l.added_line_count", "l.removed_line_count",
        F.md5(F.array_join("l.added_lines", "\n")).alias("added_md5"),
        *[v.alias(n) for n, v in numeric.line_numerics(F.col("l.added_line_count"), F.col("l.removed_line_count")).items()],
    )


# Smaller than the defaults, so that every limit is reached by these tables.
SMALL_DIFFS = {"max_files": 5, "max_added": 100, "max_deleted": 20, "max_patch_chars": 5000}


@query
def diff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["repo_id", "commit_hash"]
    stats = candidates.diff_stats(b.commit_changes(spark, sf_dir), ["commit_hash"])
    commits = b.commits(spark, sf_dir).select(*keys).join(candidates.patch_sizes(b.commit_patches(spark, sf_dir)), keys, "left")
    chars = F.coalesce("patch_chars", F.lit(0))
    verdict = patch.size_verdict(F.col("files_changed"), F.col("added_lines"), F.col("deleted_lines"), chars, SMALL_DIFFS)
    return commits.join(stats, "commit_hash", "left").select(
        *keys, "files_changed", "added_lines", "deleted_lines", verdict.alias("reason"), verdict.isNull().alias("accepted")
    )


# --- candidates -----------------------------------------------------------


PATCH_KEY = ("patch_id",)


def _useful_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored once: the verdicts and the file lists read them."""
    return stored(candidates.useful_changes(b.commit_changes(spark, sf_dir)), "changes")


def _sized(spark: SparkSession, sf_dir: str, changes: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    texts = b.patch_texts(spark, sf_dir) if patches is None else patches
    return candidates.sized_commits(b.patched_commits(spark, sf_dir), changes, texts, PATCH_KEY)


def _positives(
    spark: SparkSession, sf_dir: str, changes: DataFrame, limits: dict | None = SMALL_DIFFS, patches: DataFrame | None = None
) -> DataFrame:
    return candidates.judge_positives(_sized(spark, sf_dir, changes, patches), limits=limits)


def _accepted_positives(spark: SparkSession, sf_dir: str, changes: DataFrame, facts: DataFrame, limits: dict | None = SMALL_DIFFS) -> DataFrame:
    return candidates.accepted_positives(b.patched_commits(spark, sf_dir), changes, facts, limits, patch_key=PATCH_KEY)


def _records(
    spark: SparkSession, sf_dir: str, judged: DataFrame, changes: DataFrame | None, patches: DataFrame | None, negative: bool = False
) -> DataFrame:
    return candidates.records(judged, changes, patches, b.repository_info(spark, sf_dir), negative, PATCH_KEY)


def _patch_facts(spark: SparkSession, sf_dir: str, *facts: str) -> DataFrame:
    """Facts of every patch, one row each, stored: the size is needed before a verdict and the others after it."""
    texts = quality.patch_facts(b.patch_texts(spark, sf_dir).withColumn("patch_md5", F.md5("patch")))
    return stored(texts.select(*PATCH_KEY, "patch_chars", *facts), "facts")


def _flat(records: DataFrame) -> DataFrame:
    files = F.array_join(F.transform("changed_files", lambda f: F.concat(f["path"], F.lit(":"), f["added_lines"])), ",")
    return records.select(
        "record_id", "repository", "language", F.col("bug_signal.score").alias("score"), F.array_join("bug_signal.signals", ",").alias("signals"),
        files.alias("files"), "diff_stats.*", "patch_md5", F.col("commit.parent").alias("parent"),
        "provenance.repository_url", "provenance.commit_url",
    )


@query
def candidates_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, facts = _useful_changes(spark, sf_dir), _patch_facts(spark, sf_dir, "patch_md5")
    return _flat(_records(spark, sf_dir, _accepted_positives(spark, sf_dir, changes, facts), changes, facts))


def _negatives(spark: SparkSession, sf_dir: str, changes: DataFrame) -> DataFrame:
    """Both verdicts in one pass over the commits."""
    positives = candidates.positive_verdicts(_sized(spark, sf_dir, changes), SMALL_DIFFS)
    return candidates.judge_negatives(candidates.with_known(positives), limits=SMALL_DIFFS)


@query
def candidates_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, facts = _useful_changes(spark, sf_dir), _patch_facts(spark, sf_dir, "patch_md5")
    accepted = candidates.accepted_negatives(b.patched_commits(spark, sf_dir), changes, facts, SMALL_DIFFS, SMALL_DIFFS, patch_key=PATCH_KEY)
    records = _records(spark, sf_dir, accepted, changes, facts, negative=True)
    return _flat(records).withColumn("kind", F.lit("negative_v2"))


@query
def candidates_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _negatives(spark, sf_dir, b.commit_changes(spark, sf_dir))
    accepted = judged.filter("disposition = 'accepted'").select("repo_id", "commit_hash", "ts")
    return candidates.cap_per_repository(accepted, ["ts", "commit_hash"], per_repo=40, total=350).select("repo_id", "commit_hash", "repo_rank")


@query
def extraction_stats_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.extraction_stats(_positives(spark, sf_dir, b.commit_changes(spark, sf_dir)))


@query
def extraction_stats_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.extraction_stats(_negatives(spark, sf_dir, b.commit_changes(spark, sf_dir)), negative=True)


# --- quality --------------------------------------------------------------

SMALL_RECORDS = {"max_files": 2, "max_lines": 100}


def _judged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The verdict needs counts of files and facts of a patch: neither lists nor text move, and changes are read once.
    facts = _patch_facts(spark, sf_dir, "patch_blank")
    positives = _accepted_positives(spark, sf_dir, b.commit_changes(spark, sf_dir), facts, None)
    return quality.judge(_records(spark, sf_dir, positives, None, facts), SMALL_RECORDS)


@query
def quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged_records(spark, sf_dir).select("record_id", "accepted", "score", F.array_join("reasons", ",").alias("reasons"))


CHAIN_GROUPS = {"min_rows": 2, "max_rows": 20}


@query
def dataset_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From commits to a split dataset: candidates, quality, two-key dedup, balance, both classes, split; rows after each step."""
    # The verdict and the dedup need facts of a patch, the later steps only ids: no text moves.
    facts = _patch_facts(spark, sf_dir, "patch_blank", "patch_sha256")
    verdicts = _positives(spark, sf_dir, b.commit_changes(spark, sf_dir), None, facts)
    candidates_ = stored(_records(spark, sf_dir, verdicts, None, facts), "candidates")
    good = stored(quality.accepted_records(quality.judge(candidates_, SMALL_RECORDS)), "good")
    first = dedup.first_per_two_keys(quality.dedup_keys(good)).withColumnRenamed("order_key", "record_id")
    single = stored(good.select("repo_id", "record_id").join(first, "record_id", "left_semi"), "single")
    chosen = splits.balance_groups(single, "repo_id", ["record_id"], **CHAIN_GROUPS)
    positives = stored(chosen.select("record_id"), "positives")
    judged = candidates.judge_negatives(candidates.with_known(verdicts), limits=SMALL_DIFFS)
    negatives = stored(_records(spark, sf_dir, judged, None, None, negative=True).select("record_id"), "negatives")
    labelled = [splits.with_record_ids(rows, name, label, ["record_id"]) for rows, name, label in ((positives, "positive", 1), (negatives, "negative", 0))]
    dataset = stored(splits.assemble(*labelled, ["record_id"]).select("record_id", "label"), "dataset")
    placed = splits.require_integrity(stored(splits.stratified_split(dataset, ["record_id"]), "placed"))
    counts = placed.groupBy(F.concat_ws(":", "split", F.col("label").cast("string")).alias("step")).agg(F.count(F.lit(1)).alias("rows"))
    steps = {"candidates": candidates_, "accepted": good, "deduplicated": single, "balanced": positives, "negatives": negatives, "dataset": dataset}
    for name, rows in steps.items():
        counts = counts.unionByName(rows.agg(F.lit(name).alias("step"), F.count(F.lit(1)).alias("rows")))
    return counts


@query
def reject_top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.top_rejections(_judged_records(spark, sf_dir))


@query
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_histogram(_judged_records(spark, sf_dir))


@query
def dedup_two_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = b.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("order_key"),
        F.concat_ws(":", "source", F.col("n_chars") % 40).alias("key_a"),
        patch.fingerprint(F.col("text")).alias("key_b"),
    )
    return dedup.first_per_two_keys(keys).withColumnRenamed("order_key", "doc_id")


def _grouped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(":", "lang", "source").alias("repo"))


@query
def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.balance_groups(_grouped_documents(spark, sf_dir), "repo", ["doc_id"], min_rows=5, max_rows=30)


@query
def balance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.balance_counts(_grouped_documents(spark, sf_dir), "repo", min_rows=5, max_rows=30)


@query
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_groups(_grouped_documents(spark, sf_dir), ["repo"], ["doc_id"])


# --- samples and splits ---------------------------------------------------


@query
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.downsample_classes(b.table(spark, sf_dir, "labels"), ["doc_id"], "quality").select("doc_id", "quality")


@query
def balanced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = splits.label_by_message(b.file_changes(spark, sf_dir)).select("commit_hash", "file_path", "label")
    return splits.downsample_classes(labelled, ["commit_hash", "file_path"])


@query
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.cap_classes(b.table(spark, sf_dir, "labels"), ["doc_id"], "quality", 200, 50).select("doc_id", "quality")


def _two_classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Good documents, some twice; bad or toxic ones, some of which are good too. Some ids are missing."""
    labels = b.table(spark, sf_dir, "labels")
    record_id = F.expr("case when doc_id % 17 = 0 then null when doc_id % 19 = 0 then ' ' else concat(' d', doc_id) end")
    rows = labels.withColumn("record_id", record_id)

    def both(first: str, second: str) -> DataFrame:
        return rows.filter(first).withColumn("seq", F.lit(1)).unionByName(rows.filter(second).withColumn("seq", F.lit(2)))

    positives = both("quality = 1", "quality = 1 and toxic = 1").drop("toxic")
    negatives = both("quality = 0", "toxic = 1")
    order = ["doc_id", "seq"]
    return splits.with_record_ids(positives, "positive", 1, order), splits.with_record_ids(negatives, "negative", 0, order)


@query
def dataset_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    positives, negatives = _two_classes(spark, sf_dir)
    return splits.assemble(positives, negatives, ["doc_id", "seq"]).select("record_id", "label", "doc_id", "seq", "toxic")


@query
def assembly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assembly_counts(*_two_classes(spark, sf_dir))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(_labelled(spark, sf_dir), ["doc_id"])


@query
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = splits.stratified_split(_labelled(spark, sf_dir), ["doc_id"])
    return splits.integrity(placed.withColumnRenamed("doc_id", "record_id"))


@query
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = b.table(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("record_id"))
    return splits.duplicate_ids(lines)


@query
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.random_split(b.table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"])


@query
def split_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = splits.random_split(b.table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"])
    return splits.distribution(placed, ["lang"], ["split"])


@query
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = b.file_changes(spark, sf_dir).select("commit_hash", "file_path", "timestamp")
    return splits.temporal_split(changes).select("commit_hash", "file_path", "split")


@query
def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.numstat(spark, sf_dir).select("commit_hash", "file_path")
    return splits.leakage(splits.random_split(rows, ["commit_hash", "file_path"]), "commit_hash")


@query
def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    # History, records and their places read the changes, counts and ranks of the split the records: both are stored.
    columns = ["commit_hash", "file_path", "label"]
    measured = ["timestamp", "parent_count", "message", "author_email", "author_name", "insertions", "deletions"]
    changes = stored(splits.label_by_message(b.file_changes(spark, sf_dir)).select(*columns, *measured), "changes")
    rooted = changes.filter("parent_count > 0")
    past = history.enrich(changes.select(*columns, "timestamp", "parent_count"), history.history_rows(rooted), same_rows=True)
    known = past.select(*columns, F.when(F.col("parent_count") > 0, F.col("historical_features")).alias("historical_features"))
    untimed = changes.filter("timestamp is null").select(*columns)
    whole = stored(known.unionByName(untimed, allowMissingColumns=True), "labelled")
    # A split moves every row; whether it has a history goes along in place of the history.
    labelled = whole.withColumn("historical_features", F.when(F.col("historical_features").isNotNull(), F.lit(True)))
    return splits.label_stats(splits.random_split(labelled, ["commit_hash", "file_path"]), history="historical_features")


# --- features -------------------------------------------------------------


@query
def numeric_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["repo_id", "commit_hash"]
    changes = b.commit_changes(spark, sf_dir)
    rows = (
        b.commits(spark, sf_dir).select(*keys)
        .join(numeric.file_counts(changes, ["commit_hash"]), "commit_hash", "left")
        .join(candidates.diff_stats(changes, ["commit_hash"]), "commit_hash", "left")
        .join(b.commit_patches(spark, sf_dir), keys, "left")
    )
    none = F.lit(None).cast("bigint")
    full = numeric.with_patch_numerics(
        rows, F.col("patch"), F.col("file_counts"), none, none, F.col("added_lines"), F.col("deleted_lines"), F.col("files_changed")
    )
    return full.select("commit_hash", *[F.round(n, 6).alias(n) for n in numeric.PATCH_NUMERICS])


@query
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    rows = b.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", *columns)
    scaled = features.fit_scaler(rows, columns).transform(rows)
    return scaled.select("l_orderkey", "l_partkey", "l_linenumber", *[F.round(c, 5).alias(c) for c in columns])


@query
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = features.class_weights(_labelled(spark, sf_dir))
    return weights.select("label", "records", *[F.round(c, 6).alias(c) for c in ("balanced_weight", "relative_weight")])


@query
def tfidf_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tfidf.documents(b.table(spark, sf_dir, "documents"), "doc_id", "text")
    vocab = tfidf.vocabulary(docs, docs.count())
    return vocab.select("term", "corpus_count", "df", F.round("idf", 6).alias("idf"))


@query
def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tfidf.documents(b.table(spark, sf_dir, "documents"), "doc_id", "text")
    weighted = tfidf.fit_documents(docs, docs.count(), tfidf.LONG_WORD).weights_of(docs)
    return weighted.select(F.col("doc").alias("doc_id"), "term", "tf", F.round("weight", 6).alias("weight"))


@query
def pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.pre_token_counts(bpe.training_text(b.patches(spark, sf_dir)))


def _word_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    return b.table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"))


def _joined(encoded, name: str):
    return F.array_join(encoded[name].cast("array<string>"), " ").alias(name)


@query
def encode_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _word_lengths(spark, sf_dir).select("doc_id", encode.head_and_tail(F.col("ids"), 65).alias("e"))
    return rows.select("doc_id", _joined(F.col("e"), "input_ids"), _joined(F.col("e"), "attention_mask"))


@query
def subword_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches as subword ids of a public vocabulary, whole and as model input of both kinds."""
    import public_tokenizers

    rows = bpe.subword_ids(b.patches(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), "doc_id")
    fixed, prefix = encode.head_and_tail(F.col("ids"), 1024), encode.head_only(F.col("ids"), 256)
    digest = lambda ids: F.md5(F.array_join(F.transform(ids, lambda i: i.cast("string")), " "))
    return rows.select(
        "doc_id", F.size("ids").alias("n_ids"), digest(F.col("ids")).alias("ids_md5"), digest(fixed["input_ids"]).alias("fixed_md5"),
        digest(prefix["input_ids"]).alias("prefix_md5"), F.aggregate(fixed["attention_mask"], F.lit(0), lambda s, m: s + m).alias("n_seen"),
    )


@query
def encode_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _word_lengths(spark, sf_dir).select("doc_id", encode.head_only(F.col("ids"), 64).alias("e"))
    return rows.select("doc_id", _joined(F.col("e"), "input_ids"), _joined(F.col("e"), "attention_mask"))


# --- evaluation -----------------------------------------------------------


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), (1 - F.col("toxic")).alias("prediction"))


@query
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_predictions(spark, sf_dir))


@query
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(_predictions(spark, sf_dir))


@query
def metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = metrics.metrics(metrics.confusion(_predictions(spark, sf_dir)))
    return values.select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = metrics.class_report(_predictions(spark, sf_dir))
    return report.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def prediction_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _predictions(spark, sf_dir).select(
        F.col("doc_id").alias("record_id"), "label", "prediction", F.when(F.col("prediction") == 1, 0.75).otherwise(0.25).alias("probability_bug_fix")
    )
    about = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("repo_id"), F.col("lang").alias("commit"))
    return metrics.prediction_records(scored, about)


# --- manifest -------------------------------------------------------------


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verdicts(b.repositories(spark, sf_dir))


@query
def repo_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(spark, sf_dir).select("repo_id", "status", "score", F.array_join("notes", "; ").alias("notes"))


@query
def repo_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verdict_counts(_verdicts(spark, sf_dir))


@query
def manifest_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts recorded twice: the second run adds no note."""
    rows = manifest.new_records(b.repositories(spark, sf_dir).drop("collection_status", "quality_status"))
    judged = _verdicts(spark, sf_dir)
    once = manifest.record_verdicts(rows, judged)
    return manifest.record_verdicts(once, judged).select(
        "repo_id", "collection_status", "quality_status", F.array_join("quality_notes", "|").alias("notes"), "dataset_version",
        "provenance.source", "provenance.source_url",
    )


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = b.repositories(spark, sf_dir)
    full = manifest.new_records(rows).join(rows.select("repo_id", "c_custkey"), "repo_id")
    old = full.filter("c_custkey % 3 > 0").withColumn("dataset_version", F.lit("v0"))
    return old.drop("c_custkey"), full.filter("c_custkey % 2 = 0").drop("c_custkey")


@query
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _halves(spark, sf_dir)
    merged = manifest.add_missing(old, new)
    per_customer = b.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    changes = per_customer.select(
        F.concat(F.lit("cust"), "o_custkey").alias("repo_id"), F.col("n").alias("stars"),
        F.when(F.col("n") % 2 == 0, F.lit("main")).alias("default_branch"),
    )
    return manifest.update(merged, changes).select("repo_id", "dataset_version", "stars", "default_branch", "collection_status", "language")


@query
def manifest_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.addition_counts(*_halves(spark, sf_dir))


def _collection_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = b.table(spark, sf_dir, "orders")
    at = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey"))
    kind = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "started").otherwise("failed")
    return orders.select(
        F.concat(F.lit("cust"), "o_custkey").alias("repo_id"), at.alias("at"), kind.alias("event"), F.col("o_orderpriority").alias("error"),
        F.col("o_orderkey").alias("commit_count"), (F.col("o_orderkey") % 100).alias("source_file_count"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("diff_record_count", "bug_fix_record_count")],
    )


def _collected(after: DataFrame) -> DataFrame:
    return after.select(
        "repo_id", "collection_status", "collection_error", "commit_count", "source_file_count", F.unix_micros("last_collected_at").alias("collected_us")
    )


@query
def manifest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collected(manifest.apply_events(manifest.new_records(b.repositories(spark, sf_dir)), _collection_events(spark, sf_dir)))


@query
def kept_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events in three batches out of order, the first one twice, on a stored manifest made in two parts."""
    full = manifest.new_records(b.repositories(spark, sf_dir))
    kept = KeptManifest(spark, scratch_path(spark, "manifest"))
    kept.create(full.where("crc32(cast(repo_id as binary)) % 2 = 0"))
    kept.add(full)
    events = _collection_events(spark, sf_dir)
    for batch in (2, 0, 1, 2):
        kept.apply(events.where(F.col("commit_count") % 3 == batch))
    return _collected(kept.read())


@query
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.status_counts(b.repositories(spark, sf_dir))


@query
def repository_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = b.file_changes(spark, sf_dir).select("repo_id", "file_path").distinct()
    return manifest.repository_counts(b.commits(spark, sf_dir), files)


# --- code graph -----------------------------------------------------------

REPOSITORY_NAME = "sample"


@query
def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    every_path = b.files(spark, sf_dir).select("file_path").unionByName(b.numstat(spark, sf_dir).select("file_path").distinct())
    return codegraph.module_map(every_path)


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.module_map(b.files(spark, sf_dir))


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.resolve_imports(b.positioned_imports(spark, sf_dir), _modules(spark, sf_dir))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.resolve_calls(
        b.caller_calls(spark, sf_dir), b.functions(spark, sf_dir), b.positioned_imports(spark, sf_dir), _modules(spark, sf_dir), "position"
    )


@query
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _imports(spark, sf_dir).select("file_path", "kind", "module", "name", "alias", "level", "target_path")


@query
def visible_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.visible_names(b.positioned_imports(spark, sf_dir), "position")


@query
def function_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.global_lookup(b.functions(spark, sf_dir))


@query
def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir).select("fn_no", "caller_id", "call", "target_id", "resolution", "disposition")


@query
def call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.plain_edges(codegraph.plain_call_graph(b.caller_calls(spark, sf_dir), b.functions(spark, sf_dir)))


@query
def call_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = codegraph.plain_call_graph(b.caller_calls(spark, sf_dir), b.functions(spark, sf_dir))
    return codegraph.histogram(resolved, "disposition")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.nodes(
        REPOSITORY_NAME, b.files(spark, sf_dir), b.classes(spark, sf_dir), b.functions(spark, sf_dir), _imports(spark, sf_dir)
    )


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    contains = codegraph.contains_edges(REPOSITORY_NAME, b.files(spark, sf_dir), b.classes(spark, sf_dir), b.functions(spark, sf_dir))
    return contains.unionByName(codegraph.import_edges(_imports(spark, sf_dir)), allowMissingColumns=True).unionByName(
        codegraph.call_edges(_calls(spark, sf_dir)), allowMissingColumns=True
    )


@query
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.display_label(_nodes(spark, sf_dir)).select("id", "node_type", "name", "file", "line_start", "label")


@query
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).select("src", "dst", "relation", "module", "imported_name", "original_call", "resolution")


@query
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.resolution_stats(_calls(spark, sf_dir), _imports(spark, sf_dir))


@query
def graph_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    node_counts = codegraph.histogram(_nodes(spark, sf_dir), "node_type").withColumnRenamed("node_type", "name")
    edge_counts = codegraph.histogram(_edges(spark, sf_dir), "relation").withColumnRenamed("relation", "name")
    return node_counts.unionByName(edge_counts)


@query
def first_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first edges between parts and suppliers; edges of other lines belong to another relation."""
    relation = F.when(F.col("l_linenumber") == 1, "SUPPLIES").otherwise("RESTOCKS").alias("relation")
    lines = b.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("part"), "l_partkey").alias("src"), F.concat(F.lit("supplier"), "l_suppkey").alias("dst"), relation)
    parts = b.table(spark, sf_dir, "part").select(F.concat(F.lit("part"), "p_partkey").alias("id"), F.col("p_name").alias("qualified_name"), F.col("p_brand").alias("file"))
    suppliers = b.table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier"), "s_suppkey"), "s_name", F.concat(F.lit("nation"), "s_nationkey"))
    return codegraph.first_edges(lines.distinct(), parts.unionAll(suppliers), "SUPPLIES", 20, ["src", "dst"])


def _supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("part"), "l_partkey").alias("src"), F.concat(F.lit("supplier"), "l_suppkey").alias("dst")
    )


def _start(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = b.table(spark, sf_dir, "part").select(F.concat(F.lit("part"), "p_partkey").alias("id"), F.col("p_name").alias("qualified_name"))
    return codegraph.find_nodes(parts, "red w").orderBy("id").limit(1)


@query
def khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.neighbourhood(_supply_edges(spark, sf_dir), _start(spark, sf_dir), 2)


@query
def khop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _supply_edges(spark, sf_dir).distinct()
    return codegraph.induced_edges(edges, codegraph.neighbourhood(edges, _start(spark, sf_dir), 1))


# --- code structure -------------------------------------------------------


def _generated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Python file per part, written from its columns; some do not parse."""
    lines = [
        "'import os'", "'from pkg.m' || p_size || ' import helper as h' || p_size",
        "case when p_partkey % 4 = 0 then 'class C' || p_partkey || '(Base()):' else 'if True:' end",
        "'    def f' || p_partkey || '(self, a, *, b=1):'", "'        \"\"\"' || p_name || '\"\"\"'", "'        self.g(a)'",
        "'        def inner():'", "'            return os.path.join(a, ' || p_size || ')'", "'        return inner()'",
        "case when p_partkey % 9 = 0 then 'def broken(:' else 'async def g' || p_size || '(): h' || p_size || '()' end",
    ]
    code = F.expr(f"concat_ws('\n', {', '.join(lines)})")
    return b.table(spark, sf_dir, "part").select(F.concat(F.lit("src/p"), "p_partkey", F.lit(".py")).alias("file_path"), code.alias("code"))


@query
def code_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = structure.extract_structure(_generated_sources(spark, sf_dir))
    names = F.array_join(F.transform("functions", lambda f: f["qualified_name"]), ",")
    calls = F.array_join(F.flatten(F.transform("functions", lambda f: f["calls"])), ",")
    return items.select(
        "file_path", "parsed", F.size("functions").alias("functions"), F.size("classes").alias("classes"), F.size("imports").alias("imports"),
        names.alias("names"), calls.alias("calls"),
    )


@query
def code_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = _generated_sources(spark, sf_dir)
    return structure.summary(sources, structure.extract_structure(sources))


# --- subwords, models and streaming: no SQL counterpart -------------------


def _document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labelled(spark, sf_dir)
    texts = b.patches(spark, sf_dir).withColumn("l", patch.line_changes(F.col("patch")))
    rows = texts.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("record_id"), "label", F.col("source").alias("message"), "patch",
        "l.added_line_count", "l.removed_line_count", F.col("lang").alias("change_type"),
        F.concat("source", F.when(F.col("lang") == "en", ".py").otherwise(".js")).alias("file_path"),
    )
    # Training reads its rows several times, so the assembled dataset is stored.
    return stored(splits.stratified_split(rows, ["record_id"]), "records")


def _scores(classifier: models.Classifier, rows: DataFrame, model_text=None, texts: models.Texts | None = None) -> DataFrame:
    scored = classifier.score(rows if model_text is None else rows.withColumn("model_text", model_text), texts=texts)
    return scored.select("record_id", "split", "label", "prediction", F.round("probability_bug_fix", 4).alias("probability_bug_fix"))


@query
def lr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _document_records(spark, sf_dir)
    classifier = models.train_message_and_patch(rows.filter("split = 'train'"))
    return _scores(classifier, rows.filter("split <> 'train'"), features.model_text(F.col("message"), F.col("patch")))


@query
def lr_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _document_records(spark, sf_dir)
    classifier = models.train_patch_only(rows.filter("split = 'train'"))
    return _scores(classifier, rows.filter("split <> 'train'"), features.model_text(None, F.col("patch")))


@query
def lr_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _document_records(spark, sf_dir)
    classifier = models.train_hybrid(rows.filter("split = 'train'"))
    rest = features.change_columns(rows.filter("split <> 'train'"))
    return _scores(classifier, rest, features.model_text(None, F.col("patch")))


def _history_records(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """File records with label, history and split; of those before the split only ``columns`` are stored, if it says which."""
    message = F.col("message")
    flags = {"label": text.is_fix_message(message).cast("int"), "fix_like": text.is_fix_like(message)}
    changes = b.file_changes(spark, sf_dir, flags).filter("parent_count > 0")
    past = history.history_rows(changes, bug_like=F.col("fix_like"))
    enriched = history.enrich(changes, past, same_rows=True).select(
        F.concat_ws(":", "commit_hash", "file_path").alias("record_id"), "commit_hash", "file_path", "timestamp", "label", "historical_features",
        F.col("insertions").alias("added_line_count"), F.col("deletions").alias("removed_line_count"), F.col("flag").alias("change_type"),
    )
    return splits.temporal_split(stored(enriched.select(columns or "*"), "records"))


# What the models on history alone are trained on.
_HISTORY_ONLY = ["commit_hash", "timestamp", "label", "historical_features"]


@query
def lr_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history_records(spark, sf_dir)
    classifier = models.train_history_only(rows.filter("split = 'train'"))
    return _scores(classifier, features.history_columns(rows.filter("split <> 'train'"), missing_days=0.0))


def _commit_texts(spark: SparkSession, sf_dir: str) -> models.Texts:
    """The patch of a commit, which its file records share."""
    patches = b.patches(spark, sf_dir).select(F.concat(F.lit("c"), "doc_id").alias("commit_hash"), features.model_text(None, F.col("patch")).alias("model_text"))
    return models.Texts(patches, "commit_hash")


@query
def lr_historical_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, texts = _history_records(spark, sf_dir), _commit_texts(spark, sf_dir)
    classifier = models.train_historical_hybrid(rows.filter("split = 'train'"), texts)
    rest = features.history_columns(features.change_columns(rows.filter("split <> 'train'")))
    return _scores(classifier, rest, texts=texts)


@query
def history_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine history features as the models read them, of files with and without a past."""
    changes = b.file_changes(spark, sf_dir).filter("parent_count > 0")
    enriched = history.enrich(
        changes.select("commit_hash", "file_path", "timestamp"), history.history_rows(changes), same_rows=True
    )
    rows = features.history_columns(enriched)
    return rows.select("commit_hash", "file_path", *[F.round(n, 6).alias(n) for n in rules.HISTORY_FEATURES])


@query
def change_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change numerics and categories of file-level records."""
    rows = b.numstat(spark, sf_dir).withColumns(
        {"change_type": F.nullif("flag", F.lit("A")), "removed": F.when(F.col("deletions") > 3, F.col("deletions"))}
    )
    full = features.change_columns(rows, "insertions", "removed")
    return full.select("commit_hash", "file_path", "added", "removed", "total_changes", "change_balance", "change_type", "extension")


@query
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the one-hot categories; fitted without one language, which becomes all zeros."""
    rows = b.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("change_type"), F.col("source").alias("extension"))
    encoded = features.fit_one_hot(rows.filter("change_type <> 'fr'"), features.CATEGORIES).transform(rows)
    place = lambda c: (F.array_position(vector_to_array(f"{c}_onehot"), 1.0) - 1).cast("bigint").alias(c)
    return encoded.select("doc_id", *[place(c) for c in features.CATEGORIES])


def _fit_proof(classifier: models.Classifier, rows: DataFrame, texts: models.Texts | None = None) -> DataFrame:
    """Slope of the loss for every feature where training starts, and where it ended as a share of the steepest start."""
    slopes = stored(models.gradient(classifier, rows, texts=texts), "slopes")
    steepest = slopes.agg(F.max(F.abs("start"))).scalar()
    # Adding zero turns a rounded -0.0 into 0.0.
    return slopes.select(
        "block", "feature", (F.round("start", 6) + F.lit(0.0)).alias("start"),
        (F.round(F.col("gradient") / steepest, 2) + F.lit(0.0)).alias("gradient"),
    )


@query
def lr_history_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit of the history model: its slopes over the training rows are zero."""
    rows = _history_records(spark, sf_dir, _HISTORY_ONLY).filter("split = 'train'")
    return _fit_proof(models.train_history_only(rows), features.history_columns(rows, missing_days=0.0))


@query
def lr_hybrid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit of the hybrid model, for every term, numeric and category."""
    rows = _document_records(spark, sf_dir).filter("split = 'train'")
    ready = features.change_columns(rows).withColumn("model_text", features.model_text(None, F.col("patch")))
    return _fit_proof(models.train_hybrid(rows), ready)


@query
def lr_text_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit of the message and patch model, for every term of its vocabulary."""
    rows = _document_records(spark, sf_dir).filter("split = 'train'")
    text_ = features.model_text(F.col("message"), F.col("patch"))
    return _fit_proof(models.train_message_and_patch(rows), rows.withColumn("model_text", text_))


@query
def lr_patch_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit of the patch model, for every term of its vocabulary."""
    rows = _document_records(spark, sf_dir).filter("split = 'train'")
    return _fit_proof(models.train_patch_only(rows), rows.withColumn("model_text", features.model_text(None, F.col("patch"))))


@query
def lr_historical_hybrid_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit of the model with text, categories, change and history numerics, for every place of its vectors."""
    rows, texts = _history_records(spark, sf_dir).filter("split = 'train'"), _commit_texts(spark, sf_dir)
    ready = features.history_columns(features.change_columns(rows))
    return _fit_proof(models.train_historical_hybrid(rows, texts), ready, texts)


@query
def lr_history_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history model evaluated on validation and test: rows and labels per split, and whether its metrics are sound."""
    rows = _history_records(spark, sf_dir, _HISTORY_ONLY)
    classifier = models.train_history_only(rows.filter("split = 'train'"))
    scored = stored(classifier.score(features.history_columns(rows.filter("split <> 'train'"), missing_days=0.0)), "scored")
    reports = [
        metrics.metrics(metrics.confusion(scored.filter(F.col("split") == split))).withColumn("split", F.lit(split)) for split in splits.SPLITS[1:]
    ]
    found = reports[0].unionByName(reports[1])
    facts = scored.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == F.col("prediction")).alias("right"))
    agrees = F.abs(F.col("accuracy") - F.col("right") / F.col("rows")) < 1e-9
    return facts.join(found, "split").select("split", "rows", "positives", agrees.alias("accuracy_agrees"))


@query
def training_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps of two runs with warm start, stops and choice, on two numerics."""
    rows = features.change_columns(_document_records(spark, sf_dir))
    train_rows, validation = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    blocks, _ = models.fit_blocks(train_rows, numerics=["added", "removed"])
    found = training.choose(train_rows, validation, blocks, (0.001, 1.0), iterations=1, max_steps=6, patience=2).history
    return found.select("run", "step", "c", F.round("loss", 6).alias("loss"), F.round("f1", 6).alias("f1"), "gain", "stopped", "chosen")


@query
def trained_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid classifier chosen on validation data, applied to the test rows."""
    rows = features.change_columns(_document_records(spark, sf_dir)).withColumn("model_text", features.model_text(None, F.col("patch")))
    train_rows, validation = rows.filter("split = 'train'"), rows.filter("split = 'validation'")
    blocks, _ = models.fit_blocks(train_rows, numerics=features.CHANGE_NUMERICS, categories=features.CATEGORIES, text_pattern=tfidf.WORD)
    choice = training.choose(train_rows, validation, blocks, (0.1, 1.0), iterations=3, max_steps=8)
    return _scores(choice.classifier, rows.filter("split = 'test'"))


@query
def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message and patch, and the patch alone, as the text models read them; some have no message or no patch."""
    rows = b.patches(spark, sf_dir).select(
        "doc_id", F.when(F.col("lang") != "de", F.col("source")).alias("message"), F.when(F.col("lang") != "fr", F.col("patch")).alias("patch")
    )
    both, alone = features.model_text(F.col("message"), F.col("patch")), features.model_text(None, F.col("patch"))
    return rows.select("doc_id", F.md5(both).alias("both_md5"), F.md5(alone).alias("alone_md5"))


@query
def invalid_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose label is missing or neither 0 nor 1."""
    label = F.when(F.col("doc_id") % 7 != 0, F.col("quality") + F.col("toxic"))
    rows = b.table(spark, sf_dir, "labels").select("doc_id", label.alias("label"))
    return features.invalid_labels(rows)


@query
def stream_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests scored in a stream by a classifier that was trained, saved and loaded; same scores as the batch."""
    texts = b.patches(spark, sf_dir).withColumn("l", patch.line_changes(F.col("patch")))
    facts = [F.col("doc_id").cast("string").alias("record_id"), F.col("patch"), F.col("l.added_line_count"), F.col("l.removed_line_count")]
    requests = stored(texts.select("doc_id", *facts), "requests")
    none = F.lit(None).cast("bigint")
    rows = numeric.with_patch_numerics(
        requests, F.col("patch"), None, F.col("added_line_count"), F.col("removed_line_count"), none, none, none
    )
    trained = models.train(rows.join(_labelled(spark, sf_dir), "doc_id"), 200, numerics=numeric.PATCH_NUMERICS[:4] + numeric.PATCH_NUMERICS[-2:])
    work = scratch_path(spark, "stream")
    trained.save(f"{work}/model")
    loaded = models.Classifier.load(spark, f"{work}/model")
    requests.select(F.to_json(F.struct(*requests.columns[1:])).alias("value")).write.text(f"{work}/in")
    running = scoring.start_scoring(
        scoring.read_requests(spark, f"{work}/in"),
        lambda batch: loaded.score(scoring.numeric_columns(batch)).select("record_id", F.col("probability_bug_fix").alias("streamed")),
        f"{work}/out", f"{work}/bad", f"{work}/state", availableNow=True,
    )
    running.awaitTermination()
    both = trained.score(rows).join(spark.read.parquet(f"{work}/out"), "record_id", "left")
    agrees = F.coalesce(F.abs(F.col("streamed") - F.col("probability_bug_fix")) < 1e-9, F.lit(False))
    return both.select("doc_id", agrees.alias("agrees"))


@query
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History features of changes that arrive in five batches, a third of them late, from state per path."""
    changes = b.file_changes(spark, sf_dir).filter("parent_count > 0")
    rows = history.history_rows(changes.withColumn("request_id", F.concat_ws("|", "commit_hash", "file_path")), carry=["request_id"])
    late = F.pmod(F.crc32("request_id"), F.lit(3)) * (10 * history.DAY_US)
    placed = stored(
        rows.withColumnRenamed("commits", "changes").withColumn("arrival", F.col("us") + late).withColumn("event_time", F.timestamp_micros("us")), "events"
    )
    low, high = placed.agg(F.min("arrival"), F.max("arrival")).first()
    work = scratch_path(spark, "stream")
    columns = ["path", "event_time", "request_id", "changes", "fixes", "plus", "minus", "author"]
    # A row far ahead moves the watermark past all others.
    end = placed.agg(F.max("us").alias("us")).select(
        F.lit("end").alias("path"), F.timestamp_micros(F.col("us") + 4000 * history.DAY_US).alias("event_time"), F.lit(None).cast("string").alias("request_id"),
        *[F.lit(0).cast("bigint").alias(c) for c in columns[3:7]], F.lit(None).cast("string").alias("author"),
    )
    batch = F.least(F.expr(f"(arrival - {low}) * 5 div ({high} - {low} + 1)"), F.lit(4))
    # Each batch is written by all tasks, in any number of files; the stream goes on from its checkpoint with the files of one batch at a time.
    # Answers wait for the next batch; only after the last one a batch without rows has to follow.
    follow = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(follow)
    for i, rows in enumerate([*(placed.filter(batch == i).select(*columns) for i in range(5)), end.coalesce(1)]):
        rows.write.mode("append").parquet(f"{work}/in")
        spark.conf.set(follow, before if i == 5 else "false")
        events = spark.readStream.schema(rows.schema).parquet(f"{work}/in")
        running = (
            arrival.history_at_arrival(events, "40 days").writeStream.format("parquet").option("path", f"{work}/out")
            .option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start()
        )
        running.awaitTermination()
    answered = spark.read.parquet(f"{work}/out")
    return answered.select(
        F.split_part("request_id", F.lit("|"), F.lit(1)).alias("commit_hash"), F.col("path").alias("file_path"), *rules.HISTORY_FEATURES
    )


@query
def kept_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History features from a kept history to which three batches were added, late rows among them."""
    changes = b.file_changes(spark, sf_dir).filter("parent_count > 0")
    rows = stored(history.history_rows(changes, carry=["commit_hash", "file_path"]), "rows")
    kept = history.KeptHistory(scratch_path(spark, "kept"))
    for i in range(3):
        kept.add(rows.filter(F.pmod(F.crc32("commit_hash"), F.lit(3)) == i).drop("commit_hash", "file_path"), i + 1)
    found = kept.features(rows.select("path", "us"))
    return rows.select("commit_hash", "file_path", "path", "us").join(found, ["path", "us"]).drop("path", "us")


@query
def coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _history_records(spark, sf_dir, _HISTORY_ONLY)
    classifier = models.train_history_only(rows.filter("split = 'train'"))
    return models.coefficients(classifier)


# A stored linear scorer: means, scales and weights by feature.
STORED_MEAN = {"added": 10.0, "removed": 10.0, "patch_length": 2000.0, "patch_line_count": 30.0}
STORED_SCALE = {"added": 8.0, "removed": 9.0, "patch_length": 1500.0, "patch_line_count": 25.0}
STORED_WEIGHTS = {"added": 0.7, "removed": -0.4, "patch_length": 0.3, "patch_line_count": -0.2}
STORED_INTERCEPT = 0.1


def _stored_probability():
    return models.linear_probability(features.Scaler(STORED_MEAN, STORED_SCALE), STORED_WEIGHTS, STORED_INTERCEPT)


@query
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as request files, scored by a stream that ends when all are done; bad lines counted too."""
    texts = b.patches(spark, sf_dir).withColumn("l", patch.line_changes(F.col("patch")))
    request = F.to_json(
        F.struct(
            F.col("doc_id").cast("string").alias("record_id"), "patch",
            F.when(F.col("lang") != "de", F.col("l.added_line_count")).alias("added_line_count"),
            F.when(F.col("lang") != "de", F.col("l.removed_line_count")).alias("removed_line_count"),
            F.struct(F.lit(1).alias("files_changed"), F.lit(3).alias("added_lines"), F.lit(2).alias("deleted_lines")).alias("diff_stats"),
        )
    )
    line = F.when(F.col("lang") == "es", F.concat(F.lit("not json "), "doc_id")).otherwise(request)
    work = scratch_path(spark, "stream")
    texts.select(line.alias("value")).write.text(f"{work}/in")
    running = scoring.start_scoring(
        scoring.read_requests(spark, f"{work}/in"),
        lambda rows: scoring.responses(rows, _stored_probability(), rules.DECISION_THRESHOLD),
        f"{work}/out", f"{work}/bad", f"{work}/state", availableNow=True,
    )
    running.awaitTermination()
    good = spark.read.parquet(f"{work}/out").select("record_id", "prediction", F.round("bug_fix_probability", 6).alias("probability"))
    bad = spark.read.parquet(f"{work}/bad").select(F.col("value").alias("record_id"), F.lit("rejected").alias("prediction"))
    return good.unionByName(bad, allowMissingColumns=True)


@query
def linear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same stored scorer over a table at the threshold for outside data."""
    texts = b.patches(spark, sf_dir).withColumn("l", patch.line_changes(F.col("patch")))
    none = F.lit(None).cast("bigint")
    full = numeric.with_patch_numerics(
        texts, F.col("patch"), None, F.col("l.added_line_count"), F.col("l.removed_line_count"), none, none, none
    )
    scored = full.withColumn("p", _stored_probability())
    return scored.select(
        "doc_id", F.round("p", 6).alias("probability"), models.label_name(models.decide(F.col("p"), rules.EXTERNAL_THRESHOLD)).alias("prediction")
    )


@query
def best_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choice among runs: one per language, scored on the labels."""
    rows = _predictions(spark, sf_dir).join(b.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("model"), "n_chars"), "doc_id")
    counts = rows.groupBy("model").agg(
        *[F.count_if(t).alias(n) for n, t in {
            "tp": (F.col("label") == 1) & (F.col("prediction") == 1), "fp": (F.col("label") == 0) & (F.col("prediction") == 1),
            "tn": (F.col("label") == 0) & (F.col("prediction") == 0), "fn": (F.col("label") == 1) & (F.col("prediction") == 0),
        }.items()],
        F.avg("n_chars").alias("loss"),
    )
    chosen = models.best_model(metrics.metrics(counts).select("model", "f1", "loss", *["tp", "fp", "tn", "fn"]))
    return chosen.select("model", F.round("f1", 6).alias("f1"), F.round("loss", 4).alias("loss"))
