"""Sampling, splits, leakage checks and distributions of labelled datasets."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from patchlake import rules
from patchlake.functions.text import is_fix_message
from patchlake.operators.dedup import first_per_key
from patchlake.operators.ranking import hash_ranks, shuffle_key, sorted_ranks

SPLITS = ["train", "validation", "test"]


# --- assembly -------------------------------------------------------------


def with_record_ids(df: DataFrame, source: str, label: int, order: list[str], record_id: str = "record_id") -> DataFrame:
    """Rows with a forced label and a non-empty record id.

    A row with none gets one from its 1-based position in ``order`` (unique).
    Positions are worked out on the order columns alone, and joined to the rows
    that need one.
    """
    text = F.trim(F.col(record_id).cast("string"))
    labelled = df.withColumn(record_id, F.nullif(text, F.lit(""))).withColumn("label", F.lit(label))
    missing = labelled.filter(F.col(record_id).isNull())
    positions = sorted_ranks(df.select(*order), order, "__position")
    named = (
        missing.join(positions, order)
        .withColumn(record_id, F.concat(F.lit(f"{source}:missing_record_id:"), F.col("__position") + 1))
        .drop("__position")
    )
    return labelled.filter(F.col(record_id).isNotNull()).unionByName(named)


def assemble(positives: DataFrame, negatives: DataFrame, order: list[str]) -> DataFrame:
    """One dataset of both classes, one row per id; a positive wins over a negative."""
    first_positive = first_per_key(positives, "record_id", order)
    first_negative = first_per_key(negatives, "record_id", order)
    rest = first_negative.join(first_positive.select("record_id"), "record_id", "left_anti")
    return first_positive.unionByName(rest, allowMissingColumns=True)


def assembly_counts(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Rows, duplicates inside each class and ids found in both classes."""
    tagged = positives.select("record_id", F.lit(1).alias("p"), F.lit(0).alias("n")).unionByName(
        negatives.select("record_id", F.lit(0).alias("p"), F.lit(1).alias("n"))
    )
    per_id = tagged.groupBy("record_id").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return per_id.agg(
        F.sum("p").alias("positive_rows"),
        F.sum("n").alias("negative_rows"),
        F.sum(F.greatest(F.col("p") - 1, F.lit(0))).alias("positive_duplicates"),
        F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("negative_duplicates"),
        F.count_if((F.col("p") > 0) & (F.col("n") > 0)).alias("cross_class_conflicts"),
    )


def integrity(dataset: DataFrame, split: str = "split") -> DataFrame:
    """One row: both classes present, ids unique, splits complete."""
    per_id = dataset.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == 1).alias("p"),
        F.count_if(F.col("label") == 0).alias("q"),
        F.count_if(F.col(split).isin(SPLITS)).alias("placed"),
    )
    return per_id.agg(
        F.sum("n").alias("rows"),
        (F.sum("p") > 0).alias("has_positives"),
        (F.sum("q") > 0).alias("has_negatives"),
        (F.max("n") == 1).alias("ids_unique"),
        (F.sum("placed") == F.sum("n")).alias("splits_complete"),
    )


def check_ratios(ratios: tuple[float, ...]) -> None:
    if abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError("split ratios must sum to 1")


def require_integrity(dataset: DataFrame, split: str = "split") -> DataFrame:
    """``dataset`` itself, after a check that raises on the first broken rule."""
    row = integrity(dataset, split).first()
    for name in ["has_positives", "has_negatives", "ids_unique", "splits_complete"]:
        if not row[name]:
            raise ValueError(f"dataset check failed: {name}")
    return dataset


# --- sampling -------------------------------------------------------------


def balance_groups(
    df: DataFrame,
    group: str,
    ids: list[str],
    min_rows: int = rules.MIN_RECORDS_PER_REPO,
    max_rows: int = rules.MAX_RECORDS_PER_REPO,
    seed: int = rules.SEED,
) -> DataFrame:
    """Groups below ``min_rows`` left out, others sampled down to ``max_rows``."""
    ranked = hash_ranks(df, [group], shuffle_key(seed, *ids), ids)
    return ranked.filter((F.col("group_size") >= min_rows) & (F.col("rank") <= max_rows)).drop("rank", "group_size")


def balance_counts(
    df: DataFrame, group: str, min_rows: int = rules.MIN_RECORDS_PER_REPO, max_rows: int = rules.MAX_RECORDS_PER_REPO
) -> DataFrame:
    """Rows kept per group, zero for those left out."""
    n = F.col("n")
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(group, F.when(n < min_rows, 0).otherwise(F.least(n, F.lit(max_rows))).cast("bigint").alias("kept"))


def label_by_message(file_patches: DataFrame, message: str = "message") -> DataFrame:
    return file_patches.withColumn("label", is_fix_message(F.col(message)).cast("int"))


def downsample_classes(df: DataFrame, ids: list[str], label: str = "label", seed: int = rules.SEED) -> DataFrame:
    """Both classes sampled down to the size of the smaller one."""
    smaller = df.agg(
        F.least(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).alias("n")
    ).scalar()
    ranked = hash_ranks(df.filter(F.col(label).isin(0, 1)), [label], shuffle_key(seed, *ids), ids)
    return ranked.filter(F.col("rank") <= smaller).drop("rank", "group_size")


def cap_classes(
    df: DataFrame,
    ids: list[str],
    label: str = "label",
    max_positives: int = rules.MAX_PER_CLASS,
    max_negatives: int = rules.MAX_PER_CLASS,
    seed: int = rules.SEED,
) -> DataFrame:
    """Positives up to their cap; negatives up to theirs and to the positives taken."""
    taken = df.agg(F.least(F.count_if(F.col(label) == 1), F.lit(max_positives)).alias("n")).scalar()
    ranked = hash_ranks(df.filter(F.col(label).isin(0, 1)), [label], shuffle_key(seed, *ids), ids)
    limit = F.when(F.col(label) == 1, F.lit(max_positives)).otherwise(F.least(F.lit(max_negatives), taken))
    return ranked.filter(F.col("rank") <= limit).drop("rank", "group_size")


# --- splits ---------------------------------------------------------------


def _by_rank(rank: Column, size: Column, ratios: tuple[float, float, float], min_rows: int = 0) -> Column:
    """Split name of a 1-based rank; both inner borders round down, the rest is test."""
    train = F.floor(size * F.lit(float(ratios[0])))
    validation = train + F.floor(size * F.lit(float(ratios[1])))
    return (
        F.when((size < min_rows) | (rank <= train), F.lit("train"))
        .when(rank <= validation, F.lit("validation"))
        .otherwise(F.lit("test"))
    )


def split_groups(
    df: DataFrame,
    groups: list[str],
    ids: list[str],
    ratios: tuple[float, float, float] = rules.SPLIT_RATIOS,
    min_rows: int = 10,
    seed: int = rules.SEED,
) -> DataFrame:
    """Every group split on its own; groups below ``min_rows`` go to train whole.

    With no groups this is the plain random split, with the label as group the
    stratified one (``min_rows=0`` for both).
    """
    check_ratios(ratios)
    ranked = hash_ranks(df, groups, shuffle_key(seed, *ids), ids)
    return ranked.withColumn("split", _by_rank(F.col("rank"), F.col("group_size"), ratios, min_rows)).drop("rank", "group_size")


def stratified_split(df: DataFrame, ids: list[str], label: str = "label", **options) -> DataFrame:
    return split_groups(df, [label], ids, min_rows=0, **options)


def random_split(df: DataFrame, ids: list[str], **options) -> DataFrame:
    return split_groups(df, [], ids, min_rows=0, **options)


def commit_times(df: DataFrame, commit: str = "commit_hash", ts: str = "timestamp") -> DataFrame:
    """Earliest time per commit; rows with no commit are left out."""
    return df.filter(F.col(commit) != "").groupBy(commit).agg(F.min(ts).alias("commit_ts"))


def temporal_split(
    df: DataFrame,
    commit: str = "commit_hash",
    ts: str = "timestamp",
    ratios: tuple[float, float, float] = rules.TEMPORAL_RATIOS,
) -> DataFrame:
    """Oldest commits to train, newest to test; all rows of a commit stay together.

    Ties go by commit hash. Commits with no time come first. The ranking sees
    one narrow row per commit; the rows themselves are only joined to its result.
    """
    check_ratios(ratios)
    times = commit_times(df, commit, ts)
    ranked = sorted_ranks(times, [F.col("commit_ts").asc_nulls_first(), F.col(commit)])
    total = ranked.agg(F.count(F.lit(1)).alias("n")).scalar()
    train = F.floor(total * F.lit(float(ratios[0])))
    validation = F.floor(total * F.lit(float(ratios[0]) + float(ratios[1])))
    placed = ranked.select(
        commit,
        F.when(F.col("rank") < train, F.lit("train"))
        .when(F.col("rank") < validation, F.lit("validation"))
        .otherwise(F.lit("test"))
        .alias("split"),
    )
    return df.join(placed, commit)


# --- reports --------------------------------------------------------------


def leakage(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys found in two splits, for each pair of splits; one pass with flags."""
    seen = df.filter(F.col(key).cast("string") != "").groupBy(key).agg(
        *[F.bool_or(F.col(split) == s).alias(s) for s in SPLITS]
    )
    return seen.agg(
        *[F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}_overlap") for a, b in combinations(SPLITS, 2)]
    )


def require_no_leakage(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    row = leakage(df, key, split).first()
    found = {name: n for name, n in row.asDict().items() if n}
    if found:
        raise ValueError(f"keys shared between splits: {found}")
    return df


def duplicate_ids(df: DataFrame, key: str = "record_id") -> DataFrame:
    """Number of rows beyond the first of their id, over all splits."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"))


def distribution(df: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """Rows per combination of ``within + by`` and its percentage inside ``within``.

    Shares are taken over the counted table, which has one row per combination.
    """
    from pyspark.sql import Window

    counts = df.groupBy(*within, *by).agg(F.count(F.lit(1)).alias("records"))
    whole = F.sum("records").over(Window.partitionBy(*(within or [F.lit(0)])))
    return counts.withColumn("percent", F.round(F.col("records") * 100.0 / whole, 2))


def label_stats(df: DataFrame, split: str = "split", history: str | None = None) -> DataFrame:
    """Positives and negatives per split, and rows that carry a history struct."""
    extra = [F.count_if(F.col(history).isNotNull()).alias("with_history")] if history else []
    return df.groupBy(split).agg(
        F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"), *extra
    )
