"""Strictly earlier (as-of) history of a key, for any number of probe times."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from patchlake import rules
from patchlake.functions.text import is_fix_like
from patchlake.session import stored

DAY_US = 86_400_000_000
_MEASURES = ["commits", "fixes", "plus", "minus", "authors"]
_KEPT = f"path string, us bigint, {', '.join(f'{m} bigint' for m in _MEASURES)}, batch int"


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def history_rows(
    history: DataFrame,
    path: str = "file_path",
    ts: str = "timestamp",
    email: str = "author_email",
    name: str = "author_name",
    insertions: str = "insertions",
    deletions: str = "deletions",
    bug_like: Column | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """History as narrow rows, with the columns ``carry`` besides; those with no path or time are left out."""
    author = F.coalesce(F.nullif(F.col(email), F.lit("")), F.nullif(F.col(name), F.lit("")))
    flag = is_fix_like(F.col("message")) if bug_like is None else bug_like
    return history.filter((F.col(path) != "") & F.col(ts).isNotNull()).select(
        F.col(path).alias("path"),
        _micros(F.col(ts)).alias("us"),
        author.alias("author"),
        F.lit(1).cast("bigint").alias("commits"),
        flag.cast("bigint").alias("fixes"),
        F.coalesce(F.col(insertions), F.lit(0)).cast("bigint").alias("plus"),
        F.coalesce(F.col(deletions), F.lit(0)).cast("bigint").alias("minus"),
        *(carry or []),
    )


def asof_features(history: DataFrame, probes: DataFrame | None, bucket_days: int = 30) -> DataFrame:
    """History features for each distinct (path, us) of ``probes``.

    ``history`` comes from :func:`history_rows`; only rows strictly before the
    probe count. Without ``probes`` the history rows ask about themselves, which
    saves one branch of the plan. Work is bounded per task even if one path holds most rows:

    1. All measures are additive per (path, time), distinct authors too once
       each author counts only at its first time on the path. So one combined
       aggregate leaves a single row per path and instant.
    2. Time is cut into buckets. A window runs over one (path, bucket) only,
       and a second one over the bucket totals of a path.

    The narrow rows and the instants are each stored once: three and two later
    steps read them.
    """
    history = stored(history, "history")
    first_seen = _author_rows(history.filter(F.col("author").isNotNull()).groupBy("path", "author").agg(F.min("us").alias("us")), 1)
    rows = history.select("path", "us", *_MEASURES[:4], F.lit(0).cast("bigint").alias("authors"), F.lit(probes is None).alias("asked"))
    return _features_at(rows.unionByName(first_seen.withColumn("asked", F.lit(False))), probes, bucket_days)


def _author_rows(instants: DataFrame, n: int) -> DataFrame:
    """``n`` authors at each (path, us), and nothing else."""
    return instants.select("path", "us", *[F.lit(n if m == "authors" else 0).cast("bigint").alias(m) for m in _MEASURES])


def _features_at(rows: DataFrame, probes: DataFrame | None, bucket_days: int) -> DataFrame:
    """Features of the probes, and of rows that ask themselves, from additive rows (path, us, measures, asked)."""
    if probes is not None:
        rows = rows.unionByName(_author_rows(probes, 0).withColumn("asked", F.lit(True)))
    instants = stored(
        rows.groupBy("path", "us")
        .agg(*[F.sum(m).alias(m) for m in _MEASURES], F.bool_or("asked").alias("asked"))
        .withColumn("bucket", F.floor(F.col("us") / F.lit(bucket_days * DAY_US))),
        "instants",
    )
    changed_at = F.when(F.col("commits") > 0, F.col("us"))
    strictly_before = (Window.unboundedPreceding, -1)

    def running(window, columns: list[str]) -> list[Column]:
        return [F.sum(c).over(window).alias(f"{c}_before") for c in columns] + [F.max("last").over(window).alias("last_before")]

    inside = Window.partitionBy("path", "bucket").orderBy("us").rowsBetween(*strictly_before)
    local = (
        instants.withColumn("last", changed_at)
        .repartition("path", "bucket")
        .select("path", "bucket", "us", "asked", *running(inside, _MEASURES))
        .filter("asked")
    )
    across = Window.partitionBy("path").orderBy("bucket").rowsBetween(*strictly_before)
    totals = (
        instants.withColumn("last", changed_at)
        .groupBy("path", "bucket")
        .agg(*[F.sum(m).alias(m) for m in _MEASURES], F.max("last").alias("last"), F.bool_or("asked").alias("asked"))
        .select("path", "bucket", "asked", *running(across, _MEASURES))
        .filter("asked")
        .drop("asked")
        .withColumnsRenamed({f"{c}_before": f"{c}_carried" for c in [*_MEASURES, "last"]})
    )
    joined = local.join(totals, ["path", "bucket"])

    def total(m: str) -> Column:
        return F.coalesce(F.col(f"{m}_before"), F.lit(0)) + F.coalesce(F.col(f"{m}_carried"), F.lit(0))

    # A later bucket always holds later instants, so the local one comes first.
    last = F.coalesce("last_before", "last_carried")
    return joined.select("path", "us", last.alias("last"), *[total(m).alias(m) for m in _MEASURES]).select("path", "us", *feature_columns())


def feature_columns() -> list[Column]:
    """The nine features from the totals before an instant ``us``; ``last`` is the latest earlier change, if any."""
    return [
        F.col("commits").alias("prior_commit_count"),
        F.col("fixes").alias("prior_bug_fix_count"),
        F.col("plus").alias("prior_total_insertions"),
        F.col("minus").alias("prior_total_deletions"),
        (F.col("plus") + F.col("minus")).alias("prior_total_churn"),
        F.col("authors").alias("prior_unique_authors"),
        F.coalesce(F.expr(f"(us - last) div {DAY_US}"), F.lit(-1)).cast("bigint").alias("days_since_last_change"),
        _ratio("fixes").alias("historical_bug_fix_ratio"),
        _ratio("plus + minus").alias("average_prior_churn"),
    ]


def _ratio(sum_expr: str) -> Column:
    return F.coalesce(F.round(F.expr(f"try_divide(cast({sum_expr} as double), cast(commits as double))"), 6), F.lit(0.0))


def defaults() -> dict[str, Column]:
    """Features of a record whose path has no earlier change."""
    values: dict[str, Column] = {}
    for name in rules.HISTORY_FEATURES:
        if name == "days_since_last_change":
            values[name] = F.lit(-1).cast("bigint")
        elif name in ("historical_bug_fix_ratio", "average_prior_churn"):
            values[name] = F.lit(0.0)
        else:
            values[name] = F.lit(0).cast("bigint")
    return values


def enrich(
    dataset: DataFrame,
    history: DataFrame,
    path: str = "file_path",
    ts: str = "timestamp",
    out: str = "historical_features",
    bucket_days: int = 30,
    same_rows: bool = False,
) -> DataFrame:
    """``dataset`` with a struct of history features.

    Records with no time are dropped; records with no path, and paths with no
    earlier change, get the defaults. ``history`` comes from :func:`history_rows`;
    say ``same_rows`` if it was made from the dataset itself.
    """
    timed = dataset.filter(F.col(ts).isNotNull()).withColumn("us", _micros(F.col(ts)))
    probes = None if same_rows else timed.filter(F.col(path) != "").select(F.col(path).alias("path"), "us")
    found = asof_features(history, probes, bucket_days).withColumnRenamed("us", "probe_us")
    condition = (F.col(path) == F.col("path")) & (F.col("us") == F.col("probe_us"))
    features = F.struct(*[F.coalesce(F.col(n), d).alias(n) for n, d in defaults().items()])
    return (
        timed.join(found, condition, "left")
        .withColumn(out, features)
        .drop("us", "probe_us", "path", *rules.HISTORY_FEATURES)
    )


@dataclass(frozen=True)
class KeptHistory:
    """Additive history of all paths under a folder, to which batches of new rows are added.

    Every batch leaves two tables: the measures it adds per (path, instant), and
    the first time of each of its authors on a path. An author whose first time
    moves back takes its count along: one more at the new instant, one less at
    the old. So late batches need no rewrite, reading sums what all batches left,
    and :meth:`compact` folds them into one.
    """

    path: str

    def add(self, rows: DataFrame, batch: int) -> None:
        """Add rows of :func:`history_rows`; a batch that comes again replaces what it left the first time.

        Batches are numbered from 1 in the order in which they are added; only
        the last one may come again, as later corrections build on earlier ones.
        """
        spark = rows.sparkSession
        rows = stored(rows, "batch")
        first = rows.filter(F.col("author").isNotNull()).groupBy("path", "author").agg(F.min("us").alias("us"))
        known = self._read(spark, "authors", "path string, author string, us bigint, batch int")
        before = known.filter(F.col("batch") < batch).groupBy("path", "author").agg(F.min("us").alias("known_us"))
        earlier = stored(first.join(before, ["path", "author"], "left").filter("known_us is null or us < known_us"), "authors")
        gone = _author_rows(earlier.filter("known_us is not null").select("path", F.col("known_us").alias("us")), -1)
        added = rows.select("path", "us", *_MEASURES[:4], F.lit(0).cast("bigint").alias("authors"))
        summed = added.unionByName(_author_rows(earlier, 1)).unionByName(gone).groupBy("path", "us").agg(*[F.sum(m).alias(m) for m in _MEASURES])
        earlier.select("path", "author", "us").write.mode("overwrite").parquet(f"{self.path}/authors/batch={batch}")
        summed.write.mode("overwrite").parquet(f"{self.path}/measures/batch={batch}")

    def _read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def features(self, probes: DataFrame, bucket_days: int = 30) -> DataFrame:
        """The features of :func:`asof_features` for (path, us) of ``probes``, over all batches so far."""
        kept = self._read(probes.sparkSession, "measures", _KEPT)
        return _features_at(kept.drop("batch").withColumn("asked", F.lit(False)), probes, bucket_days)

    def compact(self, spark: SparkSession, path: str) -> KeptHistory:
        """The same history under another folder, in one batch with number 0."""
        kept = self._read(spark, "measures", _KEPT).groupBy("path", "us").agg(*[F.sum(m).alias(m) for m in _MEASURES])
        kept.write.mode("overwrite").parquet(f"{path}/measures/batch=0")
        authors = self._read(spark, "authors", "path string, author string, us bigint, batch int")
        authors.groupBy("path", "author").agg(F.min("us").alias("us")).write.mode("overwrite").parquet(f"{path}/authors/batch=0")
        return KeptHistory(path)
