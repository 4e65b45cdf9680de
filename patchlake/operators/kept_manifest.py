"""The manifest as a stored table: numbered versions of Parquet, each written once.

A writer stores its rows beside the table and then renames the folder to the
next number. The rename fails if another writer was there first, so of two
writers that started from one version exactly one wins; readers see whole
versions only. This needs a file system whose rename is atomic (HDFS and local
disks are; plain object stores are not).

Changes are functions of the version they start from and leave alone what they
have already done: an addition skips known ids, an event is remembered by its
time, a note is not repeated. A repeated batch gives equal rows, and equal rows
make no version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from patchlake.operators import manifest as steps

_NAME = "v{:010d}"


class Conflict(RuntimeError):
    """Another writer has made the version that this one wanted to make."""


def _remembered(rows: DataFrame) -> DataFrame:
    """The events that a manifest still shows: the latest one, and the latest completion if it is another."""
    done = F.col("last_collected_at")
    event = (
        F.when(F.col("collection_status") == "collecting", "started")
        .when(F.col("collection_status") == "complete", "complete")
        .otherwise("failed")
    )
    completion = F.struct(
        done.alias("at"), F.lit("complete").alias("event"), F.lit(None).cast("string").alias("error"), *steps.COUNTERS
    )
    latest = F.struct(
        F.col("status_at").alias("at"), event.alias("event"), F.col("collection_error").alias("error"),
        *[F.lit(None).cast("bigint").alias(c) for c in steps.COUNTERS],
    )
    both = F.array(F.when(done.isNotNull(), completion), F.when(~F.col("status_at").eqNullSafe(done), latest))
    return rows.where("status_at is not null").select("repo_id", F.inline(F.filter(both, lambda e: e.isNotNull())))


def merge_events(rows: DataFrame, events: DataFrame) -> DataFrame:
    """:func:`manifest.apply_events` on top of all batches merged before, in whatever order they come.

    ``rows`` has status_at, the time of the event that gave the status. A repository has one
    event at a time; events without a time or an id change nothing. Only the latest event and the latest completion
    of each repository go on, so a repository with most of the events is reduced before the shuffle.
    """
    fields = ["at", "event", "error", *steps.COUNTERS]
    whole = F.struct(*fields)
    condensed = (
        events.where("repo_id is not null and at is not null")
        .groupBy("repo_id")
        .agg(F.max_by(whole, "at").alias("latest"), F.max_by(whole, F.when(F.col("event") == "complete", F.col("at"))).alias("done"))
        # An only event that is no completion gives the latest one alone; array_distinct joins the two if they are one.
        .select("repo_id", F.inline(F.array_distinct(F.filter(F.array("latest", "done"), lambda e: e.isNotNull()))))
    )
    kinds = {f.name: f.dataType for f in rows.schema if f.name in steps.COUNTERS}
    typed = condensed.select("repo_id", "at", "event", F.col("error").cast("string").alias("error"), *[F.col(c).cast(kinds[c]).alias(c) for c in steps.COUNTERS])
    known = _remembered(rows).unionByName(typed)
    times = known.groupBy("repo_id").agg(F.max("at").alias("__at"))
    merged = steps.apply_events(rows, known).join(times, "repo_id", "left")
    return merged.withColumn("status_at", F.coalesce("__at", "status_at")).drop("__at").select(*rows.columns)


class KeptManifest:
    """A manifest under ``path``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._root = self._hadoop.Path(self.path)
        self._files = self._root.getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Numbers of the versions that are there, ascending."""
        if not self._files.exists(self._root):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(self._root)]
        return sorted(int(name[1:]) for name in names if name[0] == "v" and name[1:].isdigit())

    def version(self) -> int:
        """The latest version; 0 for a table without any."""
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default."""
        return self.spark.read.parquet(f"{self.path}/{_NAME.format(version or self.version())}")

    def create(self, rows: DataFrame) -> int:
        """The first version, from full manifest rows; raises :class:`Conflict` if there is one."""
        return self.commit(rows.withColumn("status_at", F.lit(None).cast("timestamp")), 0)

    def commit(self, rows: DataFrame, base: int) -> int:
        """``rows`` as the version behind ``base``; ``base`` itself if they are the same rows.

        Raises :class:`Conflict`, and leaves the table alone, if that version has been made meanwhile.
        """
        attempt = self._hadoop.Path(f"{self.path}/_attempt-{uuid.uuid4().hex}")
        try:
            rows.write.parquet(attempt.toString())
            if base and self._same(self.read(base), self.spark.read.parquet(attempt.toString())):
                return base
            if self.version() != base:
                raise Conflict(f"version {base + 1} of {self.path} has been made by another writer")
            context = self._hadoop.FileContext.getFileContext(self._root.toUri(), self._conf)
            no_overwrite = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
            target = self._hadoop.Path(f"{self.path}/{_NAME.format(base + 1)}")
            try:
                context.rename(attempt, target, no_overwrite)
            except Py4JJavaError as error:
                if self._files.exists(target):
                    raise Conflict(f"version {base + 1} of {self.path} has been made by another writer") from error
                raise
            return base + 1
        finally:
            self._files.delete(attempt, True)

    @staticmethod
    def _same(old: DataFrame, new: DataFrame) -> bool:
        if sorted(old.columns) != sorted(new.columns):
            return False
        left = old.select(F.col("repo_id").alias("__id"), F.struct(*old.columns).alias("__old"))
        right = new.select("repo_id", F.struct(*old.columns).alias("__new"))
        joined = left.join(right, F.col("__id").eqNullSafe(F.col("repo_id")), "full")
        return joined.where(~F.col("__old").eqNullSafe(F.col("__new"))).isEmpty()

    def change(self, step: Callable[[DataFrame], DataFrame], attempts: int = 5) -> int:
        """``step`` applied to the latest version; done anew from the winner's version when another writer was first."""
        for attempt in range(attempts):
            base = self.version()
            try:
                return self.commit(step(self.read(base)), base)
            except Conflict:
                if attempt == attempts - 1:
                    raise
        raise ValueError("attempts must be positive")

    def add(self, rows: DataFrame) -> int:
        """Insert-if-absent of full manifest rows with unique ids."""
        return self.change(lambda kept: steps.add_missing(kept, rows).select(*kept.columns))

    def update(self, changes: DataFrame) -> int:
        """Update by key."""
        return self.change(lambda kept: steps.update(kept, changes).select(*kept.columns))

    def apply(self, events: DataFrame) -> int:
        """A batch of collection events, late ones too."""
        return self.change(lambda kept: merge_events(kept, events))

    def record(self, judged: DataFrame) -> int:
        """Quality status and notes."""
        return self.change(lambda kept: steps.record_verdicts(kept, judged).select(*kept.columns))

    def prune(self, keep: int = 2) -> int:
        """Delete all but the latest ``keep`` versions, for the owner to call when nobody reads them; their number."""
        gone = self.versions()[: -max(keep, 1)]
        for version in gone:
            self._files.delete(self._hadoop.Path(f"{self.path}/{_NAME.format(version)}"), True)
        return len(gone)
