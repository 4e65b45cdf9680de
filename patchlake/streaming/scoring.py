"""Scoring of patches as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from patchlake.functions.numeric import listed_counts, with_patch_numerics
from patchlake.operators.models import decide, label_name
from patchlake.schemas import SCORE_REQUEST
from patchlake.sources.tables import CORRUPT


def read_requests(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of request lines; ``bad`` marks lines that are no request with a patch."""
    schema = type(SCORE_REQUEST)([*SCORE_REQUEST.fields]).add(CORRUPT, "string")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    lines = spark.readStream.text(folder).filter(F.trim("value") != "")
    rows = lines.select("value", parsed.alias("request"))
    bad = F.col("request").isNull() | F.col(f"request.{CORRUPT}").isNotNull() | F.col("request.patch").isNull()
    return rows.withColumn("bad", F.coalesce(bad, F.lit(True)))


def numeric_columns(requests: DataFrame) -> DataFrame:
    """Requests with the fifteen numerics."""
    return with_patch_numerics(
        requests, F.col("patch"), listed_counts(F.col("changed_files")), F.col("added_line_count"), F.col("removed_line_count"),
        F.col("diff_stats.added_lines"), F.col("diff_stats.deleted_lines"), F.col("diff_stats.files_changed"),
    )


def responses(requests: DataFrame, probability, threshold: float) -> DataFrame:
    """Label and both probabilities for each request; stateless."""
    scored = numeric_columns(requests).withColumn("bug_fix_probability", probability)
    return scored.select(
        "record_id",
        label_name(decide(F.col("bug_fix_probability"), threshold)).alias("prediction"),
        (1.0 - F.col("bug_fix_probability")).alias("non_bug_fix_probability"),
        "bug_fix_probability",
    )


def start_scoring(
    stream: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    output: str,
    rejects: str,
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Good requests through ``score`` to ``output``, bad lines to ``rejects``.

    Each batch goes to a folder of its own that a repeated batch overwrites, so
    a restart after a failure neither loses nor doubles rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            good = batch.filter(~F.col("bad")).select("request.*").drop(CORRUPT)
            score(good).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")
            batch.filter("bad").select("value").write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
