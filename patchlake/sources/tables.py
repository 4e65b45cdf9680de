"""JSON Lines, JSON arrays and Parquet, with declared schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType, StructType

from patchlake.session import stored

CORRUPT = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One object per line, blank lines skipped. A line that is not a JSON object fails the read.

    :func:`require_objects` says beforehand which line of which file that is.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_lax(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that could not be read, see :func:`bad_lines`."""
    with_text = StructType([*schema.fields]).add(CORRUPT, StringType())
    rows = spark.read.schema(with_text).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    good = rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, bad_lines(spark, path, schema)


def bad_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(file, line, line_no): lines that are not blank and not objects of the schema, numbered from 1 in their file.

    A file is read in blocks by several tasks. One pass counts the lines of each
    block and keeps its bad ones with their place among the rows of the block,
    which are read in order; the counts of the blocks before give the number in
    the file. Blank lines count. Only bad lines and one row per block move.
    """
    with_text = StructType([*schema.fields]).add(CORRUPT, StringType())
    parsed = F.from_json("value", with_text, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value", parsed.alias("parsed"),
    )
    broken = (F.trim("value") != "") & (F.col("parsed").isNull() | F.col(f"parsed.{CORRUPT}").isNotNull())
    kept = F.collect_list(F.when(broken, F.struct("place", F.col("value").alias("line")))).alias("bad")
    blocks = stored(
        lines.groupBy("file", "block").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("lines"), kept), "blocks"
    )
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("file", "block", F.coalesce(before, F.lit(0)).alias("before"))
    found = blocks.select("file", "block", "first", F.explode("bad").alias("b"))
    number = F.col("before") + F.col("b.place") - F.col("first") + 1
    return found.join(offsets, ["file", "block"]).select("file", F.col("b.line").alias("line"), number.alias("line_no"))


def require_objects(spark: SparkSession, path: str, schema: StructType) -> None:
    """Fail with file and line number if a line is neither blank nor an object of the schema."""
    first = bad_lines(spark, path, schema).orderBy("file", "line_no").first()
    if first is not None:
        raise ValueError(f"{first.file}:{first.line_no}: no object of the schema: {first.line[:200]}")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} holds no records")
    return df


def read_json_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A file with one JSON array of objects; a path that does not exist gives no rows."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def write_jsonl(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """JSON Lines, non-ASCII text as it is and null fields written out."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split."""
    write_jsonl(df, path, [split])


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Prediction records as JSON Lines; see :func:`metrics.prediction_records`."""
    write_jsonl(predictions, path)


def probability_table(predictions: DataFrame, index: str) -> DataFrame:
    """Short form of predictions: row index, actual label and both probabilities."""
    return predictions.select(
        F.col(index).alias("index"),
        F.col("true_label").alias("actual"),
        F.col("probability_non_bug_fix").alias("non_bug_fix_probability"),
        F.col("probability_bug_fix").alias("bug_fix_probability"),
    )
