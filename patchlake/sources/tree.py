"""Source trees on a file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from patchlake.operators.structure import code_files

# A character no file has: a noncharacter between two private ones.
_ASIDE = "\ue000\uffff\ue001"


def scan_tree(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """Source files below ``root`` with language and size, and their bytes if asked for.

    Without ``content`` no file is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString().rstrip("/")
    return below(files.select("path", F.col("length").alias("size_bytes"), *([F.col("content")] if content else [])), base)


def below(files: DataFrame, root: str) -> DataFrame:
    """Source files of a listing (path and more) with their path below the qualified ``root``.

    All paths begin with the root, whatever else they hold: it is cut off by
    length, so a root that occurs again further down does no harm.
    """
    tail = F.substring("path", len(root.rstrip("/")) + 2, 2147483647)
    return code_files(files.withColumn("file_path", tail).drop("path"))


def source_text(files: DataFrame) -> DataFrame:
    """Python files as text; bytes that are not UTF-8 are dropped from it."""
    raw = F.col("content").cast("string")
    # Genuine replacement characters are set aside while those that stand for bad bytes are taken out.
    aside = F.replace(raw, F.lit("\ufffd"), F.lit(_ASIDE))
    mended = F.replace(F.make_valid_utf8(aside), F.lit("\ufffd"), F.lit(""))
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(mended, F.lit(_ASIDE), F.lit("\ufffd")))
    return files.filter("language = 'python'").select("file_path", text.alias("code"))
