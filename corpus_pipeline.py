"""A training-data pipeline over ``documents``: five stages, each an operator of ``patchlake.llm``.

Every stage takes all documents that its predecessor kept, as a table with the
columns of ``documents`` (others are carried along), and returns such a table;
the last returns the encoded documents. Between stages the documents are
written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from patchlake.llm import bpe_codec, exact_dedup, language_id, mixing, ngram_join
from patchlake.llm.common import keep, table
from patchlake.llm.queries import tokenizer

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects: no letters, or a probability below its calibrated threshold."""
    found = language_id.identify(docs, language_id.train(docs), carry=True)
    return found.where(~F.col("__rejected")).drop("__lang_pred", "__score", "__rejected")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle similarity, the one with the smallest doc_id.

    Documents without words stay. Rows that share a doc_id stay or go together:
    they stay if one of them is its group's first.
    """
    found = ngram_join.ngram_join(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    stay = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("__stay"))
    # What stays grows with the input, so it is never broadcast; the same holds for the times below.
    return docs.join(keep(stay, "stay").hint("merge"), F.col("doc_id").eqNullSafe(F.col("__stay")), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes its words, to the nearest whole number (0 to 3 times).

    Documents without words are never taken. Rows that share a doc_id are taken
    equally often.
    """
    mixed = mixing.mix(docs).select("doc_id", F.expr("if(size = 0, 0, (2 * taken + size) div (2 * size))").alias("times"))
    times = keep(mixed.groupBy(F.col("doc_id").alias("__id")).agg(F.max("times").alias("__times")).where("__times > 0"), "times")
    joined = docs.join(times.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")))
    return joined.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("bigint"), "__times"))).drop("__id", "__times", "__n")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text that they decode to."""
    outputs = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    return bpe_codec.encode_documents(docs, tokenizer("word_bpe_49k.json"), outputs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# The classifier, the similarity join and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, name)
    return docs
