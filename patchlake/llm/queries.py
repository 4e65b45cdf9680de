"""The registered queries of the subpackage: thin views of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from patchlake.llm import (
    bpe_codec,
    centroids,
    embedding_dedup,
    exact_dedup,
    hard_negatives,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    pii,
    sharding,
    suffix_dedup,
    token_counts,
)
from patchlake.llm.common import table

TOKEN_LIMIT = 4096


def tokenizer(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose four-word shingles agree to 85 of 100."""
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), words=4, percent=85)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 400 bytes."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), min_bytes=400)
    n_spans = F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("bigint").alias("n_spans")
    return found.select("doc_id", "n_bytes", "n_removed", n_spans, "kept_sha256")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors of one label with a cosine of 0.98 or more."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; n_* and base_sha256 describe the plain spans, spans all of them."""
    return pii.personal_data(table(spark, sf_dir, "documents")).drop("base")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards under the law ``rows``: counts at most one apart."""
    return sharding.shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_cut"
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece tokens of every document."""
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word BPE ids of every document and what they decode to, as digests."""
    outputs = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return bpe_codec.encode_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), outputs)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that five documents hold."""
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), with_text=False)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh has a wrong label."""
    wrong = F.col("vec_id") % 7 == 0
    label = F.when(wrong, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), anchor=F.col("vec_id") % 50 == 0, label=label)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors after ten rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_pii": op4_pii,
    "op5_sharding": op5_sharding,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_mixing": op9_mixing,
    "op10_language_id": op10_language_id,
    "op11_line_dedup": op11_line_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_centroid_clustering": op13_centroid_clustering,
}
