"""Pre-tokens of patches: their counts over a corpus, and subword ids by a given vocabulary."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from patchlake import rules
from patchlake.operators.tfidf import slices


def training_text(df: DataFrame, patch: str = "patch") -> DataFrame:
    """Patches without outer whitespace; blank ones are left out."""
    text = F.regexp_replace(F.coalesce(patch, F.lit("")), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    return df.select(text.alias("text")).filter("text != ''")


def pre_tokens(text: Column) -> Column:
    """Words, numbers and runs of signs, each with one leading space; runs of whitespace."""
    return F.regexp_extract_all(text, F.lit("(?U)" + rules.PRE_TOKEN_PATTERN), F.lit(0))


def pre_token_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Distinct pre-tokens with their counts: the one step over the whole corpus."""
    return (
        texts.select(F.explode(pre_tokens(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@functools.cache
def _library(path: str):
    """The vocabulary file as the library reads it, once per worker."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return library


def _encode(lists: pa.Array, tokenizer: str) -> pa.Array:
    """Subword ids of lists of pre-tokens; each distinct one is encoded once, the library never sees a whole patch."""
    encoded = pc.dictionary_encode(lists.flatten())
    found = _library(tokenizer).encode_batch(encoded.dictionary.to_pylist(), add_special_tokens=False)
    each = pa.array([e.ids for e in found], pa.list_(pa.int32())).take(encoded.indices)
    lengths = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (lists, each)]
    words, ids = (np.concatenate(([0], np.cumsum(n))) for n in lengths)
    return pa.ListArray.from_arrays(pa.array(ids[words].astype(np.int32)), each.flatten())


def subword_ids(df: DataFrame, tokenizer: str, doc_id: str = "record_id", text: str = "patch") -> DataFrame:
    """(doc_id, ids): the subword ids of every text by a byte-level vocabulary file that splits texts as :func:`pre_tokens` does.

    Texts are dealt out by document and encoded where they are, a slice at a time,
    each distinct pre-token of a slice once; no pre-token moves. Strings of special
    tokens are ordinary text; a null or empty text has no ids.
    """

    @F.arrow_udf(returnType="array<int>")
    def ids(lists: pa.Array) -> pa.Array:
        return pa.concat_arrays([_encode(part, tokenizer) for part in slices(lists)])

    dealt = df.select(doc_id, F.coalesce(text, F.lit("")).alias("text")).repartition(doc_id)
    return dealt.select(doc_id, ids(pre_tokens(F.col("text"))).alias("ids"))
