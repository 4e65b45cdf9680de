"""Fixed-length token sequences from an array of token ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _padded(ids: Column, max_length: int, pad: int) -> Column:
    missing = F.lit(max_length) - F.size(ids)
    return F.struct(
        F.concat(ids, F.array_repeat(F.lit(pad), missing)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), missing)).alias("attention_mask"),
    )


def head_and_tail(ids: Column, max_length: int, bos: int = 2, eos: int = 3, pad: int = 0) -> Column:
    """Begin and end marks around the ids; an over-long content keeps both its ends."""
    content = F.coalesce(ids, F.array().cast("array<int>"))
    room = max_length - 2
    head, tail = room // 2, room - room // 2
    kept = F.when(F.size(content) <= room, content).otherwise(
        F.concat(F.slice(content, 1, head), F.slice(content, F.size(content) - (tail - 1), F.lit(tail)))
    )
    return _padded(F.concat(F.array(F.lit(bos)), kept, F.array(F.lit(eos))), max_length, pad)


def head_only(ids: Column, max_length: int, bos: int = 2, eos: int = 3, pad: int = 0) -> Column:
    """As above, but an over-long content keeps its beginning only."""
    content = F.coalesce(ids, F.array().cast("array<int>"))
    kept = F.slice(content, 1, max_length - 2)
    return _padded(F.concat(F.array(F.lit(bos)), kept, F.array(F.lit(eos))), max_length, pad)
