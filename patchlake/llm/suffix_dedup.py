"""Removal of long repeated byte strings by threshold-bounded interval expansion.

Suffixes are compared in buckets that no repeat can leave. Among the grams of a
window of ``min_bytes`` bytes, the one with the smallest hash is its anchor; equal
windows have equal anchors, so only windows with the same anchor gram can be
equal. Each anchor owns the run of window starts that chose it, and the bytes
these windows cover are its segment. Anchors met once in the corpus need no
further look. Of the others, equal segments become one with a count, and where
all segments of an anchor are equal all of their windows are repeats.

The segments of whole buckets are then joined to one string. Its suffixes are
sorted, the Burrows-Wheeler transform is taken, and intervals of suffixes are
extended backwards breadth-first: round l finds every border between neighbours
whose common prefix is l, in increasing order, and the rounds stop at
``min_bytes``. Where no border was set, neighbours share ``min_bytes`` or more.

A bucket above ``bucket_bytes`` is halved by context until it is small: windows
that start in one half of the offsets around the anchor all contain the same
bytes, so those bytes are a finer key, and segments cut down to the half
coincide more often. No bucket is capped or sampled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from patchlake.llm.common import discard, keep, prefix_sums, slices, span_hashes

GRAM = 100
BUCKET_BYTES = 128 << 10
CHUNK_BYTES = 1 << 20
_BLOCK = 1 << 20
_PLACE_BITS = np.uint64(24)
_PLACE = np.uint64((1 << 24) - 1)
_ROW_BITS = 38
# Symbols that one sort key of 63 bits holds: bytes and the separator, nine bits each.
_PACKED = 7


def anchors(text: bytes, min_bytes: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first owned start, last owned start) of every anchor of a text."""
    wide = min_bytes - gram + 1
    found = []
    for begin in range(0, len(text) - min_bytes + 1, _BLOCK):
        data = np.frombuffer(text, dtype=np.uint8)[begin : begin + _BLOCK + min_bytes - 1]
        count = len(data) - gram + 1
        starts = np.arange(count)
        hashes = span_hashes(prefix_sums(data), starts, starts + gram)
        # Leftmost of the smallest: the place breaks ties.
        keys = (hashes & ~_PLACE) | starts.astype(np.uint64)
        padded = np.full(-(-count // wide) * wide, np.uint64(2**64 - 1), dtype=np.uint64)
        padded[:count] = keys
        blocks = padded.reshape(-1, wide)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = count - wide + 1
        place = (np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows]) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        last = np.append(first[1:], windows) - 1
        chosen = place[first]
        found.append((hashes[chosen].view(np.int64), chosen + begin, first + begin, last + begin))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))  # type: ignore[return-value]
    return tuple(np.concatenate(part) for part in zip(*found))  # type: ignore[return-value]


_ANCHORS_DDL = (
    "rid bigint, doc_id bigint, n_bytes bigint, text_sha256 string, text binary,"
    " key array<bigint>, place array<int>, first array<int>, last array<int>"
)


def _anchor_rows(min_bytes: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << _ROW_BITS
        for batch in slices(batches):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            parts = [anchors(t, min_bytes, gram) for t in texts]
            ends = pa.array(np.concatenate(([0], np.cumsum([len(p[0]) for p in parts]))).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate([p[i] for p in parts]).astype(kind)))
                for i, kind in enumerate((np.int64, np.int32, np.int32, np.int32))
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(rid, rid + len(texts))),
                    batch.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    pa.array(texts, pa.binary()),
                    *lists,
                ],
                names=["rid", "doc_id", "n_bytes", "text_sha256", "text", "key", "place", "first", "last"],
            )
            rid += len(texts)

    return run


def sorted_suffixes(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array by the first ``depth`` symbols, rank of every suffix by its first 7 symbols)."""
    n = len(symbols)
    padded = np.concatenate((symbols, np.zeros(_PACKED, dtype=np.int64)))
    key = np.zeros(n, dtype=np.int64)
    for k in range(_PACKED):
        key = (key << 9) | padded[k : k + n]
    short = None
    sorted_to = _PACKED
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        ranks = np.cumsum(np.concatenate(([0], (ordered[1:] != ordered[:-1]).astype(np.int64))))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = ranks
        if short is None:
            short = rank
        if sorted_to >= depth or ranks[-1] == n - 1:
            return order, short
        behind = np.full(n, -1, dtype=np.int64)
        behind[: max(0, n - sorted_to)] = rank[sorted_to:]
        key = rank * (n + 1) + behind + 1
        sorted_to *= 2


def long_borders(symbols: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, border): border[i] tells whether suffixes i - 1 and i share fewer than ``threshold`` symbols.

    Every interval of suffixes that start with one string w is extended backwards
    to those that start with cw. An interval that closes at a place without a
    border sets it (the common prefix there is the length of w) and goes on; one
    that closes at a known border ends. The first seven rounds are read off the
    packed keys.
    """
    n = len(symbols)
    order, short = sorted_suffixes(symbols, threshold)
    last = symbols[order - 1]
    front = symbols[order]
    by_last = np.argsort(last, kind="stable")
    step = np.empty(n, dtype=np.int64)
    step[by_last] = np.arange(n)
    border = np.ones(n + 1, dtype=bool)
    ranks = short[order]
    border[1:n] = ranks[1:] != ranks[:-1]
    low = np.flatnonzero(border[:n])
    high = np.append(low[1:], n)
    for _ in range(_PACKED, threshold):
        if len(low) == 0:
            break
        sizes = high - low
        owner = np.repeat(np.arange(len(low)), sizes)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        to = np.sort(owner * (n + 1) + step[low[owner] + inside])
        owner, to = to // (n + 1), to % (n + 1)
        # Rows of one interval with one symbol in front stay together.
        new = np.ones(len(to), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (to[1:] != to[:-1] + 1) | (front[to[1:]] != front[to[:-1]])
        first = np.flatnonzero(new)
        low = to[first]
        high = to[np.append(first[1:], len(to)) - 1] + 1
        fresh = ~border[high]
        low, high = low[fresh], high[fresh]
        border[high] = True
    return order, border[:n]


def repeated_starts(segments: list[bytes], copies: list[int], min_bytes: int) -> list[np.ndarray]:
    """For each segment, which of its windows (all starts that leave ``min_bytes``) occur more than once."""
    sizes = np.array([len(s) for s in segments])
    begins = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int(sizes.sum()) + len(segments), dtype=np.int64)
    for begin, segment in zip(begins, segments):
        symbols[begin : begin + len(segment)] = np.frombuffer(segment, dtype=np.uint8).astype(np.int64) + 1
    order, border = long_borders(symbols, min_bytes)
    place = np.empty(len(symbols), dtype=np.int64)
    place[order] = np.cumsum(border)
    counts = sizes - min_bytes + 1
    owner = np.repeat(np.arange(len(segments)), counts)
    own = place[np.repeat(begins, counts) + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)]
    total = np.bincount(own, weights=np.asarray(copies, dtype=np.float64)[owner])
    return np.split(total[own] > 1, np.cumsum(counts)[:-1])


def _runs(hit: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last place of every run of true values."""
    edges = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) - 1).tolist()


_FOUND_DDL = "key bigint, digest binary, first array<int>, last array<int>"


def _expand(min_bytes: int):
    """Whole buckets (rows sorted by key) gathered into chunks, each searched at once."""

    def search(rows: list[tuple]) -> pa.RecordBatch:
        hits = repeated_starts([r[2] for r in rows], [r[3] for r in rows], min_bytes)
        out = [(r[0], r[1], *_runs(h)) for r, h in zip(rows, hits) if h.any()]
        columns = list(zip(*out)) or [[], [], [], []]
        kinds = (pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "digest", "first", "last"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= CHUNK_BYTES and row[0] != held[-1][0]:
                    yield search(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield search(held)

    return run


def _cut_out(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for rid, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                spans: list[list[int]] = []
                for start, end in sorted(zip(starts, ends)):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                bounds = [0, *(x for span in spans for x in span), len(text)]
                left = b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
                out.append(
                    (rid, len(text) - len(left), [{"start": s, "end": e} for s, e in spans], hashlib.sha256(left).hexdigest(), left if with_text else None)
                )
            columns = list(zip(*out)) or [[], [], [], [], []]
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            kinds = (pa.int64(), pa.int64(), span, pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["rid", "n_removed", "spans", "kept_sha256", "kept_text"]
            )

    return run


def _split(live: DataFrame, min_bytes: int) -> DataFrame:
    """Both halves of the rows of large buckets, with the finer key and the cut segment."""
    middle = F.expr("u0 + (u1 - u0) div 2")
    halves = F.array(
        F.struct(F.lit(0).alias("half"), F.col("u0").alias("h0"), middle.alias("h1")),
        F.struct(F.lit(1).alias("half"), (middle + 1).alias("h0"), F.col("u1").alias("h1")),
    )
    cut = live.withColumn("h", F.explode(halves)).select("*", "h.half", "h.h0", "h.h1")
    cut = cut.withColumn("p0", F.greatest("own0", "h0")).withColumn("p1", F.least("own1", "h1")).where("p0 <= p1")
    core = F.substring("segment", F.col("h1") - F.col("own0") + 1, F.col("h0") + min_bytes - F.col("h1"))
    piece = F.substring("segment", F.col("p0") - F.col("own0") + 1, F.col("p1") - F.col("p0") + min_bytes)
    return cut.select(
        F.col("key").alias("old_key"),
        F.col("digest").alias("old_digest"),
        (F.col("p0") - F.col("own0")).alias("shift"),
        F.xxhash64("key", "half", core).alias("key"),
        F.unhex(F.md5(piece)).alias("digest"),
        "copies",
        piece.alias("segment"),
        F.col("p0").alias("own0"),
        F.col("p1").alias("own1"),
        F.col("h0").alias("u0"),
        F.col("h1").alias("u1"),
    )


def _distinct(rows: DataFrame) -> DataFrame:
    """One row per (key, digest); copies add up."""
    return rows.groupBy("key", "digest").agg(
        F.sum("copies").alias("copies"), *(F.first(c).alias(c) for c in ("segment", "own0", "own1", "u0", "u1"))
    )


def remove_repeats(
    docs: DataFrame,
    min_bytes: int = 400,
    doc_id: str = "doc_id",
    text: str = "text",
    gram: int = GRAM,
    bucket_bytes: int = BUCKET_BYTES,
    with_text: bool = False,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256, kept_text) for every row, repeated ones too.

    A byte goes if a string of ``min_bytes`` bytes that covers it also starts at any
    other place, in the same text or another. Texts are UTF-8 bytes; null is
    empty. ``spans`` are the maximal removed runs (null if none), ``kept_text``
    the rest where ``with_text`` asks for it and something was removed. Segments
    are told apart by an MD5 digest; everything else compares bytes.
    """
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    base = keep(source.mapInArrow(_anchor_rows(min_bytes, gram), _ANCHORS_DDL), "anchors", "zstd")
    repeated = keep(
        base.select(F.explode("key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"),
        "repeated",
    )
    listed = base.select("rid", F.explode(F.arrays_zip("key", "place", "first", "last")).alias("x")).select("rid", "x.*")
    chosen = (
        listed.join(repeated, "key").groupBy("rid").agg(F.collect_list(F.struct("key", "place", "first", "last")).alias("chosen"))
    )
    texts = keep(base.select("rid", "text").join(keep(chosen, "chosen"), "rid"), "texts", "zstd")
    rows = keep(base.select("rid", "doc_id", "n_bytes", "text_sha256"), "rows")
    discard(base)
    segment = F.substring("text", F.col("x.first") + 1, F.col("x.last") - F.col("x.first") + min_bytes)
    places = keep(
        texts.select("rid", "text", F.explode("chosen").alias("x")).select(
            "rid",
            "x.key",
            F.unhex(F.md5(segment)).alias("digest"),
            "x.first",
            "x.last",
            (F.col("x.first") - F.col("x.place")).alias("own0"),
        ),
        "places",
    )
    # One place stands for all copies of a segment; only buckets with different segments need their bytes.
    kinds = keep(
        places.groupBy("key", "digest").agg(
            F.count(F.lit(1)).alias("copies"), F.min(F.struct("rid", "first", "last", "own0")).alias("x")
        ),
        "kinds",
    )
    mixed = keep(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "mixed")
    whole = kinds.join(mixed, "key", "left_anti").where("copies > 1")
    found: DataFrame = whole.select(
        "key", "digest", F.array(F.lit(0)).alias("first"), F.array(F.col("x.last") - F.col("x.first")).alias("last")
    )
    wanted = kinds.join(mixed, "key").select("x.rid", F.struct("key", "digest", "copies", "x.first", "x.last", "x.own0").alias("x"))
    wanted = keep(wanted.groupBy("rid").agg(F.collect_list("x").alias("wanted")), "wanted")
    live = keep(
        texts.select("rid", "text").join(wanted, "rid").select("text", F.explode("wanted").alias("x")).select(
            "x.key", "x.digest", "x.copies", segment.alias("segment"), "x.own0",
            (F.col("x.own0") + F.col("x.last") - F.col("x.first")).alias("own1"),
            F.lit(gram - min_bytes).alias("u0"), F.lit(0).alias("u1"),
        ),
        "segments",
        "zstd",
    )
    pieces: DataFrame | None = None
    while True:
        buckets = keep(
            live.groupBy("key")
            .agg(
                F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("all"), F.sum(F.length("segment")).alias("bytes"),
                F.max(F.col("u1") - F.col("u0")).alias("width"),
            )
            .where("all > 1"),
            "buckets",
        )
        large = (F.col("bytes") > bucket_bytes) & (F.col("width") > 0) & (F.col("kinds") > 1)
        small = live.join(buckets.where(~large).select("key", "kinds"), "key")
        alone = small.where("kinds = 1").select(
            "key", "digest", F.array(F.lit(0)).alias("first"), F.array(F.col("own1") - F.col("own0")).alias("last")
        )
        together = (
            small.where("kinds > 1").select("key", "digest", "segment", "copies").repartition("key").sortWithinPartitions("key")
        )
        results = keep(alone.unionByName(together.mapInArrow(_expand(min_bytes), _FOUND_DDL)), "found")
        if pieces is not None:
            results = pieces.join(results, ["key", "digest"]).select(
                F.col("root_key").alias("key"), F.col("root_digest").alias("digest"),
                F.transform("first", lambda x: x + F.col("shift")).alias("first"),
                F.transform("last", lambda x: x + F.col("shift")).alias("last"),
            )
        found = found.unionByName(results)
        more = buckets.where(large).select("key")
        if more.isEmpty():
            break
        halves = keep(_split(live.join(more, "key"), min_bytes), "halves", "zstd")
        steps = halves.select("old_key", "old_digest", "shift", "key", "digest")
        if pieces is None:
            pieces = steps.withColumnsRenamed({"old_key": "root_key", "old_digest": "root_digest"})
        else:
            before = pieces.select("root_key", "root_digest", F.col("shift").alias("base"), F.col("key").alias("old_key"), F.col("digest").alias("old_digest"))
            pieces = keep(
                before.join(steps, ["old_key", "old_digest"]).select(
                    "root_key", "root_digest", (F.col("base") + F.col("shift")).alias("shift"), "key", "digest"
                ),
                "pieces",
            )
        live = keep(_distinct(halves), "segments", "zstd")
    runs = (
        places.select("rid", "key", "digest", F.col("first").alias("at"))
        .join(keep(found, "found"), ["key", "digest"])
        .select("rid", "at", F.explode(F.arrays_zip("first", "last")).alias("x"))
        .select("rid", (F.col("at") + F.col("x.first")).alias("start"), (F.col("at") + F.col("x.last") + min_bytes).alias("end"))
    )
    spans = keep(runs.groupBy("rid").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends")), "runs")
    span = "array<struct<start:int,end:int>>"
    cut = (
        texts.select("rid", "text")
        .join(spans, "rid")
        .mapInArrow(_cut_out(with_text), f"rid bigint, n_removed bigint, spans {span}, kept_sha256 string, kept_text binary")
    )
    return (
        rows.join(keep(cut, "cut", "zstd"), "rid", "left")
        .select(
            "doc_id",
            "n_bytes",
            F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
            "spans",
            F.coalesce("kept_sha256", "text_sha256").alias("kept_sha256"),
            "kept_text",
        )
    )
