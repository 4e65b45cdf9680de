"""N-gram Jaccard join with prefix, length, positional and suffix filters.

Every document becomes the set of its word n-grams in one global order, rare
ones first. Two sets that are similar enough share an n-gram among the first
few of both, so only these prefixes are indexed and joined. Sizes and the
positions of the shared n-gram bound the overlap before a pair is made; bitmaps
and the suffix filter bound it again before a pair is counted; each pair is
verified once.

Equal sets are one class from the start. Pairs are made in two steps, so that a
large group of near copies does not become all its pairs: first each document
with the head of each shared n-gram, the document with the fewest rarer n-grams
before it. In a group of variants this is the one nearest to their common
origin, so most of the group meets there. Then all pairs that cross the groups
found so far. A pair inside a group cannot change
the result, any other is verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from patchlake.llm.common import components, discard, keep, mix, prefix_sums, slices, span_hashes

# Document frequencies are counted in so many buckets of hashed n-grams: the order needs to tell common from rare.
BUCKETS = 1 << 18
# The suffix filter halves the remaining sets so many times.
SUFFIX_DEPTH = 4
# Candidate ids are broadcast to the texts up to this many rows of 40 bytes, joined by a shuffle beyond.
BROADCAST_ROWS = 250_000
# Words of 64 bits of the signature that an entry of the crossing join carries: pairs of sets of up to about twice as
# many n-grams as bits are told apart in the join, larger ones by their bitmaps later.
SIGNATURE_WORDS = 8
_AT_BITS = 31
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; with fewer words, of all words as one."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    data = _LOWER[np.frombuffer(text, dtype=np.uint8)]
    inside = np.concatenate(([False], ~_SPACE[data], [False]))
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    hashes = span_hashes(prefix_sums(data), starts, ends)
    n = min(words, len(hashes))
    m = len(hashes) - n + 1
    joined = np.full(m, np.uint64(n), dtype=np.uint64)
    for k in range(n):
        joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + m])
    return np.unique(joined)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def prefix_length(n: int, percent: int) -> int:
    """N-grams of a set of ``n`` of which one must be shared: n - ceil(percent * n / 100) + 1."""
    return n - (percent * n + 99) // 100 + 1


def _count_buckets(words: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(BUCKETS, dtype=np.int64)
        for batch in slices(batches):
            parts = [_bucket(shingles(t, words)) for t in batch.column(0).to_pylist()]
            totals += np.bincount(np.concatenate(parts), minlength=BUCKETS)
        used = np.flatnonzero(totals)
        for start in range(0, len(used), 1 << 16):
            some = used[start : start + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(totals[some])], names=["bucket", "n"])

    return count


def _ordered(hashes: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    """The set in the global order: by frequency of the bucket, then by hash."""
    return hashes[np.lexsort((hashes, frequency[_bucket(hashes)]))]


def signature(hashes: np.ndarray) -> np.ndarray:
    """Parities of the numbers of members in each of ``64 * SIGNATURE_WORDS`` cells.

    A member of one set only flips one bit: the signatures of two sets never
    differ in more bits than the sets differ in members.
    """
    cells = (hashes % np.uint64(64 * SIGNATURE_WORDS)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=64 * SIGNATURE_WORDS) % 2 == 1).view(np.int64)


def _prefixes(words: int, percent: int, shared):
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                found = shingles(text, words)
                digest = hashlib.md5(found.tobytes()).digest() if len(found) else None
                order = _ordered(found, shared.value)[: prefix_length(len(found), percent)] if len(found) else found
                rows.append((len(found), digest, order.view(np.int64), signature(found)))
            n, digest, order, signatures = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.ListArray.from_arrays(
                        pa.array(np.concatenate(([0], np.cumsum([len(o) for o in order]))).astype(np.int32)),
                        pa.array(np.concatenate(order)),
                    ),
                    pa.ListArray.from_arrays(
                        pa.array((np.arange(len(rows) + 1) * SIGNATURE_WORDS).astype(np.int32)), pa.array(np.concatenate(signatures))
                    ),
                ],
                names=["doc_id", "n_shingles", "digest", "prefix", "signature"],
            )

    return prefixes


def bitmap(members: np.ndarray) -> bytes:
    """A bit for every hashed member; its length is a power of two with 8 to 16 bits a member."""
    size = 1 << max(6, int(len(members) * 8 - 1).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[(members % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set at a smaller power of two."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def _bounded(percent: int):
    """Pairs whose bitmaps allow the overlap: every bit that differs stands for a member of one set only."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = []
            for i, (na, nb, a, b) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]))):
                x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
                size = min(len(x), len(y))
                differ = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())
                if differ <= na + nb - 2 * -(-percent * (na + nb) // (100 + percent)):
                    good.append(i)
            if good:
                chosen = batch.take(pa.array(good))
                yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1)], names=["a", "b"])

    return bounded


def _sets(words: int, bits: bool):
    """The set of every candidate text, or its bitmap only, if the text still is what its class says."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = [shingles(t, words) for t in batch.column(2).to_pylist()]
            digests = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in found]
            same = [i for i, (d, want) in enumerate(zip(digests, batch.column(1).to_pylist())) if d == want]
            if same:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(same)),
                        pa.array([len(found[i]) for i in same], pa.int32()),
                        pa.array([bitmap(found[i]) if bits else found[i].tobytes() for i in same], pa.binary()),
                    ],
                    names=["cid", "n", "content"],
                )

    return sets


def _differ_at_least(a: np.ndarray, b: np.ndarray, budget: int, depth: int) -> int:
    """A lower bound of the size of the symmetric difference of two sorted arrays.

    Both are cut at the middle value of one; elements of one half never meet
    those of the other. Stops when the bound exceeds ``budget``.
    """
    gap = abs(len(a) - len(b))
    if depth == 0 or gap > budget or len(a) == 0 or len(b) == 0:
        return gap
    pivot = b[len(b) // 2]
    i, j = int(np.searchsorted(a, pivot)), len(b) // 2
    low_gap, high_gap = abs(i - j), abs((len(a) - i) - (len(b) - j))
    if low_gap + high_gap > budget:
        return low_gap + high_gap
    low = _differ_at_least(a[:i], b[:j], budget - high_gap, depth - 1)
    if low + high_gap > budget:
        return low + high_gap
    return low + _differ_at_least(a[i:], b[j:], budget - low, depth - 1)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|, with the suffix filter first."""
    total = len(a) + len(b)
    # 100 * i >= percent * (total - i) gives the least overlap i, and with it the most elements in only one set.
    least = -(-percent * total // (100 + percent))
    budget = total - 2 * least
    if budget < 0 or _differ_at_least(a, b, budget, SUFFIX_DEPTH) > budget:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= least


def _verify(percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [
                i
                for i, (a, b) in enumerate(zip(left, right))
                if similar(np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64), percent)
            ]
            if good:
                chosen = batch.take(pa.array(good))
                yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1)], names=["a", "b"])

    return verify


def _possible(percent: int, na: Column, nb: Column, ia: Column, ib: Column) -> Column:
    """Length and positional filter for a shared n-gram at positions ia and ib (from 0).

    At the first shared n-gram of a similar pair, it and the rest of the shorter
    remainder must reach the least overlap; a similar pair passes there.
    """
    rest = F.least(na - ia, nb - ib)
    return (
        (F.lit(100) * F.least(na, nb) >= F.lit(percent) * F.greatest(na, nb))
        & (F.lit(100 + percent) * rest >= F.lit(percent) * (na + nb))
    )


def _signed(percent: int) -> Column:
    """Signature filter for the pair (a, b): every bit that differs stands for a member of one set only."""
    differ = sum((F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(SIGNATURE_WORDS)), F.lit(0))
    total = F.col("n_a") + F.col("n_b")
    # With the least overlap i of :func:`similar`, all but 2 * i members may be in one set only.
    return F.lit(100 + percent) * (total - differ) >= F.lit(2 * percent) * total


def _sets_of(classes: DataFrame, pairs: DataFrame, source: DataFrame, words: int, bits: bool) -> DataFrame:
    """(cid, n, content): bitmaps or sets of all classes of ``pairs``, made anew from one text of each.

    Storing the sets of all documents would take more room than their texts; few
    are in a pair that passes the filters.
    """
    chosen = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    wanted = keep(
        classes.join(chosen, "cid", "left_semi").select("cid", F.col("first_id").alias("wanted_id"), "digest"), "candidates"
    )
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    made = (
        source.join(side, F.col("doc_id").eqNullSafe(F.col("wanted_id")))
        .select("cid", "digest", "text")
        .mapInArrow(_sets(words, bits), "cid bigint, n int, content binary")
    )
    return keep(made, "bitmaps" if bits else "sets")


def _beside(pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs with the contents of both ends, and the stored half of the way there."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("content").alias("left"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("content").alias("right"))
    half = keep(pairs.join(left, "a"), "half_pairs")
    return half.join(right, "b").select("a", "b", "na", "nb", "left", "right"), half


def _linked(pairs: DataFrame, classes: DataFrame, source: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar.

    Bitmaps, an eighth of the size of the sets, are made for the classes of all
    pairs; sets only for the classes of pairs that the bitmaps allow.
    """
    bitmaps = _sets_of(classes, pairs, source, words, True)
    both, half = _beside(pairs, bitmaps)
    possible = keep(both.mapInArrow(_bounded(percent), "a bigint, b bigint"), "possible")
    discard(half, bitmaps)
    sets = _sets_of(classes, possible, source, words, False)
    both, half = _beside(possible, sets)
    links = keep(both.select("a", "b", "left", "right").mapInArrow(_verify(percent), "a bigint, b bigint"), "links")
    discard(half, sets)
    return links


def ngram_join(
    docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row, repeated ones too.

    Words are runs of bytes that are no ASCII white space, A-Z in lower case.
    Texts with fewer words than ``words`` are one n-gram of all their words; a
    null text or one without words has an empty set and links with nothing. Two
    rows link when 100 * |intersection| >= percent * |union|; component_id is the
    smallest doc_id reachable over links. Rows with a null doc_id form classes
    like others, but never give the id if another member can.

    The driver sees the bucket counts (a table of fixed size) and one number per
    step.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    counted = source.select("text").mapInArrow(_count_buckets(words), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    frequency = np.zeros(BUCKETS, dtype=np.int64)
    totals = counted.toArrow()
    frequency[totals["bucket"].to_numpy()] = totals["n"].to_numpy()
    shared = spark.sparkContext.broadcast(frequency)
    kept = keep(
        source.mapInArrow(_prefixes(words, percent, shared), "doc_id bigint, n_shingles bigint, digest binary, prefix array<bigint>, signature array<bigint>"),
        "prefixes",
        "zstd",
    )
    classes = keep(
        kept.where("digest is not null")
        .groupBy("digest")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.first("n_shingles").alias("n"),
            F.first("prefix").alias("prefix"),
            F.first("signature").alias("signature"),
        )
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
        "zstd",
    )
    rows = keep(kept.select("doc_id", "n_shingles", "digest"), "rows")
    discard(kept)
    # Size and position in one number: an index entry has three.
    index = classes.select("cid", F.shiftleft("n", _AT_BITS).alias("n"), F.posexplode("prefix").alias("at", "gram")).select(
        "gram", "cid", (F.col("n") + F.col("at")).alias("place")
    )
    grams = keep(index.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("gram"), "grams")
    # Entries of n-grams that two classes share.
    n, at = F.shiftright("place", _AT_BITS).alias("n"), F.col("place").bitwiseAND((1 << _AT_BITS) - 1).alias("at")
    entries = keep(index.join(grams, "gram").select("gram", "cid", n, at), "entries")
    prefixed, classes = classes, keep(classes.select("cid", "digest", "first_id", "signature"), "classes")
    discard(prefixed, grams)
    # The head of a list is where the n-gram comes earliest.
    heads = keep(entries.groupBy("gram").agg(F.min(F.struct("at", "cid", "n")).alias("head")), "heads")
    starred = keep(
        entries.join(heads, "gram")
        .where("cid <> head.cid")
        .where(_possible(percent, F.col("n"), F.col("head.n"), F.col("at"), F.col("head.at")))
        .select(F.col("head.cid").alias("a"), F.col("cid").alias("b"))
        .distinct(),
        "pairs",
    )
    links = _linked(starred, classes, source, words, percent)
    found = components(links)
    labelled = keep(
        entries.join(found.select(F.col("node").alias("cid"), "component"), "cid", "left").select(
            "gram", "cid", "n", "at", F.coalesce("component", "cid").alias("component")
        ),
        "entries",
    )
    mixed = keep(
        labelled.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("gram"),
        "grams",
    )
    signs = [f"s{i}" for i in range(SIGNATURE_WORDS)]
    signed = classes.select("cid", *(F.col("signature")[i].alias(s) for i, s in enumerate(signs)))
    open_ = keep(keep(labelled.join(mixed, "gram"), "entries").join(signed, "cid"), "entries")
    left = open_.select("gram", *(F.col(c).alias(f"{c}_a") for c in ("cid", "n", "at", "component", *signs)))
    right = open_.select("gram", *(F.col(c).alias(f"{c}_b") for c in ("cid", "n", "at", "component", *signs)))
    crossing = (
        left.join(right, "gram")
        .where(
            (F.col("cid_a") < F.col("cid_b"))
            & (F.col("component_a") != F.col("component_b"))
            & _possible(percent, F.col("n_a"), F.col("n_b"), F.col("at_a"), F.col("at_b"))
            & _signed(percent)
        )
        .select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))
        .distinct()
        .join(starred, ["a", "b"], "left_anti")
    )
    links = links.unionByName(_linked(keep(crossing, "pairs"), classes, source, words, percent))
    groups = components(links)
    member = keep(
        classes.select("cid", "digest", "first_id")
        .join(groups.select(F.col("node").alias("cid"), "component"), "cid", "left")
        .select("digest", "first_id", F.coalesce("component", "cid").alias("component")),
        "classes",
    )
    ids = keep(member.groupBy("component").agg(F.min("first_id").alias("component_id")), "components")
    named = keep(member.join(ids, "component").select("digest", "component_id"), "classes")
    return rows.join(named, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
