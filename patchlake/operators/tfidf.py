"""TF-IDF over one- and two-word terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from patchlake import rules
from patchlake.session import discard, stored

WORD = r"[\p{L}\p{N}_]+"
LONG_WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_]+"
# Fewest signs of a word; a run of fewer is none, and its neighbours become neighbours of each other.
_SHORTEST = {WORD: 1, LONG_WORD: 2}
# About 60 MB as a broadcast table; larger vocabularies need a join of their own.
TERM_BOUND = 1_000_000


# Words, and bytes of texts, that are counted at once inside a task.
_SLICE_WORDS = 500_000
_SLICE_BYTES = 1_500_000
# Sums of the counts of all terms by their hash, in parts of this many; they tell which terms cannot be among the most frequent.
_BUCKETS, _BUCKET_PART = 1 << 20, 1 << 14


def _unique(df: DataFrame, doc_id: str) -> bool:
    """Whether every row is a document of its own; reads the ids only."""
    return df.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def documents(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, texts, copies): one row per document, dealt out by document and stored for the passes over them.

    Texts move once, before they are split; terms never do. Rows that share an id
    are one document of several texts. ``copies`` says for how many documents a
    row stands, here one.
    """
    dealt = df.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).repartition("doc")
    if _unique(df, doc_id):
        found = dealt.select("doc", F.array("text").alias("texts"))
    else:
        found = dealt.groupBy("doc").agg(F.collect_list(F.coalesce("text", F.lit(""))).alias("texts"))
    return stored(found.withColumn("copies", F.lit(1).cast("bigint")), "documents")


def slices(lists: pa.Array) -> Iterator[pa.Array]:
    """The rows of ``lists`` in slices of bounded length; a longer row is a slice of its own."""
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(lists):
        start = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, start + _SLICE_WORDS, "right")))
        yield lists.slice(first, last - first)
        first = last


def _text_slices(lists: pa.Array) -> Iterator[pa.Array]:
    """The rows of lists of texts in slices of bounded bytes; a longer row is a slice of its own."""
    sizes = np.concatenate(([0], np.cumsum(pc.binary_length(lists.flatten()).fill_null(0).to_numpy(zero_copy_only=False))))
    ends = sizes[np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
    first = 0
    while first < len(lists):
        start = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, start + _SLICE_BYTES, "right")))
        yield lists.slice(first, last - first)
        first = last


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length says, one after the other."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)


def split_words(lists: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct lower-case words of lists of texts, and per word that occurs, in order, its row, its code and that of the next in its text or -1.

    Texts are cut at blanks first, so that letters are looked at once per distinct piece and not once per place.
    """
    texts = lists.flatten().fill_null("")
    pieces = pc.ascii_split_whitespace(texts)
    encoded = pc.dictionary_encode(pieces.flatten())
    cut = pc.split_pattern_regex(pc.utf8_lower(encoded.dictionary), pattern=r"[^\p{L}\p{N}_]+")
    runs = cut.flatten()
    long = pc.greater_equal(pc.utf8_length(runs), _SHORTEST[pattern]).to_numpy(zero_copy_only=False)
    of_piece = np.repeat(np.arange(len(cut)), cut.value_lengths().to_numpy(zero_copy_only=False))[long]
    words = pc.dictionary_encode(runs.filter(pa.array(long)))
    known = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_words = np.bincount(of_piece, minlength=len(cut))
    piece = encoded.indices.to_numpy(zero_copy_only=False)
    lengths = n_words[piece]
    codes = known[_ranges((np.cumsum(n_words) - n_words)[piece], lengths)]
    of_text = np.repeat(np.repeat(np.arange(len(texts)), pieces.value_lengths().to_numpy(zero_copy_only=False)), lengths)
    following = np.full(len(codes), -1, dtype=np.int64)
    following[:-1] = np.where(of_text[1:] == of_text[:-1], codes[1:], -1)
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[of_text]
    return words.dictionary, rows, codes, following


def _lists(n_rows: int, rows: np.ndarray, columns: dict[str, pa.Array]) -> pa.Array:
    """One list of structs per row; ``rows`` is sorted."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n_rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def _counts(
    words: pa.Array, rows: np.ndarray, codes: np.ndarray, following: np.ndarray, alone: np.ndarray, paired: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, term and count of every term of every row, sorted, and the distinct terms, by number.

    Terms are the words chosen by ``alone`` and the pairs chosen by ``paired``.
    """
    # A word and a pair of neighbours are one number: the second place is 0 for a word alone.
    size = len(words) + 1
    places, term = np.unique(np.concatenate((codes[alone] * size, (codes * size + following + 1)[paired])), return_inverse=True)
    n = max(len(places), 1)
    keys, tf = np.unique(np.concatenate((rows[alone], rows[paired])) * n + term, return_counts=True)
    second = places % size
    terms = pc.binary_join_element_wise(words.take(pa.array(places // size)), words.take(pa.array(second - 1, mask=second == 0)), " ", null_handling="skip")
    return keys // n, keys % n, tf, terms


def term_counts(df: DataFrame, doc_id: str, text: str, pattern: str = WORD) -> DataFrame:
    """(doc, term, tf): count of each lower-case word and each pair of neighbouring words per document, made where the text is."""

    def count(part: pa.Array) -> pa.Array:
        words, rows, codes, following = split_words(part, pattern)
        rows, term, tf, terms = _counts(words, rows, codes, following, following >= -1, following >= 0)
        return _lists(len(part), rows, {"term": terms.take(pa.array(term)), "tf": pa.array(tf.astype(np.int64))})

    @F.arrow_udf(returnType="array<struct<term:string,tf:bigint>>")
    def counted(lists: pa.Array) -> pa.Array:
        return pa.concat_arrays([count(part) for part in _text_slices(lists)])

    found = documents(df, doc_id, text).select("doc", counted("texts").alias("entries"))
    return found.select("doc", F.inline("entries"))


def _by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        first = 0
        for part in _text_slices(batch.column("texts")):
            yield part, batch.column("copies").slice(first, len(part)).to_numpy(zero_copy_only=False)
            first += len(part)


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A hash of every word; the sum of its bytes times a power of an odd number that goes with their place."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    lengths = np.diff(ends)
    powers = np.multiply.accumulate(np.full(lengths.max(initial=1), 0x9E3779B97F4A7C15, dtype=np.uint64))
    letters = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    hashes = np.add.reduceat(letters * powers[_ranges(np.zeros_like(lengths), lengths)], ends[:-1] - ends[0])
    return (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _buckets(words: pa.Array, codes: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every word, and of it and its next one (to be left out where there is none)."""
    if len(words) == 0:
        return codes, codes
    hashes, shift = _word_hashes(words), np.uint64(65 - _BUCKETS.bit_length())
    alone = (hashes >> shift).astype(np.int64)[codes]
    pairs = (hashes * np.uint64(0x94D049BB133111EB))[codes] + (hashes ^ (hashes >> np.uint64(31)))[following]
    return alone, (pairs * np.uint64(0xD6E8FEB86659FD93) >> shift).astype(np.int64)


def bucket_counts(docs: DataFrame, pattern: str = WORD) -> np.ndarray:
    """The summed counts of the terms of each bucket: no term has more than its bucket. Fixed size; tasks and parts add up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BUCKETS)
        for part, times in _by_slice(batches):
            words, rows, codes, following = split_words(part, pattern)
            alone, pairs = _buckets(words, codes, following)
            paired = following >= 0
            total += np.bincount(alone, weights=times[rows], minlength=_BUCKETS)
            total += np.bincount(pairs[paired], weights=times[rows[paired]], minlength=_BUCKETS)
        parts = [x.tobytes() for x in total.astype(np.int64).reshape(-1, _BUCKET_PART)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("counts"))
        return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, counts binary"
    found = docs.select("texts", "copies").mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).collect()
    return np.concatenate([np.zeros(0, np.int64)] + [np.frombuffer(r.counts, np.int64) for r in sorted(found)])


def term_totals(docs: DataFrame, pattern: str = WORD, buckets: np.ndarray | None = None, least: int = 0) -> DataFrame:
    """(term, corpus_count, df) over ``docs`` (:func:`documents`), added up where the text is, a slice of texts at a time.

    With ``buckets``, terms of buckets below ``least`` are left out before anything moves: each has fewer than that.
    """
    allowed = None if buckets is None else docs.sparkSession.sparkContext.broadcast(np.packbits(buckets >= least))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None if allowed is None else np.unpackbits(allowed.value).astype(bool)
        for part, times in _by_slice(batches):
            words, rows, codes, following = split_words(part, pattern)
            alone, paired = np.ones(len(codes), dtype=bool), following >= 0
            if kept is not None:
                single, pairs = _buckets(words, codes, following)
                alone, paired = kept[single], paired & kept[pairs]
            rows, term, tf, terms = _counts(words, rows, codes, following, alone, paired)
            sums = [np.bincount(term, weights=x, minlength=len(terms)).astype(np.int64) for x in (tf * times[rows], times[rows])]
            yield pa.RecordBatch.from_arrays([terms, *map(pa.array, sums)], names=["term", "corpus_count", "df"])

    parts = docs.select("texts", "copies").mapInArrow(totals, "term string, corpus_count bigint, df bigint")
    return parts.groupBy("term").agg(F.sum("corpus_count").alias("corpus_count"), F.sum("df").alias("df"))


def vocabulary(
    docs: DataFrame,
    n_docs: int,
    pattern: str = WORD,
    max_terms: int = rules.MAX_TERMS,
    min_docs: int = rules.MIN_DOC_COUNT,
    max_share: float = rules.MAX_DOC_SHARE,
) -> DataFrame:
    """The most frequent terms of ``docs`` (:func:`documents`) within the document limits, with their idf.

    Ties at the cut go by term. The result has at most ``max_terms`` rows; it is
    broadcast and collected later, so that number is checked here.

    Most terms are rare, and none of those needs to move: a first pass counts by
    hash, a second one counts exactly what may be frequent enough. If the last
    term taken is rarer than what was left out may be, less is left out and the
    second pass made again, down to nothing left out.
    """
    if not 0 < max_terms <= TERM_BOUND:
        raise ValueError(f"max_terms must be between 1 and {TERM_BOUND}")
    buckets = bucket_counts(docs, pattern)
    least = int(np.partition(buckets, -max_terms)[-max_terms]) // 2 if max_terms < len(buckets) else 0
    while True:
        totals = term_totals(docs, pattern, buckets if least > 1 else None, least)
        kept = totals.filter((F.col("df") >= min_docs) & (F.col("df") <= F.lit(n_docs) * F.lit(max_share)))
        top = kept.orderBy(F.desc("corpus_count"), "term").limit(max_terms).toArrow()
        if least <= 1 or len(top) == max_terms and pc.min(top.column("corpus_count")).as_py() >= least:
            break
        least //= 4
    idf = F.ln(F.lit(n_docs + 1).cast("double") / (F.col("df") + 1)) + 1
    return docs.sparkSession.createDataFrame(top).withColumn("idf", idf)


def sparse_column(indices: Column, values: Column, size: int) -> Column:
    """A sparse vector of sorted ``indices`` and ``values``: whole Arrow columns get another name, no row is touched."""

    @F.arrow_udf(returnType=VectorUDT())
    def relabel(i: pa.Array, v: pa.Array) -> pa.Array:
        sparse, length = pa.array(np.zeros(len(i), dtype=np.int8)), pa.array(np.full(len(i), size, dtype=np.int32))
        return pa.StructArray.from_arrays([sparse, length, i, v], names=["type", "size", "indices", "values"])

    return relabel(F.coalesce(indices, F.array().cast("array<int>")), F.coalesce(values, F.array().cast("array<double>")))


class Lookup:
    """Places of the vocabulary's terms by the codes of their words."""

    def __init__(self, terms: list[str], idf: list[float]):
        parts = [t.split(" ") for t in terms]
        self.words = sorted({w for p in parts for w in p})
        self.word_set = pa.array(self.words, pa.string())
        code = {w: i for i, w in enumerate(self.words)}
        self.idf = np.array(idf)
        self.alone = np.full(len(self.words) + 1, -1, dtype=np.int64)
        pairs = []
        for i, p in enumerate(parts):
            if len(p) == 1:
                self.alone[code[p[0]]] = i
            else:
                pairs.append((code[p[0]] * len(self.words) + code[p[1]], i))
        keys = np.array(sorted(pairs), dtype=np.int64).reshape(-1, 2)
        self.pairs, self.places = keys[:, 0].copy(), keys[:, 1].copy()

    def weigh(self, lists: pa.Array, pattern: str) -> pa.Array:
        size = max(len(self.idf), 1)
        words, rows, codes, following = split_words(lists, pattern)
        # Words of these texts by their code in the vocabulary; the last place is that of no word.
        known = np.append(pc.index_in(words, value_set=self.word_set).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), -1)
        codes, following = known[codes], known[following]
        # Code -1 reads the last place, which holds no term.
        alone = self.alone[codes]
        paired = np.flatnonzero((codes >= 0) & (following >= 0))
        wanted = codes[paired] * len(self.words) + following[paired]
        at = np.searchsorted(self.pairs, wanted)
        hit = at < len(self.pairs)
        hit[hit] = self.pairs[at[hit]] == wanted[hit]
        found = np.concatenate(((rows * size + alone)[alone >= 0], rows[paired[hit]] * size + self.places[at[hit]]))
        keys, tf = np.unique(found, return_counts=True)
        row, index = keys // size, keys % size
        raw = (np.log(tf) + 1.0) * self.idf[index]
        norm = np.sqrt(np.bincount(row, weights=raw * raw, minlength=len(lists)))
        columns = {"index": pa.array(index.astype(np.int32)), "tf": pa.array(tf.astype(np.int64)), "weight": pa.array(raw / norm[row])}
        return _lists(len(lists), row, columns)


def distinct_texts(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct rows of lists of one text each, and which one each row is; rows of several texts stay as they are."""
    if len(lists) == 0 or lists.null_count or pc.min_max(lists.value_lengths()) != pa.scalar({"min": 1, "max": 1}, pc.min_max(lists.value_lengths()).type):
        return lists, np.arange(len(lists))
    encoded = lists.flatten().fill_null("").dictionary_encode()
    single = pa.ListArray.from_arrays(pa.array(np.arange(len(encoded.dictionary) + 1, dtype=np.int32)), encoded.dictionary)
    return single, encoded.indices.to_numpy(zero_copy_only=False)


def weigh(lists: pa.Array, lookup: Lookup, pattern: str) -> pa.Array:
    """The entries of each row of lists of texts, a slice of them at a time."""
    return pa.concat_arrays([lookup.weigh(part, pattern) for part in _text_slices(lists)] or [lookup.weigh(lists, pattern)])


@dataclass
class TfIdf:
    """A fitted vocabulary: (term, index, idf), at most ``size`` rows."""

    vocab: DataFrame
    size: int
    pattern: str
    _shared: Broadcast | None = field(default=None, repr=False)

    def lookup(self) -> Broadcast:
        """The vocabulary, bounded by its number of terms and sent to every worker once, so that terms are found where the text is."""
        if self._shared is None:
            rows = self.vocab.orderBy("index").collect()
            self._shared = self.vocab.sparkSession.sparkContext.broadcast(Lookup([r.term for r in rows], [r.idf for r in rows]))
        return self._shared

    def entries(self, texts: Column) -> Column:
        """(index, tf, weight) of the terms in the texts of a document: (1 + ln tf) * idf, scaled to length one."""
        shared, pattern = self.lookup(), self.pattern

        @F.arrow_udf(returnType="array<struct<index:int,tf:bigint,weight:double>>")
        def weighed(lists: pa.Array) -> pa.Array:
            distinct, member = distinct_texts(lists)
            return weigh(distinct, shared.value, pattern).take(pa.array(member))

        return weighed(texts)

    def weights(self, df: DataFrame, doc_id: str, text: str) -> DataFrame:
        """(doc, term, tf, idf, weight) of the vocabulary's terms in every document."""
        return self.weights_of(documents(df, doc_id, text))

    def weights_of(self, docs: DataFrame) -> DataFrame:
        """:meth:`weights` of documents that are stored already (:func:`documents`)."""
        found = docs.select("doc", F.inline(self.entries(F.col("texts"))))
        return found.join(F.broadcast(self.vocab), "index").select("doc", "term", "tf", "idf", "weight")

    def with_texts(self, df: DataFrame, doc_id: str, text: str) -> DataFrame:
        """``df`` with the ``texts`` of every row: its own, or those of all rows that share its id."""
        if _unique(df, doc_id):
            return df.withColumn("texts", F.array(F.col(text)))
        docs = df.select(F.col(doc_id).alias("doc"), F.coalesce(text, F.lit("")).alias("text")).groupBy("doc").agg(F.collect_list("text").alias("texts"))
        return df.join(docs.withColumnRenamed("doc", doc_id), doc_id, "left")

    def vectors(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` with a sparse vector per row instead of its ``texts``; a row holds at most ``size`` entries."""
        found = df.withColumn("entries", self.entries(F.col("texts"))).drop("texts")
        return found.withColumn(out, sparse_column(F.col("entries.index"), F.col("entries.weight"), self.size)).drop("entries")

    def transform(self, df: DataFrame, doc_id: str, text: str, out: str) -> DataFrame:
        """``df`` with a sparse vector per row. Rows that share an id get the vector of all."""
        return self.vectors(self.with_texts(df, doc_id, text), out)


def fit(df: DataFrame, doc_id: str, text: str, pattern: str = WORD, **limits) -> TfIdf:
    """Vocabulary of the training rows; its at most ``max_terms`` terms are numbered in order."""
    docs = documents(df, doc_id, text)
    fitted = fit_documents(docs, docs.count(), pattern, **limits)
    discard(docs)
    return fitted


def fit_documents(docs: DataFrame, n_docs: int, pattern: str = WORD, **limits) -> TfIdf:
    """:func:`fit` for documents that are stored already (:func:`documents`), some of which may stand for several."""
    rows = sorted((r.term, r.idf) for r in vocabulary(docs, n_docs, pattern, **limits).select("term", "idf").collect())
    columns = {"term": [t for t, _ in rows], "index": range(len(rows)), "idf": [idf for _, idf in rows]}
    types = {"term": pa.string(), "index": pa.int32(), "idf": pa.float64()}
    table = docs.sparkSession.createDataFrame(pa.table({n: pa.array(v, types[n]) for n, v in columns.items()}))
    return TfIdf(table, max(len(rows), 1), pattern)
