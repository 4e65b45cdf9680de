"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text becomes lower-case UTF-8 with every run of non-letters as one space. Its
features are the byte n-grams inside words (a space counts at either end),
hashed to buckets. Each bucket has an embedding; a text is the average of its
embeddings, and a linear softmax gives the languages. Both layers are trained
by stochastic gradient descent in numpy on a bounded sample of labelled rows.
For prediction the two layers fold into one table (bucket x language). A softmax
always prefers some language, so one more column has the log share of the bucket
in the training texts: its average is low for texts of unseen n-grams, whatever
the softmax says, and with the log probability it decides what is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from patchlake.llm.common import slices

UNKNOWN = "und"
ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
DIMENSIONS = 16
# At most about this many labelled rows are used for training and calibration.
SAMPLE_ROWS = 6000
SEED = 11
EPOCHS = 4
RATE = 0.5
# Share of right calibration rows below the level from which rejection starts to count, and how far the threshold lies
# from there towards the level of n-grams drawn at random.
REJECTED_SHARE = 0.0005
SLACK = 0.25
# A training text counts as this many n-grams for the log shares, an unseen bucket as half of one.
TEXT_WEIGHT = 1000
# Everything but letters (category L): digits, signs such as ² or ① and marks part words.
_GAP = regex.compile(r"[^\p{L}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letters_only(text: str | None) -> bytes | None:
    """Lower-case words between single spaces, or None without any letter."""
    if not text:
        return None
    words = _GAP.sub(" ", text.lower()).strip()
    return f" {words} ".encode("utf-8", "replace") if words else None


def buckets_of(data: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams of a byte array that have no space inside."""
    found = []
    space = data == 32
    wide = data.astype(np.uint64)
    for n in ORDERS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        code = np.zeros(m, dtype=np.uint64)
        inner = np.zeros(m, dtype=bool)
        for k in range(n):
            code = (code << np.uint64(8)) | wide[k : k + m]
            if 0 < k < n - 1:
                inner |= space[k : k + m]
        if n == 2:
            inner = space[:m] & space[1 : 1 + m]
        code = ((code + np.uint64(n << 40)) * _MIX) >> np.uint64(64 - BUCKETS.bit_length() + 1)
        found.append(code[~inner].astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int32)


@dataclass
class Model:
    """Folded table with the log shares last, bias, languages, softmax temperature and the least familiar level that is kept."""

    table: np.ndarray
    bias: np.ndarray
    languages: list[str]
    temperature: float
    least: float

    @property
    def threshold(self) -> float:
        """The score below which a text is rejected; the best probability is never less."""
        return (1 - 1e-9) / max(len(self.languages), 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the probability, for texts less familiar than ``least`` scaled down below the threshold.

        A text without letters is unknown with score 0.
        """
        data = letters_only(text)
        if data is None or not self.languages:
            return UNKNOWN, 0.0
        array = np.frombuffer(data, dtype=np.uint8)
        total, count = np.zeros(len(self.languages) + 1), 0
        for start in range(0, len(array), 1 << 20):
            ids = buckets_of(array[start : start + (1 << 20) + max(ORDERS) - 1])
            total += self.table.take(ids, axis=0).sum(axis=0, dtype=np.float64)
            count += len(ids)
        total /= max(count, 1)
        p = softmax((total[:-1] + self.bias) / self.temperature)
        best = int(p.argmax())
        score, beyond = float(p[best]), float(total[-1] + np.log(p[best])) - self.least
        return self.languages[best], score if beyond >= 0 else score * self.threshold * float(np.exp(beyond))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str | None, str]]) -> Model:
    """Train on (text, language) rows; every fifth row is held back to calibrate.

    Without usable rows the model knows no language and rejects only texts without letters.
    """
    prepared = [(d, lang) for text, lang in rows if (d := letters_only(text)) is not None]
    languages = sorted({lang for _, lang in prepared})
    if not languages:
        return Model(np.zeros((BUCKETS, 0), np.float32), np.zeros(0), [], 1.0, -np.inf)
    number = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(SEED)
    features = []
    for data, lang in prepared:
        ids, counts = np.unique(buckets_of(np.frombuffer(data, dtype=np.uint8)), return_counts=True)
        features.append((ids, (counts / max(counts.sum(), 1)).astype(np.float32), number[lang]))
    held = features[::5] if len(features) >= 50 else features
    train = [f for i, f in enumerate(features) if i % 5] if len(features) >= 50 else held
    embed = rng.normal(0, 0.3, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = np.zeros((DIMENSIONS, len(languages)), dtype=np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    steps, step = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            ids, share, label = train[i]
            rate = np.float32(RATE * (1 - step / steps))
            hidden = share @ embed[ids]
            error = softmax(hidden @ weights + bias)
            error[label] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= rate * error
            # The gradient of an embedding is its share of the text; scaled up, since shares are small.
            embed[ids] -= (rate * 20 * share)[:, None] * back
            step += 1
    table = (embed @ weights).astype(np.float32)
    logits = np.array([share @ table[ids] + bias for ids, share, _ in held], dtype=np.float64)
    truth = np.array([label for _, _, label in held])
    grid = np.geomspace(0.05, 20, 60)
    losses = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(losses))])
    p = softmax(logits / temperature)
    seen = np.zeros(BUCKETS)
    for ids, share, _ in train:
        seen[ids] += share
    # Without calibration rows of their own, training rows are judged by the others.
    own = 1 if held is train else 0
    known = log_shares(seen, len(train))
    familiar = np.array([share @ log_shares(seen[ids] - own * share, len(train) - own) for ids, share, _ in held])
    right = (familiar + np.log(p.max(axis=1)))[p.argmax(axis=1) == truth]
    level = float(np.quantile(right, REJECTED_SHARE)) if len(right) else -np.inf
    least = level - SLACK * max(0.0, level - float(known.mean())) if len(right) else level
    return Model(np.column_stack([table, known]).astype(np.float32), bias.astype(np.float64), languages, temperature, least)


def log_shares(seen: np.ndarray, texts: int) -> np.ndarray:
    """Smoothed log shares of buckets whose shares in ``texts`` texts add up to ``seen``."""
    return np.log((TEXT_WEIGHT * np.maximum(seen, 0) + 0.5) / (TEXT_WEIGHT * texts + 0.5 * BUCKETS))


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 1 modulo 3. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on about ``rows`` labelled rows that are not held out, an even share for each language.

    The sample is every row whose id hash lies below the language's quota, so it
    is the same in each run. The driver sees the count of each language and the
    sample; texts of the sample are whole. Languages beyond ``rows`` / 50 rows
    each are not split further: with many languages raise ``rows``.
    """
    spread = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 30))
    usable = docs.where(~held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in usable.groupBy(lang).count().collect()}
    if not sizes:
        return fit([])
    quota = max(1, rows // len(sizes))
    wanted = F.lit(False)
    for name, size in sizes.items():
        wanted = wanted | ((F.col(lang) == name) & (spread < int((1 << 30) * min(1.0, quota / size))))
    picked = usable.where(wanted).select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l"))
    sample = sorted(((r.i, r.t, r.l) for r in picked.limit(2 * rows).toLocalIterator()), key=lambda r: (r[0], r[1]))
    return fit([(t, lang_) for _, t, lang_ in sample])


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row; ``carry`` puts them behind all columns of ``docs`` instead.

    The whole text counts. A null, empty or letterless text is ``und`` with
    score 0 and rejected; other texts are rejected below the threshold: if their
    n-grams are less familiar than calibrated on right rows. A model without
    languages calls all texts ``und`` and rejects only the letterless ones. The model is a table of fixed size, broadcast to the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(texts: pa.Array) -> list[pa.Array]:
        values = texts.to_pylist()
        found = [shared.value.predict(t) for t in values]
        least = shared.value.threshold
        # A model without languages calls every text unknown.
        blind = not shared.value.languages
        return [
            pa.array([f[0] for f in found], pa.string()),
            pa.array([f[1] for f in found], pa.float64()),
            pa.array([letters_only(t) is None if blind else f[0] == UNKNOWN or f[1] < least for t, f in zip(values, found)], pa.bool_()),
        ]

    added = ["__lang_pred", "__score", "__rejected"] if carry else ["lang_pred", "score", "rejected"]
    source = docs if carry else docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    at = source.columns.index(text if carry else "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept = [i for i in range(batch.num_columns) if carry or i != at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), *predicted(batch.column(at))],
                names=[*(batch.schema.names[i] for i in kept), *added],
            )

    fields = [f for f in source.schema.fields if carry or f.name != "text"]
    kinds = (StringType(), DoubleType(), BooleanType())
    schema = StructType([*fields, *(StructField(name, kind) for name, kind in zip(added, kinds))])
    return source.mapInArrow(run, schema)
