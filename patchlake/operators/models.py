"""Logistic-regression classifiers and their application."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patchlake import rules
from patchlake.operators import features, tfidf
from patchlake.session import discard, stored


@dataclass
class Linear:
    """Weights of a linear classifier, one per place of the feature vector, and how it is applied."""

    weights: np.ndarray
    intercept: float

    @property
    def coefficients(self) -> DenseVector:
        return DenseVector(self.weights)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the probabilities of both classes as a vector."""
        shared, intercept = df.sparkSession.sparkContext.broadcast(self.weights), self.intercept

        @F.arrow_udf(returnType="double")
        def margin(entries: pa.Array) -> pa.Array:
            return pa.array(margins(entries, shared.value, intercept)[0])

        p = 1.0 / (1.0 + F.exp(-margin(vector_entries(F.col("features")))))
        return df.withColumn("__p", p).withColumn("probability", array_to_vector(F.array(1.0 - F.col("__p"), F.col("__p")))).drop("__p")


def margins(entries: pa.Array, weights: np.ndarray, intercept: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Margin of every row of :func:`vector_entries`, and the row, slot and value of every entry."""
    flat = entries.flatten()
    slots, values = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("slot", "value"))
    rows = np.repeat(np.arange(len(entries)), entries.value_lengths().to_numpy(zero_copy_only=False))
    margin = np.bincount(rows, weights=values * weights[slots], minlength=len(entries)) + intercept
    return margin, rows, slots, values


@dataclass(frozen=True)
class Texts:
    """Texts that several rows share: one row of ``table`` (key, model_text) per key; rows name theirs in a column of that name."""

    table: DataFrame
    key: str

    def copies(self, df: DataFrame) -> DataFrame:
        """(texts, copies): those that rows of ``df`` name, and how many rows do, stored for the passes over them."""
        named = self.table.select(self.key, "model_text").join(df.groupBy(self.key).agg(F.count(F.lit(1)).alias("copies")), self.key)
        return stored(named.select(F.array("model_text").alias("texts"), "copies"), "texts")


@dataclass
class Classifier:
    """A fitted model and everything needed to build its input."""

    model: Linear | None = None
    numerics: list[str] = field(default_factory=list)
    scaler: features.Scaler | None = None
    one_hot: PipelineModel | None = None
    text: tfidf.TfIdf | None = None
    doc_id: str = "record_id"

    def with_texts(self, df: DataFrame, texts: Texts | None = None) -> DataFrame:
        """Rows with their ``texts``: their own, or those they share with others, which come to lie side by side and are looked at once."""
        if texts is None:
            return self.text.with_texts(df, self.doc_id, "model_text")
        found = texts.table.select(texts.key, F.array("model_text").alias("texts"))
        # Texts grow with the input, so they are never broadcast.
        joined = df.join(found.hint("merge"), texts.key, "left")
        return joined.withColumn("texts", F.coalesce("texts", F.array(F.lit(""))))

    def inputs(self, df: DataFrame, texts: Texts | None = None) -> DataFrame:
        if self.text is not None:
            df = self.text.vectors(self.with_texts(df, texts), "text_features")
        return _inputs(df, self.numerics, self.scaler, self.one_hot, self.text is not None)

    def parts(self, df: DataFrame, texts: Texts | None = None) -> tuple[DataFrame, Shape]:
        """Rows with the parts of their vector, not put together, and its shape.

        ``texts`` holds the texts whose terms make up its first part, ``numeric`` the
        scaled numerics, ``hot`` one place per category, -1 for a value that
        training has not seen.
        """
        terms = self.text.size if self.text else 0
        df = self.with_texts(df, texts) if self.text is not None else df.withColumn("texts", F.array().cast("array<string>"))
        known = self.one_hot.stages[0].labelsArray if self.one_hot is not None else []
        hot, place = [], terms + len(self.numerics)
        if self.one_hot is not None:
            df = self.one_hot.stages[0].transform(df)
        for name, values in zip(features.CATEGORIES, known):
            index = F.col(f"{name}_index").cast("int")
            hot.append(F.when(index < len(values), index + place).otherwise(-1))
            place += len(values)
        scaled = list(self.scaler.columns().values()) if self.scaler is not None else []
        df = df.withColumns({"numeric": F.array(*scaled).cast("array<double>"), "hot": F.array(*hot).cast("array<int>")})
        return df, Shape(terms, len(self.numerics), len(known), place)

    def score(self, df: DataFrame, threshold: float | None = rules.DECISION_THRESHOLD, texts: Texts | None = None) -> DataFrame:
        """Rows with both probabilities and the label.

        At or above ``threshold`` is a fix; without a threshold the more likely
        class wins.
        """
        scored = self.model.transform(self.inputs(df, texts))
        p = vector_to_array("probability")
        return (
            scored.withColumns({"probability_non_bug_fix": p[0], "probability_bug_fix": p[1]})
            .withColumn("prediction", decide(F.col("probability_bug_fix"), threshold))
            .drop("features", "rawPrediction", "probability")
        )

    def size(self) -> int:
        """Places of the feature vector."""
        known = self.one_hot.stages[0].labelsArray if self.one_hot is not None else []
        return (self.text.size if self.text else 0) + len(self.numerics) + sum(map(len, known))

    def with_model(self, model) -> "Classifier":
        """The same input blocks under another model: one that has coefficients, intercept and transform."""
        return replace(self, model=model)

    def save(self, path: str) -> None:
        """Write everything that scoring needs below ``path``, for :meth:`load` in another job."""
        spark = SparkSession.active()
        weight_table(self).write.mode("overwrite").parquet(f"{path}/weights")
        facts: dict = {"numerics": self.numerics, "doc_id": self.doc_id, "intercept": float(self.model.intercept)}
        if self.scaler is not None:
            facts |= {"mean": self.scaler.mean, "scale": self.scaler.scale}
        if self.one_hot is not None:
            self.one_hot.write().overwrite().save(f"{path}/one_hot")
            facts["one_hot"] = True
        if self.text is not None:
            self.text.vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
            facts |= {"terms": self.text.size, "pattern": self.text.pattern}
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Classifier":
        """The classifier that :meth:`save` wrote."""
        facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
        scaler = features.Scaler(facts["mean"], facts["scale"]) if "mean" in facts else None
        text = None
        if "terms" in facts:
            vocab = spark.read.parquet(f"{path}/vocabulary")
            text = tfidf.TfIdf(vocab, facts["terms"], facts["pattern"])
        one_hot = PipelineModel.load(f"{path}/one_hot") if facts.get("one_hot") else None
        rows = spark.read.parquet(f"{path}/weights").orderBy("slot").collect()
        model = Linear(np.array([r.coefficient for r in rows]), facts["intercept"])
        return cls(model, facts["numerics"], scaler, one_hot, text, facts["doc_id"])


def decide(probability: Column, threshold: float | None) -> Column:
    limit = 0.5 if threshold is None else threshold
    hit = probability > limit if threshold is None else probability >= limit
    return F.when(hit, 1).otherwise(0)


def label_name(prediction: Column) -> Column:
    return F.when(prediction == 1, "bug_fix").otherwise("non_bug_fix")


def _inputs(df, numerics, scaler, one_hot, text) -> DataFrame:
    parts = ["text_features"] if text else []
    if scaler is not None:
        df = df.withColumns({f"{c}_scaled": v for c, v in scaler.columns().items()})
        parts += [f"{c}_scaled" for c in numerics]
    if one_hot is not None:
        df = one_hot.transform(df)
        parts += [f"{c}_onehot" for c in features.CATEGORIES]
    assembled = VectorAssembler(inputCols=parts, outputCol="features").transform(df)
    extra = [p for p in parts] + [f"{c}_index" for c in features.CATEGORIES if one_hot is not None]
    # The assembler names every place of the vector in the column's metadata; every task of every pass would carry those names.
    return assembled.drop(*extra).withMetadata("features", {})


def fit_blocks(
    df: DataFrame,
    numerics: list[str] | None = None,
    categories: list[str] | None = None,
    text_pattern: str | None = None,
    doc_id: str = "record_id",
    texts: Texts | None = None,
    **text_limits,
) -> tuple[Classifier, DataFrame | None]:
    """A classifier without a model, its blocks fitted on these rows, and its vocabulary, if it reads texts.

    Texts are split once for the vocabulary and again where a vector is made: the
    counts of all terms would be many times the texts. A text that rows share is
    split once and counts for each of them.
    """
    numerics = numerics or []
    scaler = features.fit_scaler(df, numerics) if numerics else None
    one_hot = features.fit_one_hot(df, categories) if categories else None
    text = None
    if text_pattern and texts is not None:
        named = texts.copies(df)
        text = tfidf.fit_documents(named, df.count(), text_pattern, **text_limits)
        discard(named)
    elif text_pattern:
        text = tfidf.fit(df, doc_id, "model_text", text_pattern, **text_limits)
    return Classifier(None, numerics, scaler, one_hot, text, doc_id), None if text is None else text.vocab


# Places behind those of the vector, counted from the end of the sums.
INTERCEPT, LOSS, TP, FP, FN = -1, -2, -3, -4, -5
# The largest slope of the mean loss at which a fit has ended, as a share of the steepest at its start.
SLOPE_SHARE = 1e-4
# Steps whose change of slope L-BFGS remembers; the driver holds two numbers per step and place.
_MEMORY = 100
# Numerics, categories and intercept together, up to which their whole curvature is a matrix; more categories count one by one.
_MATRIX_PLACES = 512


# Partitions whose sums the driver adds up itself; more of them are added up in a tree of tasks.
_DRIVER_PARTS = 32

_BLOCK = {
    "label": np.float64, "weight": np.float64, "numeric": np.float64, "hot": np.int32,
    "member": np.int32, "entries": np.int32, "slot": np.int32, "value": np.float64,
}


def _packed(batches: Iterator[pa.RecordBatch], lookup: tfidf.Lookup | None, pattern: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, member, slot, value = (np.zeros(0, dtype=t) for t in (np.int32, np.int32, np.int32, np.float64))
        if lookup is not None:
            # Rows with the same text share its entries within a block.
            texts, member = tfidf.distinct_texts(batch.column("texts"))
            found = tfidf.weigh(texts, lookup, pattern)
            lengths, (slot, value) = found.value_lengths().to_numpy(), (found.flatten().field(n).to_numpy() for n in ("index", "weight"))
        numeric = batch.column("numeric").flatten()
        if numeric.null_count:
            raise ValueError("a numeric feature has no value")
        numbers = [*(c.to_numpy(zero_copy_only=False) for c in (batch.column("label"), batch.column("weight"), numeric, batch.column("hot").flatten()))]
        blobs = [np.ascontiguousarray(x.astype(t)).tobytes() for x, t in zip([*numbers, member, lengths, slot, value], _BLOCK.values())]
        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()) for blob in blobs], names=list(_BLOCK))


@dataclass(frozen=True)
class Shape:
    """Places of the vector: terms, numerics, then the values of the categories, of which a row has one each at most."""

    terms: int
    numerics: int
    categories: int
    size: int

    @property
    def matrix(self) -> int:
        """The first of the places whose curvature is a matrix, counted with the intercept as the last."""
        return self.size + 1 - (self.size - self.terms + 1 if self.size - self.terms < _MATRIX_PLACES else 0)


class Block:
    """Some thousand rows as arrays, opened for a pass."""

    def __init__(self, block: tuple, shape: Shape):
        self.shape = shape
        self.label, self.weight, numeric, hot, self.member, lengths, self.slot, self.value = (
            np.frombuffer(blob, dtype=t) for blob, t in zip(block, _BLOCK.values())
        )
        self.numeric = numeric.reshape(len(self.label), shape.numerics)
        # One more than the place, so that an unknown value is 0.
        self.hot = hot.reshape(len(self.label), shape.categories) + 1
        self.texts, self.inside = len(lengths), np.repeat(np.arange(len(lengths)), lengths)

    def margin(self, weights: np.ndarray, intercept: float) -> np.ndarray:
        first = self.shape.terms
        total = self.numeric @ weights[first : first + self.shape.numerics] + intercept
        if len(self.slot):
            total += np.bincount(self.inside, weights=self.value * weights[self.slot], minlength=self.texts)[self.member]
        if self.shape.categories:
            total += np.append(0.0, weights)[self.hot].sum(axis=1)
        return total

    def spread(self, of_rows: np.ndarray, power: int = 1) -> np.ndarray:
        """Per place, the sum over the rows of its value, to the power, times a number of the row."""
        shape, total = self.shape, np.zeros(self.shape.size)
        if len(self.slot):
            of_texts = np.bincount(self.member, weights=of_rows, minlength=self.texts)
            total += np.bincount(self.slot, weights=self.value**power * of_texts[self.inside], minlength=shape.size)
        total[shape.terms : shape.terms + shape.numerics] += of_rows @ self.numeric**power
        if shape.categories:
            total += np.bincount(self.hot.ravel(), weights=np.repeat(of_rows, shape.categories), minlength=shape.size + 1)[1:]
        return total

    def matrix(self, of_rows: np.ndarray) -> np.ndarray:
        """The products of all pairs of places behind the terms, the intercept last, summed like :meth:`spread`."""
        shape = self.shape
        wide = np.zeros((len(of_rows), shape.size - shape.terms + 2))
        wide[np.arange(len(of_rows))[:, None], np.where(self.hot > 0, self.hot - shape.terms, 0)] = 1.0
        wide[:, 1 : shape.numerics + 1], wide[:, -1] = self.numeric, 1.0
        wide = wide[:, 1:]
        return (wide * of_rows[:, None]).T @ wide


@dataclass
class Rows:
    """Training or validation rows as blocks of arrays, a few thousand rows each, which every pass of a solver reads."""

    table: DataFrame
    blocks: RDD
    shape: Shape

    def opened(self) -> RDD:
        shape = self.shape
        return self.blocks.map(lambda block: Block(block, shape))

    def release(self) -> None:
        self.blocks.unpersist()
        discard(self.table)


def training_rows(classifier: Classifier, df: DataFrame, weight: Column, name: str, texts: Texts | None = None) -> Rows:
    """Rows with vectors, label and weight, stored in blocks and kept by the executors, on disk where memory ends."""
    rows, shape = classifier.parts(df, texts)
    rows = rows.select(F.col("label").cast("double").alias("label"), weight.alias("weight"), "numeric", "hot", "texts")
    text, lookup = classifier.text, classifier.text.lookup() if classifier.text else None
    pattern = text.pattern if text else None

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed(batches, lookup.value if lookup else None, pattern)

    table = stored(rows.mapInArrow(packed, ", ".join(f"{n} binary" for n in _BLOCK)), name)
    return Rows(table, table.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK), shape)


def sums(rows: Rows, weights: np.ndarray, intercept: float, slopes: bool) -> tuple[np.ndarray, dict[int, float]]:
    """The slopes per place of the vector (none, unless ``slopes``), and loss and either slope of the intercept or confusion counts: one job."""
    shared = rows.table.sparkSession.sparkContext.broadcast((weights, intercept))

    def part(blocks: Iterator[Block]) -> Iterator[np.ndarray]:
        weights, intercept = shared.value
        total = np.zeros(len(weights) if slopes else 0)
        extra = np.zeros(5)
        for block in blocks:
            y, w = block.label, block.weight
            margin = block.margin(weights, intercept)
            extra[LOSS] += (w * (np.logaddexp(0.0, margin) - y * margin)).sum()
            if slopes:
                error = w * (1.0 / (1.0 + np.exp(-margin)) - y)
                extra[INTERCEPT] += error.sum()
                total += block.spread(error)
            else:
                hit = margin > 0
                extra[TP] += (hit & (y == 1)).sum()
                extra[FP] += (hit & (y == 0)).sum()
                extra[FN] += (~hit & (y == 1)).sum()
        yield np.concatenate((total, extra))

    found = _added(rows.opened().mapPartitions(part))
    shared.unpersist()
    return found[:-5], {k: float(found[k]) for k in (INTERCEPT, LOSS, TP, FP, FN)}


def _added(parts: RDD) -> np.ndarray:
    return parts.treeReduce(np.add) if parts.getNumPartitions() > _DRIVER_PARTS else parts.reduce(np.add)


def _curvature(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Weighted squares per place, the intercept last, and the weighted products of the places from ``shape.matrix`` on: one job."""
    shape = rows.shape
    side = shape.size + 1 - shape.matrix

    def part(blocks: Iterator[Block]) -> Iterator[np.ndarray]:
        total, products = np.zeros(shape.size + 1), np.zeros((side, side))
        for block in blocks:
            total += np.append(block.spread(block.weight, 2), block.weight.sum())
            if side:
                products += block.matrix(block.weight)
        yield np.concatenate((total, products.ravel()))

    found = _added(rows.opened().mapPartitions(part))
    return found[: shape.size + 1], found[shape.size + 1 :].reshape(side, side)


def solve(rows: Rows, size: int, n_rows: int, c: float, max_iter: int) -> Linear:
    """The minimum of the weighted mean log loss with the penalty of :func:`train`, by L-BFGS.

    Only loss and slopes come back from a pass; the driver holds a few vectors.
    A step starts from the slope through the curvature of loss and penalty at
    zero weights: all of it for numerics, categories and intercept, which depend
    on each other (lines in total are those added and those removed), and that in
    its own place for a term. Without terms this is the whole curvature, and a
    fit takes a few passes for any number of rows.
    """
    penalty = np.append(np.full(size, 1.0 / (c * n_rows)), 0.0)
    squares, products = _curvature(rows)
    own = 0.25 * squares / n_rows + penalty
    first = rows.shape.matrix
    inverse = np.linalg.pinv(0.25 * products / n_rows + np.diag(penalty[first:]), rcond=1e-15, hermitian=True)

    def through(slope: np.ndarray) -> np.ndarray:
        return np.concatenate((slope[:first] / own[:first], inverse @ slope[first:]))

    def loss(at: np.ndarray) -> tuple[float, np.ndarray]:
        pull, found = sums(rows, at[:-1], float(at[-1]), True)
        return found[LOSS] / n_rows + 0.5 * float(penalty * at @ at), np.append(pull, found[INTERCEPT]) / n_rows + penalty * at

    at = np.zeros(size + 1)
    value, slope = loss(at)
    enough = SLOPE_SHARE * np.abs(slope).max()
    moves: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=_MEMORY)
    for _ in range(max_iter):
        if np.abs(slope).max() <= enough:
            break
        ahead = _downhill(slope, moves, through)
        step = 1.0
        new_value, new_slope = loss(at + ahead)
        # A sum over tasks is exact to about 1e-15 of the loss, no step is refused for less.
        while new_value > value + 1e-4 * step * float(slope @ ahead) + 1e-14 * abs(value) and step > 1e-10:
            step /= 2
            new_value, new_slope = loss(at + step * ahead)
        moved, bent = step * ahead, new_slope - slope
        if moved @ bent > 0:
            moves.append((moved, bent))
        at, value, slope = at + moved, new_value, new_slope
    return Linear(at[:-1], float(at[-1]))


def _downhill(slope: np.ndarray, moves: deque[tuple[np.ndarray, np.ndarray]], through: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The direction of L-BFGS: the slope through the curvature that the last moves have met, and through that at the start before them."""
    pull, shares = -slope, []
    for moved, bent in reversed(moves):
        share = (moved @ pull) / (moved @ bent)
        pull = pull - share * bent
        shares.append(share)
    pull = through(pull)
    if moves:
        moved, bent = moves[-1]
        pull = pull * ((moved @ bent) / (bent @ through(bent)))
    for (moved, bent), share in zip(moves, reversed(shares)):
        pull = pull + (share - (bent @ pull) / (moved @ bent)) * moved
    return pull


def train(df: DataFrame, max_iter: int, c: float = 1.0, texts: Texts | None = None, **blocks) -> Classifier:
    """Fit on balanced class weights; scaling and vocabulary come from these rows only (:func:`fit_blocks`).

    The penalty is that of inverse strength ``c`` on the summed loss. Balanced
    weights sum to the number of rows, and the loss here is a weighted mean, so
    the strength is one over that number. Rows without a text of their own are
    read several times, so what the fit needs of them is stored.
    """
    own_text = "text_pattern" in blocks and texts is None
    if not own_text:
        df = stored(df.select("label", *blocks.get("numerics", []), *blocks.get("categories", []), *([texts.key] if texts else [])), "inputs")
    rows = features.require_labels(df)
    fitted, _ = fit_blocks(rows, texts=texts, **blocks)
    weights, n_rows = features.balanced_weights(rows)
    ready = training_rows(fitted, rows, features.weight_column(weights), "training", texts)
    model = solve(ready, fitted.size(), n_rows, c, max_iter)
    ready.release()
    if not own_text:
        discard(df)
    return fitted.with_model(model)


def train_message_and_patch(df: DataFrame, **options) -> Classifier:
    rows = df.withColumn("model_text", features.model_text(F.col("message"), F.col("patch")))
    return train(rows, 2000, text_pattern=tfidf.LONG_WORD, **options)


def train_patch_only(df: DataFrame, **options) -> Classifier:
    rows = df.withColumn("model_text", features.model_text(None, F.col("patch")))
    return train(rows, 2000, text_pattern=tfidf.WORD, **options)


def train_hybrid(df: DataFrame, **options) -> Classifier:
    """Patch text, change numerics and categories."""
    rows = features.change_columns(df).withColumn("model_text", features.model_text(None, F.col("patch")))
    return train(rows, 3000, numerics=features.CHANGE_NUMERICS, categories=features.CATEGORIES, text_pattern=tfidf.WORD, **options)


def train_historical_hybrid(df: DataFrame, texts: Texts | None = None, **options) -> Classifier:
    """As hybrid, with the nine history features. Patches come as ``texts``, or with the rows."""
    rows = features.history_columns(features.change_columns(df))
    if texts is None:
        rows = rows.withColumn("model_text", features.model_text(None, F.col("patch")))
    numerics = [*features.CHANGE_NUMERICS, *rules.HISTORY_FEATURES]
    return train(rows, 4000, texts=texts, numerics=numerics, categories=features.CATEGORIES, text_pattern=tfidf.WORD, **options)


def train_history_only(df: DataFrame, **options) -> Classifier:
    return train(features.history_columns(df, missing_days=0.0), 3000, numerics=rules.HISTORY_FEATURES, **options)


def slots(classifier: Classifier) -> DataFrame:
    """(slot, block, feature): what each place of the feature vector stands for, in the order of its blocks.

    Blocks are the terms, the numerics and one block per category, whose features
    are the category's known values. Vectors without a term have one empty place.
    """
    spark = SparkSession.active()
    named = [("numeric", name) for name in classifier.numerics]
    if classifier.one_hot is not None:
        known = classifier.one_hot.stages[0].labelsArray
        named += [(block, value) for block, values in zip(features.CATEGORIES, known) for value in values]
    offset = classifier.text.size if classifier.text else 0
    rest = spark.createDataFrame([(offset + i, *pair) for i, pair in enumerate(named)], "slot int, block string, feature string")
    if classifier.text is None:
        return rest
    return classifier.text.vocab.select(F.col("index").alias("slot"), F.lit("term").alias("block"), F.col("term").alias("feature")).unionByName(rest)


def _by_slot(**columns: np.ndarray) -> DataFrame:
    """(slot, columns) of one number per place."""
    places = len(next(iter(columns.values())))
    numbers = {"slot": pa.array(np.arange(places, dtype=np.int32))} | {n: pa.array(v, pa.float64()) for n, v in columns.items()}
    return SparkSession.active().createDataFrame(pa.table(numbers))


def weight_table(classifier: Classifier) -> DataFrame:
    """(slot, coefficient) of the fitted model."""
    return _by_slot(coefficient=classifier.model.coefficients.toArray())


def coefficients(classifier: Classifier) -> DataFrame:
    """(feature, block, coefficient, direction) of every place of the vector, largest weight first."""
    direction = F.when(F.col("coefficient") > 0, "bug-risk").otherwise("normal-change")
    named = slots(classifier).join(weight_table(classifier), "slot").withColumn("direction", direction)
    return named.select("feature", "block", "coefficient", "direction").orderBy(F.desc(F.abs("coefficient")), "block", "feature")


def vector_entries(vector: Column) -> Column:
    """The (slot, value) entries of a sparse or dense vector, column by column in Arrow."""

    @F.arrow_udf(returnType="array<struct<slot:int,value:double>>")
    def entries(x: pa.Array) -> pa.Array:
        values, indices = x.field("values"), x.field("indices")
        lengths = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        slot = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
        slot[np.repeat(x.field("type").to_numpy(zero_copy_only=False) == 0, lengths)] = indices.flatten().to_numpy(zero_copy_only=False)
        pairs = pa.StructArray.from_arrays([pa.array(slot.astype(np.int32)), values.flatten()], names=["slot", "value"])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pairs)

    return entries(vector)


def gradient(classifier: Classifier, df: DataFrame, label: str = "label", c: float = 1.0, texts: Texts | None = None) -> DataFrame:
    """(slot, block, feature, start, gradient) of the training loss for every place of the vector and the intercept.

    The loss is the weighted mean log loss plus the penalty that :func:`train`
    sets. ``gradient`` is its slope at the fitted weights, zero at the minimum,
    and ``start`` the slope where all weights are zero. Two passes over the
    blocks of the rows, whose slopes are added up per place by the tasks.
    """
    weights, n_rows = features.balanced_weights(df, label)
    rows = training_rows(classifier, df.withColumn("label", F.col(label)), features.weight_column(weights), "slopes", texts)
    fitted = classifier.model.coefficients.toArray()
    places, ends = {}, []
    for name, at, intercept in (("start", np.zeros(len(fitted)), 0.0), ("gradient", fitted, classifier.model.intercept)):
        pull, found = sums(rows, at, float(intercept), True)
        places[name] = pull / n_rows + at / (c * n_rows)
        ends.append(found[INTERCEPT] / n_rows)
    rows.release()
    intercept = SparkSession.active().createDataFrame(
        [(-1, "intercept", "intercept", *ends)], "slot int, block string, feature string, start double, gradient double"
    )
    return slots(classifier).join(_by_slot(**places), "slot").select(intercept.columns).unionByName(intercept)


def best_model(results: DataFrame) -> DataFrame:
    """The row with the highest validation F1; of equals the one with the lower loss."""
    return results.orderBy(F.desc("f1"), "loss", "model").limit(1)


def linear_probability(scaler: features.Scaler, weights: dict[str, float], intercept: float) -> Column:
    """Probability from stored means, scales and weights, as one column expression."""
    scaled = scaler.columns()
    total = F.lit(float(intercept))
    for name, weight in weights.items():
        total = total + scaled[name] * F.lit(float(weight))
    return 1.0 / (1.0 + F.exp(-total))
