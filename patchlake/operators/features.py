"""Fitted features: scaling, one-hot categories, class weights, label checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, functions as F

from patchlake import rules
from patchlake.functions.numeric import number
from patchlake.functions.paths import extension

CHANGE_NUMERICS = ["added", "removed", "total_changes", "change_balance"]
CATEGORIES = ["change_type", "extension"]


@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per column; a zero deviation counts as one."""

    mean: dict[str, float]
    scale: dict[str, float]

    def columns(self) -> dict[str, Column]:
        return {c: (F.col(c) - F.lit(self.mean[c])) / F.lit(self.scale[c]) for c in self.mean}

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns())


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    """One aggregate over the training rows; only two numbers per column reach the driver."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    return Scaler(
        {c: float(row[f"m_{c}"] or 0.0) for c in columns},
        {c: float(row[f"s_{c}"] or 0.0) or 1.0 for c in columns},
    )


def change_columns(df: DataFrame, added: str = "added_line_count", removed: str = "removed_line_count") -> DataFrame:
    """Four change numerics and the two categories of a file-level record."""
    plus, minus = number(F.col(added)), number(F.col(removed))
    return df.withColumns(
        {
            "added": plus,
            "removed": minus,
            "total_changes": plus + minus,
            "change_balance": plus - minus,
            "change_type": F.coalesce("change_type", F.lit("unknown")),
            "extension": extension(F.col("file_path")),
        }
    )


def history_columns(df: DataFrame, struct: str = "historical_features", missing_days: float = -1.0) -> DataFrame:
    """The nine history features as double columns; days without a change are -1, the rest 0.

    The history-only model reads a missing feature, days included, as zero:
    pass ``missing_days=0``.
    """

    def value(name: str) -> Column:
        missing = missing_days if name == "days_since_last_change" else 0.0
        return F.coalesce(F.col(f"{struct}.{name}").cast("double"), F.lit(missing))

    return df.withColumns({n: value(n) for n in rules.HISTORY_FEATURES})


def one_hot_stages(columns: list[str]) -> list:
    """Index and one-hot stages; an unseen category becomes all zeros."""
    indexed = [f"{c}_index" for c in columns]
    return [
        StringIndexer(inputCols=columns, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=[f"{c}_onehot" for c in columns], handleInvalid="error", dropLast=True),
    ]


def fit_one_hot(df: DataFrame, columns: list[str]):
    return Pipeline(stages=one_hot_stages(columns)).fit(df)


def class_weights(df: DataFrame, label: str = "label", classes: int = 2) -> DataFrame:
    """Per class: balanced weight n / (k * count), and the weight relative to class 0."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("records"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    negatives = df.agg(F.count_if(F.col(label) == 0).alias("n")).scalar()
    return counts.select(
        "label",
        "records",
        (total.cast("double") / (classes * F.greatest("records", F.lit(1)))).alias("balanced_weight"),
        F.when(F.col("label") == 1, negatives.cast("double") / F.col("records")).otherwise(1.0).alias("relative_weight"),
    )


def balanced_weights(df: DataFrame, label: str = "label") -> tuple[dict[int, float], int]:
    """Balanced weight by class and the number of rows; one aggregate, one driver row per class."""
    counts = {r[0]: r[1] for r in df.groupBy(label).agg(F.count(F.lit(1))).collect()}
    total = sum(counts.values())
    return {c: total / (len(counts) * n) for c, n in counts.items()}, total


def weight_column(weights: dict[int, float], label: str = "label") -> Column:
    pairs = [F.lit(x) for c, w in weights.items() for x in (c, float(w))]
    return F.create_map(*pairs)[F.col(label)]


def invalid_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(~F.coalesce(F.col(label).isin(0, 1), F.lit(False)))


def require_labels(df: DataFrame, label: str = "label") -> DataFrame:
    bad = invalid_labels(df, label).select(label).first()
    if bad is not None:
        raise ValueError(f"label must be 0 or 1, found {bad[0]!r}")
    return df


def model_text(message: Column | None, patch: Column) -> Column:
    """Message and patch with a blank line between, or the patch alone."""
    body = F.coalesce(patch, F.lit(""))
    return body if message is None else F.concat(F.coalesce(message, F.lit("")), F.lit("\n\n"), body)
