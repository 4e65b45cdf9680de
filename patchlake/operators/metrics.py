"""Confusion counts, metrics and per-class reports of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _share(part: Column, whole: Column) -> Column:
    """Quotient, with zero for a zero denominator."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """True and false positives and negatives in one row."""
    truth, guess = F.col(label) == 1, F.col(prediction) == 1
    return df.agg(
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(~truth & ~guess).alias("tn"),
        F.count_if(truth & ~guess).alias("fn"),
    )


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per true label, one column per predicted label."""
    guess = F.col(prediction)
    return df.groupBy(F.col(label).alias("label")).agg(
        F.count_if(guess == 0).alias("predicted_0"), F.count_if(guess == 1).alias("predicted_1")
    )


def metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall and F1 from confusion counts."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        "*",
        _share(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, with macro and weighted means."""
    pairs = df.groupBy(F.col(label).alias("t"), F.col(prediction).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    # Every pair counts once for its true class and once for its predicted one.
    sides = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("t").alias("c"), F.lit(1).alias("as_true"), F.lit(0).alias("as_guess")),
                F.struct(F.col("g").alias("c"), F.lit(0).alias("as_true"), F.lit(1).alias("as_guess")),
            )
        ).alias("s"),
        (F.col("t") == F.col("g")).cast("int").alias("hit"),
        "n",
    )
    per_class = (
        sides.groupBy(F.col("s.c").alias("c"))
        .agg(
            F.sum(F.col("n") * F.col("hit") * F.col("s.as_true")).alias("hits"),
            F.sum(F.col("n") * F.col("s.as_true")).alias("support"),
            F.sum(F.col("n") * F.col("s.as_guess")).alias("guessed"),
        )
        .select(
            F.col("c").cast("string").alias("class"),
            _share(F.col("hits"), F.col("guessed")).alias("precision"),
            _share(F.col("hits"), F.col("support")).alias("recall"),
            _share(2 * F.col("hits"), F.col("support") + F.col("guessed")).alias("f1"),
            "support",
        )
    )
    names = ["precision", "recall", "f1"]
    means = per_class.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        *[_share(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}") for c in names],
        F.coalesce(F.sum("support"), F.lit(0)).alias("support"),
    )
    averages = means.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(f"{kind} avg").alias("class"), *[F.col(f"{kind}_{c}").alias(c) for c in names], "support")
                    for kind in ("macro", "weighted")
                ]
            )
        ).alias("row")
    ).select("row.*")
    return per_class.unionByName(averages)


def prediction_records(df: DataFrame, records: DataFrame | None = None, key: str = "record_id") -> DataFrame:
    """Predictions with the identity of their record and whether they are right."""
    joined = df if records is None else df.join(records.select(key, "repo_id", "commit"), key)
    identity = [c for c in (key, "repo_id", "commit") if c in joined.columns]
    return joined.select(
        *identity,
        F.col("label").cast("int").alias("true_label"),
        F.col("prediction").cast("int").alias("predicted_label"),
        (1.0 - F.col("probability_bug_fix")).alias("probability_non_bug_fix"),
        "probability_bug_fix",
        (F.col("label") == F.col("prediction")).alias("correct"),
    )
