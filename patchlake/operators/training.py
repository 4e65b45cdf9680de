"""Training in steps with a choice on validation data: a grid of penalties, warm starts, early stopping.

A run belongs to one penalty. Each of its steps makes a few accelerated gradient
iterations over the stored training rows and is then judged on the validation
rows by F1, ties by the lower loss. A run ends after ``patience`` steps without
gain, or after ``max_steps``. Runs go from the strongest penalty to the weakest
and each starts where the best step of the run before it ended.

A pass over the rows is one job: every task sums the slopes of its rows per place
of the vector, Spark adds them up, the driver holds the weights (one number per
place, as many as the vocabulary and the other blocks have).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from patchlake.operators import features, models

STRENGTHS = (0.01, 0.1, 1.0)
ITERATIONS = 5
MAX_STEPS = 40
PATIENCE = 2
_HISTORY = "run int, step int, c double, loss double, f1 double, gain boolean, stopped boolean, chosen boolean"


def _squares(block: models.Block) -> float:
    """Weighted square of the rows of a block, the one of the intercept among it."""
    return float(block.spread(block.weight, 2).sum() + block.weight.sum())


class _Descent:
    """Accelerated gradient descent on the weighted mean log loss with a squared penalty, the intercept left out."""

    def __init__(self, rows: models.Rows, n_rows: int, c: float, start: tuple[np.ndarray, float]):
        self.rows, self.n_rows, self.penalty = rows, n_rows, 1.0 / (c * n_rows)
        # The curvature of the log loss is a quarter at most, along the mean square of the rows at most.
        bound = rows.opened().map(_squares).fold(0.0, lambda a, b: a + b) / n_rows or 1.0
        self.rate = 1.0 / (0.25 * bound + self.penalty)
        self.now = self.before = np.append(start[0], start[1])
        self.done = 0

    def iterate(self) -> None:
        ahead = self.now + self.done / (self.done + 3.0) * (self.now - self.before)
        pull, found = models.sums(self.rows, ahead[:-1], float(ahead[-1]), True)
        slope = np.append(pull / self.n_rows + self.penalty * ahead[:-1], found[models.INTERCEPT] / self.n_rows)
        self.before, self.now, self.done = self.now, ahead - self.rate * slope, self.done + 1


@dataclass
class Choice:
    """The classifier of the best step and the history of all steps."""

    classifier: models.Classifier
    history: DataFrame


def better(f1: float, loss: float, best_f1: float, best_loss: float) -> bool:
    """Whether a step gains: a higher F1, or the same with a lower loss."""
    return f1 > best_f1 or (f1 == best_f1 and loss < best_loss)


def choose(
    train: DataFrame,
    validation: DataFrame,
    blocks: models.Classifier,
    strengths: tuple[float, ...] = STRENGTHS,
    iterations: int = ITERATIONS,
    max_steps: int = MAX_STEPS,
    patience: int = PATIENCE,
) -> Choice:
    """The best step over all runs, judged on ``validation``.

    ``blocks`` says how vectors are built (:func:`models.fit_blocks` on the
    training rows). Both sets are weighted by the classes of the training rows.
    Of equal steps the earlier one is chosen. The history has a row per step:
    run, step, inverse penalty strength, validation loss and F1, whether the step
    gained on its run, whether the run stopped after it, whether it is the choice.
    """
    spark = train.sparkSession
    train = features.require_labels(train)
    class_weights, n_rows = features.balanced_weights(train)

    def ready(df: DataFrame, name: str) -> models.Rows:
        return models.training_rows(blocks, df, features.weight_column(class_weights), name)

    rows, held = ready(train, "training"), ready(features.require_labels(validation), "validation")
    held_weight = held.opened().map(lambda block: float(block.weight.sum())).fold(0.0, lambda a, b: a + b) or 1.0
    size = blocks.size()
    start = (np.zeros(size), 0.0)
    records, best, chosen = [], None, None
    for run, c in enumerate(sorted(strengths)):
        descent = _Descent(rows, n_rows, c, start)
        run_f1, run_loss, without = -1.0, float("inf"), 0
        for step in range(1, max_steps + 1):
            for _ in range(iterations):
                descent.iterate()
            _, sums = models.sums(held, descent.now[:-1], float(descent.now[-1]), False)
            loss = sums[models.LOSS] / held_weight
            tp, fp, fn = (sums[k] for k in (models.TP, models.FP, models.FN))
            f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
            gain = better(f1, loss, run_f1, run_loss)
            if gain:
                run_f1, run_loss, without = f1, loss, 0
                start = (descent.now[:-1].copy(), float(descent.now[-1]))
            else:
                without += 1
            if best is None or better(f1, loss, *best):
                best, chosen, weights = (f1, loss), len(records), models.Linear(*start)
            records.append([run, step, float(c), float(loss), float(f1), gain, without >= patience, False])
            if without >= patience:
                break
    rows.release()
    held.release()
    if chosen is None:
        raise ValueError("no run to choose from")
    records[chosen][-1] = True
    history = spark.createDataFrame([tuple(r) for r in records], _HISTORY)
    return Choice(blocks.with_model(weights), history)
