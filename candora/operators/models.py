"""Baseline classifiers behind the ``fit(train) -> score(rows)`` protocol.

Inputs are ``(review_id, label, features)`` with ``features`` a double array or an ML vector.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candora.functions.columns import sigmoid
from candora.operators import linear
from candora.operators.forest import ForestScore, random_forest, rf_feature_importance
from candora.operators.splits import stratified_kfold
from candora.operators.text import tfidf_fit, tfidf_vectors
from candora.operators.validation import Fit, Score
from candora.plans.storage import freeze

__all__ = [
    "ForestScore", "LogisticScore", "SvmScore", "as_vectors", "linear_svm_calibrated", "logreg_balanced", "on_tfidf", "random_forest",
    "rf_feature_importance",
]

TOLERANCE = 1e-4  # the gradient's fall, relative to the first one, at which the iterative learners stop


def as_vectors(df: DataFrame, column: str = "features") -> DataFrame:
    """ML vectors from double arrays; vectors pass through."""
    if isinstance(df.schema[column].dataType, VectorUDT):
        return df
    return df.withColumn(column, array_to_vector(F.col(column).cast("array<double>")))


class LogisticScore:
    """Fitted logistic regression: callable on rows. ``weights`` has a row, the intercept last."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights

    def __call__(self, df: DataFrame) -> DataFrame:
        scored = linear.margins(df, self.weights)
        scored = scored.withColumn("prob", sigmoid(F.col("_margins")[0])).drop("_margins")
        return scored.withColumn("pred", (F.col("prob") > 0.5).cast("int"))


def logreg_balanced(
    train: DataFrame, c: float = 1.0, max_iter: int = 100, tolerance: float = TOLERANCE
) -> LogisticScore:
    """L2 logistic regression with balanced class weights: ``|w|^2 / 2`` plus ``c`` times the summed, weighted losses.

    The intercept isn't penalised. Rows without a label take no part; what is missing in a vector counts as 0.
    """
    blocks, width, seen = linear.packed(train.select("label", "features"))
    classes = c * linear.balanced(seen.sum(axis=0))[None, :]
    weights = linear.solve(blocks, width, linear.LOGISTIC, classes, False, max_iter, tolerance)
    blocks.unpersist()
    return LogisticScore(weights)


class SvmScore:
    """Calibrated linear machines, one per fold: callable on rows.

    ``weights`` has a row per machine (the intercept last), ``curves`` the slope and offset of its sigmoid.
    """

    def __init__(self, weights: np.ndarray, curves: np.ndarray) -> None:
        self.weights, self.curves = weights, curves

    def __call__(self, df: DataFrame, margins: bool = False) -> DataFrame:
        """Add ``prob`` and ``pred``; with ``margins`` also each machine's margin, as the array ``_margins``."""
        scored = linear.margins(df, self.weights)
        parts = [sigmoid(F.col("_margins")[k] * float(a) + float(b)) for k, (a, b) in enumerate(self.curves)]
        scored = scored.withColumn("prob", sum(parts[1:], parts[0]) / len(parts))
        scored = scored.withColumn("pred", (F.col("prob") > 0.5).cast("int"))
        return scored if margins else scored.drop("_margins")


def linear_svm_calibrated(train: DataFrame, c: float = 1.0, folds: int = 3, max_iter: int = 100, tolerance: float = TOLERANCE) -> SvmScore:
    """Balanced linear machine (squared hinge loss, the intercept penalised) whose margin is made a probability by a sigmoid.

    Each of ``folds`` machines is fitted on the other folds, all of them side by side, and calibrated on its own fold;
    probabilities are averaged over the machines. Rows without a label take no part.
    """
    rows = freeze(train.select("review_id", "label", "features").withColumn("_row", F.monotonically_increasing_id()))
    numbers = stratified_kfold(rows.select("review_id", "label", "_row"), folds)  # ranked without the vectors
    numbered = rows.join(numbers.select("_row", "fold"), "_row")
    blocks, width, seen = linear.packed(numbered)
    own = np.zeros((folds + 1, 2))
    own[: len(seen)] = seen
    rest = own.sum(axis=0) - own[1:]
    weights = linear.solve(blocks, width, linear.SQUARED_HINGE, c * linear.balanced(rest), True, max_iter, tolerance)
    curves = linear.platt(blocks, weights, own[1:])
    blocks.unpersist()
    return SvmScore(weights, curves)


def on_tfidf(learner: Fit, max_features: int = 50_000, min_df: int = 2) -> Fit:
    """A learner on text: vocabulary and document frequencies come from the training texts only."""

    def fit(train: DataFrame) -> Score:
        model = tfidf_fit(train, max_features, min_df)
        inner = learner(tfidf_vectors(train, model))

        def score(df: DataFrame) -> DataFrame:
            return inner(tfidf_vectors(df, model))

        return score

    return fit
