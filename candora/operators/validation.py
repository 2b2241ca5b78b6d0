"""Model protocol and resampling experiments.

A learner is ``fit(train) -> score`` where ``score(rows)`` returns the rows with ``pred`` and ``prob`` added.
Only the loop over folds or feature slices runs on the driver; all scored rows are stacked and measured as
one grouped job.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candora.operators.cleaning import slice_branch
from candora.operators.evaluation import aggregate_folds, all_metrics, roc_curve, to_long
from candora.plans.scalars import one_row
from candora.plans.storage import freeze

Score = Callable[[DataFrame], DataFrame]
Fit = Callable[[DataFrame], Score]

SCORED = ("review_id", "label", "pred", "prob")


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def score_folds(df: DataFrame, folds: DataFrame, fit: Fit, keep: Sequence[str] = ()) -> DataFrame:
    """Scored test rows of every fold; ``folds`` holds ``(review_id, fold, role)``.

    A row's roles become one column by a single join; each fold then filters the stored rows.
    """
    folds = freeze(folds)
    numbers = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").collect()]
    roles = folds.groupBy("review_id").agg(  # as many entries as folds
        F.map_from_entries(F.collect_list(F.struct("fold", "role"))).alias("_roles")
    )
    rows = freeze(df.join(roles, "review_id"))
    parts = []
    for number in numbers:
        role = F.col("_roles")[number]
        train, test = (rows.filter(role == name).drop("_roles") for name in ("train", "test"))
        parts.append(fit(train)(test).select(*SCORED, *keep, F.lit(number).alias("fold")))
    return _stack(parts)


def folds_from_numbers(df: DataFrame, k: int) -> DataFrame:
    """``(review_id, fold, role)`` from a ``fold`` column that names each row's test fold."""
    every = df.select("review_id", F.col("fold").alias("_own")).withColumn(
        "fold", F.explode(F.sequence(F.lit(1), F.lit(k)))
    )
    role = F.when(F.col("fold") == F.col("_own"), "test").otherwise("train")
    return every.select("review_id", "fold", role.alias("role"))


class CrossValidation:
    """Results of one cross-validation: scored rows and everything derived from them."""

    def __init__(self, scored: DataFrame) -> None:
        self.scored = scored

    def fold_metrics(self) -> DataFrame:
        return all_metrics(self.scored, ["fold"])

    def aggregated(self) -> DataFrame:
        return aggregate_folds(to_long(self.fold_metrics(), ["fold"]))

    def curves(self) -> DataFrame:
        return roc_curve(self.scored, ["fold"])


def cross_validate(df: DataFrame, folds: DataFrame, fit: Fit) -> CrossValidation:
    """Fit on each fold's train rows, score its test rows."""
    return CrossValidation(freeze(score_folds(df, folds, fit)))


def score_all(train: DataFrame, test: DataFrame, learners: Mapping[str, Fit]) -> DataFrame:
    """Every learner fitted on ``train``: scored ``test`` rows as ``(model, review_id, label, pred, prob)``."""
    parts = [fit(train)(test).select(*SCORED, F.lit(name).alias("model")) for name, fit in learners.items()]
    return freeze(_stack(parts))


def compared(scored: DataFrame) -> DataFrame:
    """Long ``(model, section, metric, value)`` of scored rows, one grouped job for all models."""
    return to_long(all_metrics(scored, ["model"]), ["model"]).withColumn("section", F.lit("in_domain"))


def ablation(
    train: DataFrame, test: DataFrame, slices: Mapping[str, tuple[int, int]], fit: Fit, full: str,
    column: str = "features",
) -> DataFrame:
    """The same learner on several vector slices: metrics and differences to ``full`` in percentage points."""
    parts = []
    for name, (low, high) in slices.items():
        scored = fit(slice_branch(train, column, low, high))(slice_branch(test, column, low, high))
        parts.append(scored.select(*SCORED, F.lit(name).alias("config")))
    metrics = freeze(all_metrics(_stack(parts), ["config"]).select("config", "auc_roc", "macro_f1"))
    base = one_row(metrics.filter(F.col("config") == full))
    return metrics.select(
        "config",
        "auc_roc",
        "macro_f1",
        ((F.col("auc_roc") - base["auc_roc"]) * 100).alias("auc_delta_pp"),
        ((F.col("macro_f1") - base["macro_f1"]) * 100).alias("f1_delta_pp"),
    )


def cross_domain_eval(
    source: DataFrame, target: DataFrame, models: Mapping[str, Fit]
) -> DataFrame:
    """Fit each model on the source table and measure it on the target table without refitting."""
    parts = [
        fit(source)(target).select(*SCORED, F.lit(name).alias("model")) for name, fit in models.items()
    ]
    return all_metrics(_stack(parts), ["model"])
