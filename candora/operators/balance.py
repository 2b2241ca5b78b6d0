"""Class balance, focal loss and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candora.functions.columns import focal, sigmoid
from candora.plans.scalars import one_row


def class_weights(df: DataFrame, label: str = "label", classes: int = 2) -> DataFrame:
    """Inverse-frequency weight of each class, scaled so that the weights sum to ``classes``.

    A class without rows counts as one row. Result: one row per class, in one aggregation.
    """
    counts = df.agg(
        F.count(label).alias("n"),
        *[F.count(F.when(F.col(label) == c, True)).alias(f"n{c}") for c in range(classes)],
    )
    raw = [
        F.col("n") / (F.lit(classes) * F.greatest(F.col(f"n{c}"), F.lit(1))) for c in range(classes)
    ]
    mean = sum(raw[1:], raw[0]) / classes
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("label"), F.col(f"n{c}").alias("n_rows"), (raw[c] / mean).alias("weight")
            )
            for c in range(classes)
        ]
    )
    return counts.select(F.explode(rows).alias("r")).select("r.label", "r.n_rows", "r.weight")


def focal_alpha(df: DataFrame, label: str = "label") -> DataFrame:
    """Focal weight of the positive class: its share of the two class weights."""
    weights = class_weights(df, label)
    positive = F.sum(F.when(F.col("label") == 1, F.col("weight")))
    return weights.agg((positive / F.sum("weight")).alias("alpha"))


def with_class_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Attach each row's balanced class weight ``n / (classes * n_class)``."""
    counts = one_row(
        df.agg(F.count(label).alias("n"), F.count(F.when(F.col(label) == 1, True)).alias("n1"))
    )
    n, n1 = counts["n"], counts["n1"]
    positive, negative = n / (2.0 * max(n1, 1)), n / (2.0 * max(n - n1, 1))
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(positive)).otherwise(F.lit(negative)))


def focal_loss(
    df: DataFrame,
    logit: str = "logit",
    label: str = "label",
    gamma: float = 2.0,
    alpha: float | tuple[float, float] = (0.5, 0.5),
    reduction: str = "mean",
) -> DataFrame:
    """Focal loss per row (``none``, adds ``loss``) or as one row (``mean``, ``sum``)."""
    pair = (1.0 - alpha, alpha) if isinstance(alpha, float) else alpha
    per_row = df.withColumn("loss", focal(F.col(logit), F.col(label), gamma, pair))
    if reduction == "none":
        return per_row
    if reduction not in ("mean", "sum"):
        raise ValueError(f"unknown reduction: {reduction}")
    total = F.avg("loss") if reduction == "mean" else F.sum("loss")
    return per_row.agg(total.alias("loss"))


def sigmoid_score(df: DataFrame, logit: str = "logit", threshold: float = 0.5) -> DataFrame:
    """Add probability and prediction; the threshold itself counts as positive."""
    scored = df.withColumn("prob", sigmoid(F.col(logit)))
    return scored.withColumn("pred", (F.col("prob") >= threshold).cast("int"))
