"""Two closed-form learners that SQL can reproduce, for checking the resampling operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candora.functions.columns import dot, sigmoid
from candora.operators.validation import Fit, Score
from candora.plans.scalars import one_row
from candora.plans.skew import spread_join


def rate_fit(column: str) -> Fit:
    """Score = the training share of fakes among rows with the same value of ``column``."""

    def fit(train: DataFrame) -> Score:
        base = one_row(train.agg(F.avg("label").alias("rate")))["rate"]
        rates = train.groupBy(column).agg(
            F.count(F.lit(1)).alias("_rows"), F.avg("label").alias("_rate")
        )

        def score(df: DataFrame) -> DataFrame:
            joined = spread_join(df, rates, [column], "_rows", spread_by=["review_id"])
            prob = F.coalesce("_rate", F.lit(base))
            return joined.withColumn("prob", prob).withColumn(
                "pred", (F.col("prob") >= base).cast("int")
            ).drop("_rate")

        return score

    return fit


def centroid_fit(train: DataFrame) -> Score:
    """Linear score along the difference of the class means, zero halfway between them."""
    width = one_row(train.agg(F.max(F.size("features")).alias("w")))["w"]

    def means(label: int):
        chosen = F.col("label") == label
        return [F.avg(F.when(chosen, F.col("features")[j])) for j in range(width)]

    row = one_row(train.agg(*means(1), *means(0)))
    fake, genuine = row[:width], row[width:]
    weights = [a - b for a, b in zip(fake, genuine, strict=True)]
    offset = sum(w * (a + b) / 2 for w, a, b in zip(weights, fake, genuine, strict=True))

    def score(df: DataFrame) -> DataFrame:
        logit = dot(F.col("features"), weights) - F.lit(offset)
        return df.withColumn("prob", F.round(sigmoid(logit), 9)).withColumn("pred", (logit >= 0).cast("int"))

    return score
