"""Point-in-time variants of the reviewer features: a row only sees what was known when it was posted.

Rows are first reduced to one row per (user, time); running sums are then taken inside each day and over the days
before, so a user with a third of all reviews is spread over many tasks. Equal timestamps are not prior.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candora.functions.columns import epoch_micros
from candora.plans.ordering import bucketed_totals, exact_percentiles
from candora.plans.skew import spread_join
from candora.schema import BEHAVIOR_FEATURES, DAY_MICROS


def _history(df: DataFrame) -> DataFrame:
    """Per (user, time): totals of the user's strictly earlier rows."""
    moments = (
        df.select("user_id", epoch_micros(df, "date").alias("_t"), "rating")
        .filter(F.col("user_id").isNotNull() & F.col("_t").isNotNull())
        .groupBy("user_id", "_t")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.count("rating").alias("_n"),
            F.coalesce(F.sum("rating"), F.lit(0.0)).alias("_s"),
        )
    )
    totals = bucketed_totals(
        moments, ["user_id"], "_t", [], {"_cum_rows": "_rows", "_cum_n": "_n", "_cum_s": "_s"}, DAY_MICROS
    )
    return totals.select(
        "user_id",
        "_t",
        "_rows",
        (F.col("_cum_rows") - F.col("_rows")).alias("_prior_rows"),
        (F.col("_cum_n") - F.col("_n")).alias("_prior_n"),
        (F.col("_cum_s") - F.col("_s")).alias("_prior_s"),
    )


def _with_history(df: DataFrame) -> DataFrame:
    timed = df.withColumn("_t", epoch_micros(df, "date"))
    return spread_join(timed, _history(df), ["user_id", "_t"], "_rows", spread_by=["review_id"])


def asof_avg_rating(df: DataFrame) -> DataFrame:
    """Mean rating of the user's strictly earlier reviews; null when there are none."""
    mean = F.when(F.col("_prior_n") > 0, F.col("_prior_s") / F.col("_prior_n"))
    return _with_history(df).withColumn("asof_avg_rating", mean).drop(
        "_t", "_prior_rows", "_prior_n", "_prior_s"
    )


def asof_review_count(df: DataFrame) -> DataFrame:
    """Strictly earlier reviews of the user plus the row itself; null without user or date."""
    return _with_history(df).withColumn("asof_review_count", F.col("_prior_rows") + 1).drop(
        "_t", "_prior_rows", "_prior_n", "_prior_s"
    )


def trailing_counts(df: DataFrame, days: int = 30) -> DataFrame:
    """Per (user, time): rows ``_rows`` at that time and reviews ``c`` of the user in the ``days`` up to it.

    ``c`` is a difference of two running counts: one at the time itself, one at a probe placed ``days``
    earlier, where reviews exactly ``days`` old no longer count.
    """
    moments = (
        df.select("user_id", epoch_micros(df, "date").alias("_t"))
        .filter(F.col("user_id").isNotNull() & F.col("_t").isNotNull())
        .groupBy("user_id", "_t")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    events = moments.select("user_id", "_t", "_rows", F.col("_t").alias("_at"), F.lit(0).alias("_probe"))
    probes = moments.select(
        "user_id",
        "_t",
        F.lit(0).cast("bigint").alias("_rows"),
        (F.col("_t") - days * DAY_MICROS).alias("_at"),
        F.lit(1).alias("_probe"),
    )
    counted = bucketed_totals(
        events.unionByName(probes), ["user_id"], "_at", ["_probe", "_t"], {"_seen": "_rows"}, DAY_MICROS
    )
    signed = F.when(F.col("_probe") == 0, F.col("_seen")).otherwise(-F.col("_seen"))
    return counted.groupBy("user_id", "_t").agg(
        F.sum("_rows").alias("_rows"), F.sum(signed).alias("c")
    )


def rolling_burst_ratio(df: DataFrame, days: int = 30, k: float = 2.0) -> DataFrame:
    """One row per user: share of reviews whose trailing count exceeds the user's mean + k standard deviations."""
    counts = trailing_counts(df, days)
    weight = F.col("_rows")
    exact = F.col("c").cast("decimal(18,0)")  # sums of products with 38 digits hold any user's history
    moments = counts.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_times"),
        F.sum(weight).alias("_n"),
        F.sum(weight * exact).cast("decimal(38,0)").alias("_s1"),
        F.sum((weight * exact * exact).cast("decimal(38,0)")).cast("decimal(38,0)").alias("_s2"),
    )
    # deviations from the mean's integer part: exact, and no large squares are subtracted afterwards
    whole, n = F.floor(F.col("_s1") / F.col("_n")).cast("decimal(18,0)"), F.col("_n").cast("decimal(18,0)")
    rest = F.col("_s1") - (n * whole).cast("decimal(38,0)")
    around = F.col("_s2") - (2 * whole * F.col("_s1")).cast("decimal(38,0)") + (n * whole * whole).cast("decimal(38,0)")
    moments = moments.select(
        "user_id",
        "_times",
        (whole.cast("double") + rest.cast("double") / F.col("_n")).alias("_mean"),
        (around.cast("double") / F.col("_n") - F.pow(rest.cast("double") / F.col("_n"), F.lit(2))).alias("_variance"),
    )
    joined = spread_join(counts, moments, ["user_id"], "_times", spread_by=["_t"])
    mean, variance = F.col("_mean"), F.greatest(F.col("_variance"), F.lit(0.0))
    flagged = F.when(F.col("c") > mean + F.lit(float(k)) * F.sqrt(variance), weight).otherwise(0)
    return joined.groupBy("user_id").agg(
        F.sum(weight).alias("n_reviews"), (F.sum(flagged) / F.sum(weight)).alias("rolling_burst_ratio")
    )


def reviewer_rating_deviation(df: DataFrame) -> DataFrame:
    """Per user: mean distance of the ratings from the product's mean over genuine (label 0) rows."""
    genuine = (
        df.filter(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.avg(F.when(F.col("label") == 0, F.col("rating"))).alias("_genuine_mean"),
        )
    )
    joined = spread_join(
        df.select("review_id", "user_id", "product_id", "rating"), genuine, ["product_id"], "_rows",
        spread_by=["review_id"],
    )
    deviation = F.abs(F.col("rating") - F.col("_genuine_mean"))
    return (
        joined.filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.avg(deviation).alias("reviewer_rating_deviation"))
    )


def category_entropy(df: DataFrame) -> DataFrame:
    """Per user: Shannon entropy (natural log) of the product distribution, via sums of n and n ln n."""
    pairs = (
        df.filter(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
        .groupBy("user_id", "product_id")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    total = F.sum("_n")
    entropy = F.log(total) - F.sum(F.col("_n") * F.log(F.col("_n"))) / total
    return pairs.groupBy("user_id").agg(F.greatest(entropy, F.lit(0.0)).alias("category_entropy"))


def impute_cold_start(df: DataFrame, columns: Sequence[str] = tuple(BEHAVIOR_FEATURES)) -> DataFrame:
    """Fill nulls with the exact population median of the column (one pass for all columns)."""
    cells = df.select([F.col(c).cast("double") for c in columns]).unpivot([], list(columns), "c", "v")
    medians = exact_percentiles(cells, "v", {"median": 0.5}, ["c"]).collect()  # one row per column
    return df.withColumns(
        {r["c"]: F.coalesce(F.col(r["c"]).cast("double"), F.lit(r["median"])) for r in medians}
    )
