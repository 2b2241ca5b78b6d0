"""Cleaning, profiling and vector shaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candora.functions.columns import pad_vector, ratio, strip, words


def clean_reviews(df: DataFrame) -> DataFrame:
    """Drop rows without label or text, trim the text, drop blank text, make the label an integer."""
    return (
        df.filter(F.col("label").isNotNull() & F.col("text").isNotNull())
        .withColumn("text", strip(F.col("text")))
        .filter(F.length("text") > 0)
        .withColumn("label", F.col("label").cast("int"))
    )


def cleaning_report(df: DataFrame) -> DataFrame:
    """One row: rows before cleaning, rows kept, rows dropped. One pass."""
    usable = (
        F.col("label").isNotNull()
        & F.col("text").isNotNull()
        & (F.length(strip(F.col("text"))) > 0)
    )
    kept = F.count(F.when(usable, True))
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        kept.alias("rows_kept"),
        (F.count(F.lit(1)) - kept).alias("rows_dropped"),
    )


def text_lengths(df: DataFrame) -> DataFrame:
    """Word and character count of each text."""
    return df.withColumn("text_length", F.size(words(F.col("text")))).withColumn(
        "char_length", F.length("text")
    )


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row of totals for the whole table."""
    total = F.count(F.lit(1))
    fake = F.count(F.when(F.col("label") == 1, True))
    genuine = F.count(F.when(F.col("label") == 0, True))
    return df.agg(
        total.alias("n_reviews"),
        fake.alias("n_fake"),
        (ratio(fake, total) * 100).alias("pct_fake"),
        genuine.alias("n_genuine"),
        (ratio(genuine, total) * 100).alias("pct_genuine"),
        F.countDistinct("user_id").alias("n_users"),
        F.countDistinct("product_id").alias("n_products"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )


def split_summary(df: DataFrame) -> DataFrame:
    """Size and label balance of each split."""
    total = F.count(F.lit(1))
    fake = F.count(F.when(F.col("label") == 1, True))
    return df.groupBy("split").agg(
        total.alias("n_reviews"),
        fake.alias("n_fake"),
        F.count(F.when(F.col("label") == 0, True)).alias("n_genuine"),
        ratio(fake, total).alias("fake_rate"),
    )


def to_vectors(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """Gather wide numeric columns into one double array."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in columns])).drop(*columns)


def pad_features(df: DataFrame, column: str, width: int) -> DataFrame:
    return df.withColumn(column, pad_vector(F.col(column), width))


def slice_branch(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Keep vector positions ``[low, high)``."""
    return df.withColumn(column, F.slice(column, low + 1, high - low))


def fuse_features(
    text: DataFrame, behavior: DataFrame, on: str = "review_id", column: str = "features"
) -> DataFrame:
    """Keyed join of the two branches into one vector, text first."""
    left = text.withColumnRenamed(column, "_text")
    right = behavior.select(on, F.col(column).alias("_behavior"))
    joined = left.join(right, on, "inner")
    return joined.withColumn(column, F.concat("_text", "_behavior")).drop("_text", "_behavior")


def train_eval_union(first: DataFrame, second: DataFrame) -> DataFrame:
    """Stack two row sets by column name."""
    return first.unionByName(second)
