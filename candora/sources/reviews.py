"""Reading review tables with heterogeneous headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candora.plans.ordering import global_row_number
from candora.schema import COLUMN_ALIASES, REVIEW_COLUMNS
from candora.sources.quoted_csv import read_quoted_csv


YEAR_1, YEAR_10000 = -62_135_596_800, 253_402_300_800  # seconds since 1970


def resolve_columns(raw: DataFrame, dataset: str, by_row: bool = False) -> DataFrame:
    """Project any known header naming onto the canonical columns; absent ones become null.

    ``by_row`` takes each row's first known name that holds a value, for inputs whose rows may differ in naming.
    """
    chosen = []
    for target, candidates in COLUMN_ALIASES.items():
        source = next((c for c in candidates if c in raw.columns), None)
        if source is None:
            chosen.append(F.lit(None).cast("string").alias(target))
        elif by_row:
            chosen.append(F.coalesce(*[F.col(f"`{c}`") for c in candidates if c in raw.columns]).alias(target))
        else:
            chosen.append(F.col(f"`{source}`").alias(target))
    if "review_id" in raw.columns:
        chosen.append(F.col("review_id"))
    chosen.append(F.lit(dataset).alias("dataset"))
    resolved = raw.select(*chosen)
    return resolved.select(*[c for c in REVIEW_COLUMNS if c in resolved.columns])


def ingest_reviews(
    spark: SparkSession, path: str, dataset: str, fmt: str = "csv", multi_line: bool = True
) -> DataFrame:
    """Read delimited, JSON or Parquet reviews into the canonical columns (values untouched).

    CSV is read as strings, without a schema-inference pass, and all files of a folder must have the first one's
    header: another order of columns is an error, not a shift of values. JSON is read with the known names as strings,
    also without inference, and rows may differ in naming. ``multi_line`` keeps line breaks inside quoted text; large
    files are split among tasks all the same (:mod:`candora.sources.quoted_csv`, which reads the files twice).
    """
    if fmt == "csv" and multi_line:
        raw = read_quoted_csv(spark, path)
    elif fmt == "csv":
        raw = spark.read.csv(path, header=True, quote='"', escape='"', enforceSchema=False)
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
    elif fmt == "json":
        known = ["review_id", *(c for names in COLUMN_ALIASES.values() for c in names)]
        raw = spark.read.schema(", ".join(f"`{c}` string" for c in dict.fromkeys(known))).json(path)
        return resolve_columns(raw, dataset, by_row=True)
    else:
        raise ValueError(f"unknown format: {fmt}")
    return resolve_columns(raw, dataset)


def normalize_types(df: DataFrame) -> DataFrame:
    """Rating to double, label to int, date from epoch seconds or an ISO string; bad values become null.

    Not-a-number, infinities, labels beyond an int and dates outside the years 1 to 9999 are bad values.
    """
    number = F.col("rating").cast("string").try_cast("double")
    rating = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    label = F.col("label").cast("string").try_cast("double")
    raw_date = F.col("date").cast("string")
    seconds = raw_date.try_cast("double")
    dated = F.when(seconds.between(YEAR_1, YEAR_10000 - 1e-6), seconds)
    epoch = F.timestamp_micros(F.round(dated * 1_000_000).cast("bigint"))
    iso = F.try_to_timestamp(raw_date)
    return (
        df.withColumn("rating", rating)
        .withColumn("label", F.when((label == F.round(label)) & (F.abs(label) <= 2147483647), label).cast("int"))
        .withColumn("date", F.coalesce(epoch, iso).cast("timestamp_ntz"))
    )


def surrogate_review_id(df: DataFrame, order_cols: Sequence[str]) -> DataFrame:
    """Add ``review_id`` = 'r' + zero-padded 0-based position in the order of ``order_cols``.

    A Spark table has no stored row position, so the caller names a key list that orders it totally.
    """
    if "review_id" in df.columns:
        return df
    numbered = global_row_number(df, list(order_cols), "_row")
    return numbered.withColumn("review_id", F.format_string("r%08d", F.col("_row"))).drop("_row")
