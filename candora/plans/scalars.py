"""Fitted constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row


def one_row(df: DataFrame) -> Row:
    """The single row of an ungrouped aggregation, for use as constants in a later plan."""
    return df.collect()[0]
