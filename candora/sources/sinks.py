"""Writers for splits and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candora.operators.cleaning import split_summary


def write_splits(df: DataFrame, path: str) -> DataFrame:
    """Write one Parquet folder per ``split`` and return the per-split summary of what was written."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    return split_summary(df.sparkSession.read.parquet(path))


def write_results(metrics: DataFrame, path: str, by: str = "model") -> None:
    """Write a long ``(by, metric, value)`` table as JSON, one nested object per ``by`` value."""
    entry = F.struct("metric", "value")
    nested = metrics.groupBy(by).agg(
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("metrics")
    )
    nested.write.mode("overwrite").json(path)


def read_results(spark, path: str, by: str = "model") -> DataFrame:
    """Read results written by :func:`write_results` back into the long form."""
    stored = spark.read.schema(f"{by} string, metrics map<string,double>").json(path)
    return stored.select(by, F.explode("metrics").alias("metric", "value"))
