"""Shared steps of the operators: written tables, text passes, spread joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from candora.plans.skew import spread_join
from candora.plans.storage import scratch_path

#: Rows handed to Python at a time; texts of some megabytes each still fit a worker's memory.
BATCH_ROWS = 2000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back: computed once, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_chunks(rows: DataFrame, name: str) -> DataFrame:
    """Write rows with a ``_chunk`` name, a few large ones per task, to a table bucketed by it below the shared folder.

    Later steps group it by chunk together with small tables of findings, and only the findings are shuffled.
    """
    spark = rows.sparkSession
    table = f"candora_{name}_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    writer = rows.write.bucketBy(buckets, "_chunk").option("compression", "zstd")
    writer.option("path", scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def over_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """Apply ``work`` to each Arrow batch of ``df``; its input never holds more than :data:`BATCH_ROWS` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH_ROWS):
                out = work(batch.slice(low, BATCH_ROWS))
                if out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def attach(rows: DataFrame, stats: DataFrame, keys: Sequence[str], size: str, spread_by: Sequence[str]) -> DataFrame:
    """Left join ``rows`` to one row per key; keys with very many rows are spread over several tasks (``size`` stays)."""
    return spread_join(rows, stats.withColumn("_rows_of_key", F.col(size)), keys, "_rows_of_key", spread_by)
