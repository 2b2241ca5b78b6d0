"""Joins that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


ROWS_PER_TASK = 200_000  # rows of one key that a task may hold before the key is split
HOT_KEYS = 100_000  # length of the broadcast list; a key outside it has fewer than 1/100,000 of all rows


def spread_join(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    size_col: str,
    spread_by: Sequence[str],
    *,
    sizes: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Left join ``rows`` to per-key ``stats`` (one row per key, ``size_col`` = rows holding that key).

    A key with more than ``rows_per_task`` rows is hot: its rows are spread by a hash of ``spread_by`` over as many
    sub-keys as its size asks for, and its single stats row is repeated as often. The list of hot keys is broadcast; it
    holds the ``hot_keys`` largest at most, and a key beyond those has at most ``1 / hot_keys`` of all rows. Rows with
    a null key match nothing and are spread as well. ``size_col`` is dropped.

    ``sizes`` may name a cheaper table with ``keys`` and ``size_col`` to find the hot keys in, so that
    expensive statistics are not computed twice.
    """
    keys = list(keys)
    measured = stats if sizes is None else sizes
    hot = (
        measured.filter(F.col(size_col) > rows_per_task)
        .orderBy(F.desc(size_col), *keys)
        .limit(hot_keys)
        .select(*keys, F.ceil(F.col(size_col) / F.lit(rows_per_task)).cast("int").alias("_copies"))
    )
    hot = F.broadcast(hot)
    unkeyed = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    hashed = F.xxhash64(*spread_by)
    left = rows.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(F.col("_copies").isNotNull(), F.pmod(hashed, F.col("_copies")).cast("int"))
        .when(unkeyed, F.pmod(hashed, F.lit(1 << 30)).cast("int"))
        .otherwise(F.lit(0)),
    )
    repeats = F.coalesce(F.col("_copies"), F.lit(1)) - 1
    right = stats.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), repeats)))
    joined = left.drop("_copies").join(right.drop("_copies", size_col), [*keys, "_salt"], "left")
    return joined.drop("_salt")
