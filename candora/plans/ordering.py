"""Exact global order without a one-task sort.

A window without partition keys, or one over a hot key, moves everything to one task. The helpers here
range-partition on the full sort key instead (ties are split by the later sort columns), freeze that layout,
and add one small offset per range chunk. All per-task work is bounded by the chunk size, whatever the
distribution of the keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candora.plans.skew import spread_join
from candora.plans.storage import freeze

_POSITION_BITS = 33  # layout of monotonically_increasing_id: partition << 33 | position


def _chunked(df: DataFrame, order: Sequence[str | Column]) -> tuple[DataFrame, int]:
    """Sorted, frozen copy of ``df`` with ``_o_chunk`` (range partition) and ``_o_pos`` (row within it)."""
    placed = freeze(df.orderBy(*order).withColumn("_o_id", F.monotonically_increasing_id()))
    chunks = placed.rdd.getNumPartitions()
    placed = placed.withColumn("_o_chunk", F.shiftright("_o_id", _POSITION_BITS))
    placed = placed.withColumn("_o_pos", F.col("_o_id").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
    return placed.drop("_o_id"), chunks


def global_row_number(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """0-based position of every row in the total order ``order`` (which must break all ties)."""
    placed, chunks = _chunked(df, order)
    if chunks <= 1:
        return placed.withColumn(out, F.col("_o_pos")).drop("_o_chunk", "_o_pos")
    sizes = placed.groupBy("_o_chunk").agg(F.count(F.lit(1)).alias("_o_n"))
    before = Window.orderBy("_o_chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row per chunk
    offsets = sizes.select("_o_chunk", F.coalesce(F.sum("_o_n").over(before), F.lit(0)).alias("_o_offset"))
    numbered = placed.join(F.broadcast(offsets), "_o_chunk")
    return numbered.withColumn(out, F.col("_o_pos") + F.col("_o_offset")).drop("_o_chunk", "_o_pos", "_o_offset")


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[str | Column], totals: Mapping[str, str]
) -> DataFrame:
    """Inclusive running sums within each ``by`` group, in ``order``.

    ``totals`` maps output column to summed column. Groups may span any number of chunks: each chunk's
    leading group receives the sum of what the chunks before it hold for that group.
    """
    by = list(by)
    placed, chunks = _chunked(df, [*by, *order])
    inside = (
        Window.partitionBy("_o_chunk", *by).orderBy("_o_pos").rowsBetween(Window.unboundedPreceding, 0)
    )
    summed = placed
    for out, source in totals.items():
        summed = summed.withColumn(out, F.sum(source).over(inside))
    if chunks <= 1:
        return summed.drop("_o_chunk", "_o_pos")

    key = F.struct(*[F.col(c) for c in by], F.lit(0).alias("_o_one"))
    edges = placed.groupBy("_o_chunk").agg(
        F.min_by(key, "_o_pos").alias("_o_head"), F.max_by(key, "_o_pos").alias("_o_tail")
    )
    tail_rows = placed.withColumn("_o_key", key).join(F.broadcast(edges), "_o_chunk")
    tails = (
        tail_rows.filter(F.col("_o_key").eqNullSafe(F.col("_o_tail")))
        .groupBy("_o_chunk", "_o_key")
        .agg(*[F.sum(source).alias(f"_ot_{out}") for out, source in totals.items()])
    )
    heads = edges.filter(~F.col("_o_head").eqNullSafe(F.col("_o_tail"))).select(
        "_o_chunk", F.col("_o_head").alias("_o_key"), *[F.lit(0).alias(f"_ot_{out}") for out in totals]
    )
    earlier = (  # at most two rows per chunk take part
        Window.partitionBy("_o_key").orderBy("_o_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = tails.unionByName(heads).select(
        F.col("_o_chunk").alias("_o_c"),
        F.col("_o_key").alias("_o_k"),
        *[F.sum(f"_ot_{out}").over(earlier).alias(f"_oc_{out}") for out in totals],
    )
    joined = summed.withColumn("_o_key", key).join(
        F.broadcast(carry),
        (F.col("_o_chunk") == F.col("_o_c")) & F.col("_o_key").eqNullSafe(F.col("_o_k")),
        "left",
    )
    for out in totals:
        joined = joined.withColumn(out, F.col(out) + F.coalesce(F.col(f"_oc_{out}"), F.lit(0)))
    return joined.drop("_o_chunk", "_o_pos", "_o_key", "_o_c", "_o_k", *[f"_oc_{out}" for out in totals])


BUCKET_ROWS = 2_000_000  # rows of one bucket that a task sums up


def bucketed_totals(
    df: DataFrame, by: Sequence[str], at: str, ties: Sequence[str | Column], totals: Mapping[str, str], width: int
) -> DataFrame:
    """Inclusive running sums within each ``by`` group in the order of ``at`` (whole numbers) and ``ties``.

    Two levels instead of a global order: sums inside buckets of ``width`` along ``at``, and over a group's buckets the
    sums of the buckets before. A hot group is spread over its buckets. If a single bucket holds more than
    :data:`BUCKET_ROWS` rows, the sums come from :func:`running_totals`.
    """
    by = list(by)
    bucketed = df.withColumn("_b", F.floor(F.col(at) / F.lit(width)))
    sizes = bucketed.groupBy(*by, "_b").agg(
        F.count(F.lit(1)).alias("_b_rows"), *[F.sum(source).alias(f"_b_{out}") for out, source in totals.items()]
    )
    sizes = freeze(sizes)
    if (sizes.agg(F.max("_b_rows").alias("n")).collect()[0]["n"] or 0) > BUCKET_ROWS:
        return running_totals(df, by, [at, *ties], totals)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sizes.select(*by, "_b", *[F.sum(f"_b_{out}").over(before).alias(f"_b_{out}") for out in totals])
    inside = Window.partitionBy(*by, "_b").orderBy(at, *ties).rowsBetween(Window.unboundedPreceding, 0)
    summed = bucketed.withColumns({out: F.sum(source).over(inside) for out, source in totals.items()})
    joined = summed.join(earlier, [*by, "_b"])
    names = {out: F.col(out) + F.coalesce(F.col(f"_b_{out}"), F.lit(0)) for out in totals}
    return joined.withColumns(names).drop("_b", *[f"_b_{out}" for out in totals])


def exact_percentiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact linearly interpolated percentiles of the non-null values, one row per ``by`` group.

    Works on distinct values and their counts, so a heavily repeated value costs one row.
    """
    return percentiles_of_counts(value_counts(df, value, by), value, probs, by)


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct non-null values per group with their number of rows ``n``."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value)
    return counted.agg(F.count(F.lit(1)).alias("n"))


def percentiles_of_counts(
    counts: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """:func:`exact_percentiles` from a table of :func:`value_counts`."""
    by = list(by)
    group = by or ["_all"]
    source = counts if by else counts.withColumn("_all", F.lit(0))
    source = source.select(*group, F.col(value).alias("_v"), F.col("n").alias("_n"))
    ranked = running_totals(source, group, ["_v"], {"_cum": "_n"})
    sizes = ranked.groupBy(*group).agg(
        F.sum("_n").alias("_size"), F.count(F.lit(1)).alias("_rows")
    )
    sized = spread_join(ranked, sizes, group, "_rows", spread_by=["_v"])
    picks = []
    for name, p in probs.items():
        at = (F.col("_size") - 1) * F.lit(float(p))
        low = F.min(F.when(F.col("_cum") > F.floor(at), F.col("_v")))
        high = F.min(F.when(F.col("_cum") > F.ceil(at), F.col("_v")))
        part = F.max(at - F.floor(at))
        picks.append((low + (high - low) * part).alias(name))
    out = sized.groupBy(*group).agg(*picks)
    return out if by else out.drop("_all")
