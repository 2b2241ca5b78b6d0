"""Reviewer-behaviour features over the whole table.

Statistics are pre-aggregated per user and per product (map-side combine keeps hot keys cheap) and joined
back with salted hot keys, so no task ever holds one user's or one product's rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candora.functions.columns import epoch_micros, pad_vector
from candora.plans.ordering import running_totals
from candora.plans.skew import spread_join
from candora.plans.storage import freeze
from candora.schema import BEHAVIOR_FEATURES, DAY_MICROS

LINEAR_LIMIT = 1_000_000  # most distinct review times of one user that pass through one task
BROADCAST_LIMIT = 100_000  # most user ids that are ever broadcast


def _per_user(df: DataFrame, *aggregates: Column) -> DataFrame:
    return (
        df.filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("_rows"), *aggregates)
    )


def _attach(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Join statistics back to the rows. They are computed once; their row counts tell which keys are hot."""
    return spread_join(df, freeze(stats), [key], "_rows", spread_by=["review_id"])


def _or_zero(df: DataFrame, name: str, value: Column | None = None) -> DataFrame:
    value = F.col(name) if value is None else value
    return df.withColumn(name, F.coalesce(value.cast("double"), F.lit(0.0)))


def avg_star_rating(df: DataFrame) -> DataFrame:
    """Mean of the user's ratings over all rows."""
    stats = _per_user(df, F.avg("rating").alias("avg_star_rating"))
    return _or_zero(_attach(df, stats, "user_id"), "avg_star_rating")


def review_count(df: DataFrame) -> DataFrame:
    """Number of the user's rows; 0 where the user is unknown."""
    stats = _per_user(df, F.count(F.lit(1)).alias("review_count"))
    return _or_zero(_attach(df, stats, "user_id"), "review_count")


def _product_means(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(F.count(F.lit(1)).alias("_rows"), F.avg("rating").alias("_product_mean"))
    )


def rating_deviation(df: DataFrame) -> DataFrame:
    """Distance of the rating from the product's mean rating."""
    joined = _attach(df, _product_means(df), "product_id")
    deviation = F.abs(F.col("rating") - F.col("_product_mean"))
    return _or_zero(joined, "rating_deviation", deviation).drop("_product_mean")


def _diversity() -> Column:
    reviewed = F.greatest(F.count("product_id"), F.lit(1))
    return F.countDistinct("product_id") / reviewed


def category_diversity(df: DataFrame) -> DataFrame:
    """Distinct products per review of the user."""
    stats = _per_user(df, _diversity().alias("category_diversity"))
    return _or_zero(_attach(df, stats, "user_id"), "category_diversity")


def _age_days(now: Column, first: Column) -> Column:
    return F.floor((now - first) / F.lit(DAY_MICROS))


def account_age_at_review(df: DataFrame) -> DataFrame:
    """Whole elapsed days (not calendar days) since the user's first review."""
    timed = df.withColumn("_now", epoch_micros(df, "date"))
    stats = _per_user(timed, F.min("_now").alias("_first"))
    joined = _attach(timed, stats, "user_id")
    age = _age_days(F.col("_now"), F.col("_first"))
    return _or_zero(joined, "account_age_at_review", age).drop("_now", "_first")


# --- burst windows -------------------------------------------------------------------------------------


def _review_times(df: DataFrame) -> DataFrame:
    """Distinct review times per user with the number of reviews at each."""
    return (
        df.select("user_id", epoch_micros(df, "date").alias("t"))
        .filter(F.col("user_id").isNotNull() & F.col("t").isNotNull())
        .groupBy("user_id", "t")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _split_by_weight(times: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Users whose times pass through one task, and the others (None when there are none)."""
    times = freeze(times)
    heavy = times.groupBy("user_id").agg(F.count(F.lit(1)).alias("_rows"))
    heavy = heavy.filter(F.col("_rows") > LINEAR_LIMIT)
    found = heavy.count()
    if found == 0:
        return times, None
    heavy = freeze(heavy)
    if found <= BROADCAST_LIMIT:
        ids = F.broadcast(heavy.select("user_id"))
        return times.join(ids, "user_id", "left_anti"), times.join(ids, "user_id", "left_semi")
    marked = spread_join(
        times, heavy.withColumn("_heavy", F.lit(True)), ["user_id"], "_rows", spread_by=["t"]
    )
    light = marked.filter(F.col("_heavy").isNull()).drop("_heavy")
    return light, marked.filter(F.col("_heavy")).drop("_heavy")


def greedy_windows(user: np.ndarray, t: np.ndarray, n: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window number (from 1), start and size for sorted distinct times; ``user`` marks with True where a user begins."""
    count = len(t)
    begins = np.flatnonzero(user)
    segment = np.cumsum(user) - 1
    ends = np.r_[begins[1:], count]
    # the first time at or after t + reach: a probe is sorted before equal times, and the times before it are counted
    probe = np.r_[np.ones(count, np.int64), np.zeros(count, np.int64)]
    order = np.lexsort((probe, np.r_[t, t + reach], np.r_[segment, segment]))
    seen = np.cumsum(probe[order])
    following = np.empty(count, np.int64)
    asks = order >= count
    following[order[asks] - count] = seen[asks]
    opens = np.zeros(count, bool)
    current = begins
    while len(current):  # all users side by side, as often as the longest history has windows
        opens[current] = True
        after = following[current]
        current = after[after < ends[segment[current]]]
    number = np.cumsum(opens)
    first = np.flatnonzero(opens)
    size = np.add.reduceat(n, first) if count else n
    return number - number[begins][segment] + 1, t[first][number - 1], size[number - 1]


def _linear_windows(times: DataFrame, reach: int) -> DataFrame:
    """Greedy windows in one pass over each task's users, sorted by user and time.

    What is left of the last user of a batch waits for the next one, so memory holds a batch and one user at most.
    """
    names = ["user_id", "t", "n", "window_no", "window_start", "window_size"]

    def located(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        users = rows.column("user_id").combine_chunks()
        t, n = (rows.column(c).to_numpy() for c in ("t", "n"))
        changes = pc.not_equal(users.slice(1), users.slice(0, len(users) - 1)).to_numpy(zero_copy_only=False).astype(bool)
        found = greedy_windows(np.r_[True, changes], t, n, reach)
        return pa.RecordBatch.from_arrays([users, pa.array(t), pa.array(n), *(pa.array(x.astype(np.int64)) for x in found)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            users = batch.column(0)
            last = users[batch.num_rows - 1]
            own = pc.index(users, last).as_py()  # the last user's first row of the batch
            if own == 0 and (not held or held[0].column(0)[0] == last):
                held.append(batch)
                continue
            yield located(pa.Table.from_batches([*held, batch.slice(0, own)]))
            held = [batch.slice(own)]
        if held:
            yield located(pa.Table.from_batches(held))

    placed = times.select("user_id", "t", "n").repartition("user_id").sortWithinPartitions("user_id", "t")
    kind = times.schema["user_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"user_id {kind}, t long, n long, window_no long, window_start long, window_size long")


def _next_index(times: DataFrame, reach: int) -> DataFrame:
    """``(user_id, t, n, i, j)``: 0-based index of each time and of the first time at or after t + reach.

    A probe is placed at t + reach; counting the times sorted before it gives the index it points at.
    """
    events = times.select("user_id", "t", "n", F.col("t").alias("at"), F.lit(1).alias("is_time"))
    probes = times.select(
        "user_id", "t", "n", (F.col("t") + reach).alias("at"), F.lit(0).alias("is_time")
    )
    counted = running_totals(
        events.unionByName(probes), ["user_id"], ["at", "is_time", "t"], {"seen": "is_time"}
    )
    return counted.groupBy("user_id", "t", "n").agg(
        F.max(F.when(F.col("is_time") == 1, F.col("seen") - 1)).alias("i"),
        F.max(F.when(F.col("is_time") == 0, F.col("seen"))).alias("j"),
    )


def _heavy_windows(times: DataFrame, reach: int) -> DataFrame:
    """Greedy windows of users with any number of review times, without gathering a user in one task.

    Each time points at the time that would open the next window. Doubling the pointers and then following
    them from the first time marks every window start in log2(number of windows) equi-joins on the unique
    key (user, index). A running count of the marks numbers the windows.
    """
    indexed = freeze(_next_index(times, reach))
    span = indexed.agg((F.max("t") - F.min("t")).alias("span")).collect()[0]["span"]
    levels = max(1, math.ceil(math.log2(span // reach + 2)))
    jump = indexed.select("user_id", "i", "j")
    jumps = [jump]
    for _ in range(levels - 1):
        target = jump.select("user_id", F.col("i").alias("j"), F.col("j").alias("far"))
        jump = freeze(jump.join(target, ["user_id", "j"]).select("user_id", "i", F.col("far").alias("j")))
        jumps.append(jump)
    starts = indexed.filter(F.col("i") == 0).select("user_id", "i")
    for jump in reversed(jumps):
        reached = starts.join(jump, ["user_id", "i"]).select("user_id", F.col("j").alias("i"))
        starts = freeze(starts.unionByName(reached).distinct())
    marks = starts.withColumn("start", F.lit(1))
    marked = indexed.join(marks, ["user_id", "i"], "left").select(
        "user_id", "t", "n", F.coalesce("start", F.lit(0)).alias("start")
    )
    numbered = freeze(running_totals(marked, ["user_id"], ["t"], {"window_no": "start"}))
    windows = numbered.groupBy("user_id", "window_no").agg(
        F.min("t").alias("window_start"), F.sum("n").alias("window_size"), F.count(F.lit(1)).alias("_rows")
    )
    return spread_join(numbered, windows, ["user_id", "window_no"], "_rows", spread_by=["t"]).select(
        "user_id", "t", "n", "window_no", "window_start", "window_size"
    )


def _windowed_times(df: DataFrame, days: int) -> DataFrame:
    """Window number, start and size for every distinct review time of every user."""
    reach = (days + 1) * DAY_MICROS  # whole elapsed days <= days means less than days + 1 days
    light, heavy = _split_by_weight(_review_times(df))

    out = _linear_windows(light, reach)
    return out if heavy is None else out.unionByName(_heavy_windows(heavy, reach))


def burst_windows(df: DataFrame, days: int = 30) -> DataFrame:
    """Greedy anchored windows per user.

    A review joins the current window while fewer than ``days + 1`` whole days have passed since the window's
    first review; otherwise it opens the next one. ``in_burst`` marks windows of two or more reviews. Undated
    reviews stand alone, without a window number; reviews without a user get nulls.
    """
    located = _windowed_times(df, days).withColumnRenamed("n", "_rows")
    timed = df.withColumn("t", epoch_micros(df, "date"))
    sizes = _review_times(df).withColumnRenamed("n", "_rows")
    joined = spread_join(timed, located, ["user_id", "t"], "_rows", spread_by=["review_id"], sizes=sizes)
    size = F.when(F.col("user_id").isNotNull(), F.coalesce("window_size", F.lit(1)))
    start = F.timestamp_micros("window_start").cast(df.schema["date"].dataType)
    return (
        joined.withColumn("window_size", size)
        .withColumn("window_start", start)
        .withColumn("in_burst", (F.col("window_size") >= 2).cast("int"))
        .drop("t")
    )


def _burst_reviews(df: DataFrame, days: int) -> DataFrame:
    """Number of in-burst reviews per user."""
    windows = _windowed_times(df, days).filter(F.col("window_size") >= 2)
    return windows.groupBy("user_id").agg(F.sum("n").alias("_burst_rows"))


def _with_burst_ratio(stats: DataFrame, df: DataFrame, days: int) -> DataFrame:
    """Add ``burst_ratio`` to per-user statistics (a join of two unique-key tables)."""
    joined = stats.join(_burst_reviews(df, days), "user_id", "left")
    share = F.coalesce("_burst_rows", F.lit(0)) / F.col("_rows")
    return joined.withColumn("burst_ratio", share).drop("_burst_rows")


def burst_ratio(df: DataFrame, days: int = 30) -> DataFrame:
    """Share of the user's reviews that lie in a burst window."""
    stats = _with_burst_ratio(_per_user(df), df, days)
    return _or_zero(_attach(df, stats, "user_id"), "burst_ratio")


# --- all six, scaling ----------------------------------------------------------------------------------


def behavior_features(df: DataFrame, days: int = 30, keep: Sequence[str] = ()) -> DataFrame:
    """All six features keyed by ``review_id`` in their fixed order, nulls as 0.

    A table without dates gets one constant date, hence account age 0. ``keep`` carries further columns
    (say the label) through.
    """
    if "date" not in df.columns:
        df = df.withColumn("date", F.lit("2010-01-01").cast("timestamp_ntz"))
    keep = [c for c in keep if c != "review_id"]
    slim = df.select(
        *dict.fromkeys(["review_id", "user_id", "product_id", "rating", "date", *keep])
    )
    timed = slim.withColumn("_now", epoch_micros(slim, "date"))
    users = _per_user(
        timed,
        F.avg("rating").alias("avg_star_rating"),
        F.count(F.lit(1)).alias("review_count"),
        _diversity().alias("category_diversity"),
        F.min("_now").alias("_first"),
    )
    users = _with_burst_ratio(users, slim, days)
    joined = _attach(_attach(timed, _product_means(slim), "product_id"), users, "user_id")
    age = _age_days(F.col("_now"), F.col("_first"))
    joined = joined.withColumn("account_age_at_review", age).withColumn(
        "rating_deviation", F.abs(F.col("rating") - F.col("_product_mean"))
    )
    for name in BEHAVIOR_FEATURES:
        joined = _or_zero(joined, name)
    return joined.select("review_id", *keep, *BEHAVIOR_FEATURES)


def standardize_fit(df: DataFrame, columns: Sequence[str] = tuple(BEHAVIOR_FEATURES)) -> DataFrame:
    """One row per column: mean and population standard deviation (1 where a column is constant)."""
    sums = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"m_{c}").alias("mean"),
                F.when(F.col(f"s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"s_{c}")).alias("scale"),
            )
            for c in columns
        ]
    )
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def standardize_apply(
    df: DataFrame, stats: DataFrame, columns: Sequence[str] = tuple(BEHAVIOR_FEATURES)
) -> DataFrame:
    """Scale the columns with fitted statistics (one row per column, used as constants)."""
    fitted = {r["feature"]: r for r in stats.collect()}
    return df.withColumns(
        {c: (F.col(c) - F.lit(fitted[c]["mean"])) / F.lit(fitted[c]["scale"]) for c in columns}
    )


def split_feature_sets(
    train: DataFrame, test: DataFrame, width: int = 16, keep: Sequence[str] = ()
) -> DataFrame:
    """Features of each split from its own rows, scaled with train statistics, as padded vectors."""
    parts = {
        "train": freeze(behavior_features(train, keep=keep)),  # used twice: fitting and scaling
        "test": behavior_features(test, keep=keep),
    }
    stats = standardize_fit(parts["train"])
    out = None
    for split, part in parts.items():
        scaled = standardize_apply(part, stats)
        vector = pad_vector(F.array(*BEHAVIOR_FEATURES), width).alias("features")
        rows = scaled.select("review_id", F.lit(split).alias("split"), *keep, vector)
        out = rows if out is None else out.unionByName(rows)
    return out
