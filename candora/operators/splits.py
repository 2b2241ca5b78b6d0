"""Train/test splits, folds and samples. All of them are deterministic."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candora.functions.columns import epoch_micros, hash_uniform, keyed_md5
from candora.operators.balance import class_weights
from candora.plans.ordering import bucketed_totals, global_row_number
from candora.schema import DAY_MICROS

_SECOND_MICROS = 1_000_000


def temporal_cutoff(df: DataFrame, fraction: float = 0.8, date_col: str = "date") -> int:
    """Microseconds of the date at 0-based position ``int(n * fraction)`` of the date order.

    Narrows the range day, second, microsecond. Each step is a counting aggregation whose result is bounded
    by the calendar (days), 86,400 (seconds of a day) or 1,000,000 (microseconds of a second); it stops as
    soon as the cell holds a single value. Undated rows count, and sort last.
    """
    if date_col not in df.columns:
        raise ValueError(f"date column {date_col!r} not found")
    micros = df.select(epoch_micros(df, date_col).alias("m"))
    inside, position = micros, None
    for width in (DAY_MICROS, _SECOND_MICROS, 1):
        cell = F.col("m") - F.pmod(F.col("m"), F.lit(width))
        counts = inside.groupBy(cell.alias("cell")).agg(
            F.count(F.lit(1)).alias("n"), F.min("m").alias("low"), F.max("m").alias("high")
        )
        running = counts.withColumn("cum", F.sum("n").over(Window.orderBy(F.asc_nulls_last("cell"))))
        if position is None:
            total = F.sum("n").over(Window.partitionBy())
            target = F.floor(total * F.lit(float(fraction)))
        else:
            target = F.lit(position)
        placed = running.withColumn("target", target).filter(F.col("cum") > F.col("target"))
        hit = placed.orderBy(F.asc_nulls_last("cell")).limit(1).collect()
        if not hit or hit[0]["cell"] is None:
            raise ValueError("the cutoff position lies outside the dated rows")
        if hit[0]["low"] == hit[0]["high"]:
            return hit[0]["low"]
        position = hit[0]["target"] - (hit[0]["cum"] - hit[0]["n"])
        inside = micros.filter(F.col("m").between(hit[0]["low"], hit[0]["high"]))
    raise AssertionError("a one-microsecond cell holds one value")


def temporal_split(df: DataFrame, fraction: float = 0.8, date_col: str = "date") -> DataFrame:
    """Add ``split``: train up to and including the cutoff date, test after it. Undated rows are dropped."""
    cutoff = temporal_cutoff(df, fraction, date_col)
    boundary = F.timestamp_micros(F.lit(cutoff)).cast(df.schema[date_col].dataType)
    return df.filter(F.col(date_col).isNotNull()).withColumn(
        "split", F.when(F.col(date_col) <= boundary, "train").otherwise("test")
    )


CELL_ROWS = 4096  # rows that a hash cell holds at most in expectation
CELLS_PER_TASK = 1 << 16  # cells whose sizes one task adds up


def _hash_position(df: DataFrame, by: str, key: str, seed: int) -> DataFrame:
    """``_rank`` = 0-based position of each row in the md5 order of its ``by`` group, ``_size`` = group size.

    Leading hex digits cut every group into equal cells, more of them the more rows there are, so that a task ranks
    some thousand rows of a cell however large the group is, and the cells' sizes are added up in two levels. Rows are
    shuffled once: the join and the window share (by, cell). ``by`` has few values. Rows without a ``by`` value belong to no stratum and are left out.
    """
    digits = max(2, math.ceil(math.log(max(1, df.count()) / CELL_ROWS + 1, 16)))
    hashed = df.withColumn("_h", keyed_md5(seed, F.col(key))).withColumn(
        "_cell", F.substring("_h", 1, digits)
    )
    cells = hashed.groupBy(by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    numbered = cells.withColumn("_place", F.conv("_cell", 16, 10).cast("long"))
    summed = bucketed_totals(numbered, [by], "_place", [], {"_upto": "_n"}, CELLS_PER_TASK)
    offsets = summed.select(by, "_cell", (F.col("_upto") - F.col("_n")).alias("_before"))
    sizes = [(r[by], r["_size"]) for r in hashed.groupBy(by).agg(F.count(F.lit(1)).alias("_size")).collect()]  # one row a label
    size = F.lit(0).cast("long")
    for value, rows in sizes:
        if value is not None:
            size = F.when(F.col(by) == F.lit(value), F.lit(rows).cast("long")).otherwise(size)
    inside = Window.partitionBy(by, "_cell").orderBy("_h", key)
    ranked = hashed.withColumn("_r", F.row_number().over(inside) - 1).join(offsets, [by, "_cell"])
    ranked = ranked.withColumn("_rank", F.col("_r") + F.col("_before")).withColumn("_size", size)
    return ranked.drop("_h", "_cell", "_r", "_before")


def stratified_split(
    df: DataFrame, test: float = 0.2, validation: float = 0.2, seed: int = 42, label: str = "label",
    key: str = "review_id",
) -> DataFrame:
    """Add ``split`` (test, validation, train) with the label ratio kept in each."""
    ranked = _hash_position(df, label, key, seed)
    test_end = F.ceil(F.col("_size") * F.lit(test))
    validation_end = test_end + F.ceil(F.col("_size") * F.lit(validation))
    split = (
        F.when(F.col("_rank") < test_end, "test")
        .when(F.col("_rank") < validation_end, "validation")
        .otherwise("train")
    )
    return ranked.withColumn("split", split).drop("_rank", "_size")


def stratified_kfold(
    df: DataFrame, k: int = 5, seed: int = 42, label: str = "label", key: str = "review_id"
) -> DataFrame:
    """Add ``fold`` in 1..k with the label ratio kept in each fold."""
    ranked = _hash_position(df, label, key, seed)
    return ranked.withColumn("fold", (F.col("_rank") % k + 1).cast("int")).drop("_rank", "_size")


def temporal_fold_bounds(n: int, k: int = 5, min_train: float = 0.4) -> list[tuple[int, int, int]]:
    """``(fold, train end, test end)`` positions of the expanding windows over ``n`` sorted rows.

    Fold f trains on the first ``f * (n // k)`` rows and tests on the next ``n // k``. Folds run from the first one
    that trains on at least ``int(n * min_train)`` rows to the last one that starts before row ``n``.
    """
    step, needed = n // k, int(n * min_train)
    if step == 0:  # fewer rows than folds: every fold trains on nothing
        return [(fold, 0, 0) for fold in range(1, k + 1)] if 0 < n and needed == 0 else []
    first, last = max(1, math.ceil(needed / step)), min(k, (n - 1) // step)
    return [(fold, fold * step, min(n, (fold + 1) * step)) for fold in range(first, last + 1)]


def temporal_kfold(
    df: DataFrame, k: int = 5, min_train: float = 0.4, date_col: str = "date", key: str = "review_id"
) -> DataFrame:
    """Expanding-window folds as ``(key, fold, role)``; date ties are ordered by ``key``, undated rows last."""
    slim = df.select(key, F.col(date_col).alias("_d"))
    ordered = global_row_number(slim, [F.asc_nulls_last("_d"), key], "_row")
    bounds = temporal_fold_bounds(ordered.count(), k, min_train)
    roles = F.array(
        *[
            F.struct(
                F.lit(fold).alias("fold"),
                F.when(F.col("_row") < start, "train").when(F.col("_row") < end, "test").alias("role"),
            )
            for fold, start, end in bounds
        ]
    )
    used = ordered.select(key, F.explode(F.filter(roles, lambda r: r["role"].isNotNull())).alias("_r"))
    return used.select(key, "_r.fold", "_r.role")


MERGED_ROWS = 100_000  # rows that one task may merge


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "review_id") -> DataFrame:
    """``n`` rows without replacement: those with the smallest keyed hashes.

    Up to :data:`MERGED_ROWS` this is a top-k per task and a merge. More rows are cut off by position in a global sort
    of the rows up to the cell of hashes (counted first, 65,536 at most) in which the ``n``-th lies. Keys may repeat or
    be null: their rows share a hash, and the other columns spread them over the sort.
    """
    hashed = df.withColumn("_h", keyed_md5(seed, F.col(key)))
    if n <= MERGED_ROWS:
        return hashed.orderBy("_h", key).limit(n).drop("_h")
    cells = hashed.groupBy(F.substring("_h", 1, 4).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
    last, below = None, 0
    for cell in sorted(cells, key=lambda c: c["cell"]):
        last, below = cell["cell"], below + cell["n"]
        if below >= n:
            break
    if last is None or below < n:
        return df
    ties = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()])
    candidates = hashed.filter(F.substring("_h", 1, 4) <= last).withColumn("_tie", ties)
    placed = global_row_number(candidates, ["_h", key, "_tie"], "_place").drop("_tie")
    return placed.filter(F.col("_place") < n).drop("_h", "_place")


def oversample_minority(
    df: DataFrame, label: str = "label", seed: int = 42, keys: Sequence[str] = ("review_id",)
) -> DataFrame:
    """Resample with replacement so that the classes come out about equal in size.

    Each row is repeated by a Poisson draw whose mean is its share of ``n`` weighted draws. The draw is the
    inverse distribution function at a hash of the row key, so it needs no shuffle and repeats exactly.
    Means above 32 are split into independent draws of at most 32. Column ``copy`` numbers the repeats.
    """
    weights = class_weights(df, label).collect()  # one row per class
    drawn_from = sum(r["weight"] * r["n_rows"] for r in weights)
    total = sum(r["n_rows"] for r in weights)
    copies = F.lit(0)
    for r in weights:
        mean = total * r["weight"] / drawn_from
        draws = max(1, -(-int(mean + 0.999999) // 32))
        cdf = _poisson_cdf(mean / draws)
        one_class = F.lit(0)
        for d in range(draws):
            one_class = one_class + _poisson_draw(cdf, hash_uniform(f"{seed}.{d}", *map(F.col, keys)))
        copies = F.when(F.col(label) == r["label"], one_class).otherwise(copies)
    repeated = df.withColumn("_copies", copies).filter(F.col("_copies") > 0)
    return repeated.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")


def _poisson_draw(cdf: Column, u: Column) -> Column:
    return F.size(F.filter(cdf, lambda c: c <= u))


def _poisson_cdf(mean: float) -> Column:
    """Poisson distribution function as an array constant, up to where it reaches 1 in double precision."""
    term = total = math.exp(-mean)
    values, k = [total], 0
    while k < mean or term > 1e-17:
        k += 1
        term *= mean / k
        total += term
        values.append(total)
    return F.array(*[F.lit(v) for v in values])
