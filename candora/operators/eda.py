"""Exploratory tables: the data behind each chart. Labels are binary (0 genuine, 1 fake)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candora.functions.columns import ratio
from candora.plans.ordering import percentiles_of_counts, value_counts
from candora.plans.scalars import one_row
from candora.plans.storage import freeze
from candora.schema import BEHAVIOR_FEATURES


def _spreads(counts: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """``mean`` and sample standard deviation ``std`` per group of values that occur ``n`` times.

    Squares are taken of deviations from the mean, so a small spread around a large mean keeps its digits.
    """
    means = counts.groupBy(*by).agg((F.sum(F.col("n") * F.col(value)) / F.sum("n")).alias("mean"))
    away = F.col(value).cast("double") - F.col("mean")
    joined = counts.join(F.broadcast(means), list(by))  # labels times measures
    total = F.sum("n")
    std = F.when(total > 1, F.sqrt(F.sum(F.col("n") * away * away) / (total - 1)))
    return joined.groupBy(*by).agg(F.first("mean").alias("mean"), std.alias("std"))


def describe_by_label(
    df: DataFrame, columns: Sequence[str] = ("text_length", "char_length"), label_col: str = "label"
) -> DataFrame:
    """Count, mean, sample standard deviation, extremes and quartiles per label and column."""
    long = df.unpivot([label_col], list(columns), "measure", "value")
    counts = freeze(value_counts(long, "value", [label_col, "measure"]))
    basic = counts.groupBy(label_col, "measure").agg(
        F.sum("n").alias("count"),
        F.min("value").cast("double").alias("min"),
        F.max("value").cast("double").alias("max"),
    )
    quartiles = percentiles_of_counts(
        counts, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, [label_col, "measure"]
    )
    spreads = _spreads(counts, "value", [label_col, "measure"])
    return basic.join(spreads, [label_col, "measure"]).join(quartiles, [label_col, "measure"])


def label_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Count and percentage per label."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per label
    return counts.withColumn("pct", F.col("n") / total * 100)


def _clipped_counts(df: DataFrame, label_col: str, length_col: str, clip: int) -> DataFrame:
    """Rows per (label, clipped length): at most ``clip`` + 1 rows per label."""
    clipped = F.least(F.col(length_col), F.lit(clip)).alias("v")
    return df.groupBy(label_col, clipped).agg(F.count(F.lit(1)).alias("n"))


def length_histogram(
    df: DataFrame, label_col: str = "label", length_col: str = "text_length", clip: int = 500, bins: int = 60
) -> DataFrame:
    """Density histogram of clipped lengths over each label's own range; the last bin is closed."""
    counts = _clipped_counts(df, label_col, length_col, clip)
    whole = Window.partitionBy(label_col)  # at most clip + 1 rows per label
    ranged = (
        counts.withColumn("lo", F.min("v").over(whole))
        .withColumn("hi", F.max("v").over(whole))
        .withColumn("total", F.sum("n").over(whole))
    )
    # a constant column gets the unit-wide range around its value
    flat = F.col("lo") == F.col("hi")
    ranged = ranged.withColumn(
        "low", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo").cast("double"))
    ).withColumn("width", F.when(flat, F.lit(1.0)).otherwise(F.col("hi") - F.col("lo")) / bins)
    bin_no = F.least(F.floor((F.col("v") - F.col("low")) / F.col("width")), F.lit(bins - 1)).cast("int")
    filled = ranged.groupBy(label_col, bin_no.alias("bin"), "low", "width", "total").agg(
        F.sum("n").alias("count")
    )
    frame = ranged.select(label_col, "low", "width", "total").distinct()
    every = frame.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    joined = every.join(filled.select(label_col, "bin", "count"), [label_col, "bin"], "left")
    count = F.coalesce("count", F.lit(0))
    return joined.select(
        label_col,
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"),
        count.alias("count"),
        (count / (F.col("total") * F.col("width"))).alias("density"),
    )


def length_cdf(
    df: DataFrame, label_col: str = "label", length_col: str = "text_length", clip: int = 500
) -> DataFrame:
    """Cumulative share at every distinct clipped length per label."""
    counts = _clipped_counts(df, label_col, length_col, clip)
    upto = Window.partitionBy(label_col).orderBy("v")  # at most clip + 1 rows per label
    whole = Window.partitionBy(label_col)
    return counts.select(
        label_col, F.col("v").alias("length"), (F.sum("n").over(upto) / F.sum("n").over(whole)).alias("cdf")
    )


def rating_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Count and share within the label of each rating, labels side by side."""
    wide = (
        df.filter(F.col("rating").isNotNull())
        .groupBy("rating")
        .agg(*[F.count(F.when(F.col(label_col) == c, True)).alias(f"n{c}") for c in (0, 1)])
    )
    totals = one_row(
        df.filter(F.col("rating").isNotNull()).agg(
            *[F.count(F.when(F.col(label_col) == c, True)).alias(f"t{c}") for c in (0, 1)]
        )
    )
    return wide.select(
        "rating",
        F.col("n0").alias("n_genuine"),
        F.col("n1").alias("n_fake"),
        (ratio(F.col("n0"), F.lit(totals["t0"])) * 100).alias("pct_genuine"),
        (ratio(F.col("n1"), F.lit(totals["t1"])) * 100).alias("pct_fake"),
    )


def rating_box_stats(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Quartiles, whiskers at the last values inside 1.5 interquartile ranges, and outliers per label."""
    rated = df.filter(F.col(label_col).isin(0, 1)).select(
        label_col, F.col("rating").cast("double").alias("rating")
    )
    counts = freeze(value_counts(rated, "rating", [label_col]))
    quartiles = percentiles_of_counts(
        counts, "rating", {"q1": 0.25, "median": 0.5, "q3": 0.75}, [label_col]
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("rating") >= F.col("q1") - reach) & (F.col("rating") <= F.col("q3") + reach)
    return (
        counts.join(F.broadcast(quartiles), label_col)  # two labels
        .groupBy(label_col, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("rating"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("rating"))).alias("whisker_high"),
            F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("n_outliers"),
        )
    )


def top_reviewers(df: DataFrame, k: int = 20, label_col: str = "label") -> DataFrame:
    """The ``k`` users with most labelled reviews."""
    users = (
        df.filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.count(label_col).alias("review_count"), F.sum(label_col).cast("bigint").alias("fake_count"))
    )
    rated = users.withColumn("fake_rate", ratio(F.col("fake_count"), F.col("review_count")))
    return rated.orderBy(F.desc("review_count"), "user_id").limit(k)


def monthly_volume(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Reviews per month and label, fake share, its centred three-month mean, and the mean of all months."""
    months = (
        df.filter(F.col("date").isNotNull())
        .groupBy(F.date_format("date", "yyyy-MM").alias("month"))
        .agg(
            F.count(F.when(F.col(label_col) == 0, True)).alias("n_genuine"),
            F.count(F.when(F.col(label_col) == 1, True)).alias("n_fake"),
        )
        .filter(F.col("n_genuine") + F.col("n_fake") > 0)
        .withColumn("fake_fraction", F.col("n_fake") / (F.col("n_genuine") + F.col("n_fake")))
    )
    around = Window.orderBy("month").rowsBetween(-1, 1)  # one row per calendar month
    full = F.count(F.lit(1)).over(around) == 3
    return months.withColumn(
        "rolling_fraction", F.when(full, F.avg("fake_fraction").over(around))
    ).withColumn("overall_mean", F.avg("fake_fraction").over(Window.partitionBy()))


def feature_correlation(
    df: DataFrame, columns: Sequence[str] = (*BEHAVIOR_FEATURES, "label"), target: str = "label"
) -> DataFrame:
    """Pearson correlations as a long table, all from one aggregation; rows against ``target`` are ranked."""
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    sums = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = []
    for a, b in pairs:
        for x, y in {(a, b), (b, a)}:
            cells.append(
                F.struct(F.lit(x).alias("feature_a"), F.lit(y).alias("feature_b"), F.col(f"{a}|{b}").alias("corr"))
            )
    long = sums.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    against = (F.col("feature_b") == target) & (F.col("feature_a") != target)
    order = Window.partitionBy(against).orderBy(F.desc("corr"), "feature_a")  # one row per pair
    return long.withColumn("rank", F.when(against, F.row_number().over(order)))


TERMS = 8  # terms of a kernel's series around a cell's middle: left out is less than 4e-10 of a kernel's height
CELL = 0.25  # width of a cell in bandwidths
REACH = 9.0  # bandwidths beyond which a kernel is below 3e-18 of its height


def _hermite(terms: int) -> list[list[int]]:
    """Coefficients of Hermite's polynomials (of probability): ``exp(z u - u^2 / 2)`` is their series in ``u^k / k!``."""
    rows = [[1], [0, 1]]
    for k in range(1, terms - 1):
        higher = [0, *rows[k]]
        for j, c in enumerate(rows[k - 1]):
            higher[j] -= k * c
        rows.append(higher)
    return rows[:terms]


def feature_density(
    df: DataFrame,
    columns: Sequence[str] = tuple(BEHAVIOR_FEATURES),
    label_col: str = "label",
    grid: int = 200,
    adjust: float = 0.8,
    cut: float = 3.0,
    log_columns: Sequence[str] = ("review_count",),
) -> DataFrame:
    """Gaussian kernel density per feature and label on ``grid`` points from min - cut·h to max + cut·h.

    ``h`` is Scott's bandwidth times ``adjust``. Values are gathered in cells a quarter of a bandwidth wide, with the
    first moments of their distances from the cell's middle; a cell's kernels are their series in these moments. The work
    after one pass over the rows depends on the cells, not on the number of distinct values.
    """
    by = [label_col, "feature"]
    shaped = df.filter(F.col(label_col).isin(0, 1)).select(
        label_col,
        *[(F.log1p(c) if c in log_columns else F.col(c).cast("double")).alias(c) for c in columns],
    )
    long = shaped.unpivot([label_col], list(columns), "feature", "v").filter(F.col("v").isNotNull())
    stats = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd")
    )
    h = F.pow(F.col("total").cast("double"), F.lit(-0.2)) * F.col("sd") * adjust
    frame = (
        stats.filter(F.col("sd") > 0)
        .withColumn("h", h)
        .withColumn("start", F.col("lo") - cut * F.col("h"))
        .withColumn("step", (F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (grid - 1))
        .drop("sd", "lo", "hi")
    )
    frame = freeze(frame)  # two labels x features
    placed = long.join(F.broadcast(frame.drop("total")), by)
    placed = placed.withColumn("cell", F.floor((F.col("v") - F.col("start")) / (F.col("h") * CELL)))
    middle = (F.col("cell") + 0.5) * CELL  # in bandwidths from the start
    u = (F.col("v") - F.col("start")) / F.col("h") - middle
    moments = [F.sum(F.pow(u, F.lit(float(k))) / math.factorial(k)).alias(f"m{k}") for k in range(TERMS)]
    cells = placed.groupBy(*by, "cell", "h", "start", "step").agg(*moments)
    hermite = _hermite(TERMS)
    powers = []
    for j in range(TERMS):
        parts = [F.col(f"m{k}") * float(row[j]) for k, row in enumerate(hermite) if j < len(row) and row[j]]
        powers.append(sum(parts[1:], parts[0]))
    pace = F.col("step") / F.col("h")
    first = F.greatest(F.ceil((middle - REACH) / pace), F.lit(0))
    last = F.least(F.floor((middle + REACH) / pace), F.lit(grid - 1))
    near = F.when(last >= first, F.sequence(first.cast("int"), last.cast("int")))
    spread = cells.select(*by, middle.alias("middle"), pace.alias("pace"), *[x.alias(f"a{j}") for j, x in enumerate(powers)], F.explode(near).alias("point"))
    spread = spread.withColumn("z", F.col("point") * F.col("pace") - F.col("middle"))
    series = F.col(f"a{TERMS - 1}")
    for j in range(TERMS - 2, -1, -1):
        series = series * F.col("z") + F.col(f"a{j}")
    sums = spread.groupBy(*by, "point").agg(F.sum(series * F.exp(-F.col("z") * F.col("z") / 2)).alias("k"))
    every = frame.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    joined = every.join(sums, [*by, "point"], "left")
    norm = F.col("total") * F.col("h") * F.sqrt(2 * F.pi())
    return joined.select(
        label_col,
        "feature",
        "point",
        (F.col("start") + F.col("point") * F.col("step")).alias("x"),
        (F.greatest(F.coalesce("k", F.lit(0.0)), F.lit(0.0)) / norm).alias("density"),
    )


def feature_means_by_label(
    df: DataFrame, columns: Sequence[str] = tuple(BEHAVIOR_FEATURES), label_col: str = "label"
) -> DataFrame:
    """Mean per label, difference fake - genuine, and percentage difference (one decimal)."""

    def mean(c: str, label: int) -> Column:
        return F.avg(F.when(F.col(label_col) == label, F.col(c)))

    sums = df.agg(
        *[mean(c, 0).alias(f"g_{c}") for c in columns], *[mean(c, 1).alias(f"f_{c}") for c in columns]
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"g_{c}").alias("genuine"), F.col(f"f_{c}").alias("fake"))
            for c in columns
        ]
    )
    long = sums.select(F.explode(rows).alias("r")).select("r.*")
    delta = F.col("fake") - F.col("genuine")
    base = F.when(F.col("genuine") != 0, F.abs("genuine"))
    return long.withColumn("delta", delta).withColumn("pct_difference", F.round(delta / base * 100, 1))
