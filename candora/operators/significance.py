"""Paired significance test."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candora.plans.ordering import running_totals

EXACT_LIMIT = 25  # most untied pairs for which the exact distribution is used


def _exact_table(spark) -> DataFrame:
    """``(n, w, tail)``: P(W <= w) for every n up to the limit, by adding one rank at a time."""
    rows, ways = [], [1]
    for n in range(1, EXACT_LIMIT + 1):
        longer = ways + [0] * n
        for w, count in enumerate(ways):
            longer[w + n] += count
        ways, below = longer, 0
        for w, count in enumerate(ways):
            below += count
            rows.append((n, float(w), below / 2.0**n))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["n", "w", "tail"]))


def _two_sided_normal():
    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        import math

        return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore")

    return tail


def wilcoxon_signed_rank(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """Two-sided paired test as one row ``(n_pairs, n, statistic, p_value, significant)``.

    Zero differences are dropped and absolute differences get average ranks. Without ties and up to 25 pairs
    the distribution is exact; otherwise a tie-corrected normal approximation is used. Fewer than two pairs
    give null results. A row with one side missing is an error: the two series differ in length.
    """
    missing = F.col(a).isNull() != F.col(b).isNull()
    checked = F.when(missing, F.raise_error(F.lit("paired series differ in length")).cast("double"))
    pairs = df.filter(~(F.col(a).isNull() & F.col(b).isNull())).select(
        F.coalesce(checked, F.col(a) - F.col(b)).alias("d")
    )
    sides = pairs.groupBy(F.abs("d").alias("size")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col("d") > 0, True)).alias("plus"),
        F.count(F.when(F.col("d") < 0, True)).alias("minus"),
    )
    kept = F.when(F.col("size") > 0, F.col("rows")).otherwise(F.lit(0))
    ranked = running_totals(sides.withColumn("t", kept), [], ["size"], {"cum": "t"})
    rank = F.col("cum") - (F.col("t") - 1) / 2.0
    sums = ranked.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_pairs"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("n"),
        F.sum(F.when(F.col("t") > 0, F.col("plus").cast("double") * rank)).alias("w_plus"),
        F.sum(F.when(F.col("t") > 0, F.col("minus").cast("double") * rank)).alias("w_minus"),
        F.sum(F.pow(F.col("t").cast("double"), F.lit(3)) - F.col("t")).alias("ties"),
    )
    sums = sums.withColumn("w", F.least("w_plus", "w_minus"))
    table = F.broadcast(_exact_table(df.sparkSession))  # n <= EXACT_LIMIT: under 3,000 rows
    joined = sums.join(table, ["n", "w"], "left")
    n = F.col("n").cast("double")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    normal = _two_sided_normal()((F.col("w") - n * (n + 1) / 4) / F.when(spread > 0, spread))
    exact = F.least(2 * F.col("tail"), F.lit(1.0))
    untied = (F.col("ties") == 0) & (F.col("n") == F.col("n_pairs")) & F.col("tail").isNotNull()
    p = F.when(F.col("n_pairs") >= 2, F.when(untied, exact).otherwise(normal))
    return joined.select(
        "n_pairs",
        "n",
        F.when(F.col("n_pairs") >= 2, F.col("w")).alias("statistic"),
        p.alias("p_value"),
        F.coalesce(p < alpha, F.lit(False)).cast("int").alias("significant"),
    )
