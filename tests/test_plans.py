"""Global order, running totals, skew-proof joins: exact for any layout."""

from __future__ import annotations

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from candora.plans.ordering import exact_percentiles, global_row_number, running_totals
from candora.plans.skew import spread_join


def test_row_number_over_ties_and_chunks(spark, many_chunks):
    rows = [(i, 5 if i % 3 else i) for i in range(300)]  # two thirds share one key
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, k long").repartition(5)
    got = {r["id"]: r["pos"] for r in global_row_number(df, ["k", "id"], "pos").collect()}
    expected = {row[0]: i for i, row in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert got == expected


def _running(rows):
    out, sums = {}, {}
    for g, k, v in sorted(rows):
        sums[g] = sums.get(g, 0) + v
        out[(g, k)] = sums[g]
    return out


def test_running_totals_across_chunks(spark, many_chunks):
    # one group holds most rows and spans every chunk, others are tiny
    rows = [("big", i, i % 7) for i in range(400)] + [(f"g{i}", j, i + j) for i in range(40) for j in range(2)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(6)
    got = {(r["g"], r["k"]): r["cum"] for r in running_totals(df, ["g"], ["k"], {"cum": "v"}).collect()}
    assert got == _running(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 200)), min_size=1, max_size=60, unique=True))
def test_running_totals_property(spark, many_chunks, keys):
    rows = [(g, k, (k * 7) % 5) for g, k in keys]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {(r["g"], r["k"]): r["cum"] for r in running_totals(df, ["g"], ["k"], {"cum": "v"}).collect()}
    assert got == _running(rows)


def test_spread_join_with_hot_and_null_keys(spark):
    rows = [(i, 1 if i % 2 else (i % 9 if i % 5 else None)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k long")
    stats = df.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    joined = spread_join(df, stats, ["k"], "n", ["id"], hot_keys=3, rows_per_task=2)
    sums = {}
    for i, k in rows:
        if k is not None:
            sums[k] = sums.get(k, 0) + i
    got = {r["id"]: (r["k"], r["s"]) for r in joined.collect()}
    assert len(got) == joined.count() == 500
    assert got == {i: (k, sums.get(k)) for i, k in rows}


def test_spread_join_spreads_the_hot_key(spark, many_chunks):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(20_000).select("id", F.lit(1).alias("k"))
        stats = df.groupBy("k").agg(F.count("*").alias("n"))
        joined = spread_join(df, stats, ["k"], "n", ["id"], rows_per_task=50)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 10_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_percentiles_interpolate(spark, many_chunks):
    df = spark.createDataFrame([("a", float(i)) for i in (1, 2, 3, 10)] + [("b", 4.0)] * 9, "g string, v double")
    got = {r["g"]: (r["q1"], r["q2"], r["q3"]) for r in exact_percentiles(
        df, "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, ["g"]).collect()}
    assert got == {"a": (1.75, 2.5, 4.75), "b": (4.0, 4.0, 4.0)}
