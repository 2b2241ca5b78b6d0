from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from candora.operators import splits

T0 = datetime(2020, 1, 1)


def dated(spark, days):
    rows = [(i, None if d is None else T0 + timedelta(days=d)) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "review_id long, date timestamp_ntz")


def test_cutoff_ties_go_to_train(spark):
    df = dated(spark, [0, 1, 2, 3, 4, 7, 7, 7, 7, 9, None])  # position int(11 * 0.7) = 7
    got = {r["review_id"]: r["split"] for r in splits.temporal_split(df, 0.7).collect()}
    assert got == {**{i: "train" for i in range(9)}, 9: "test"}


def test_cutoff_with_sub_day_times(spark):
    times = [T0 + timedelta(hours=h, microseconds=h) for h in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)]
    df = spark.createDataFrame(list(enumerate(times)), "review_id long, date timestamp_ntz")
    cutoff = splits.temporal_cutoff(df, 0.8)
    assert cutoff == int((times[8] - datetime(1970, 1, 1)) / timedelta(microseconds=1))


def test_temporal_split_rejects_bad_input(spark):
    df = dated(spark, [0, 1])
    with pytest.raises(ValueError):
        splits.temporal_split(df.drop("date"))
    with pytest.raises(ValueError):
        splits.temporal_split(df, 1.0)
    with pytest.raises(ValueError):
        splits.temporal_split(dated(spark, [0, None, None]), 0.8)


def test_temporal_folds_of_13_and_10():
    assert splits.temporal_fold_bounds(13) == [(3, 6, 8), (4, 8, 10), (5, 10, 12)]
    assert splits.temporal_fold_bounds(10) == [(2, 4, 6), (3, 6, 8), (4, 8, 10)]


def test_temporal_kfold_respects_time(spark, orders, many_chunks):
    folds = splits.temporal_kfold(orders).join(orders.select("review_id", "date"), "review_id")
    spans = folds.groupBy("fold").pivot("role", ["train", "test"]).agg(
        F.min("date").alias("lo"), F.max("date").alias("hi"))
    rows = spans.collect()
    assert len(rows) == 3
    assert all(r["train_hi"] <= r["test_lo"] for r in rows)


def test_stratified_split_is_disjoint_exhaustive_and_balanced(spark, orders):
    got = splits.stratified_split(orders)
    assert got.count() == got.select("review_id").distinct().count() == orders.count()
    rates = {r["split"]: r["rate"] for r in got.groupBy("split").agg(F.avg("label").alias("rate")).collect()}
    assert max(rates.values()) - min(rates.values()) < 0.01


def test_folds_and_samples_do_not_depend_on_layout(spark, orders):
    shuffled = orders.repartition(7)
    for f in (splits.stratified_kfold, splits.stratified_split, lambda d: splits.sample_n(d, 50),
              splits.oversample_minority):
        assert sorted(map(tuple, f(orders).collect())) == sorted(map(tuple, f(shuffled).collect()))


def test_oversampling_balances_classes(spark, orders):
    counts = {r["label"]: r["count"] for r in splits.oversample_minority(orders).groupBy("label").count().collect()}
    assert abs(counts[0] - counts[1]) < 0.1 * orders.count()


def test_large_poisson_means_are_split(spark):
    df = spark.range(20_001).select(F.col("id").alias("review_id"), (F.col("id") < 50).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in splits.oversample_minority(df).groupBy("label").count().collect()}
    assert 0.9 < counts[1] / counts[0] < 1.1


def test_row_level_ranks_are_not_single_partition(spark, orders, many_chunks):
    for df in (splits.stratified_kfold(orders), splits.stratified_split(orders)):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


def test_large_sample_of_repeated_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(splits, "MERGED_ROWS", 10)
    key = F.when(F.col("id") % 3 > 0, F.col("id")).when(F.col("id") < 1500, F.lit(7))
    df = spark.range(3000).select(key.alias("review_id"), F.col("id").alias("row"))  # a sixth has one id, a sixth has none
    for seed in range(4):
        got = [(r["review_id"], r["row"]) for r in splits.sample_n(df, 1200, seed).collect()]
        assert len(got) == len(set(got)) == 1200
        hashes = {r["review_id"]: r["h"] for r in df.select("review_id", splits.keyed_md5(seed, F.col("review_id")).alias("h")).collect()}
        everyone = sorted(hashes[r["review_id"]] for r in df.collect())
        assert sorted(hashes[k] for k, _ in got) == everyone[:1200]
    assert splits.sample_n(df, 3000).count() == splits.sample_n(df, 5000).count() == 3000 and splits.sample_n(df.limit(0), 20).count() == 0
