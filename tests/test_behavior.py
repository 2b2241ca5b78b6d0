from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from candora.operators import asof, behavior
from candora.schema import BEHAVIOR_FEATURES

T0 = datetime(2020, 1, 1, 12)
SCHEMA = "review_id long, user_id string, product_id string, rating double, label int, date timestamp_ntz"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def burst_edges(spark):
    offsets = [timedelta(0), timedelta(days=30, hours=23, minutes=59, seconds=59), timedelta(days=31),
               timedelta(days=61), timedelta(days=62)]
    rows = [(i, "u", "p", 3.0, 0, T0 + o) for i, o in enumerate(offsets)]
    return table(spark, rows + [(10, "single", "p", 1.0, 1, T0), (11, "nodate", "p", 2.0, 0, None),
                                (12, "nodate", "p", 2.0, 0, T0), (13, None, "p", 2.0, 0, T0)])


EXPECTED_BURSTS = {
    0: (1, 2, 1), 1: (1, 2, 1), 2: (2, 2, 1), 3: (2, 2, 1), 4: (3, 1, 0), 10: (1, 1, 0), 11: (None, 1, 0),
    12: (1, 1, 0), 13: (None, None, None),
}


@pytest.mark.parametrize("limit", [1_000_000, 2])
def test_burst_edges(spark, monkeypatch, limit):
    monkeypatch.setattr(behavior, "LINEAR_LIMIT", limit)
    rows = behavior.burst_windows(burst_edges(spark)).collect()
    assert {r["review_id"]: (r["window_no"], r["window_size"], r["in_burst"]) for r in rows} == EXPECTED_BURSTS


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_long_histories_match_short_ones(spark, orders, many_chunks, monkeypatch, broadcast):
    """The pointer-doubling path and the pass over sorted times give the same windows."""
    columns = ["review_id", "window_no", "window_start", "window_size", "in_burst"]
    short = behavior.burst_windows(orders).select(columns).collect()
    monkeypatch.setattr(behavior, "LINEAR_LIMIT", 3)
    monkeypatch.setattr(behavior, "BROADCAST_LIMIT", broadcast)
    long = behavior.burst_windows(orders).select(columns).collect()
    assert sorted(map(tuple, long)) == sorted(map(tuple, short))
    ratios = {r["review_id"]: r["burst_ratio"] for r in behavior.burst_ratio(orders).collect()}
    monkeypatch.undo()
    assert ratios == {r["review_id"]: r["burst_ratio"] for r in behavior.burst_ratio(orders).collect()}


def plain_windows(times, reach):
    out, start = [], None
    for t, n in times:
        if start is None or t >= start + reach:
            start = t
            out.append([])
        out[-1].append((t, n))
    return [(t, k, w[0][0], sum(n for _, n in w)) for k, w in enumerate(out, 1) for t, _ in w]


def test_one_pass_equals_the_rule():
    rng = np.random.default_rng(6)
    histories = [np.unique(rng.integers(0, 400, rng.integers(1, 80))) for _ in range(200)]
    t, n = np.concatenate(histories), rng.integers(1, 4, sum(map(len, histories)))
    begins = np.zeros(len(t), bool)
    begins[np.r_[0, np.cumsum([len(h) for h in histories])[:-1]]] = True
    number, start, size = behavior.greedy_windows(begins, t, n, 31)
    at, want = 0, []
    for h in histories:
        want += plain_windows(list(zip(h.tolist(), n[at : at + len(h)].tolist(), strict=True)), 31)
        at += len(h)
    assert list(zip(t.tolist(), number.tolist(), start.tolist(), size.tolist(), strict=True)) == want


def test_users_longer_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    rows = [(k, f"u{k % 3 if k < 900 else k}", "p", 1.0, 0, T0 + timedelta(days=int(k * 7 % 2000))) for k in range(1000)]
    got = {r["review_id"]: (r["window_no"], r["window_size"]) for r in behavior.burst_windows(table(spark, rows)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for user in {r[1] for r in rows}:
        days = Counter(r[5] for r in rows if r[1] == user)
        want = {t: (k, size) for t, k, _, size in plain_windows(sorted(days.items()), timedelta(days=31))}
        assert all(got[r[0]] == want[r[5]] for r in rows if r[1] == user)


def test_windows_gather_no_arrays(spark, orders):
    plan = behavior.burst_windows(orders)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "SinglePartition" not in plan


def test_account_age_counts_elapsed_days(spark):
    rows = [(1, "u", "p", 1.0, 0, datetime(2020, 1, 1, 23, 50)), (2, "u", "p", 1.0, 0, datetime(2020, 1, 2, 0, 10))]
    got = behavior.account_age_at_review(table(spark, rows)).collect()
    assert [r["account_age_at_review"] for r in got] == [0.0, 0.0]


def test_null_keys_give_zeros(spark):
    rows = [(1, None, "p", 5.0, 0, T0), (2, None, None, 1.0, 0, T0), (3, "u", None, None, 0, None),
            (4, "u", "p", 1.0, 0, T0)]
    got = {r["review_id"]: tuple(r[f] for f in BEHAVIOR_FEATURES)
           for r in behavior.behavior_features(table(spark, rows)).collect()}
    assert got == {
        1: (0.0, 0.0, 0.0, 2.0, 0.0, 0.0),
        2: (0.0, 0.0, 0.0, 0.0, 0.0, 0.0),
        3: (1.0, 2.0, 0.0, 0.0, 1.0, 0.0),
        4: (1.0, 2.0, 0.0, 2.0, 1.0, 0.0),
    }


def test_missing_date_column_means_age_zero(spark):
    df = burst_edges(spark).drop("date")
    assert {r["account_age_at_review"] for r in behavior.behavior_features(df).collect()} == {0.0}


def test_features_do_not_depend_on_layout(spark, orders, many_chunks):
    def result(df):
        return sorted(map(tuple, behavior.behavior_features(df).select(
            "review_id", *[F.round(c, 9).alias(c) for c in BEHAVIOR_FEATURES]).collect()))

    assert result(orders) == result(orders.orderBy(F.md5(F.col("review_id").cast("string"))).repartition(5))


def test_constant_column_keeps_scale_one(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "a double, b double")
    stats = behavior.standardize_fit(df, ["a", "b"])
    assert {r["feature"]: (r["mean"], r["scale"]) for r in stats.collect()} == {"a": (1.0, 1.0), "b": (3.0, 1.0)}
    scaled = behavior.standardize_apply(df, stats, ["a", "b"]).collect()
    assert sorted((r["a"], r["b"]) for r in scaled) == [(0.0, -1.0), (0.0, 1.0)]


def test_equal_timestamps_are_not_prior(spark, many_chunks):
    rows = [(1, "u", "p", 1.0, 0, T0), (2, "u", "p", 3.0, 0, T0), (3, "u", "p", 5.0, 0, T0 + timedelta(days=1))]
    got = {r["review_id"]: r["asof_avg_rating"] for r in asof.asof_avg_rating(table(spark, rows)).collect()}
    assert got == {1: None, 2: None, 3: 2.0}
    counts = {r["review_id"]: r["asof_review_count"] for r in asof.asof_review_count(table(spark, rows)).collect()}
    assert counts == {1: 1, 2: 1, 3: 3}


def test_trailing_count_excludes_the_far_edge(spark, many_chunks):
    rows = [(i, "u", "p", 1.0, 0, T0 + timedelta(days=d)) for i, d in enumerate((0, 10, 30, 40))]
    got = sorted((r["_t"], r["c"]) for r in asof.trailing_counts(table(spark, rows)).collect())
    assert [c for _, c in got] == [1, 2, 2, 2]


def test_no_row_level_single_partition(spark, orders):
    plan = behavior.behavior_features(orders)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
