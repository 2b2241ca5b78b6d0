from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from candora.operators import balance, evaluation, significance

SCHEMA = "review_id long, label int, prob double, pred int"


def scored(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


TOY = [(1, 0.9, 1), (0, 0.9, 1), (1, 0.6, 1), (0, 0.4, 0), (1, 0.4, 0), (0, 0.1, 0)]


def test_toy_auc_and_curve(spark, many_chunks):
    df = scored(spark, TOY)
    # pairs won: 0.9 -> 2.5, 0.6 -> 2, 0.4 -> 1.5 of 9
    assert evaluation.auc_roc(df).collect()[0]["auc_roc"] == pytest.approx(6.0 / 9.0)
    points = sorted((r["fpr"], r["tpr"]) for r in evaluation.roc_curve(df).collect())
    third = 1 / 3
    expected = [(0, 0), (third, third), (third, 2 * third), (2 * third, 1), (1, 1)]
    assert [v for point in points for v in point] == pytest.approx([v for point in expected for v in point])


def test_auc_of_reversed_scores(spark, many_chunks):
    df = scored(spark, TOY)
    flipped = df.withColumn("prob", -F.col("prob"))
    total = evaluation.auc_roc(df).collect()[0][0] + evaluation.auc_roc(flipped).collect()[0][0]
    assert total == pytest.approx(1.0)


def test_one_class(spark):
    df = scored(spark, [(0, 0.2, 0), (0, 0.8, 0)])
    assert evaluation.auc_roc(df).collect()[0]["auc_roc"] == 0.0
    assert evaluation.auc_roc(df, on_single_class=None).collect()[0]["auc_roc"] is None
    m = evaluation.classification_metrics(df).collect()[0]
    # only the class that occurs is averaged; undefined precision and recall are 0
    assert (m["macro_f1"], m["f1_fake"], m["precision_fake"], m["recall_fake"]) == (1.0, 0.0, 0.0, 0.0)


def test_small_strata_are_left_out(spark):
    rows = [(i, i % 2, i / 20, int(i > 9), "a" if i < 12 else f"u{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "review_id long, label int, prob double, pred int, user_id string")
    assert [r["stratum"] for r in evaluation.stratum_metrics(df).collect()] == ["5-19"]


def test_aggregate_ignores_nan(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", 3.0), ("m", float("nan")), ("m", None)], "metric string, value double")
    row = evaluation.aggregate_folds(df).collect()[0]
    assert (row["mean"], row["std"], row["n_folds"]) == (2.0, 1.0, 2)


def wilcoxon(spark, pairs):
    df = spark.createDataFrame(pairs, "a double, b double")
    return significance.wilcoxon_signed_rank(df, "a", "b").collect()[0]


def test_wilcoxon_five_positive_differences(spark):
    row = wilcoxon(spark, [(i + 0.1 * i + 1.0, float(i)) for i in range(5)])
    assert (row["statistic"], row["p_value"], row["significant"]) == (0.0, 0.0625, 0)


def test_wilcoxon_edges(spark):
    assert wilcoxon(spark, [(1.0, 0.0)])["p_value"] is None
    with pytest.raises(Exception, match="differ in length"):
        wilcoxon(spark, [(1.0, None), (2.0, 1.0)])


def test_wilcoxon_normal_approximation(spark):
    pairs = [(float(d), 0.0) for d in (1, 1, 2, -2, 3, 4, 5, -6, 7, 8)]
    row = wilcoxon(spark, pairs)
    # ranks 1.5 1.5 3.5 3.5 5 … 10; W- = 3.5 + 8
    spread = math.sqrt((10 * 11 * 21 - (6 + 6) / 2) / 24)
    assert row["statistic"] == 11.5
    assert row["p_value"] == pytest.approx(math.erfc((27.5 - 11.5) / spread / math.sqrt(2)))


def test_focal_loss_without_focus_is_half_cross_entropy(spark):
    df = spark.createDataFrame([(1, 2.0), (0, 2.0), (1, -30.0)], "label int, logit double")
    got = [r["loss"] for r in balance.focal_loss(df, gamma=0.0, reduction="none").collect()]
    bce = [math.log1p(math.exp(-2)), 2 + math.log1p(math.exp(-2)), 30 + math.log1p(math.exp(-30))]
    assert got == pytest.approx([x / 2 for x in bce])
    with pytest.raises(ValueError):
        balance.focal_loss(df, reduction="max")


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.0,), (-0.1,)], "logit double")
    assert [r["pred"] for r in balance.sigmoid_score(df).collect()] == [1, 0]


def test_class_weights_of_missing_class(spark):
    df = spark.createDataFrame([(0,), (0,)], "label int")
    weights = {r["label"]: r["weight"] for r in balance.class_weights(df).collect()}
    assert weights[0] + weights[1] == pytest.approx(2.0) and weights[1] == pytest.approx(2 * weights[0])


def test_curve_has_no_single_partition(spark):
    df = scored(spark, TOY)
    plan = evaluation.roc_curve(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.replace("TakeOrderedAndProject", "")
