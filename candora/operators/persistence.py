"""Saving and loading fitted state: Parquet tables and Spark ML folders, readable by any later session.

Every ``save_*`` writes below a new folder (an existing one is an error) and every ``load_*`` returns what was saved.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCAModel, StandardScalerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candora.operators.forest import ForestScore, forest_from, forest_table
from candora.operators.mlp import Layers, TrainedMlp
from candora.operators.models import LogisticScore, SvmScore
from candora.operators.text import PcaModel, TfidfModel


def save_table(table: DataFrame, path: str) -> None:
    """Any fitted table, such as the statistics of ``standardize_fit``."""
    table.write.parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_tfidf(model: TfidfModel, path: str) -> None:
    model.vocabulary.write.parquet(f"{path}/vocabulary")


def load_tfidf(spark: SparkSession, path: str) -> TfidfModel:
    vocabulary = spark.read.parquet(f"{path}/vocabulary")
    return TfidfModel(vocabulary, vocabulary.count())


def save_pca(model: PcaModel, path: str) -> None:
    model.center.save(f"{path}/center")
    model.rotation.save(f"{path}/rotation")
    spark = SparkSession.active()
    spark.createDataFrame([(k, s) for k, s in enumerate(model.signs)], "place int, sign double").coalesce(1).write.parquet(f"{path}/signs")


def load_pca(spark: SparkSession, path: str) -> PcaModel:
    signs = [r["sign"] for r in spark.read.parquet(f"{path}/signs").orderBy("place").collect()]  # one per component
    return PcaModel(StandardScalerModel.load(f"{path}/center"), PCAModel.load(f"{path}/rotation"), signs)


def _save_rows(rows: np.ndarray, path: str) -> None:
    table = SparkSession.active().createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(rows)], "place int, numbers array<double>")
    table.coalesce(1).write.parquet(path)


def _load_rows(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["numbers"] for r in spark.read.parquet(path).orderBy("place").collect()])  # one per fitted machine


def save_logistic(score: LogisticScore, path: str) -> None:
    _save_rows(score.weights, f"{path}/weights")


def load_logistic(spark: SparkSession, path: str) -> LogisticScore:
    return LogisticScore(_load_rows(spark, f"{path}/weights"))


def save_svm(score: SvmScore, path: str) -> None:
    _save_rows(score.weights, f"{path}/weights")
    _save_rows(score.curves, f"{path}/curves")


def load_svm(spark: SparkSession, path: str) -> SvmScore:
    return SvmScore(_load_rows(spark, f"{path}/weights"), _load_rows(spark, f"{path}/curves"))


def save_forest(score: ForestScore, path: str) -> None:
    forest_table(score).coalesce(1).write.parquet(f"{path}/model")


def load_forest(spark: SparkSession, path: str) -> ForestScore:
    return forest_from(spark.read.parquet(f"{path}/model"))


def save_mlp(trained: TrainedMlp, path: str) -> None:
    """Layers as ``(layer, kind, rows, values)``, the history as a table."""
    rows = []
    for k, (weights, bias) in enumerate(trained.layers):
        rows.append((k, "weights", weights.shape[0], weights.ravel().tolist()))
        rows.append((k, "bias", bias.size, bias.tolist()))
    spark = trained.history.sparkSession
    table = spark.createDataFrame(rows, "layer int, kind string, n_rows int, values array<double>")
    table.withColumn("best_epoch", F.lit(int(trained.best_epoch))).coalesce(1).write.parquet(f"{path}/layers")
    trained.history.write.parquet(f"{path}/history")


def load_mlp(spark: SparkSession, path: str) -> TrainedMlp:
    rows = spark.read.parquet(f"{path}/layers").orderBy("layer", "kind").collect()  # two per layer
    layers: Layers = []
    for bias, weights in zip(rows[::2], rows[1::2], strict=True):
        matrix = np.array(weights["values"]).reshape(weights["n_rows"], -1)
        layers.append((matrix, np.array(bias["values"])))
    return TrainedMlp(layers, spark.read.parquet(f"{path}/history"), rows[0]["best_epoch"])
