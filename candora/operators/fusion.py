"""The fusion model end to end: text and behaviour of a review in one vector, a focal-loss network on top.

Text goes through TF-IDF, feature hashing and principal components; behaviour through the six features, scaled and
padded. Everything is fitted on the training rows alone and travels with the model.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candora.functions.columns import pad_vector
from candora.operators import behavior, cleaning, mlp, persistence, text
from candora.plans.storage import freeze
from candora.schema import BEHAVIOR_FEATURES


@dataclass
class FusionModel:
    """Fitted parts; call it on reviews to get ``prob`` and ``pred``."""

    tfidf: text.TfidfModel
    pca: text.PcaModel
    scaler: DataFrame
    network: mlp.TrainedMlp
    embedding: int
    padding: int

    def vectors(self, reviews: DataFrame, keep: Sequence[str] = ("label",)) -> DataFrame:
        """``features``: text coordinates, then padded behaviour features of these reviews among themselves."""
        return _vectors(reviews, text.hashed_vectors(reviews, self.tfidf, self.embedding, keep), self.pca, self.scaler, self.padding)

    def __call__(self, reviews: DataFrame) -> DataFrame:
        return self.network(self.vectors(reviews))

    def save(self, path: str) -> None:
        persistence.save_tfidf(self.tfidf, f"{path}/tfidf")
        persistence.save_pca(self.pca, f"{path}/pca")
        persistence.save_table(self.scaler, f"{path}/scaler")
        persistence.save_mlp(self.network, f"{path}/network")
        sizes = [(self.embedding, self.padding)]
        self.scaler.sparkSession.createDataFrame(sizes, "embedding int, padding int").coalesce(1).write.parquet(f"{path}/sizes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FusionModel:
        sizes = spark.read.parquet(f"{path}/sizes").collect()[0]
        return cls(
            persistence.load_tfidf(spark, f"{path}/tfidf"), persistence.load_pca(spark, f"{path}/pca"),
            persistence.load_table(spark, f"{path}/scaler"), persistence.load_mlp(spark, f"{path}/network"),
            sizes["embedding"], sizes["padding"],
        )


def _vectors(reviews, hashed, pca, scaler, padding) -> DataFrame:
    texts = text.pca_transform(hashed, pca)
    scaled = behavior.standardize_apply(behavior.behavior_features(reviews), scaler)
    numbers = scaled.select("review_id", pad_vector(F.array(*BEHAVIOR_FEATURES), padding).alias("features"))
    return cleaning.fuse_features(texts, numbers)


def fit_fusion(
    train: DataFrame,
    validation: DataFrame,
    *,
    embedding: int = 64,
    components: int = 16,
    padding: int = 16,
    hidden: Sequence[int] = (256, 64),
    epochs: int = 30,
    min_df: int = 2,
    **training,
) -> FusionModel:
    """Fit all parts on ``train``; ``validation`` only picks the epoch. Both hold reviews with text and label."""
    tfidf = text.tfidf_fit(train, min_df=min_df)
    tfidf.vocabulary = freeze(tfidf.vocabulary)
    hashed = freeze(text.hashed_vectors(train, tfidf, embedding, ("label",)))  # for the components and for the network
    pca = text.pca_fit(hashed, components)
    scaler = freeze(behavior.standardize_fit(behavior.behavior_features(train)))
    checked = text.hashed_vectors(validation, tfidf, embedding, ("label",))
    parts = [freeze(_vectors(rows, found, pca, scaler, padding)) for rows, found in ((train, hashed), (validation, checked))]
    network = mlp.mlp_focal_train(*parts, hidden=hidden, epochs=epochs, **training)
    return FusionModel(tfidf, pca, scaler, network, embedding, padding)
