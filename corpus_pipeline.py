"""Cleaning pipeline over ``documents``: toxicity, exact copies, near copies, benchmark leaks, then the mix.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the last return the
columns of ``documents``; the last returns what the mix takes of each document. A document's id is its key: rows with a
null id are never dropped as copies or leaks, and rows that repeat an id share their fate. Null and empty texts are not
toxic, are one group of exact copies, have no near copies or leaks and no words to mix. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candora.llm import decontamination, exact_dedup, minhash_dedup, mixing, toxicity
from candora.llm.shared import stored


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows whose id is not among ``dropped``."""
    return docs.join(dropped.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, by a model learned from the ``labels`` of these documents."""
    model = toxicity.fit_from_folder(spark, docs, sf_dir)
    return toxicity.keep_clean(docs, model, "text")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of equal texts."""
    groups = exact_dedup.exact_groups(docs)
    return _without(docs, groups.filter("doc_id != keep_id"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more."""
    groups = minhash_dedup.near_duplicates(docs.filter("doc_id IS NOT NULL"), shingle=5, percent=80)
    return _without(docs, groups.filter("NOT kept"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: five-word shingles, containment below 0.8."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, decontamination.find_contained(docs, items))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, with its source's target."""
    taken = mixing.taken_words(mixing.mix_sources(docs))
    return taken.select(F.col("_id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix),
]

#: No SQL expresses the trained classifier of the first stage or the draws of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
