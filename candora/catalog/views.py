"""Stand-in review tables over the given tables, as DataFrames and as SQL, and small helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATING = "CAST(1 + CAST(floor({0}) AS BIGINT) % 5 AS DOUBLE)"

_REVIEWS = [
    "o_orderkey AS review_id", "o_custkey AS user_id", "(o_orderkey * 7919) % 50 AS product_id",
    f"{RATING.format('o_totalprice')} AS rating",
    "CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS label", "o_orderdate AS date",
]
_EVENT_REVIEWS = [
    "event_id AS review_id", "user_id",
    "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS product_id",
    f"{RATING.format('value')} AS rating",
    "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label", "ts AS date",
]
_SCORED = [
    "o_orderkey AS review_id", "o_custkey AS user_id",
    "CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS label",
    "CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS DOUBLE) / 1000 AS prob",
    "CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 1000 >= 500 THEN 1 ELSE 0 END AS pred",
    "o_orderstatus AS grp", "o_orderdate AS date",
]
_VECTORS = [
    "vec_id AS review_id", "CAST(embedding AS {array}) AS features",
    "CASE WHEN label = 0 THEN 1 ELSE 0 END AS label",
]

REVIEWS_SQL = f"reviews AS (SELECT {', '.join(_REVIEWS)} FROM orders)"
EVENT_REVIEWS_SQL = f"event_reviews AS (SELECT {', '.join(_EVENT_REVIEWS)} FROM events)"
SCORED_SQL = f"scored AS (SELECT {', '.join(_SCORED)} FROM orders)"
VECTORS_SQL = f"vectors AS (SELECT {', '.join(_VECTORS).format(array='DOUBLE[]')} FROM embeddings)"
TEXT_REVIEWS_SQL = (
    "text_reviews AS (SELECT d.doc_id AS review_id, d.source AS product_id, d.lang, d.text, "
    "1 - l.quality AS label FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*_REVIEWS)


def event_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*_EVENT_REVIEWS)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*_SCORED)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    exprs = [e.format(array="ARRAY<DOUBLE>") for e in _VECTORS]
    return table(spark, sf, "embeddings").selectExpr(*exprs)


def text_reviews(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").selectExpr("doc_id", "1 - quality AS label")
    # a merge join deals the texts out by id even where the labels are small: work per text is heavy, the files may be few
    joined = table(spark, sf, "documents").join(labels.hint("merge"), "doc_id", "left")
    return joined.selectExpr("doc_id AS review_id", "source AS product_id", "lang", "text", "label")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating-point column, so that summation order does not show."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema
        ]
    )


def r6(expression: str) -> str:
    """The same rounding in SQL, without negative zeros."""
    value = f"CAST({expression} AS DOUBLE)"
    return f"CASE WHEN abs({value}) < 5e-7 THEN 0.0::DOUBLE ELSE round({value}, 6) END"


def metrics_sql(source: str, by: str) -> str:
    """CTEs ``cells`` and ``metrics``: threshold metrics of table ``source`` per ``by``."""
    return f"""
    cells AS (
      SELECT {by},
             CAST(sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
             CAST(sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
             CAST(sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp
      FROM {source} GROUP BY {by}),
    parts AS (
      SELECT *,
             coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision_fake,
             coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall_fake,
             coalesce(tn::DOUBLE / nullif(tn + fn, 0), 0) AS precision_genuine,
             coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS recall_genuine
      FROM cells),
    f1s AS (
      SELECT *,
             coalesce(2 * precision_fake * recall_fake / nullif(precision_fake + recall_fake, 0), 0) AS f1_fake,
             coalesce(2 * precision_genuine * recall_genuine / nullif(precision_genuine + recall_genuine, 0), 0)
               AS f1_genuine
      FROM parts),
    metrics AS (
      SELECT *, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy,
             (f1_fake + f1_genuine)
               / ((CASE WHEN tp + fp + fn > 0 THEN 1 ELSE 0 END) + (CASE WHEN tn + fp + fn > 0 THEN 1 ELSE 0 END))
               AS macro_f1,
             (f1_fake * (tp + fn) + f1_genuine * (tn + fp)) / (tp + tn + fp + fn) AS weighted_f1
      FROM f1s)"""


def auc_sql(source: str, by: str, single: str = "0.0") -> str:
    """CTE ``areas``: AUC as the share of (positive, negative) score pairs that are ordered rightly."""
    return f"""
    score_counts AS (
      SELECT {by}, prob, sum(label) AS pos, sum(1 - label) AS neg FROM {source} GROUP BY {by}, prob),
    sizes AS (SELECT {by}, sum(pos) AS p, sum(neg) AS n FROM score_counts GROUP BY {by}),
    wins AS (
      SELECT a.{by}, sum(a.pos * b.neg * CASE WHEN a.prob > b.prob THEN 1.0::DOUBLE WHEN a.prob = b.prob
             THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS won
      FROM score_counts a JOIN score_counts b ON a.{by} = b.{by} GROUP BY a.{by}),
    areas AS (
      SELECT s.{by}, CASE WHEN p * n > 0 THEN won / (p::DOUBLE * n) ELSE {single} END AS auc_roc
      FROM sizes s JOIN wins w ON s.{by} = w.{by})"""


METRIC_NAMES = [
    "accuracy", "precision_fake", "recall_fake", "f1_fake", "precision_genuine", "recall_genuine",
    "f1_genuine", "macro_f1", "weighted_f1",
]
