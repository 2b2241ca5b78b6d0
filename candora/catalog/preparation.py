"""Sources, sinks, cleaning, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from candora.catalog.views import (
    METRIC_NAMES, REVIEWS_SQL, SCORED_SQL, TEXT_REVIEWS_SQL, VECTORS_SQL, metrics_sql, r6, reviews,
    rounded, scored, table, text_reviews, vectors,
)
from candora.operators import cleaning, evaluation, splits
from candora.plans.storage import scratch_path
from candora.sources import matrices, sinks
from candora.sources import reviews as sources

SPACE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"


def ingest_reviews(spark, sf):
    path = scratch_path(spark, "reviews-csv")
    table(spark, sf, "documents").selectExpr(
        "doc_id AS review_id", "source AS reviewer_id", "lang AS productId", "text AS reviewText",
        "1 + n_chars % 5 AS stars", "n_chars % 2 AS fake", "n_chars AS unused",
    ).write.csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False, quoteAll=True,
    )
    return sources.ingest_reviews(spark, path, "docs").withColumn("text", F.md5("text"))


def normalize_types(spark, sf):
    raw = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS review_id",
        "CASE WHEN o_orderstatus = 'P' THEN element_at(array('n/a', 'nan', 'Infinity'), CAST(1 + o_orderkey % 3 AS INT)) "
        "ELSE CAST(1 + CAST(floor(o_totalprice) AS BIGINT) % 5 AS STRING) "
        "END AS rating",
        "CASE WHEN o_orderstatus = 'P' THEN element_at(array('?', 'nan', '99999999999'), CAST(1 + o_orderkey % 3 AS INT)) "
        "WHEN o_orderpriority = '1-URGENT' THEN '1' ELSE '0' END AS label",
        "CASE o_orderstatus WHEN 'F' THEN CAST(CAST(CAST(o_orderdate AS TIMESTAMP) AS BIGINT) AS STRING) "
        "WHEN 'O' THEN CAST(o_orderdate AS STRING) "
        "ELSE element_at(array('unknown', 'nan', '1e14'), CAST(1 + o_orderkey % 3 AS INT)) END AS date",
    )
    return sources.normalize_types(raw)


def surrogate_review_id(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return sources.surrogate_review_id(rows, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


def matrix_files(spark, sf):
    """Vectors written as matrix files in the order of their ids, and read back by ranges of rows."""
    path = scratch_path(spark, "matrix")
    matrices.write_matrix_files(vectors(spark, sf), path, "review_id")
    cells = matrices.read_matrix_file(spark, path, range_bytes=1 << 16).select("row", F.posexplode("features").alias("position", "value"))
    return rounded(cells)


def read_feature_matrix(spark, sf):
    wide = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS review_id", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label",
    )
    matrix = cleaning.to_vectors(wide, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(
        matrix.select("review_id", "label", *[F.col("features")[i].alias(f"f{i}") for i in range(4)])
    )


def write_splits(spark, sf):
    split = splits.temporal_split(reviews(spark, sf))
    return rounded(sinks.write_splits(split, scratch_path(spark, "splits")))


def write_results(spark, sf):
    metrics = evaluation.classification_metrics(scored(spark, sf), ["grp"]).withColumnRenamed("grp", "model")
    long = evaluation.to_long(metrics, ["model"], evaluation.METRICS)
    path = scratch_path(spark, "results")
    sinks.write_results(long, path)
    return rounded(sinks.read_results(spark, path))


def clean_reviews(spark, sf):
    return cleaning.clean_reviews(text_reviews(spark, sf)).select("review_id", "label", "text")


def cleaning_report(spark, sf):
    return cleaning.cleaning_report(text_reviews(spark, sf))


def text_lengths(spark, sf):
    rows = cleaning.text_lengths(text_reviews(spark, sf))
    return rows.select("review_id", "text_length", "char_length")


def dataset_profile(spark, sf):
    return rounded(cleaning.dataset_profile(reviews(spark, sf)))


def split_summary(spark, sf):
    return rounded(cleaning.split_summary(splits.stratified_split(reviews(spark, sf))))


def pad_features(spark, sf):
    rows = reviews(spark, sf).select("review_id", F.array("rating", F.col("label").cast("double")).alias("v"))
    return cleaning.pad_features(rows, "v", 16).select(
        "review_id", F.size("v").alias("width"), F.col("v")[0].alias("first"), F.col("v")[1].alias("second"),
        F.col("v")[15].alias("last"),
    )


def fuse_features(spark, sf):
    behavior = reviews(spark, sf).select(
        "review_id", F.array("rating", F.col("product_id").cast("double")).alias("features")
    )
    fused = cleaning.fuse_features(vectors(spark, sf), behavior)
    v = F.col("features")
    return rounded(
        fused.select(
            "review_id", "label", F.size(v).alias("width"), v[0].alias("first"), v[63].alias("last_text"),
            v[64].alias("rating"), v[65].alias("product"),
        )
    )


def slice_branch(spark, sf):
    half = cleaning.slice_branch(vectors(spark, sf), "features", 32, 64)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
    return rounded(
        half.select(
            "review_id", F.size("features").alias("width"), F.col("features")[0].alias("first"), total.alias("total")
        )
    )


def temporal_split(spark, sf):
    return splits.temporal_split(reviews(spark, sf)).select("review_id", "date", "split")


def stratified_split(spark, sf):
    return splits.stratified_split(reviews(spark, sf)).select("review_id", "label", "split")


def stratified_kfold(spark, sf):
    return splits.stratified_kfold(reviews(spark, sf)).select("review_id", "label", "fold")


def temporal_kfold(spark, sf):
    return splits.temporal_kfold(reviews(spark, sf))


def train_eval_union(spark, sf):
    rows = splits.stratified_split(reviews(spark, sf)).select("review_id", "label", "split")
    return cleaning.train_eval_union(
        rows.filter(F.col("split") == "validation"), rows.filter(F.col("split") == "test")
    )


def sample_n(spark, sf):
    return splits.sample_n(reviews(spark, sf), 200).select("review_id", "label")


def oversample_minority(spark, sf):
    return splits.oversample_minority(reviews(spark, sf)).select("review_id", "label", "copy")


QUERIES = {
    f.__name__: f
    for f in (
        ingest_reviews, normalize_types, surrogate_review_id, matrix_files, read_feature_matrix, write_splits, write_results,
        clean_reviews, cleaning_report, text_lengths, dataset_profile, split_summary, pad_features,
        fuse_features, slice_branch, temporal_split, stratified_split, stratified_kfold, temporal_kfold,
        train_eval_union, sample_n, oversample_minority,
    )
}

_CUTOFF = """
    cut AS (SELECT date AS cutoff FROM reviews ORDER BY date
            LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) FROM reviews)),
    split AS (SELECT r.*, CASE WHEN date <= cutoff THEN 'train' ELSE 'test' END AS split FROM reviews r, cut)"""

_HASH_RANK = """
    ranked AS (
      SELECT review_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || review_id), review_id) - 1
             AS rk, count(*) OVER (PARTITION BY label) AS size
      FROM reviews)"""

_STRATIFIED = f"""{_HASH_RANK},
    stratified AS (
      SELECT review_id, label,
             CASE WHEN rk < ceil(size * 0.2::DOUBLE) THEN 'test'
                  WHEN rk < 2 * ceil(size * 0.2::DOUBLE) THEN 'validation' ELSE 'train' END AS split
      FROM ranked)"""

_SUMMARY = f"""
    SELECT split, count(*) AS n_reviews, count(*) FILTER (label = 1) AS n_fake,
           count(*) FILTER (label = 0) AS n_genuine, {r6('avg(label)')} AS fake_rate
    FROM {{0}} GROUP BY split"""

_USABLE = f"label IS NOT NULL AND text IS NOT NULL AND regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') <> ''"

ORACLES = {
    "ingest_reviews": """
        SELECT CAST(doc_id AS VARCHAR) AS review_id, source AS user_id, lang AS product_id,
               CAST(1 + n_chars % 5 AS VARCHAR) AS rating, md5(text) AS text, CAST(n_chars % 2 AS VARCHAR) AS label,
               CAST(NULL AS VARCHAR) AS date, 'docs' AS dataset
        FROM documents""",
    "normalize_types": """
        SELECT o_orderkey AS review_id,
               CASE WHEN o_orderstatus <> 'P' THEN CAST(1 + CAST(floor(o_totalprice) AS BIGINT) % 5 AS DOUBLE) END
                 AS rating,
               CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS label,
               CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderdate END AS date
        FROM orders""",
    "surrogate_review_id": """
        SELECT o_orderkey,
               'r' || lpad(CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS VARCHAR), 8, '0')
                 AS review_id
        FROM orders""",
    "matrix_files": f"""
        WITH {VECTORS_SQL},
        numbered AS (SELECT row_number() OVER (ORDER BY review_id) - 1 AS row, features FROM vectors)
        SELECT row, CAST(generate_subscripts(features, 1) - 1 AS INTEGER) AS position, {r6('unnest(features)')} AS value FROM numbered""",
    "read_feature_matrix": f"""
        SELECT l_orderkey AS review_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
               {r6('l_quantity')} AS f0, {r6('l_extendedprice')} AS f1, {r6('l_discount')} AS f2, {r6('l_tax')} AS f3
        FROM lineitem""",
    "write_splits": f"WITH {REVIEWS_SQL}, {_CUTOFF} {_SUMMARY.format('split')}",
    "write_results": f"""
        WITH {SCORED_SQL}, {metrics_sql('scored', 'grp')}
        {' UNION ALL '.join(f"SELECT grp AS model, '{m}' AS metric, {r6(m)} AS value FROM metrics" for m in METRIC_NAMES)}
        """,
    "clean_reviews": f"""
        WITH {TEXT_REVIEWS_SQL}
        SELECT review_id, CAST(label AS INTEGER) AS label,
               regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS text
        FROM text_reviews WHERE {_USABLE}""",
    "cleaning_report": f"""
        WITH {TEXT_REVIEWS_SQL}
        SELECT count(*) AS rows_before, count(*) FILTER ({_USABLE}) AS rows_kept,
               count(*) - count(*) FILTER ({_USABLE}) AS rows_dropped
        FROM text_reviews""",
    "text_lengths": f"""
        WITH {TEXT_REVIEWS_SQL}
        SELECT review_id,
               CAST(len(list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda w: w <> '')) AS INTEGER) AS text_length,
               CAST(length(text) AS INTEGER) AS char_length
        FROM text_reviews""",
    "dataset_profile": f"""
        WITH {REVIEWS_SQL}
        SELECT count(*) AS n_reviews, count(*) FILTER (label = 1) AS n_fake, {r6('avg(label) * 100')} AS pct_fake,
               count(*) FILTER (label = 0) AS n_genuine, {r6('avg(1 - label) * 100')} AS pct_genuine,
               count(DISTINCT user_id) AS n_users, count(DISTINCT product_id) AS n_products,
               min(date) AS first_date, max(date) AS last_date
        FROM reviews""",
    "split_summary": f"WITH {REVIEWS_SQL}, {_STRATIFIED} {_SUMMARY.format('stratified')}",
    "pad_features": f"""
        WITH {REVIEWS_SQL}
        SELECT review_id, 16 AS width, rating AS first, CAST(label AS DOUBLE) AS second, 0.0::DOUBLE AS last
        FROM reviews""",
    "fuse_features": f"""
        WITH {REVIEWS_SQL}, {VECTORS_SQL}
        SELECT v.review_id, v.label, 66 AS width, {r6('v.features[1]')} AS first,
               {r6('v.features[64]')} AS last_text, r.rating, CAST(r.product_id AS DOUBLE) AS product
        FROM vectors v JOIN reviews r ON v.review_id = r.review_id""",
    "slice_branch": f"""
        WITH {VECTORS_SQL}
        SELECT review_id, 32 AS width, {r6('features[33]')} AS first, {r6('list_sum(features[33:64])')} AS total
        FROM vectors""",
    "temporal_split": f"WITH {REVIEWS_SQL}, {_CUTOFF} SELECT review_id, date, split FROM split",
    "stratified_split": f"WITH {REVIEWS_SQL}, {_STRATIFIED} SELECT review_id, label, split FROM stratified",
    "stratified_kfold": f"""
        WITH {REVIEWS_SQL}, {_HASH_RANK}
        SELECT review_id, label, CAST(rk % 5 + 1 AS INTEGER) AS fold FROM ranked""",
    "temporal_kfold": f"""
        WITH {REVIEWS_SQL},
        placed AS (SELECT review_id, row_number() OVER (ORDER BY date, review_id) - 1 AS pos, count(*) OVER () AS n
                   FROM reviews),
        bounds AS (SELECT k AS fold, k * (n // 5) AS lo, least((k + 1) * (n // 5), n) AS hi, n
                   FROM (SELECT count(*) AS n FROM reviews), range(1, 6) t(k)),
        kept AS (SELECT * FROM bounds WHERE lo >= CAST(floor(n * 0.4::DOUBLE) AS BIGINT) AND lo < n)
        SELECT review_id, CAST(fold AS INTEGER) AS fold, CASE WHEN pos < lo THEN 'train' ELSE 'test' END AS role
        FROM placed JOIN kept ON pos < hi""",
    "train_eval_union": f"""
        WITH {REVIEWS_SQL}, {_STRATIFIED}
        SELECT review_id, label, split FROM stratified WHERE split <> 'train'""",
    "sample_n": f"""
        WITH {REVIEWS_SQL}
        SELECT review_id, label FROM reviews ORDER BY md5('42|' || review_id), review_id LIMIT 200""",
    "oversample_minority": f"""
        WITH {REVIEWS_SQL},
        means AS (SELECT label, sum(count(*)) OVER () / (2.0::DOUBLE * count(*)) AS mu FROM reviews GROUP BY label),
        pmf AS (SELECT label, k, exp(-mu) * pow(mu, k) / gamma(k + 1) AS p FROM means, range(0, 60) t(k)),
        cdf AS (SELECT label, k, sum(p) OVER (PARTITION BY label ORDER BY k) AS below FROM pmf),
        draws AS (
          SELECT r.review_id, r.label,
                 CAST('0x' || md5('42.0|' || review_id)[1:12] AS BIGINT) / pow(16.0::DOUBLE, 12) AS u
          FROM reviews r),
        copies AS (
          SELECT d.review_id, d.label, count(*) FILTER (c.below <= d.u) AS n
          FROM draws d JOIN cdf c ON d.label = c.label GROUP BY ALL)
        SELECT review_id, label, CAST(copy AS INTEGER) AS copy FROM copies, range(1, 60) t(copy) WHERE copy <= n""",
}
