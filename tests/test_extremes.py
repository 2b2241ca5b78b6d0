"""Hot keys, dirty input and large numbers."""

import json

import pytest
from pyspark.sql import functions as F

from candora.operators import asof, evaluation, significance, splits, text
from candora.plans.skew import spread_join
from candora.sources import reviews as sources


def test_reviewers_beyond_ten_thousand_rows_have_a_stratum(spark):
    df = spark.range(12_000).select(
        F.col("id").alias("review_id"), F.lit(7).alias("user_id"), (F.col("id") % 2).cast("int").alias("label"),
        ((F.col("id") * 7) % 10 / 10.0).alias("prob"), (F.col("id") % 3 == 0).cast("int").alias("pred"),
    )
    (row,) = evaluation.stratum_metrics(df).collect()
    assert (row["stratum"], row["n_reviews"]) == ("50+", 12_000)


def test_rolling_burst_ratio_of_a_bot(spark):
    start = F.lit("2024-01-01").cast("timestamp").cast("long")
    once = spark.range(120_000).select(F.col("id").alias("review_id"), F.lit(1).alias("user_id"), start.alias("s"))
    spread = spark.range(400_000).select(F.col("id").alias("review_id"), F.lit(2).alias("user_id"), (start + F.col("id") % 400 * 86_400).alias("s"))
    df = once.unionByName(spread).withColumn("date", F.timestamp_seconds("s")).drop("s")
    got = {r["user_id"]: (r["n_reviews"], r["rolling_burst_ratio"]) for r in asof.rolling_burst_ratio(df).collect()}
    assert got == {1: (120_000, 0.0), 2: (400_000, 0.0)}


def test_wilcoxon_with_millions_of_ties(spark):
    pairs = spark.range(2_500_000).select(F.lit(2.0).alias("a"), F.lit(1.0).alias("b"))
    (row,) = significance.wilcoxon_signed_rank(pairs, "a", "b").collect()
    assert (row["n"], row["statistic"], row["significant"]) == (2_500_000, 0.0, 1)


def test_bad_values_become_null(spark):
    raw = spark.createDataFrame(
        [("nan", "99999999999", "nan"), ("Infinity", "nan", "1e14"), ("-inf", "1.5", "9e300"), ("4.5", "1.0", "86400"), ("x", "-1", "2020-02-01")],
        "rating string, label string, date string",
    )
    got = [tuple(r) for r in sources.normalize_types(raw).select("rating", "label", F.col("date").cast("string")).collect()]
    assert got[:3] == [(None, None, None)] * 3
    assert got[3:] == [(4.5, 1, "1970-01-02 00:00:00"), (None, -1, "2020-02-01 00:00:00")]


def test_files_with_another_column_order_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("reviewerID,asin,overall,reviewText\nu1,p1,5,hello\n")
    (tmp_path / "b.csv").write_text("reviewText,reviewerID,asin,overall\nworld,u2,p2,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        sources.ingest_reviews(spark, str(tmp_path), "shop").collect()


def test_json_rows_may_name_columns_differently(spark, tmp_path):
    rows = [{"reviewerID": "u1", "asin": "p", "overall": 5, "text": "a"}, {"stars": 2.5, "user_id": "u2", "product_id": "q", "reviewText": "b"}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    got = sources.ingest_reviews(spark, str(tmp_path), "shop", "json").orderBy("user_id").collect()
    assert [(r["user_id"], r["product_id"], r["rating"], r["text"]) for r in got] == [("u1", "p", "5", "a"), ("u2", "q", "2.5", "b")]


@pytest.mark.parametrize("n,k", [(13, 5), (10, 5), (3, 5), (2, 5), (0, 5), (100, 5), (11, 3)])
def test_fold_bounds_by_definition(n, k):
    step = n // k
    expected = [
        (f, f * step, min(f * step + step, n)) for f in range(1, k + 1) if f * step >= int(n * 0.4) and f * step < n
    ]
    assert splits.temporal_fold_bounds(n, k) == expected


def _largest_share(df):
    sizes = [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    return max(sizes) / sum(sizes)


def test_every_hot_key_is_split(spark, many_chunks):
    medium = spark.range(50_000).select(F.col("id").alias("review_id"), (F.col("id") % 5000).alias("k"))
    hot = spark.range(50_000, 75_000).select(F.col("id").alias("review_id"), F.lit(-1).cast("long").alias("k"))
    rows = medium.unionByName(hot)
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("review_id").alias("s"))
    joined = spread_join(rows, stats, ["k"], "n", ["review_id"], rows_per_task=5)
    assert joined.count() == 75_000 and joined.filter("s IS NULL").count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _largest_share(spread_join(rows, stats, ["k"], "n", ["review_id"], rows_per_task=500)) < 0.25
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_top_k_per_group(spark, many_chunks):
    df = spark.range(20_000).select(F.col("id").alias("review_id"), ((F.col("id") * 7919) % 1000 / 1000.0).alias("prob"), F.when(F.col("id") % 10 > 0, "a").otherwise("b").alias("grp"))
    large = evaluation.risk_topk(df, 5000, ["grp"])
    expected = df.toPandas().sort_values(["prob", "review_id"], ascending=[False, True]).groupby("grp").head(5000)
    got = large.toPandas()
    assert set(got["review_id"]) == set(expected["review_id"]) and got.groupby("grp")["risk_rank"].max().to_dict() == {"a": 5000, "b": 2000}


def test_large_samples_equal_the_top_of_the_hash_order(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").alias("review_id"))
    small = {r["review_id"] for r in splits.sample_n(df, 700).collect()}
    monkeypatch.setattr(splits, "MERGED_ROWS", 10)
    assert {r["review_id"] for r in splits.sample_n(df, 700).collect()} == small
    assert splits.sample_n(df, 6000).count() == 5000


def test_term_counts_and_weights_do_not_shuffle(spark):
    rows = [(1, "a bb bb cc", 0), (2, None, 1), (3, "", 0), (4, "cc bb", 1), (5, "zz " * 3000, 0)]
    df = spark.createDataFrame(rows, "review_id long, text string, label int")
    counts = text.term_counts(df)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in counts.filter("review_id < 5").collect())
    assert got == [(1, "bb", 2), (1, "bb bb", 1), (1, "bb cc", 1), (1, "cc", 1), (4, "bb", 1), (4, "cc", 1), (4, "cc bb", 1)]
    model = text.tfidf_fit(df, min_df=1)
    weights = text.tfidf_transform(df, model)
    assert "Exchange" not in weights._jdf.queryExecution().executedPlan().toString()
    vectors = {r["review_id"]: r["features"] for r in text.tfidf_vectors(df, model).collect()}
    assert vectors[2].numNonzeros() == 0 and vectors[1].size == model.size and vectors[1].norm(2) == pytest.approx(1)


def test_joined_and_broadcast_vocabularies_agree(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"aa w{k % 3} w{k % 5}", 0) for k in range(40)], "review_id long, text string, label int")
    model = text.tfidf_fit(df, min_df=1)
    rounded = lambda d: sorted((r["review_id"], r["term"], r["index"], round(r["weight"], 9)) for r in d.collect())
    one = rounded(text.tfidf_transform(df, model))
    vectors = sorted((r["review_id"], str(r["features"])) for r in text.tfidf_vectors(df, model).collect())
    monkeypatch.setattr(text, "BROADCAST_TERMS", 3)
    assert rounded(text.tfidf_transform(df, model)) == one
    assert [v[0] for v in sorted((r["review_id"], str(r["features"])) for r in text.tfidf_vectors(df, model).collect())] == [v[0] for v in vectors]
