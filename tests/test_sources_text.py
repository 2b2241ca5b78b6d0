from __future__ import annotations

import unicodedata
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from candora.catalog.views import text_reviews, vectors
from candora.operators import attribution, cleaning, mlp, models, splits, text
from candora.sources import reviews as sources
from conftest import SF


def test_dirty_csv(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text(
        "asin,product_id,reviewerID,overall,unixReviewTime,spam,content\n"
        'a1,zzz,u1,5,1262304000,1,"  good, ""really""\nnice  "\n'
        "a2,zzz,u2,x,2010-01-01 00:00:00,?,plain\n"
        "a3,zzz,u3,4.5,1262304000,0,   \n"
    )
    raw = sources.ingest_reviews(spark, str(path), "toy")
    assert raw.columns == ["user_id", "product_id", "rating", "text", "label", "date", "dataset"]
    typed = sources.surrogate_review_id(sources.normalize_types(raw), ["product_id"])
    got = {r["review_id"]: r for r in typed.collect()}
    new_year = datetime(2010, 1, 1)
    assert [got[f"r{i:08d}"]["product_id"] for i in range(3)] == ["a1", "a2", "a3"]
    assert (got["r00000000"]["rating"], got["r00000000"]["label"], got["r00000000"]["date"]) == (5.0, 1, new_year)
    assert (got["r00000001"]["rating"], got["r00000001"]["label"], got["r00000001"]["date"]) == (None, None, new_year)
    cleaned = cleaning.clean_reviews(typed).collect()
    assert [r["text"] for r in cleaned] == ['good, "really"\nnice']
    report = cleaning.cleaning_report(typed).collect()[0]
    assert tuple(report) == (3, 1, 2)


def test_missing_columns_become_null(spark):
    got = sources.resolve_columns(spark.createDataFrame([("x",)], "text string"), "d").collect()[0]
    assert got["text"] == "x" and got["user_id"] is None and got["date"] is None


def fold(value):
    import re

    lowered = value.lower()
    plain = "".join(c for c in unicodedata.normalize("NFKD", lowered) if not unicodedata.combining(c))
    return re.findall(r"\w\w+", plain)


@pytest.mark.parametrize(
    "value",
    ["Café déjà-vu NAÏVE x 12 a_b", "ﬁne ½ ĳs ligature", "한국어 텍스트", "été ŀl", "Ελληνικά ά", "ＦＵＬＬ ｗｉｄｔｈ ①②", ""],
)
def test_tokens_match_full_decomposition(spark, value):
    df = spark.createDataFrame([(1, value)], "review_id long, text string")
    assert text.tokenize_words(df).collect()[0]["tokens"] == fold(value)


def test_vocabulary_cut_and_ties(spark, many_chunks):
    docs = ["bb aa cc", "aa bb dd", "aa cc dd", "zz"]
    df = spark.createDataFrame(list(enumerate(docs)), "review_id long, text string")
    top = text.build_vocabulary(df, max_features=3, min_df=2, high=1)
    assert sorted(map(tuple, top.collect())) == [("aa", 3, 3), ("bb", 2, 2), ("cc", 2, 2)]
    assert text.build_vocabulary(df, max_features=99, min_df=2, high=1).count() == 4


def test_tfidf_rows_have_unit_length(spark):
    rows = text_reviews(spark, SF)
    model = text.tfidf_fit(rows)
    norms = text.tfidf_transform(rows, model).groupBy("review_id").agg(F.sum(F.col("weight") ** 2).alias("s"))
    assert all(r["s"] == pytest.approx(1.0) for r in norms.collect())


def test_embedding_keeps_whole_texts_and_nulls(spark):
    long_text = "word " * 5000 + "last"
    df = spark.createDataFrame([(1, long_text), (2, None)], "review_id long, text string")

    def length_encoder(texts):
        return np.array([[len(t.split()), len(texts)] for t in texts])

    got = {r["review_id"]: r["features"] for r in text.text_embedding(df, length_encoder, 2).collect()}
    assert got[1][0] == 5001 and got[2][0] == 0


def test_pca_properties(spark):
    rows = vectors(spark, SF)
    model = text.pca_fit(rows, 8)
    components = model.components
    assert np.allclose(components @ components.T, np.eye(8), atol=1e-8)
    assert all(c[np.abs(c).argmax()] > 0 for c in components)
    data = np.array([r["features"] for r in rows.orderBy("review_id").collect()])
    got = np.array([r["features"] for r in text.pca_transform(rows, model).orderBy("review_id").collect()])
    assert np.allclose(got, (data - data.mean(axis=0)) @ components.T, atol=1e-8)
    variances = got.var(axis=0)
    assert all(a >= b - 1e-12 for a, b in zip(variances[:-1], variances[1:], strict=True))
    assert np.allclose(variances, np.sort(np.linalg.eigvalsh(np.cov(data.T, bias=True)))[::-1][:8])


def separable(spark, n=400):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        label = int(i % 4 == 0)
        rows.append((i, label, (rng.normal(size=4) + 2.0 * label).tolist()))
    return spark.createDataFrame(rows, "review_id long, label int, features array<double>")


def accuracy(df):
    return df.agg(F.avg((F.col("label") == F.col("pred")).cast("double"))).collect()[0][0]


def test_learners_learn(spark):
    train = separable(spark)
    for fit in (models.logreg_balanced, models.linear_svm_calibrated,
                lambda d: models.random_forest(d, trees=10, depth=4, balanced=True)):
        scored = fit(train)(train)
        assert accuracy(scored) > 0.9
        assert scored.filter("prob < 0 or prob > 1").count() == 0
    forest = models.random_forest(train, trees=10, depth=4)
    ranked = models.rf_feature_importance(forest, list("abcd")).collect()
    assert sum(r["importance"] for r in ranked) == pytest.approx(1.0)


def test_mlp_gradient_matches_differences():
    """The analytic focal gradient equals a numeric derivative of the focal loss."""
    layers = mlp.xavier_layers([3, 4, 1], 1)
    x, y = np.array([[0.3, -1.0, 2.0], [1.0, 0.5, -0.2], [-0.7, 0.1, 0.4]]), np.array([1.0, 0.0, 1.0])
    loss = lambda flat: mlp.focal_gradient(mlp._unflatten(flat, layers), x, y, 2.0, 0.7)[1]
    flat = mlp._flatten(layers)
    gradient = mlp.focal_gradient(layers, x, y, 2.0, 0.7)[0]
    for i in range(0, len(flat), 3):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert (loss(flat + step) - loss(flat - step)) / 2e-6 == pytest.approx(gradient[i], abs=1e-6)


def test_mlp_training_improves(spark):
    rows = separable(spark)
    trained = mlp.mlp_focal_train(rows, rows, hidden=(8,), epochs=6, batch=100, lr=0.03)
    history = {r["epoch"]: r for r in trained.history.collect()}
    assert history[6]["train_loss"] < history[1]["train_loss"]
    assert history[trained.best_epoch]["val_auc_roc"] == max(h["val_auc_roc"] for h in history.values()) > 0.9
    assert accuracy(trained(rows)) > 0.85


def test_mlp_training_is_plain_mini_batch_training(spark):
    """One task: the same as Adam over the batches, in order, in plain numpy."""
    rows = separable(spark, 60)
    trained = mlp.mlp_focal_train(rows, rows, hidden=(5,), epochs=2, batch=16, lr=0.01, dropout=0.0, alpha=0.7)
    local = rows.select(F.xxhash64("review_id", "features").alias("k"), "label", "features").orderBy("k").collect()
    keys, y, x = np.array([r["k"] for r in local]), np.array([r["label"] for r in local], float), np.array([r["features"] for r in local])
    layers = mlp.xavier_layers([4, 5, 1], 42)
    w = mlp._flatten(layers)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    for epoch in (1, 2):
        order = np.argsort(mlp._uniform(keys, 1, 42 * 100_003 + epoch)[:, 0])
        for low in range(0, 60, 16):
            own = order[low : low + 16]
            g = mlp.focal_gradient(mlp._unflatten(w, layers), x[own], y[own], 2.0, 0.7)[0] / len(own)
            t, m, v = t + 1, 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if epoch == trained.best_epoch:
            assert mlp._flatten(trained.layers) == pytest.approx(w, abs=1e-12)


def test_mlp_training_over_many_tasks_and_restarts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mlp, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(mlp, "MOST_ROWS", 20)
    rows = separable(spark).unionByName(spark.createDataFrame([(9000, None, [1.0] * 4), (9001, 1, None), (9002, 0, [float("nan")] * 4)], separable(spark, 1).schema))
    settings = {"hidden": (6,), "batch": 10, "lr": 0.1}
    trained = mlp.mlp_focal_train(rows, rows.filter("label IS NOT NULL"), epochs=4, restart=str(tmp_path / "run"), **settings)
    assert accuracy(trained(separable(spark))) > 0.85
    again = mlp.mlp_focal_train(rows, rows.filter("label IS NOT NULL"), epochs=4, restart=str(tmp_path / "run"), **settings)
    assert again.history.orderBy("epoch").collect() == trained.history.orderBy("epoch").collect()
    longer = mlp.mlp_focal_train(rows, rows.filter("label IS NOT NULL"), epochs=5, restart=str(tmp_path / "run"), **settings)
    assert longer.history.filter("epoch <= 4").orderBy("epoch").collect() == trained.history.orderBy("epoch").collect()


def test_sampled_attributions_of_a_linear_score_are_exact(spark):
    rows = vectors(spark, SF)
    background = splits.sample_n(rows, 20)
    weights = np.array([((j * 5) % 7 - 3) / 3 for j in range(64)])
    names = attribution.fused_names(58)
    sampled = attribution.shapley_sampling(rows, background, lambda x: x @ weights, names)
    closed = attribution.shapley_linear(rows, background, weights.tolist(), names)
    key = ["review_id", "feature"]
    joined = sampled.select(*key, "phi").join(closed.select(*key, F.col("phi").alias("exact")), key)
    worst = joined.agg(F.max(F.abs(F.col("phi") - F.col("exact"))), F.count(F.lit(1))).collect()[0]
    assert worst[0] < 1e-9 and worst[1] == rows.count() * 64


def test_coalition_values_of_a_product(spark):
    """Exact Shapley values by all orders, against estimates within their standard errors; totals are exact."""
    import itertools

    rng = np.random.default_rng(12)
    rows = [(k, 0, [float(v) for v in rng.normal(size=4)]) for k in range(6)] + [(90, 1, None), (91, 1, [1.0, None])]
    explain = spark.createDataFrame(rows, "review_id long, label int, features array<double>")
    base = [[float(v) for v in rng.normal(size=4)] for _ in range(3)]
    background = spark.createDataFrame([(b,) for b in base], "features array<double>")
    names = [(c, "text") for c in "abcd"]
    score = lambda x: x[:, 0] * x[:, 1] + 2 * x[:, 2] + np.maximum(x[:, 3], x[:, 0])
    got = attribution.shapley_coalitions(explain, background, score, names, pairs=400).collect()
    assert len(got) == 4 * len(rows)
    for k, _, vector in rows:
        x = np.array([v or 0.0 for v in [*(vector or []), 0, 0, 0, 0][:4]])
        value = lambda chosen, x=x: np.mean([score(np.where([j in chosen for j in range(4)], x, b)[None])[0] for b in np.array(base)])
        exact = np.zeros(4)
        for order in itertools.permutations(range(4)):
            for place, j in enumerate(order):
                exact[j] += (value(set(order[: place + 1])) - value(set(order[:place]))) / 24
        own = {r["feature"]: r for r in got if r["review_id"] == k}
        phi, error = (np.array([own[c][name] for c in "abcd"]) for name in ("phi", "error"))
        assert phi.sum() == pytest.approx(exact.sum(), abs=1e-9)
        assert (np.abs(phi - exact) <= 5 * error + 1e-9).all() and error.max() < 0.2


def test_background_must_be_small(spark):
    rows = vectors(spark, SF)
    with pytest.raises(ValueError):
        attribution.shapley_sampling(rows, rows, lambda x: x[:, 0], attribution.fused_names(58), background_limit=10)


def test_hashed_vectors_are_one_per_row_and_steps_bounded(spark, monkeypatch):
    """Texts that share an id keep their own vectors; a step holds a bounded number of tokens; terms of any place are found."""
    monkeypatch.setattr(text, "TOKENS_PER_STEP", 5)
    rows = [(1, "aa bb cc aa bb"), (1, "cc dd"), (2, "aa bb dd dd"), (3, None), (4, "zz yy"), (5, "cc aa bb cc dd")]
    df = spark.createDataFrame(rows, "review_id long, text string").coalesce(1)
    model = text.tfidf_fit(df)
    assert {r["term"]: (r["df"], r["cf"]) for r in model.vocabulary.collect()} == {
        "aa": (3, 4), "bb": (3, 4), "cc": (3, 4), "dd": (3, 4), "aa bb": (3, 4), "bb cc": (2, 2), "cc aa": (2, 2), "cc dd": (2, 2),
    }
    got = text.hashed_vectors(df, model, 8).collect()
    alone = [text.hashed_vectors(df.filter(F.col("text").eqNullSafe(F.lit(t))), model, 8).collect()[0]["features"] for _, t in rows]
    assert [r["review_id"] for r in got] == [k for k, _ in rows]
    assert [r["features"] for r in got] == alone and got[0]["features"] != got[1]["features"] and not any(got[3]["features"] + got[4]["features"])
    cells = {(r["review_id"], r["position"]): r["value"] for r in text.hashed_tfidf(df, model, 8).collect()}
    long = {(r["review_id"], r["position"]): r["value"] for r in text.hashed_embedding(text.tfidf_transform(df, model), 8).collect()}
    assert cells == pytest.approx(long)
    monkeypatch.setattr(text, "BROADCAST_TERMS", 0)
    joined = {(r["review_id"], r["position"]): r["value"] for r in text.hashed_tfidf(df.filter("review_id <> 1"), model, 8).collect()}
    assert joined == pytest.approx({k: v for k, v in long.items() if k[0] != 1})
    tokens = text._tokenized(df, []).toArrow().combine_chunks().to_batches()
    assert [step.num_rows for step, _, _ in text._token_steps(iter(tokens))] == [1, 1, 2, 1, 1]
