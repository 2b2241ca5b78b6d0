"""Linear learners: few passes over the rows, and the same optimum."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from candora.operators import linear, models


def counted(monkeypatch):
    passes, call = [], linear.Sums.__call__
    monkeypatch.setattr(linear.Sums, "__call__", lambda self, *a: passes.append(1) or call(self, *a))
    return passes


def test_narrow_rows_take_a_pass_a_newton_step(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 40)) * np.linspace(0.05, 5, 40)
    y = (x @ rng.normal(size=40) + 20 * rng.normal(size=600) > 0).astype(int)
    df = spark.createDataFrame([(int(k), [float(v) for v in a]) for k, a in zip(y, x, strict=True)], "label int, features array<double>")
    passes = counted(monkeypatch)
    few = models.logreg_balanced(df, tolerance=1e-9)
    assert len(passes) <= 15  # with a pass for each step of the conjugate gradients over 60
    monkeypatch.setattr(linear, "HESSIAN_WIDTH", 0)
    assert few.weights == pytest.approx(models.logreg_balanced(df, tolerance=1e-9).weights, abs=1e-6)


def test_wide_rows_are_preconditioned_with_a_sample(spark, monkeypatch):
    rng = np.random.default_rng(5)
    often = np.minimum(0.8, 3.0 / np.arange(1, 401))
    x = (rng.random((600, 400)) < often) * rng.random((600, 400))
    y = (x @ rng.normal(size=400) > 0).astype(int)
    data = [(int(k), Vectors.sparse(400, np.flatnonzero(a).tolist(), a[a != 0].tolist())) for k, a in zip(y, x, strict=True)]
    df = spark.createDataFrame(data, ["label", "features"])
    blocks, width, seen = linear.packed(df)
    share = linear.balanced(seen.sum(axis=0))[None, :]
    passes, found = counted(monkeypatch), {}
    for rows, most in ((2000, 20), (150, 80)):
        monkeypatch.setattr(linear, "SAMPLE_ROWS", rows)
        passes.clear()
        found[rows] = linear.solve(blocks, width, linear.SQUARED_HINGE, share, True, 100, 1e-5)
        assert len(passes) <= most  # without the sample over 80
    assert found[150] == pytest.approx(found[2000], abs=1e-3)
    blocks.unpersist()


def test_sample_of_no_rows_is_no_error(spark):
    df = spark.createDataFrame([], "label int, features array<double>")
    blocks, _, _ = linear.packed(df)
    weights = linear.solve(blocks, linear.HESSIAN_WIDTH + 1, linear.LOGISTIC, np.ones((1, 2)), True, 10, 1e-4)
    assert not weights.any()


def test_cross_domain_text_counts_the_words_once(spark, monkeypatch):
    from candora.catalog import QUERIES
    from candora.operators import text

    fits, fit = [], text.tfidf_fit
    for module in (text, models):
        monkeypatch.setattr(module, "tfidf_fit", lambda *a, **k: fits.append(1) or fit(*a, **k))
    assert QUERIES["cross_domain_text"](spark, "/root/testdata/sf0.001").count() == 2
    assert len(fits) == 1


def test_fusion_hashes_its_texts_once(spark, monkeypatch):
    from candora.catalog import fitted
    from candora.operators import fusion, splits, text

    rows = splits.stratified_split(fitted.document_reviews(spark, "/root/testdata/sf0.001")).cache()
    parts = [rows.filter(rows.split == s).drop("split") for s in ("train", "validation")]
    calls, hashed = [], text.hashed_vectors
    monkeypatch.setattr(text, "hashed_vectors", lambda df, *a: calls.append(df) or hashed(df, *a))
    model = fusion.fit_fusion(*parts, components=4, hidden=(4,), epochs=1)
    assert [any(df is part for part in parts) for df in calls] == [True, True]
    vectors = model.vectors(parts[1]).collect()
    assert len(vectors) == parts[1].count() and all(len(r["features"]) == 4 + 16 for r in vectors)
    rows.unpersist()
