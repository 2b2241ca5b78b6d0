"""Class balance, loss, classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from candora.catalog.views import (
    METRIC_NAMES, REVIEWS_SQL, SCORED_SQL, VECTORS_SQL, auc_sql, metrics_sql, r6, reviews,
    rounded, scored, text_reviews, vectors,
)
from candora.operators import balance, behavior, cleaning, evaluation, mlp, models, splits
from candora.plans.storage import freeze
from candora.schema import BEHAVIOR_FEATURES

LOGIT = "prob * 8 - 4"
WIDTH, HIDDEN = 64, 4


def fixed_layers():
    """Small fixed weights, so that a forward pass can be checked."""
    import numpy as np

    first = np.array([[((i * 7 + j * 3) % 11 - 5) / 10 for i in range(WIDTH)] for j in range(HIDDEN)])
    second = np.array([[(j - 1) / 2 for j in range(HIDDEN)]])
    return [(first, np.array([j / 10 for j in range(HIDDEN)])), (second, np.array([0.1]))]


def class_weights(spark, sf):
    return rounded(balance.class_weights(reviews(spark, sf)))


def focal_alpha(spark, sf):
    return rounded(balance.focal_alpha(reviews(spark, sf)))


def focal_loss(spark, sf):
    rows = scored(spark, sf).selectExpr("review_id", "label", f"{LOGIT} AS logit")
    loss = balance.focal_loss(rows, alpha=0.8, reduction="none")
    return rounded(loss.select("review_id", "loss"))


def focal_loss_mean(spark, sf):
    rows = scored(spark, sf).selectExpr("review_id", "label", f"{LOGIT} AS logit")
    return rounded(balance.focal_loss(rows))


def sigmoid_score(spark, sf):
    rows = scored(spark, sf).selectExpr("review_id", f"{LOGIT} AS logit")
    return rounded(balance.sigmoid_score(rows))


def mlp_score(spark, sf):
    rows = mlp.mlp_score(vectors(spark, sf), fixed_layers())
    return rounded(rows.select("review_id", "logit", "prob", "pred"))


def training_history(spark, sf):
    """Per-year metrics of the scored rows as epochs."""
    rows = scored(spark, sf).withColumn("epoch", F.year("date") - 1994)
    measured = evaluation.all_metrics(rows, ["epoch"]).select(
        "epoch", F.col("accuracy").alias("val_accuracy"), F.col("auc_roc").alias("val_auc_roc"),
        F.col("macro_f1").alias("val_macro_f1"),
    )
    return rounded(mlp.training_history(measured))


def best_epoch(spark, sf):
    rows = scored(spark, sf).withColumn("epoch", F.year("date") - 1994)
    measured = evaluation.all_metrics(rows, ["epoch"])
    return rounded(mlp.best_epoch(measured, "auc_roc"))


def behavior_vectors(spark, sf):
    """Train and evaluation rows with scaled behaviour vectors (statistics from train)."""
    features = behavior.behavior_features(reviews(spark, sf), keep=["label"])
    split = freeze(splits.stratified_split(features))
    stats = behavior.standardize_fit(split.filter(F.col("split") == "train"))
    scaled = cleaning.to_vectors(behavior.standardize_apply(split, stats), BEHAVIOR_FEATURES)
    return (
        scaled.filter(F.col("split") == "train").drop("split"),
        scaled.filter(F.col("split") != "train").drop("split"),
    )


def _measured(score, test):
    """Metrics of the scored rows next to how many there are."""
    rows = freeze(score(test).select("review_id", "label", "pred", "prob").withColumn("model", F.lit("m")))
    return rounded(evaluation.all_metrics(rows, ["model"]).drop("model"))


def logreg_balanced(spark, sf):
    """Vocabulary, weights and model from one half of the labelled texts, measured on the other."""
    rows = cleaning.clean_reviews(text_reviews(spark, sf)).select("review_id", "text", "label")
    split = freeze(splits.stratified_split(rows, test=0.5, validation=0.0))
    fit = models.on_tfidf(models.logreg_balanced)
    return _measured(fit(split.filter("split = 'train'")), split.filter("split = 'test'"))


def linear_svm_calibrated(spark, sf):
    rows = cleaning.clean_reviews(text_reviews(spark, sf)).select("review_id", "text", "label")
    split = freeze(splits.stratified_split(rows, test=0.5, validation=0.0))
    fit = models.on_tfidf(models.linear_svm_calibrated)
    return _measured(fit(split.filter("split = 'train'")), split.filter("split = 'test'"))


def random_forest(spark, sf):
    train, test = behavior_vectors(spark, sf)
    return _measured(models.random_forest(train), test)


def random_forest_balanced(spark, sf):
    train, test = behavior_vectors(spark, sf)
    return _measured(models.random_forest(train, balanced=True), test)


def rf_feature_importance(spark, sf):
    train, _ = behavior_vectors(spark, sf)
    return rounded(models.rf_feature_importance(models.random_forest(train), BEHAVIOR_FEATURES))


def mlp_gradient(spark, sf):
    """Gradient of the mean focal loss at fixed weights."""
    return rounded(mlp.loss_gradient(vectors(spark, sf), fixed_layers(), alpha=0.8))


STEP = 0.05


def mlp_step(spark, sf):
    """Weights after one step over all rows from fixed weights."""
    rows = vectors(spark, sf)
    trained = mlp.mlp_focal_train(rows, rows, epochs=1, batch=1 << 40, lr=STEP, alpha=0.8, dropout=0.0, layers=fixed_layers())
    cells = []
    for k, layer in enumerate(trained.layers):
        for kind, values in zip(("weights", "bias"), layer, strict=True):
            cells += [(k, kind, place, float(v)) for place, v in enumerate(values.ravel())]
    return rounded(spark.createDataFrame(cells, "layer int, kind string, position int, value double"))


def mlp_focal_train(spark, sf):
    rows = splits.stratified_split(vectors(spark, sf))
    parts = {s: rows.filter(F.col("split") == s) for s in ("train", "validation", "test")}
    trained = mlp.mlp_focal_train(parts["train"], parts["validation"])
    tested = evaluation.all_metrics(trained(parts["test"]).withColumn("m", F.lit("test")), ["m"])
    test = tested.select(F.col("auc_roc").alias("test_auc_roc"), F.col("macro_f1").alias("test_macro_f1")).collect()[0]
    best = F.col("epoch") == trained.best_epoch
    return rounded(trained.history.withColumns({c: F.when(best, F.lit(test[c])) for c in ("test_auc_roc", "test_macro_f1")}))


QUERIES = {
    f.__name__: f
    for f in (
        class_weights, focal_alpha, focal_loss, focal_loss_mean, sigmoid_score, mlp_score, training_history,
        best_epoch, logreg_balanced, linear_svm_calibrated, random_forest, random_forest_balanced,
        rf_feature_importance, mlp_gradient, mlp_step, mlp_focal_train,
    )
}

_CLASSES = """
    sizes AS (SELECT c AS label, (SELECT count(*) FROM reviews WHERE label = c) AS n_rows,
                     (SELECT count(*) FROM reviews)::DOUBLE AS n FROM range(0, 2) t(c)),
    raw AS (SELECT label, n_rows, n / (2 * greatest(n_rows, 1)) AS w FROM sizes),
    weights AS (SELECT label, n_rows, w / avg(w) OVER () AS weight FROM raw)"""


def _focal(alpha1: float) -> str:
    """-a (1 - p)^2 ln p of the true class."""
    return f"""
    rows AS (SELECT review_id, label, 1 / (1 + exp(-({LOGIT})::DOUBLE)) AS p FROM scored),
    losses AS (
      SELECT review_id,
             CASE WHEN label = 1 THEN -{alpha1}::DOUBLE * pow(1 - p, 2) * ln(p)
                  ELSE -(1 - {alpha1}::DOUBLE) * pow(p, 2) * ln(1 - p) END AS loss
      FROM rows)"""


def _forward() -> str:
    (w1, b1), (w2, b2) = fixed_layers()
    units = [
        f"{w2[0][j]} * greatest(0.0::DOUBLE, list_dot_product(features, {[float(w) for w in w1[j]]}::DOUBLE[]) + {b1[j]})"
        for j in range(HIDDEN)
    ]
    return f"SELECT review_id, {' + '.join(units)} + {b2[0]} AS z FROM vectors"


def _backward() -> str:
    """Gradient of the mean focal loss (alpha 0.8, gamma 2) by cell, and the fixed weights."""
    (w1, b1), (w2, b2) = fixed_layers()
    units = ", ".join(f"list_dot_product(features, {[float(w) for w in w1[j]]}::DOUBLE[]) + {b1[j]}" for j in range(HIDDEN))
    outer = [float(w) for w in w2[0]]
    flat = [float(w) for w in w1.ravel()]
    return f"""
    h AS (SELECT review_id, label, features, [{units}] AS h FROM vectors),
    z AS (SELECT *, list_dot_product([greatest(0.0::DOUBLE, u) FOR u IN h], {outer}::DOUBLE[]) + {b2[0]} AS z FROM h),
    p AS (SELECT *, CASE WHEN label = 1 THEN 1 / (1 + exp(-z)) ELSE 1 - 1 / (1 + exp(-z)) END AS pt,
      CASE WHEN label = 1 THEN 0.8::DOUBLE ELSE -0.2::DOUBLE END AS a FROM z),
    s AS (SELECT *, a * (2 * pow(1 - pt, 2) * pt * ln(pt) - pow(1 - pt, 3)) AS slope FROM p),
    u AS (SELECT *, unnest(range(0, {HIDDEN}))::INTEGER AS j FROM s),
    i AS (SELECT slope * ({outer}::DOUBLE[])[j + 1] * (h[j + 1] > 0)::INTEGER AS back, j, features FROM u),
    c AS (SELECT back * features[x + 1] AS g, j * {WIDTH} + x AS position FROM (SELECT *, unnest(range(0, {WIDTH}))::INTEGER AS x FROM i)),
    cells AS (
      SELECT 0 AS layer, 'weights' AS kind, position, avg(g) AS gradient FROM c GROUP BY position
      UNION ALL SELECT 0, 'bias', j, avg(back) FROM i GROUP BY j
      UNION ALL SELECT 1, 'weights', j, avg(slope * greatest(0.0::DOUBLE, h[j + 1])) FROM u GROUP BY j
      UNION ALL SELECT 1, 'bias', 0, avg(slope) FROM s),
    known AS (
      SELECT 0 AS layer, 'weights' AS kind, unnest(range(0, {len(flat)})) AS position, unnest({flat}::DOUBLE[]) AS w
      UNION ALL SELECT 0, 'bias', unnest(range(0, {HIDDEN})), unnest({[float(b) for b in b1]}::DOUBLE[])
      UNION ALL SELECT 1, 'weights', unnest(range(0, {HIDDEN})), unnest({outer}::DOUBLE[])
      UNION ALL SELECT 1, 'bias', 0, {b2[0]}::DOUBLE)"""


_EPOCHS = f"""
    WITH {SCORED_SQL}, epochs AS (SELECT *, CAST(year(date) - 1994 AS INTEGER) AS epoch FROM scored),
    {metrics_sql('epochs', 'epoch')}, {auc_sql('epochs', 'epoch')}"""

ORACLES = {
    "class_weights": f"""
        WITH {REVIEWS_SQL}, {_CLASSES}
        SELECT CAST(label AS INTEGER) AS label, n_rows, {r6('weight')} AS weight FROM weights""",
    "focal_alpha": f"""
        WITH {REVIEWS_SQL} SELECT {r6('1 - avg(label)')} AS alpha FROM reviews""",
    "focal_loss": f"WITH {SCORED_SQL}, {_focal(0.8)} SELECT review_id, {r6('loss')} AS loss FROM losses",
    "focal_loss_mean": f"WITH {SCORED_SQL}, {_focal(0.5)} SELECT {r6('avg(loss)')} AS loss FROM losses",
    "sigmoid_score": f"""
        WITH {SCORED_SQL}, z AS (SELECT review_id, ({LOGIT})::DOUBLE AS logit FROM scored)
        SELECT review_id, {r6('logit')} AS logit, {r6('1 / (1 + exp(-logit))')} AS prob,
               CAST(CASE WHEN 1 / (1 + exp(-logit)) >= 0.5 THEN 1 ELSE 0 END AS INTEGER) AS pred FROM z""",
    "mlp_score": f"""
        WITH {VECTORS_SQL}, z AS ({_forward()})
        SELECT review_id, {r6('z')} AS logit, {r6('1 / (1 + exp(-z))')} AS prob,
               CAST(CASE WHEN z >= 0 THEN 1 ELSE 0 END AS INTEGER) AS pred FROM z""",
    "mlp_gradient": f"""
        WITH {VECTORS_SQL}, {_backward()}
        SELECT CAST(layer AS INTEGER) AS layer, kind, CAST(position AS INTEGER) AS position, {r6('gradient')} AS gradient FROM cells""",
    "mlp_step": f"""
        WITH {VECTORS_SQL}, {_backward()}
        SELECT CAST(layer AS INTEGER) AS layer, kind, CAST(position AS INTEGER) AS position,
               {r6(f'w - {STEP} * gradient / (abs(gradient) + 1e-8)')} AS value
        FROM cells JOIN known USING (layer, kind, position)""",
    "training_history": f"""
        {_EPOCHS}
        SELECT epoch, 'val_accuracy' AS metric, {r6('accuracy')} AS value FROM metrics
        UNION ALL SELECT epoch, 'val_macro_f1', {r6('macro_f1')} FROM metrics
        UNION ALL SELECT epoch, 'val_auc_roc', {r6('auc_roc')} FROM areas""",
    "best_epoch": f"""
        {_EPOCHS}
        SELECT epoch AS best_epoch, {r6('auc_roc')} AS auc_roc FROM areas ORDER BY areas.auc_roc DESC, epoch LIMIT 1""",
}
assert METRIC_NAMES == evaluation.METRICS
