"""Fitted state saved and loaded, properties of fitted models, the fusion model, all models side by side."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from candora.catalog import behavior as behavior_catalog
from candora.catalog import text as text_catalog
from candora.catalog.evaluation import _METRICS
from candora.catalog.learning import behavior_vectors
from candora.catalog.views import (
    EVENT_REVIEWS_SQL, REVIEWS_SQL, VECTORS_SQL, auc_sql, event_reviews, metrics_sql, r6, reviews, rounded, text_reviews,
    vectors,
)
from candora.functions.columns import sigmoid
from candora.operators import behavior, cleaning, evaluation, fusion, mlp, models, persistence, splits, text, validation
from candora.operators.balance import with_class_weight
from candora.plans.storage import freeze, scratch_path
from candora.schema import BEHAVIOR_FEATURES


def saved_scaler(spark, sf):
    """Statistics written, read back and applied."""
    features = freeze(behavior.behavior_features(reviews(spark, sf)))
    path = scratch_path(spark, "scaler")
    persistence.save_table(behavior.standardize_fit(features), path)
    return rounded(behavior.standardize_apply(features, persistence.load_table(spark, path)))


def saved_tfidf(spark, sf):
    """Vocabulary of the labelled texts written, read back and applied to all texts."""
    rows = text_reviews(spark, sf)
    path = scratch_path(spark, "tfidf")
    persistence.save_tfidf(text.tfidf_fit(rows.filter(F.col("label").isNotNull())), path)
    weights = text.tfidf_transform(rows, persistence.load_tfidf(spark, path))
    return rounded(weights.select("review_id", "term", "weight"))


def pca_variance(spark, sf):
    """All principal coordinates together keep the columns' variance, and are uncorrelated."""
    rows, width = vectors(spark, sf), 64
    path = scratch_path(spark, "pca")
    persistence.save_pca(text.pca_fit(rows, width), path)
    reduced = freeze(text.pca_transform(rows, persistence.load_pca(spark, path)).select("features"))
    at = lambda j: F.col("features")[j]
    total = sum((F.var_pop(at(j)) for j in range(1, width)), F.var_pop(at(0)))
    # neighbours in the order of variance stand for all pairs
    mixed = F.greatest(*[F.abs(F.covar_pop(at(j), at(j + 1))) for j in range(width - 1)])
    descending = [F.var_pop(at(j)) >= F.var_pop(at(j + 1)) - 1e-9 for j in range(width - 1)]
    ordered = descending[0]
    for step in descending[1:]:
        ordered = ordered & step
    out = reduced.agg(total.alias("total_variance"), (mixed < 1e-9).alias("uncorrelated"), ordered.alias("descending"))
    return out.withColumn("total_variance", F.round("total_variance", 4))


def logreg_optimum(spark, sf):
    """Gradient of the penalised weighted loss at the fitted weights, per feature and for the intercept."""
    rows = freeze(vectors(spark, sf))
    score = models.logreg_balanced(rows, max_iter=1000, tolerance=1e-9)
    path = scratch_path(spark, "logreg")
    persistence.save_logistic(score, path)
    score = persistence.load_logistic(spark, path)
    fitted = score(with_class_weight(rows))
    error = F.col("weight") * (F.col("prob") - F.col("label"))
    with_one = F.concat(F.col("features").cast("array<double>"), F.array(F.lit(1.0)))
    cells = fitted.select(error.alias("e"), F.posexplode(with_one).alias("position", "x"))
    sums = cells.groupBy("position").agg(F.sum(F.col("e") * F.col("x")).alias("g"))
    beta = F.array(*[F.lit(float(b)) for b in [*score.weights[0][:-1], 0.0]])  # the intercept isn't penalised
    return sums.select("position", (F.abs(F.col("g") + beta[F.col("position")]) < 1e-3).alias("is_zero"))


def svm_optimum(spark, sf):
    """Gradient of the penalised squared hinge loss of each machine, per feature and for the intercept, and how many rows it counts.

    Each machine (fold 1, 2 and 3) leaves its own fold out; places are computed with the loaded model.
    """
    rows = freeze(vectors(spark, sf))
    score = models.linear_svm_calibrated(rows, max_iter=1000, tolerance=1e-9)
    path = scratch_path(spark, "svm")
    persistence.save_svm(score, path)
    score = persistence.load_svm(spark, path)
    folds = splits.stratified_kfold(rows.select("review_id", "label", "features"), 3)
    scored = freeze(score(folds, margins=True))
    parts = []
    for machine in (1, 2, 3):
        rest = with_class_weight(scored.filter(F.col("fold") != machine))
        sign = 2 * F.col("label") - 1
        pull = -2 * F.col("weight") * sign * F.greatest(F.lit(0.0), 1 - sign * F.col("_margins")[machine - 1])
        with_one = F.concat(F.col("features").cast("array<double>"), F.array(F.lit(1.0)))
        cells = rest.select(pull.alias("e"), F.posexplode(with_one).alias("position", "x"))
        sums = cells.groupBy("position").agg(F.sum(F.col("e") * F.col("x")).alias("g"), F.count(F.lit(1)).alias("n_rows"))
        beta = F.array(*[F.lit(float(b)) for b in score.weights[machine - 1]])
        zero = (F.abs(F.col("g") + beta[F.col("position")]) < 1e-3).alias("is_zero")
        parts.append(sums.select(F.lit(machine).alias("machine"), "position", zero, "n_rows"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def svm_calibration(spark, sf):
    """Stationarity of each machine's sigmoid on the fold that it left out: errors and errors times margins add up to zero."""
    rows = freeze(vectors(spark, sf))
    score = models.linear_svm_calibrated(rows)
    folds = splits.stratified_kfold(rows.select("review_id", "label", "features"), 3)
    scored = score(folds, margins=True)
    place = F.col("fold") - 1
    slopes, offsets = (F.array(*[F.lit(float(x)) for x in score.curves[:, k]])[place] for k in (0, 1))
    margin = F.col("_margins")[place]
    ones = F.sum("label").over(Window.partitionBy("fold"))
    zeros = F.count(F.lit(1)).over(Window.partitionBy("fold")) - ones
    goal = F.when(F.col("label") == 1, (ones + 1) / (ones + 2)).otherwise(1 / (zeros + 2))
    errors = scored.select("fold", margin.alias("m"), (sigmoid(margin * slopes + offsets) - goal).alias("e"))
    sums = errors.groupBy("fold").agg(F.sum("e").alias("a"), F.sum(F.col("e") * F.col("m")).alias("b"), F.count(F.lit(1)).alias("n_rows"))
    return sums.select("fold", ((F.abs("a") < 1e-4) & (F.abs("b") < 1e-4)).alias("is_zero"), "n_rows")


def forest_stump(spark, sf):
    """One tree of depth 1 on the rating: probabilities are the label's shares on both sides of the best cut.

    The label is turned round for ratings of 3 and more, so that the sides differ.
    """
    turned = F.when(F.col("rating") >= 3, 1 - F.col("label")).otherwise(F.col("label"))
    rows = reviews(spark, sf).select("review_id", "rating", turned.alias("label"), F.array("rating").alias("features"))
    path = scratch_path(spark, "forest")
    forest = models.random_forest(rows, trees=1, depth=1)
    persistence.save_forest(forest, path)
    importance = models.rf_feature_importance(forest, ["rating"]).collect()[0]["importance"]
    scored = persistence.load_forest(spark, path)(rows)
    return rounded(
        scored.groupBy("rating").agg(F.max("prob").alias("prob"), F.count(F.lit(1)).alias("n_rows"))
        .withColumn("importance", F.lit(float(importance)))
    )


LEVELS = 2


def _three_features(spark, sf):
    """Rating, store and month of each review; the label is turned round for high ratings of some stores."""
    rows = reviews(spark, sf)
    store, month = F.pmod("product_id", F.lit(5)), F.month("date")
    turned = F.when((F.col("rating") >= 3) & (store < 2), 1 - F.col("label")).otherwise(F.col("label"))
    values = [F.col("rating").cast("double"), store.cast("double"), month.cast("double")]
    return rows.select("review_id", turned.alias("label"), F.array(*values).alias("features"))


def tree_of_two_levels(spark, sf):
    """One tree of depth 2 on three features: the probability of every combination of their values."""
    rows = freeze(_three_features(spark, sf))
    path = scratch_path(spark, "tree")
    persistence.save_forest(models.random_forest(rows, trees=1, depth=LEVELS), path)
    scored = persistence.load_forest(spark, path)(rows)
    scored = scored.select(*[F.col("features")[k].alias(n) for k, n in enumerate(("rating", "store", "month"))], "prob")
    return rounded(scored.groupBy("rating", "store", "month").agg(F.max("prob").alias("prob"), F.count(F.lit(1)).alias("n_rows")))


def tree_importance(spark, sf):
    """Shares of the three features in the gain of one tree of depth 2."""
    forest = models.random_forest(_three_features(spark, sf), trees=1, depth=LEVELS)
    return rounded(models.rf_feature_importance(forest, ["rating", "store", "month"]))


ABLATED = {"full": (0, 3), "rating": (0, 1), "store and month": (1, 3)}


def ablation_tree(spark, sf):
    """A tree of two levels on all three features and on slices of them, measured on the rows it learnt from."""
    rows = freeze(_three_features(spark, sf))
    return rounded(validation.ablation(rows, rows, ABLATED, lambda part: models.random_forest(part, trees=1, depth=LEVELS), "full"))


def document_reviews(spark, sf):
    """Documents as reviews with text and behaviour."""
    texts = text_reviews(spark, sf).filter(F.col("label").isNotNull())
    return texts.select(
        "review_id", "text", "label", (F.col("review_id") % 97).alias("user_id"), "product_id",
        (1 + F.length("text") % 5).cast("double").alias("rating"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("review_id") * 31 % 700).cast("int")).alias("date"),
    )


def fusion_model(spark, sf):
    """Fitted on train, epoch picked on validation, saved, loaded, and the test rows scored and measured."""
    rows = freeze(splits.stratified_split(document_reviews(spark, sf)))
    parts = {s: rows.filter(F.col("split") == s).drop("split") for s in ("train", "validation", "test")}
    model = fusion.fit_fusion(parts["train"], parts["validation"])
    path = scratch_path(spark, "fusion")
    model.save(path)
    scored = fusion.FusionModel.load(spark, path)(parts["test"])
    return rounded(scored.select("review_id", "label", "prob", "pred"))


def fusion_history(spark, sf):
    """Training history of the network on fused vectors as a long table, with the test rows' metrics at the best epoch."""
    rows = freeze(splits.stratified_split(document_reviews(spark, sf)))
    parts = {s: rows.filter(F.col("split") == s).drop("split") for s in ("train", "validation", "test")}
    model = fusion.fit_fusion(parts["train"], parts["validation"])
    tested = evaluation.all_metrics(freeze(model(parts["test"])).withColumn("epoch", F.lit(model.network.best_epoch)), ["epoch"])
    tested = tested.select("epoch", *[F.col(c).alias(f"test_{c}") for c in ("accuracy", "auc_roc", "macro_f1")])
    return rounded(mlp.training_history(model.network.history).unionByName(mlp.training_history(tested)))


LEARNERS = {
    "logistic regression": models.logreg_balanced, "linear svm": models.linear_svm_calibrated, "random forest": models.random_forest,
}


def all_models(spark, sf):
    """Learners on the behaviour vectors of one split, side by side, with their defaults (200 trees of depth 15)."""
    train, test = (freeze(part) for part in behavior_vectors(spark, sf))
    scored = validation.score_all(train, test, LEARNERS)
    return rounded(evaluation.model_comparison(validation.compared(scored)))


def cross_validated_forest(spark, sf):
    """Five folds of all reviews, 200 trees of depth 15 each."""
    features = behavior.behavior_features(reviews(spark, sf), keep=["label"])
    rows = freeze(splits.stratified_kfold(cleaning.to_vectors(features, BEHAVIOR_FEATURES), 5))
    folds = validation.folds_from_numbers(rows, 5)
    return rounded(validation.cross_validate(rows.drop("fold"), folds, models.random_forest).aggregated())


TEXT_WIDTH, PADDING = 64, 16


def ablation_models(spark, sf):
    """Logistic regression on text and behaviour together, on text, and on behaviour; everything fitted on train."""
    rows = freeze(splits.stratified_split(document_reviews(spark, sf), validation=0.0))
    train, test = (rows.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    tfidf = text.tfidf_fit(train)
    tfidf.vocabulary = freeze(tfidf.vocabulary)
    scaler = freeze(behavior.standardize_fit(behavior.behavior_features(train)))

    def fused(part):
        scaled = behavior.standardize_apply(behavior.behavior_features(part), scaler)
        numbers = cleaning.pad_features(cleaning.to_vectors(scaled, BEHAVIOR_FEATURES), "features", PADDING)
        return freeze(cleaning.fuse_features(text.hashed_vectors(part, tfidf, TEXT_WIDTH, ("label",)), numbers.select("review_id", "features")))

    both = TEXT_WIDTH + PADDING
    slices = {"full": (0, both), "text": (0, TEXT_WIDTH), "behavior": (TEXT_WIDTH, both)}
    return rounded(validation.ablation(fused(train), fused(test), slices, models.logreg_balanced, "full"))


def cross_domain_models(spark, sf):
    """Learners fitted on the reviews' behaviour vectors, scaled by their statistics, and measured on another source's."""
    source = freeze(behavior.behavior_features(reviews(spark, sf), keep=["label"]))
    target = behavior.behavior_features(event_reviews(spark, sf), keep=["label"])
    stats = freeze(behavior.standardize_fit(source))
    parts = [freeze(cleaning.to_vectors(behavior.standardize_apply(part, stats), BEHAVIOR_FEATURES)) for part in (source, target)]
    return rounded(validation.cross_domain_eval(*parts, LEARNERS))


def cross_domain_text(spark, sf):
    """Text learners on the English documents, vocabulary and term weights from these alone, measured on the other languages."""
    rows = freeze(text_reviews(spark, sf).filter(F.col("label").isNotNull()).select("review_id", "text", "label", "lang"))
    home, away = (rows.filter(c).drop("lang") for c in (F.col("lang") == "en", F.col("lang") != "en"))
    learners = {name: LEARNERS[name] for name in ("logistic regression", "linear svm")}
    tfidf = text.tfidf_fit(home)
    tfidf.vocabulary = freeze(tfidf.vocabulary)
    home, away = (freeze(text.tfidf_vectors(part, tfidf)) for part in (home, away))  # both learners read the same vectors
    return rounded(validation.cross_domain_eval(home, away, learners))


def cross_domain_tree(spark, sf):
    """A tree of two levels learnt on the reviews and measured on another source."""
    learn = {"tree": lambda rows: models.random_forest(rows, trees=1, depth=LEVELS)}
    target = event_reviews(spark, sf).filter(F.col("label").isNotNull())
    values = [F.coalesce("rating", F.lit(0.0)).cast("double"), F.lit(0.0), F.coalesce(F.month("date"), F.lit(0)).cast("double")]
    target = target.select("review_id", "label", F.array(*values).alias("features"))
    return rounded(validation.cross_domain_eval(_three_features(spark, sf), target, learn))


QUERIES = {
    f.__name__: f
    for f in (
        saved_scaler, saved_tfidf, pca_variance, logreg_optimum, svm_optimum, svm_calibration, forest_stump, tree_of_two_levels,
        tree_importance, ablation_tree, fusion_model, fusion_history,
        all_models, cross_validated_forest, ablation_models, cross_domain_models, cross_domain_text, cross_domain_tree,
    )
}

_FOLDS_SQL = """
    folded AS (
      SELECT review_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42|' || review_id), review_id) - 1) % 3 + 1 AS INTEGER) AS fold
      FROM vectors)"""


def _cut_sql(name: str, rows: str, node: str, features: str = "[1, 2, 3]") -> str:
    """Best cut by Gini impurity in each node of ``rows`` (value lists ``v``): feature, the largest value on the left, gain."""
    return f"""
    cells_{name} AS (SELECT {node} AS node, f, v[f] AS x, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS k
      FROM {rows}, (SELECT unnest({features}) AS f) GROUP BY ALL),
    sides_{name} AS (SELECT node, f, x, sum(n) OVER up AS ln, sum(k) OVER up AS lk, sum(n) OVER whole AS tn, sum(k) OVER whole AS tk
      FROM cells_{name} WINDOW up AS (PARTITION BY node, f ORDER BY x), whole AS (PARTITION BY node, f)),
    {name} AS (
      SELECT node, f, x, 2 * tk * (tn - tk) / tn - 2 * lk * (ln - lk) / ln - 2 * (tk - lk) * (tn - ln - tk + lk) / (tn - ln) AS gain
      FROM sides_{name} WHERE ln < tn QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 6) DESC, f, x) = 1)"""


_BASE_SQL = f"""
    {REVIEWS_SQL},
    base AS (SELECT review_id, [rating::DOUBLE, (product_id % 5)::DOUBLE, month(date)::DOUBLE] AS v,
      CASE WHEN rating >= 3 AND product_id % 5 < 2 THEN 1 - label ELSE label END AS label FROM reviews)"""

_TREE_SQL = f"""
    {_BASE_SQL},
    {_cut_sql('cut0', 'base', '0')},
    halves AS (SELECT base.*, v[f] <= x AS side FROM base, cut0),
    {_cut_sql('cut1', 'halves', 'side')},
    quarters AS (SELECT review_id, v, label, side, coalesce(v[f] <= x, true) AS part FROM halves LEFT JOIN cut1 ON side = node),
    leaves AS (SELECT side, part, v[1] AS v1, v[2] AS v2, v[3] AS v3, avg(label) OVER (PARTITION BY side, part) AS leaf FROM quarters)"""



def _ablation_sql() -> str:
    parts, names = [], list(ABLATED)
    for k, (low, high) in enumerate(ABLATED.values()):
        features = str(list(range(low + 1, high + 1)))
        parts.append(f"""
    {_cut_sql(f'top{k}', 'base', '0', features)},
    halves{k} AS (SELECT base.*, v[f] <= x AS side FROM base, top{k}),
    {_cut_sql(f'low{k}', f'halves{k}', 'side', features)},
    quarters{k} AS (SELECT h.review_id, label, side, coalesce(v[f] <= x, true) AS part FROM halves{k} h LEFT JOIN low{k} ON side = node),
    scored{k} AS (SELECT '{names[k]}' AS config, review_id, label, avg(label) OVER (PARTITION BY side, part) AS prob FROM quarters{k})""")
    every = " UNION ALL ".join(f"SELECT config, review_id, label, prob, CAST(prob > 0.5 AS INTEGER) AS pred FROM scored{k}" for k in range(len(names)))
    return f"""
        WITH {_BASE_SQL}, {', '.join(parts)},
        every AS ({every}), {metrics_sql('every', 'config')}, {auc_sql('every', 'config')},
        measures AS (SELECT config, auc_roc, macro_f1 FROM metrics JOIN areas USING (config))
        SELECT config, {r6('b.auc_roc')} AS auc_roc, {r6('b.macro_f1')} AS macro_f1, {r6('(b.auc_roc - f.auc_roc) * 100')} AS auc_delta_pp,
               {r6('(b.macro_f1 - f.macro_f1) * 100')} AS f1_delta_pp
        FROM measures b JOIN (SELECT auc_roc, macro_f1 FROM measures WHERE config = 'full') f ON true"""


ORACLES = {
    "ablation_tree": _ablation_sql(),
    "saved_scaler": behavior_catalog.ORACLES["standardize_apply"],
    "saved_tfidf": text_catalog.ORACLES["tfidf"],
    "pca_variance": f"""
        WITH {VECTORS_SQL},
        cells AS (SELECT review_id, unnest(range(1, 65)) AS j, features FROM vectors),
        spread AS (SELECT j, var_pop(features[j]) AS v FROM cells GROUP BY j)
        SELECT round(sum(v), 4) AS total_variance, true AS uncorrelated, true AS descending FROM spread""",
    "logreg_optimum": "SELECT CAST(range AS INTEGER) AS position, true AS is_zero FROM range(0, 65)",
    "svm_optimum": f"""
        WITH {VECTORS_SQL}, {_FOLDS_SQL}
        SELECT machine, CAST(range AS INTEGER) AS position, true AS is_zero, count(*) AS n_rows
        FROM folded JOIN (SELECT unnest([1, 2, 3])::INTEGER AS machine) ON fold <> machine, range(0, 65) GROUP BY ALL""",
    "svm_calibration": f"""
        WITH {VECTORS_SQL}, {_FOLDS_SQL}
        SELECT fold, true AS is_zero, count(*) AS n_rows FROM folded GROUP BY fold""",
    "tree_of_two_levels": f"""
        WITH {_TREE_SQL}
        SELECT v1 AS rating, v2 AS store, v3 AS month, {r6('any_value(leaf)')} AS prob, count(*) AS n_rows FROM leaves GROUP BY ALL""",
    "cross_domain_tree": f"""
        WITH {EVENT_REVIEWS_SQL}, {_TREE_SQL},
        target AS (SELECT review_id, label, [coalesce(rating, 0)::DOUBLE, 0.0::DOUBLE, coalesce(month(date), 0)::DOUBLE] AS v
          FROM event_reviews WHERE label IS NOT NULL),
        sided AS (SELECT target.*, v[f] <= x AS side FROM target, cut0),
        parted AS (SELECT sided.*, coalesce(v[f] <= x, true) AS part FROM sided LEFT JOIN cut1 ON side = node),
        probs AS (SELECT DISTINCT side, part, leaf FROM leaves),
        measured AS (SELECT 'tree' AS model, review_id, label, leaf AS prob, CAST(leaf > 0.5 AS INTEGER) AS pred
          FROM parted JOIN probs USING (side, part)),
        {metrics_sql('measured', 'model')}, {auc_sql('measured', 'model')}
        SELECT model, tn, fp, fn, tp, {_METRICS}, {r6('auc_roc')} AS auc_roc
        FROM metrics JOIN areas USING (model)""",
    "tree_importance": f"""
        WITH {_TREE_SQL},
        gains AS (SELECT f, sum(gain) AS gain FROM (SELECT f, gain FROM cut0 UNION ALL SELECT f, gain FROM cut1) GROUP BY f),
        shares AS (SELECT ['rating', 'store', 'month'][n.f] AS feature, coalesce(gain, 0) / (SELECT sum(gain) FROM gains) AS importance
          FROM (SELECT unnest([1, 2, 3]) AS f) n LEFT JOIN gains USING (f))
        SELECT feature, {r6('importance')} AS importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank
        FROM shares""",
    "forest_stump": f"""
        WITH {REVIEWS_SQL},
        turned AS (SELECT rating, CASE WHEN rating >= 3 THEN 1 - label ELSE label END AS label FROM reviews),
        cuts AS (SELECT unnest([1.5, 2.5, 3.5, 4.5])::DOUBLE AS cut),
        sides AS (
          SELECT cut, rating <= cut AS below, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS fake FROM turned, cuts GROUP BY ALL),
        gain AS (SELECT cut, sum(n * (1 - pow(fake / n, 2) - pow(1 - fake / n, 2))) AS impurity FROM sides GROUP BY cut),
        best AS (SELECT cut FROM gain ORDER BY impurity, cut LIMIT 1),
        shares AS (SELECT below, fake / n AS prob FROM sides JOIN best USING (cut))
        SELECT rating, {r6('any_value(prob)')} AS prob, count(*) AS n_rows, 1.0::DOUBLE AS importance
        FROM turned JOIN best ON true JOIN shares ON (rating <= cut) = below GROUP BY rating""",
}
