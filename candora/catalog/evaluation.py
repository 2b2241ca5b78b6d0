"""Metrics, curves, significance, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from candora.catalog.views import (
    METRIC_NAMES, REVIEWS_SQL, EVENT_REVIEWS_SQL, SCORED_SQL, VECTORS_SQL, auc_sql, event_reviews, metrics_sql,
    r6, reviews, rounded, scored, vectors,
)
from candora.catalog.learners import centroid_fit, rate_fit
from candora.operators import evaluation, significance, splits, validation
from candora.plans.storage import freeze


def confusion_matrix(spark, sf):
    return evaluation.confusion_matrix(scored(spark, sf), ["grp"])


def classification_metrics(spark, sf):
    return rounded(evaluation.classification_metrics(scored(spark, sf), ["grp"]))


def auc_roc(spark, sf):
    return rounded(evaluation.auc_roc(scored(spark, sf), ["grp"]))


def roc_curve(spark, sf):
    return rounded(evaluation.roc_curve(scored(spark, sf), ["grp"]))


def mean_roc_curve(spark, sf):
    curves = evaluation.roc_curve(scored(spark, sf), ["grp"])
    return rounded(evaluation.mean_roc_curve(curves, "grp"))


def threshold_sweep(spark, sf):
    return rounded(evaluation.threshold_sweep(scored(spark, sf), ["grp"]))


def best_threshold(spark, sf):
    return rounded(evaluation.best_threshold(scored(spark, sf), ["grp"]))


def aggregate_folds(spark, sf):
    metrics = evaluation.classification_metrics(scored(spark, sf), ["grp"])
    long = evaluation.to_long(metrics, ["grp"], evaluation.METRICS)
    return rounded(evaluation.aggregate_folds(long))


def stratum_metrics(spark, sf):
    return rounded(evaluation.stratum_metrics(scored(spark, sf)))


def stratum_spread(spark, sf):
    return rounded(evaluation.stratum_spread(evaluation.stratum_metrics(scored(spark, sf))))


def wilcoxon_signed_rank(spark, sf):
    """Yearly mean score of fake and genuine rows, paired by year: an exact test."""
    years = scored(spark, sf).groupBy(F.year("date").alias("year")).agg(
        F.avg(F.when(F.col("label") == 1, F.col("prob"))).alias("a"),
        F.avg(F.when(F.col("label") == 0, F.col("prob"))).alias("b"),
    )
    return rounded(significance.wilcoxon_signed_rank(years, "a", "b"))


def wilcoxon_by_user(spark, sf):
    """Many pairs with ties (highest rating per label): normal approximation, corrected for ties."""
    users = reviews(spark, sf).groupBy("user_id").agg(
        F.max(F.when(F.col("label") == 1, F.col("rating"))).alias("a"),
        F.max(F.when(F.col("label") == 0, F.col("rating"))).alias("b"),
    )
    both = users.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    return rounded(significance.wilcoxon_signed_rank(both, "a", "b"))


def _rating_cv(spark, sf):
    rows = reviews(spark, sf)
    return validation.cross_validate(rows, splits.temporal_kfold(rows), rate_fit("rating"))


def cross_validate(spark, sf):
    return rounded(_rating_cv(spark, sf).fold_metrics())


def cross_validate_summary(spark, sf):
    return rounded(_rating_cv(spark, sf).aggregated())


def ablation(spark, sf):
    rows = freeze(splits.stratified_split(vectors(spark, sf)))
    slices = {"full": (0, 64), "first_half": (0, 32), "second_half": (32, 64)}
    train, test = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") != "train")
    return rounded(validation.ablation(train, test, slices, centroid_fit, "full"))


def cross_domain_eval(spark, sf):
    fits = {"by_rating": rate_fit("rating"), "by_product": rate_fit("product_id")}
    return rounded(validation.cross_domain_eval(reviews(spark, sf), event_reviews(spark, sf), fits))


def transfer_degradation(spark, sf):
    """Years up to 1997 as the home domain, later ones as the foreign one, per order status."""
    rows = scored(spark, sf).withColumnRenamed("grp", "model")
    home = F.year("date") <= 1997
    inside = evaluation.all_metrics(rows.filter(home), ["model"])
    outside = evaluation.all_metrics(rows.filter(~home), ["model"])
    return rounded(evaluation.transfer_degradation(inside, outside))


def model_comparison(spark, sf):
    """Order status as the model; its years as the folds."""
    rows = scored(spark, sf).withColumnRenamed("grp", "model").withColumn("fold", F.year("date"))
    test = evaluation.to_long(evaluation.all_metrics(rows, ["model"]), ["model"])
    test = test.withColumn("section", F.lit("in_domain"))
    folds = evaluation.to_long(evaluation.classification_metrics(rows, ["model", "fold"]), ["model", "fold"], ["macro_f1"])
    mean = evaluation.aggregate_folds(folds, ["model"])
    cv = mean.unpivot(["model", "metric"], ["mean", "std"], "part", "value").select(
        "model", F.concat_ws("_", "metric", "part").alias("metric"), "value", F.lit("cv").alias("section")
    )
    return rounded(evaluation.model_comparison(test.unionByName(cv)))


def risk_topk(spark, sf):
    return evaluation.risk_topk(scored(spark, sf), 100).select("review_id", "prob")


def risk_topk_by_group(spark, sf):
    return evaluation.risk_topk(scored(spark, sf), 20, ["grp"]).select("grp", "risk_rank", "review_id", "prob")


QUERIES = {
    f.__name__: f
    for f in (
        confusion_matrix, classification_metrics, auc_roc, roc_curve, mean_roc_curve, threshold_sweep,
        best_threshold, aggregate_folds, stratum_metrics, stratum_spread, wilcoxon_signed_rank, wilcoxon_by_user,
        cross_validate, cross_validate_summary, ablation, cross_domain_eval, transfer_degradation,
        model_comparison, risk_topk, risk_topk_by_group,
    )
}

_METRICS = ", ".join(f"{r6(m)} AS {m}" for m in METRIC_NAMES)

_CURVES = """
    thresholds AS (SELECT DISTINCT grp, prob AS threshold FROM scored),
    points AS (
      SELECT t.grp, t.threshold, sum(label)::DOUBLE AS tp, sum(1 - label)::DOUBLE AS fp
      FROM thresholds t JOIN (SELECT grp, prob, label FROM scored) s ON s.grp = t.grp AND s.prob >= t.threshold
      GROUP BY t.grp, t.threshold),
    totals AS (SELECT grp, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY grp),
    curve AS (
      SELECT grp, fp / n AS fpr, tp / p AS tpr, threshold FROM points JOIN totals USING (grp)
      UNION ALL SELECT grp, 0.0, 0.0, NULL FROM totals)"""

_SWEEP = f"""{_CURVES},
    sweep AS (
      SELECT grp, threshold,
             (coalesce(2 * tp / nullif(2 * tp + fp + (p - tp), 0), 0)
              + coalesce(2 * (n - fp) / nullif(2 * (n - fp) + fp + (p - tp), 0), 0)) / 2 AS macro_f1
      FROM points JOIN totals USING (grp))"""

_STRATA = f"""
    WITH {SCORED_SQL},
    counted AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS c FROM scored),
    strata AS (
      SELECT *, CASE WHEN c < 5 THEN '1-4' WHEN c < 20 THEN '5-19' WHEN c < 50 THEN '20-49' ELSE '50+' END AS stratum
      FROM counted),
    {metrics_sql('strata', 'stratum')}, {auc_sql('strata', 'stratum', 'NULL')},
    result AS (
      SELECT stratum, tn + fp + fn + tp AS n_reviews, tp + fn AS n_fake,
             (tp + fn)::DOUBLE / (tn + fp + fn + tp) AS fake_rate, auc_roc, macro_f1
      FROM metrics JOIN areas USING (stratum) WHERE tn + fp + fn + tp >= 10)"""

_RATING_CV = f"""
    WITH {REVIEWS_SQL},
    placed AS (SELECT *, row_number() OVER (ORDER BY date, review_id) - 1 AS pos, count(*) OVER () AS n FROM reviews),
    bounds AS (SELECT k AS fold, k * (n // 5) AS lo, least((k + 1) * (n // 5), n) AS hi
               FROM (SELECT count(*) AS n FROM reviews), range(1, 6) t(k)
               WHERE k * (n // 5) >= CAST(floor(n * 0.4::DOUBLE) AS BIGINT) AND k * (n // 5) < n),
    rates AS (SELECT fold, rating, avg(label) AS rate FROM placed, bounds WHERE pos < lo GROUP BY fold, rating),
    base AS (SELECT fold, avg(label) AS rate FROM placed, bounds WHERE pos < lo GROUP BY fold),
    folds AS (
      SELECT b.fold, p.label, coalesce(r.rate, s.rate) AS prob,
             CASE WHEN coalesce(r.rate, s.rate) >= s.rate THEN 1 ELSE 0 END AS pred
      FROM placed p JOIN bounds b ON p.pos >= b.lo AND p.pos < b.hi JOIN base s ON s.fold = b.fold
      LEFT JOIN rates r ON r.fold = b.fold AND r.rating = p.rating),
    {metrics_sql('folds', 'fold')}, {auc_sql('folds', 'fold')},
    measured AS (SELECT * FROM metrics JOIN areas USING (fold))"""


def _ablation() -> str:
    configs = [("full", 1, 64), ("first_half", 1, 32), ("second_half", 33, 64)]
    listed = " UNION ALL ".join(f"SELECT '{n}' AS config, {lo} AS lo, {hi} AS hi" for n, lo, hi in configs)
    return f"""
    WITH {VECTORS_SQL},
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || review_id), review_id) - 1 AS rk,
             count(*) OVER (PARTITION BY label) AS size FROM vectors),
    split AS (SELECT review_id, label, features, rk >= 2 * ceil(size * 0.2::DOUBLE) AS is_train FROM ranked),
    cells AS (SELECT review_id, label, is_train, unnest(features) AS x, generate_subscripts(features, 1) AS j FROM split),
    means AS (SELECT j, avg(x) FILTER (label = 1) AS m1, avg(x) FILTER (label = 0) AS m0 FROM cells WHERE is_train GROUP BY j),
    configs AS ({listed}),
    logits AS (
      SELECT config, review_id, label, sum((m1 - m0) * (x - (m1 + m0) / 2)) AS z
      FROM cells JOIN means USING (j) JOIN configs ON j BETWEEN lo AND hi WHERE NOT is_train GROUP BY ALL),
    rows AS (
      SELECT config, label, round(1 / (1 + exp(-z)), 9) AS prob, CASE WHEN z >= 0 THEN 1 ELSE 0 END AS pred FROM logits),
    {metrics_sql('rows', 'config').replace('cells', 'confusion')}, {auc_sql('rows', 'config')},
    measured AS (SELECT config, auc_roc, macro_f1 FROM metrics JOIN areas USING (config))
    SELECT config, {r6('m.auc_roc')} AS auc_roc, {r6('m.macro_f1')} AS macro_f1,
           {r6('(m.auc_roc - f.auc_roc) * 100')} AS auc_delta_pp, {r6('(m.macro_f1 - f.macro_f1) * 100')} AS f1_delta_pp
    FROM measured m, (SELECT auc_roc, macro_f1 FROM measured WHERE config = 'full') f"""


def _domain(model: str, column: str) -> str:
    return f"""
      SELECT '{model}' AS model, e.label, coalesce(r.rate, b.rate) AS prob,
             CASE WHEN coalesce(r.rate, b.rate) >= b.rate THEN 1 ELSE 0 END AS pred
      FROM event_reviews e
      LEFT JOIN (SELECT {column}, avg(label) AS rate FROM reviews GROUP BY {column}) r ON r.{column} = e.{column},
      (SELECT avg(label) AS rate FROM reviews) b"""


_HALVES = f"""
    WITH {SCORED_SQL},
    halves AS (SELECT *, grp || '|' || CASE WHEN year(date) <= 1997 THEN 'in' ELSE 'x' END AS side FROM scored),
    {metrics_sql('halves', 'side')}, {auc_sql('halves', 'side')},
    measured AS (SELECT split_part(side, '|', 1) AS model, split_part(side, '|', 2) AS part, auc_roc, macro_f1
                 FROM metrics JOIN areas USING (side))"""

ORACLES = {
    "confusion_matrix": f"""
        WITH {SCORED_SQL}, {metrics_sql('scored', 'grp')} SELECT grp, tn, fp, fn, tp FROM metrics""",
    "classification_metrics": f"""
        WITH {SCORED_SQL}, {metrics_sql('scored', 'grp')} SELECT grp, tn, fp, fn, tp, {_METRICS} FROM metrics""",
    "auc_roc": f"WITH {SCORED_SQL}, {auc_sql('scored', 'grp')} SELECT grp, {r6('auc_roc')} AS auc_roc FROM areas",
    "roc_curve": f"""
        WITH {SCORED_SQL}, {_CURVES}
        SELECT grp, {r6('fpr')} AS fpr, {r6('tpr')} AS tpr, {r6('threshold')} AS threshold FROM curve""",
    "mean_roc_curve": f"""
        WITH {SCORED_SQL}, {_CURVES},
        grid AS (SELECT DISTINCT grp, g, g / 99.0::DOUBLE AS x FROM curve, range(0, 100) t(g)),
        lefts AS (SELECT t.grp, g, x, max(struct_pack(fpr := fpr, tpr := tpr)) AS l
                  FROM grid t JOIN curve c ON c.grp = t.grp AND c.fpr <= t.x GROUP BY ALL),
        rights AS (SELECT t.grp, g, min(struct_pack(fpr := fpr, tpr := tpr)) AS r
                   FROM grid t JOIN curve c ON c.grp = t.grp AND c.fpr > t.x GROUP BY ALL),
        inter AS (
          SELECT l.grp, l.g, l.x,
                 CASE WHEN l.g = 0 THEN 0.0
                      WHEN r.r IS NULL THEN l.l.tpr
                      ELSE l.l.tpr + (r.r.tpr - l.l.tpr) / (r.r.fpr - l.l.fpr) * (l.x - l.l.fpr) END AS y
          FROM lefts l LEFT JOIN rights r ON l.grp = r.grp AND l.g = r.g),
        means AS (SELECT g, x, CASE WHEN g = 99 THEN 1.0 ELSE avg(y) END AS m, stddev_pop(y) AS s FROM inter GROUP BY g, x),
        strips AS (SELECT *, (x - lag(x) OVER (ORDER BY g)) * (m + lag(m) OVER (ORDER BY g)) / 2 AS strip FROM means)
        SELECT CAST(g AS INTEGER) AS point, {r6('x')} AS fpr, {r6('m')} AS mean_tpr, {r6('s')} AS std_tpr,
               {r6('sum(strip) OVER ()')} AS mean_auc
        FROM strips""",
    "threshold_sweep": f"""
        WITH {SCORED_SQL}, {_SWEEP}
        SELECT grp, {r6('threshold')} AS threshold, {r6('macro_f1')} AS macro_f1 FROM sweep""",
    "best_threshold": f"""
        WITH {SCORED_SQL}, {_SWEEP},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(macro_f1, 12) DESC, threshold) AS rk FROM sweep)
        SELECT grp, {r6('threshold')} AS threshold, {r6('macro_f1')} AS macro_f1 FROM ranked WHERE rk = 1""",
    "aggregate_folds": f"""
        WITH {SCORED_SQL}, {metrics_sql('scored', 'grp')}
        """
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {r6(f'avg({m})')} AS mean, {r6(f'stddev_pop({m})')} AS std, count(*) AS n_folds FROM metrics"
        for m in METRIC_NAMES
    ),
    "stratum_metrics": f"""
        {_STRATA} SELECT stratum, n_reviews, n_fake, {r6('fake_rate')} AS fake_rate, {r6('auc_roc')} AS auc_roc,
                         {r6('macro_f1')} AS macro_f1 FROM result""",
    "stratum_spread": f"{_STRATA} SELECT {r6('max(auc_roc) - min(auc_roc)')} AS auc_spread FROM result",
    "wilcoxon_signed_rank": f"""
        WITH {SCORED_SQL},
        pairs AS (SELECT year(date) AS y, avg(prob) FILTER (label = 1) - avg(prob) FILTER (label = 0) AS d
                  FROM scored GROUP BY y),
        ranks AS (SELECT d, row_number() OVER (ORDER BY abs(d)) AS r, count(*) OVER () AS n FROM pairs),
        stat AS (SELECT least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w,
                        max(n) AS n FROM ranks),
        signs AS (SELECT s, sum(CASE WHEN (s >> (k - 1)) & 1 = 1 THEN k ELSE 0 END) AS t
                  FROM stat, range(0, CAST(pow(2, n) AS BIGINT)) a(s), range(1, n + 1) b(k) GROUP BY s),
        tail AS (SELECT least(1.0::DOUBLE, 2 * avg(CASE WHEN t <= w THEN 1.0::DOUBLE ELSE 0.0 END)) AS p FROM signs, stat)
        SELECT n AS n_pairs, CAST(n AS INTEGER) AS n, {r6('w')} AS statistic, {r6('p')} AS p_value,
               CAST(CASE WHEN p < 0.05 THEN 1 ELSE 0 END AS INTEGER) AS significant
        FROM stat, tail""",
    "wilcoxon_by_user": f"""
        WITH {REVIEWS_SQL},
        users AS (SELECT max(rating) FILTER (label = 1) - max(rating) FILTER (label = 0) AS d FROM reviews GROUP BY user_id),
        pairs AS (SELECT d FROM users WHERE d IS NOT NULL),
        ranks AS (
          SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r
          FROM pairs WHERE d <> 0),
        tied AS (SELECT sum(pow(t, 3) - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM ranks GROUP BY abs(d))),
        stat AS (
          SELECT (SELECT count(*) FROM pairs) AS n_pairs, count(*) AS n, any_value(ties) AS ties,
            least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w
          FROM ranks, tied),
        score AS (
          SELECT *, greatest(abs(w - n * (n + 1) / 4.0::DOUBLE) / sqrt((n::DOUBLE * (n + 1) * (2 * n + 1) - ties / 2) / 24), 1e-9) AS z FROM stat),
        tail AS (  -- the normal distribution's series: odd powers over odd factorials
          SELECT *, 1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum([
            exp((2 * k + 1) * ln(z) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2) FOR k IN range(0, 400)]) AS p FROM score)
        SELECT n_pairs, CAST(n AS BIGINT) AS n, {r6('w')} AS statistic, {r6('p')} AS p_value, CAST(CASE WHEN p < 0.05 THEN 1 ELSE 0 END AS INTEGER) AS significant
        FROM tail""",
    "cross_validate": f"""
        {_RATING_CV} SELECT CAST(fold AS INTEGER) AS fold, tn, fp, fn, tp, {_METRICS}, {r6('auc_roc')} AS auc_roc FROM measured""",
    "cross_validate_summary": f"{_RATING_CV} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {r6(f'avg({m})')} AS mean, {r6(f'stddev_pop({m})')} AS std, count(*) AS n_folds FROM measured"
        for m in (*METRIC_NAMES, "auc_roc")
    ),
    "ablation": _ablation(),
    "cross_domain_eval": f"""
        WITH {REVIEWS_SQL}, {EVENT_REVIEWS_SQL},
        rows AS ({_domain('by_rating', 'rating')} UNION ALL {_domain('by_product', 'product_id')}),
        {metrics_sql('rows', 'model')}, {auc_sql('rows', 'model')}
        SELECT model, tn, fp, fn, tp, {_METRICS}, {r6('auc_roc')} AS auc_roc FROM metrics JOIN areas USING (model)""",
    "transfer_degradation": f"""
        {_HALVES}
        SELECT a.model, {r6('a.auc_roc')} AS in_auc, {r6('a.macro_f1')} AS in_f1, {r6('b.auc_roc')} AS x_auc,
               {r6('b.macro_f1')} AS x_f1, {r6('(a.auc_roc - b.auc_roc) * 100')} AS auc_drop_pp,
               {r6('(a.macro_f1 - b.macro_f1) * 100')} AS f1_drop_pp,
               CAST(CASE WHEN (a.macro_f1 - b.macro_f1) * 100 < 5.0 THEN 1 ELSE 0 END AS INTEGER) AS verified
        FROM measured a JOIN measured b ON a.model = b.model AND a.part = 'in' AND b.part = 'x'""",
    "model_comparison": f"""
        WITH {SCORED_SQL},
        yearly AS (SELECT *, grp || '|' || year(date) AS fold FROM scored),
        {metrics_sql('scored', 'grp')}, {auc_sql('scored', 'grp')},
        {metrics_sql('yearly', 'fold').replace('cells', 'y_cells').replace('parts', 'y_parts').replace('f1s', 'y_f1s').replace('metrics', 'y_metrics')},
        folds AS (SELECT split_part(fold, '|', 1) AS grp, avg(macro_f1) AS m, stddev_pop(macro_f1) AS s FROM y_metrics GROUP BY ALL)
        SELECT grp AS model, {r6('auc_roc')} AS auc_roc, {r6('macro_f1')} AS macro_f1, {r6('f1_fake')} AS f1_fake,
               {r6('f1_genuine')} AS f1_genuine, {r6('precision_fake')} AS precision_fake,
               {r6('recall_fake')} AS recall_fake, {r6('accuracy')} AS accuracy,
               0.0::DOUBLE AS cv_auc_roc_mean, 0.0::DOUBLE AS cv_auc_roc_std,
               {r6('m')} AS cv_macro_f1_mean, {r6('s')} AS cv_macro_f1_std,
               CAST(row_number() OVER (ORDER BY areas.auc_roc DESC, grp) AS INTEGER) AS rank
        FROM metrics JOIN areas USING (grp) JOIN folds USING (grp)""",
    "risk_topk": f"WITH {SCORED_SQL} SELECT review_id, prob FROM scored ORDER BY prob DESC, review_id LIMIT 100",
    "risk_topk_by_group": f"""
        WITH {SCORED_SQL},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY prob DESC, review_id) AS rk FROM scored)
        SELECT grp, CAST(rk AS INTEGER) AS risk_rank, review_id, prob FROM ranked WHERE rk <= 20""",
}
