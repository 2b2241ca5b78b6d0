"""Exact binary-classification metrics over scored tables ``(…, label, pred, prob)``.

Every metric works per group (model, fold, data set, stratum) in one job. Rows are first reduced to counts
per (group, score); curves are running sums over those counts, so neither a large group nor a heavily tied
score puts its rows into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candora.functions.columns import ratio
from candora.plans.ordering import running_totals
from candora.plans.skew import spread_join

METRICS = [
    "accuracy", "precision_fake", "recall_fake", "f1_fake", "precision_genuine", "recall_genuine",
    "f1_genuine", "macro_f1", "weighted_f1",
]


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def confusion_matrix(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp per group."""

    def cell(label: int, pred: int) -> Column:
        return F.count(F.when((F.col("label") == label) & (F.col("pred") == pred), True))

    cells = [cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")]
    return df.groupBy(*by).agg(*cells)


def f1_columns(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """All threshold metrics as expressions of the four cells; empty denominators give 0."""
    f1_fake = ratio(2 * tp, 2 * tp + fp + fn)
    f1_genuine = ratio(2 * tn, 2 * tn + fp + fn)
    has_fake = ((tp + fp + fn) > 0).cast("int")
    has_genuine = ((tn + fp + fn) > 0).cast("int")
    total = tn + fp + fn + tp
    return {
        "accuracy": ratio(tp + tn, total),
        "precision_fake": ratio(tp, tp + fp),
        "recall_fake": ratio(tp, tp + fn),
        "f1_fake": f1_fake,
        "precision_genuine": ratio(tn, tn + fn),
        "recall_genuine": ratio(tn, tn + fp),
        "f1_genuine": f1_genuine,
        "macro_f1": ratio(f1_fake + f1_genuine, has_fake + has_genuine),
        "weighted_f1": ratio(f1_fake * (tp + fn) + f1_genuine * (tn + fp), total),
    }


def classification_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, per-class precision/recall/F1, macro F1 over the classes present, weighted F1."""
    cells = confusion_matrix(df, by)
    metrics = f1_columns(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])
    return cells.select(*by, "tn", "fp", "fn", "tp", *[v.alias(k) for k, v in metrics.items()])


def _score_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return (
        df.filter(F.col("prob").isNotNull() & F.col("label").isNotNull())
        .groupBy(*by, "prob")
        .agg(
            F.count(F.when(F.col("label") == 1, True)).alias("_pos"),
            F.count(F.when(F.col("label") == 0, True)).alias("_neg"),
        )
    )


def auc_roc(df: DataFrame, by: Sequence[str] = (), on_single_class: float | None = 0.0) -> DataFrame:
    """Exact area under the ROC curve, ties counted one half; ``on_single_class`` where it is undefined."""
    source, group = _grouped(df, by)
    ranked = running_totals(_score_counts(source, group), group, ["prob"], {"_cum_neg": "_neg"})
    below = F.col("_cum_neg") - F.col("_neg") + F.col("_neg") / 2.0
    out = ranked.groupBy(*group).agg(
        F.sum(F.col("_pos") * below).alias("_wins"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n")
    )
    pairs = F.col("_p").cast("double") * F.col("_n")
    area = F.when(pairs > 0, F.col("_wins") / pairs).otherwise(F.lit(on_single_class).cast("double"))
    return out.select(*by, area.alias("auc_roc"))


def _curve_counts(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Per (group, score): true and false positives when the score is the threshold, and class totals."""
    ranked = running_totals(
        _score_counts(df, group), group, [F.desc("prob")], {"tp": "_pos", "fp": "_neg"}
    )
    totals = ranked.groupBy(*group).agg(
        F.sum("_pos").alias("p"), F.sum("_neg").alias("n"), F.count(F.lit(1)).alias("_rows")
    )
    return spread_join(ranked, totals, group, "_rows", spread_by=["prob"])


def roc_curve(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(fpr, tpr, threshold) at every distinct score, after the point (0, 0) with a null threshold."""
    source, group = _grouped(df, by)
    points = _curve_counts(source, group).select(
        *group,
        ratio(F.col("fp"), F.col("n")).alias("fpr"),
        ratio(F.col("tp"), F.col("p")).alias("tpr"),
        F.col("prob").alias("threshold"),
    )
    origin = source.select(*group).distinct().select(
        *group,
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
        F.lit(None).cast("double").alias("threshold"),
    )
    return origin.unionByName(points).select(*by, "fpr", "tpr", "threshold")


def mean_roc_curve(curves: DataFrame, fold: str = "fold", n: int = 100) -> DataFrame:
    """Mean and population standard deviation of the folds' curves on ``n`` equally spaced rates.

    Each curve is first reduced to the first and last point of every grid cell; the interpolation then works
    on at most ``n`` rows per fold. The first rate is fixed to 0 and the last mean to 1.
    """
    last = n - 1
    guess = F.ceil(F.col("fpr") * last)
    cell = F.when(F.col("fpr") <= (guess - 1) / F.lit(float(last)), guess - 1).otherwise(guess)
    point = F.struct("fpr", "tpr")
    cells = curves.groupBy(fold, cell.cast("int").alias("g")).agg(
        F.min(point).alias("first"), F.max(point).alias("last")
    )
    grid = curves.select(fold).distinct().select(
        fold, F.explode(F.sequence(F.lit(0), F.lit(last))).alias("g")
    )
    upto = Window.partitionBy(fold).orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(fold).orderBy("g").rowsBetween(1, Window.unboundedFollowing)
    placed = grid.join(cells, [fold, "g"], "left").select(
        fold,
        "g",
        (F.col("g") / F.lit(float(last))).alias("x"),
        F.max("last").over(upto).alias("left"),
        F.min("first").over(after).alias("right"),
    )
    slope = (F.col("right.tpr") - F.col("left.tpr")) / (F.col("right.fpr") - F.col("left.fpr"))
    inside = F.col("left.tpr") + slope * (F.col("x") - F.col("left.fpr"))
    y = F.when(F.col("g") == 0, F.lit(0.0)).otherwise(F.coalesce(inside, F.col("left.tpr")))
    means = placed.groupBy("g", "x").agg(F.avg(y).alias("m"), F.stddev_pop(y).alias("std_tpr"))
    means = means.select(
        "g",
        F.col("x").alias("fpr"),
        F.when(F.col("g") == last, F.lit(1.0)).otherwise(F.col("m")).alias("mean_tpr"),
        "std_tpr",
    )
    ordered = Window.orderBy("g")  # n rows
    strip = (F.col("fpr") - F.lag("fpr").over(ordered)) * (
        F.col("mean_tpr") + F.lag("mean_tpr").over(ordered)
    ) / 2
    return means.withColumn("_strip", strip).select(
        F.col("g").alias("point"), "fpr", "mean_tpr", "std_tpr",
        F.sum("_strip").over(Window.partitionBy()).alias("mean_auc"),
    )


def threshold_sweep(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro F1 with every distinct score as the (inclusive) threshold."""
    source, group = _grouped(df, by)
    counts = _curve_counts(source, group)
    tp, fp = F.col("tp"), F.col("fp")
    macro = f1_columns(F.col("n") - fp, fp, F.col("p") - tp, tp)["macro_f1"]
    return counts.select(*by, F.col("prob").alias("threshold"), macro.alias("macro_f1"))


def best_threshold(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The threshold with the highest macro F1 per group; the lowest one on ties."""
    sweep = threshold_sweep(df, by)
    best = F.max(F.struct(F.round("macro_f1", 12).alias("f1"), (-F.col("threshold")).alias("t")))
    return sweep.groupBy(*by).agg(best.alias("_b")).select(
        *by, (-F.col("_b.t")).alias("threshold"), F.col("_b.f1").alias("macro_f1")
    )


def all_metrics(
    df: DataFrame, by: Sequence[str], on_single_class: float | None = 0.0
) -> DataFrame:
    """Threshold metrics and AUC side by side, one row per group."""
    areas = auc_roc(df, by, on_single_class)
    return classification_metrics(df, by).join(areas, list(by), "left")


def to_long(metrics: DataFrame, by: Sequence[str], names: Sequence[str] = (*METRICS, "auc_roc")) -> DataFrame:
    """Wide metrics as ``(by…, metric, value)``."""
    return metrics.unpivot(list(by), list(names), "metric", "value")


def aggregate_folds(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation per metric over the folds, NaN and null left out."""
    valid = F.when(~F.isnan("value"), F.col("value"))
    return metrics.groupBy(*by, "metric").agg(
        F.avg(valid).alias("mean"), F.stddev_pop(valid).alias("std"), F.count(valid).alias("n_folds")
    )


# Names and edges of the reviewer volume strata; lower edge inclusive, upper exclusive, the last open.
STRATA = [("1-4", 1, 5), ("5-19", 5, 20), ("20-49", 20, 50), ("50+", 50, None)]


def stratum_metrics(
    df: DataFrame, strata: Sequence[tuple[str, int, int | None]] = tuple(STRATA), least: int = 10
) -> DataFrame:
    """Metrics by how many of the evaluated rows the reviewer wrote; strata below ``least`` rows are left out."""
    counts = (
        df.filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.count(F.lit(1)).alias("_rows"))
    )
    joined = spread_join(df, counts, ["user_id"], "_rows", spread_by=["review_id"])
    stratum = F.lit(None).cast("string")
    for name, low, high in strata:
        inside = F.col("_n") >= low if high is None else (F.col("_n") >= low) & (F.col("_n") < high)
        stratum = F.when(inside, name).otherwise(stratum)
    rows = joined.withColumn("stratum", stratum).filter(F.col("stratum").isNotNull())
    wide = all_metrics(rows, ["stratum"], on_single_class=None)
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    fake = F.col("tp") + F.col("fn")
    return wide.filter(total >= least).select(
        "stratum",
        total.alias("n_reviews"),
        fake.alias("n_fake"),
        ratio(fake, total).alias("fake_rate"),
        "auc_roc",
        "macro_f1",
    )


def stratum_spread(strata: DataFrame) -> DataFrame:
    """Largest minus smallest AUC across strata."""
    return strata.agg((F.max("auc_roc") - F.min("auc_roc")).alias("auc_spread"))


def model_comparison(results: DataFrame) -> DataFrame:
    """One row per model from long ``(model, section, metric, value)`` results, ranked by AUC.

    ``section`` is ``in_domain`` for test metrics or ``cv`` for fold means and deviations.
    """

    def pick(section: str, metric: str) -> Column:
        chosen = (F.col("section") == section) & (F.col("metric") == metric)
        return F.coalesce(F.max(F.when(chosen, F.col("value"))), F.lit(0.0))

    test = ["auc_roc", "macro_f1", "f1_fake", "f1_genuine", "precision_fake", "recall_fake", "accuracy"]
    folds = ["auc_roc_mean", "auc_roc_std", "macro_f1_mean", "macro_f1_std"]
    wide = results.groupBy("model").agg(
        *[pick("in_domain", m).alias(m) for m in test], *[pick("cv", m).alias(f"cv_{m}") for m in folds]
    )
    better = Window.orderBy(F.desc("auc_roc"), "model")  # one row per model
    return wide.withColumn("rank", F.row_number().over(better))


PRUNED_K = 1000  # Spark's limit for pruning ranked groups before the shuffle


def risk_topk(df: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``k`` riskiest rows overall or per group, by probability, then id (``risk_rank`` from 1 per group).

    Overall this is a per-task top-k and a merge. Per group and up to :data:`PRUNED_K` rows, Spark prunes every task
    to k rows a group before the shuffle, as the rank is filtered. Larger k are ranked by running counts over a global
    sort, in which a group may span any number of tasks.
    """
    if not by:
        return df.orderBy(F.desc("prob"), "review_id").limit(k)
    if k > PRUNED_K:
        order = [F.desc_nulls_last("prob"), "review_id"]
        counted = running_totals(df.withColumn("_one", F.lit(1).cast("long")), list(by), order, {"risk_rank": "_one"})
        return counted.filter(F.col("risk_rank") <= k).drop("_one").withColumn("risk_rank", F.col("risk_rank").cast("int"))
    order = Window.partitionBy(*by).orderBy(F.desc("prob"), "review_id")
    return df.withColumn("risk_rank", F.row_number().over(order)).filter(F.col("risk_rank") <= k)


def transfer_degradation(in_domain: DataFrame, cross: DataFrame, max_drop: float = 5.0) -> DataFrame:
    """Per model: in-domain and cross-domain AUC and macro F1, drops in percentage points, and the verdict."""
    left = in_domain.select("model", F.col("auc_roc").alias("in_auc"), F.col("macro_f1").alias("in_f1"))
    right = cross.select("model", F.col("auc_roc").alias("x_auc"), F.col("macro_f1").alias("x_f1"))
    return left.join(right, "model").select(
        "*",
        ((F.col("in_auc") - F.col("x_auc")) * 100).alias("auc_drop_pp"),
        ((F.col("in_f1") - F.col("x_f1")) * 100).alias("f1_drop_pp"),
        (((F.col("in_f1") - F.col("x_f1")) * 100) < max_drop).cast("int").alias("verified"),
    )
