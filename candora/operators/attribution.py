"""Shapley attributions as long tables ``(review_id, label, feature, branch, value, phi)``."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candora.operators.mlp import dense_rows
from candora.plans.ordering import exact_percentiles
from candora.plans.scalars import one_row
from candora.schema import BEHAVIOR_FEATURES

Names = Sequence[tuple[str, str]]  # (feature, branch) per vector position


def fused_names(text_width: int, behavior: Sequence[str] = tuple(BEHAVIOR_FEATURES)) -> Names:
    """Feature and branch names of a fused vector: text positions first, then behaviour features."""
    text = [(f"text_{i:03d}", "text") for i in range(text_width)]
    return [*text, *[(name, "behavior") for name in behavior]]


WORK_CELLS = 4_000_000  # numbers of a work array: 32 MB
ROWS_AT_ONCE = 100  # explained rows per frame handed back


def shapley_sampling(
    explain: DataFrame,
    background: DataFrame,
    score: Callable[[np.ndarray], np.ndarray],
    names: Names,
    *,
    column: str = "features",
    seed: int = 42,
    background_limit: int = 1000,
) -> DataFrame:
    """Permutation-sampling Shapley values for any batch score function.

    Every background row gets its own random feature order; walking that order turns the background row into
    the explained row one feature at a time, and each step's change in score is credited to its feature. The
    values of a row therefore add up to its score minus the mean background score exactly. Explained rows
    stay distributed; the background travels to the tasks and is limited to ``background_limit`` rows.
    """
    rows = background.select(column).limit(background_limit + 1).collect()
    if not rows or len(rows) > background_limit:
        raise ValueError(f"the background must have 1 to {background_limit} rows; take a sample of it first")
    # rows sorted by content: the pairing with orders must not depend on how Spark returned them
    base = np.array(sorted(list(map(float, r[0])) for r in rows))
    count, width = base.shape
    if width != len(names):
        raise ValueError("one name per vector position is needed")
    orders = np.array([np.random.default_rng([seed, i]).permutation(width) for i in range(count)])
    features = np.array([n for n, _ in names], dtype=object)
    branches = np.array([b for _, b in names], dtype=object)
    id_field, label_field = explain.schema["review_id"], explain.schema["label"]

    # place of each feature in each order: at step s, the features placed before s come from the explained row
    place = np.argsort(orders, axis=1)
    at_once = max(1, WORK_CELLS // ((width + 1) * width))
    steps = np.arange(width + 1)[:, None, None]

    def attribute(x: np.ndarray) -> np.ndarray:
        total = np.zeros(width)
        for low in range(0, count, at_once):
            part = slice(low, low + at_once)
            walk = np.where(place[part][None] < steps, x, base[part][None])
            scores = np.asarray(score(walk.reshape(-1, width)), dtype=float).reshape(width + 1, -1)
            gains = np.diff(scores, axis=0).T
            total += np.take_along_axis(gains, place[part], axis=1).sum(axis=0)
        return total / count

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), ROWS_AT_ONCE):
                part = frame.iloc[low : low + ROWS_AT_ONCE]
                values = np.array([np.asarray(v, dtype=float) for v in part[column]]).reshape(len(part), width)
                yield pd.DataFrame(
                    {
                        "review_id": part["review_id"].repeat(width).to_numpy(),
                        "label": part["label"].repeat(width).to_numpy(),
                        "feature": np.tile(features, len(part)),
                        "branch": np.tile(branches, len(part)),
                        "value": values.reshape(-1),
                        "phi": np.concatenate([attribute(x) for x in values]),
                    }
                )

    schema = (
        f"review_id {id_field.dataType.simpleString()}, label {label_field.dataType.simpleString()}, "
        "feature string, branch string, value double, phi double"
    )
    return explain.select("review_id", "label", column).mapInPandas(run, schema=schema)


def coalitions(width: int, pairs: int, seed: int) -> np.ndarray:
    """``pairs`` random sets of features and their complements, by rows; sizes as the Shapley kernel weighs them."""
    rng = np.random.default_rng(seed)
    sizes = np.arange(1, width)
    chosen = rng.choice(sizes, pairs, p=(1 / (sizes * (width - sizes))) / (1 / (sizes * (width - sizes))).sum())
    sets = np.stack([rng.permutation(width) for _ in range(pairs)]) < chosen[:, None]
    return np.stack([sets, ~sets], 1).reshape(2 * pairs, width)


def coalition_values(sets: np.ndarray, gains: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attributions and their standard errors by least squares, each row's adding up to its total.

    ``gains`` holds for every row (rows by sets) what the sets gain over the empty one. Errors come from the residuals of
    the pairs of a set and its complement, which are drawn independently of each other.
    """
    z = sets.astype(float)
    inverse = np.linalg.pinv(z.T @ z, hermitian=True)
    one = inverse.sum(axis=1)
    free = gains @ z @ inverse
    values = free - ((free.sum(axis=1) - totals) / one.sum())[:, None] * one
    # the restriction takes what moves the total out of every direction
    spread = inverse - np.outer(one, one) / one.sum()
    residual = gains - values @ z.T
    influence = (residual[:, :, None] * (z @ spread)).reshape(len(gains), len(z) // 2, 2, -1).sum(axis=2)
    return values, np.sqrt((influence**2).sum(axis=1))


def shapley_coalitions(
    explain: DataFrame,
    background: DataFrame,
    score: Callable[[np.ndarray], np.ndarray],
    names: Names,
    *,
    pairs: int | None = None,
    column: str = "features",
    seed: int = 42,
    background_limit: int = 1000,
) -> DataFrame:
    """Shapley values of any batch score function by weighted least squares over random coalitions, with standard errors.

    A coalition's value is the mean score of the row's features in the coalition and the background's outside. ``pairs``
    (default: four a feature) sets and their complements are drawn once by the Shapley kernel and shared by all rows. The
    values of a row add up to its score minus the mean background score exactly, and are exact for linear scores. Extra
    column: ``error``. Explained rows stay distributed; the background is limited to ``background_limit`` rows. What is
    missing in a vector counts as 0.
    """
    rows = background.select(column).limit(background_limit + 1).collect()
    if not rows or len(rows) > background_limit:
        raise ValueError(f"the background must have 1 to {background_limit} rows; take a sample of it first")
    base = np.array(sorted(list(map(float, r[0])) for r in rows))
    width = base.shape[1]
    if width != len(names):
        raise ValueError("one name per vector position is needed")
    pairs = 4 * width if pairs is None else pairs
    if pairs < width:
        raise ValueError("fewer pairs than features leave the values undetermined")
    sets = coalitions(width, pairs, seed) if width > 1 else np.zeros((0, 1), bool)
    every = np.vstack([np.zeros((1, width), bool), sets, np.ones((1, width), bool)])
    at_once = max(1, WORK_CELLS // (len(base) * width))
    features, branches = (pa.array([n[k] for n in names]) for k in (0, 1))
    columns = ["review_id", "label", "feature", "branch", "value", "phi", "error"]

    def value_of(x: np.ndarray) -> np.ndarray:
        out = []
        for low in range(0, len(every), at_once):
            mixed = np.where(every[low : low + at_once, None, :], x, base)
            out.append(np.asarray(score(mixed.reshape(-1, width)), float).reshape(-1, len(base)).mean(axis=1))
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(low, ROWS_AT_ONCE)
                x = dense_rows(part.column(2), width)
                found = np.stack([value_of(row) for row in x])
                totals = found[:, -1] - found[:, 0]
                phi, error = totals[:, None], np.zeros((len(x), 1))
                if width > 1:
                    phi, error = coalition_values(sets, found[:, 1:-1] - found[:, :1], totals)
                who = pa.array(np.repeat(np.arange(len(x)), width))
                place = pa.array(np.tile(np.arange(width), len(x)))
                numbers = (pa.array(np.ascontiguousarray(v).ravel()) for v in (x, phi, error))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(who), part.column(1).take(who), features.take(place), branches.take(place), *numbers], columns
                )

    id_kind, label_kind = (explain.schema[c].dataType.simpleString() for c in ("review_id", "label"))
    schema = f"review_id {id_kind}, label {label_kind}, feature string, branch string, value double, phi double, error double"
    slim = explain.select("review_id", "label", F.col(column).cast("array<double>").alias(column))
    return slim.mapInArrow(run, schema)


def shapley_linear(
    explain: DataFrame, background: DataFrame, weights: Sequence[float], names: Names,
    column: str = "features",
) -> DataFrame:
    """Closed form for a linear score: weight times distance from the background mean."""
    means = one_row(
        background.agg(*[F.avg(F.col(column)[j].cast("double")) for j in range(len(weights))])
    )
    vector = F.col(column).cast("array<double>")
    centred = F.zip_with(vector, F.array(*[F.lit(float(m)) for m in means]), lambda x, m: x - m)
    phi = F.zip_with(centred, F.array(*[F.lit(float(w)) for w in weights]), lambda d, w: d * w)
    cells = F.arrays_zip(
        F.array(*[F.lit(feature) for feature, _ in names]).alias("feature"),
        F.array(*[F.lit(branch) for _, branch in names]).alias("branch"),
        vector.alias("value"),
        phi.alias("phi"),
    )
    return explain.select("review_id", "label", F.explode(cells).alias("_c")).select(
        "review_id", "label", "_c.*"
    )


def global_importance(attr: DataFrame, top: int | None = None) -> DataFrame:
    """Mean absolute and mean signed attribution per feature, ranked."""
    means = attr.groupBy("feature", "branch").agg(
        F.avg(F.abs("phi")).alias("mean_abs_phi"), F.avg("phi").alias("mean_phi")
    )
    order = Window.orderBy(F.desc("mean_abs_phi"), "feature")  # one row per feature
    ranked = means.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def branch_importance(attr: DataFrame) -> DataFrame:
    """Mean absolute attribution over the cells of each branch and its share in percent."""
    means = attr.groupBy("branch").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
    total = F.sum("mean_abs_phi").over(Window.partitionBy())  # one row per branch
    return means.withColumn("pct", F.col("mean_abs_phi") / total * 100)


VOLUME_BUCKETS = ["quartile 1", "quartile 2", "quartile 3", "quartile 4"]


def branch_by_volume(attr: DataFrame, feature: str = "review_count", least: int = 5) -> DataFrame:
    """Branch shares by quartile (linear interpolation, intervals (lo, hi]) of one feature's value."""
    volumes = attr.filter(F.col("feature") == feature).select("review_id", F.col("value").alias("_v"))
    cuts = one_row(exact_percentiles(volumes, "_v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}))
    bucket = (
        F.when(F.col("_v") <= cuts["q1"], VOLUME_BUCKETS[0])
        .when(F.col("_v") <= cuts["q2"], VOLUME_BUCKETS[1])
        .when(F.col("_v") <= cuts["q3"], VOLUME_BUCKETS[2])
        .otherwise(VOLUME_BUCKETS[3])
    )
    placed = volumes.select("review_id", bucket.alias("bucket"))

    def mean_of(branch: str):
        return F.avg(F.when(F.col("branch") == branch, F.abs("phi")))

    volume_rows = F.count(F.when(F.col("feature") == feature, True))
    shares = attr.join(placed, "review_id").groupBy("bucket").agg(
        volume_rows.alias("n_reviews"), mean_of("text").alias("_t"), mean_of("behavior").alias("_b")
    )
    total = F.col("_t") + F.col("_b")
    return shares.filter(F.col("n_reviews") >= least).select(
        "bucket",
        "n_reviews",
        (F.col("_t") / total * 100).alias("text_pct"),
        (F.col("_b") / total * 100).alias("behavior_pct"),
    )


def row_explanation(attr: DataFrame, review_id: object = None) -> DataFrame:
    """Text attribution summed to one entry plus each behaviour feature, ranked by absolute value.

    For one review, or for every review when no id is given.
    """
    rows = attr if review_id is None else attr.filter(F.col("review_id") == review_id)
    component = F.when(F.col("branch") == "text", "text").otherwise(F.col("feature"))
    parts = rows.groupBy("review_id", "label", component.alias("component")).agg(F.sum("phi").alias("phi"))
    order = Window.partitionBy("review_id").orderBy(F.desc(F.abs("phi")), "component")  # 7 rows per review
    return parts.withColumn("rank", F.row_number().over(order))


def value_attr_relation(attr: DataFrame) -> DataFrame:
    """Correlation of value and attribution per behaviour feature and label."""
    behavior = attr.filter(F.col("branch") == "behavior")
    return behavior.groupBy("feature", "label").agg(
        F.count(F.lit(1)).alias("n"), F.corr("value", "phi").alias("corr"), F.avg("phi").alias("mean_phi")
    )
