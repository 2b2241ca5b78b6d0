"""Reviewer-behaviour features, scaling, point-in-time variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from candora.catalog.views import EVENT_REVIEWS_SQL, REVIEWS_SQL, event_reviews, r6, reviews, rounded
from candora.operators import asof, behavior, splits
from candora.plans.storage import freeze
from candora.schema import BEHAVIOR_FEATURES


def _one_feature(name):
    operator = getattr(behavior, name)

    def query(spark, sf):
        return rounded(operator(reviews(spark, sf)).select("review_id", name))

    return query


def burst_windows(spark, sf):
    return behavior.burst_windows(reviews(spark, sf)).select(
        "review_id", "user_id", "window_no", "window_start", "window_size", "in_burst"
    )


def burst_windows_one_day(spark, sf):
    return behavior.burst_windows(event_reviews(spark, sf), days=1).select(
        "review_id", "user_id", "window_no", "window_start", "window_size", "in_burst"
    )


def behavior_features(spark, sf):
    return rounded(behavior.behavior_features(reviews(spark, sf)))


def behavior_features_events(spark, sf):
    return rounded(behavior.behavior_features(event_reviews(spark, sf), days=1))


def standardize_fit(spark, sf):
    return rounded(behavior.standardize_fit(behavior.behavior_features(reviews(spark, sf))))


def standardize_apply(spark, sf):
    features = freeze(behavior.behavior_features(reviews(spark, sf)))
    return rounded(behavior.standardize_apply(features, behavior.standardize_fit(features)))


def split_feature_sets(spark, sf):
    split = splits.temporal_split(reviews(spark, sf))
    parts = [split.filter(F.col("split") == s).drop("split") for s in ("train", "test")]
    out = behavior.split_feature_sets(*parts)
    named = [F.col("features")[i].alias(n) for i, n in enumerate(BEHAVIOR_FEATURES)]
    return rounded(out.select("review_id", "split", F.size("features").alias("width"), *named))


def asof_avg_rating(spark, sf):
    return rounded(asof.asof_avg_rating(reviews(spark, sf)).select("review_id", "asof_avg_rating"))


def asof_avg_rating_events(spark, sf):
    return rounded(asof.asof_avg_rating(event_reviews(spark, sf)).select("review_id", "asof_avg_rating"))


def asof_review_count(spark, sf):
    return asof.asof_review_count(reviews(spark, sf)).select("review_id", "asof_review_count")


def rolling_burst_ratio(spark, sf):
    return rounded(asof.rolling_burst_ratio(reviews(spark, sf)))


def rolling_burst_ratio_events(spark, sf):
    return rounded(asof.rolling_burst_ratio(event_reviews(spark, sf), days=1, k=1.5))


def reviewer_rating_deviation(spark, sf):
    return rounded(asof.reviewer_rating_deviation(reviews(spark, sf)))


def category_entropy(spark, sf):
    return rounded(asof.category_entropy(reviews(spark, sf)))


def impute_cold_start(spark, sf):
    prior = asof.asof_avg_rating(reviews(spark, sf)).select("review_id", "asof_avg_rating")
    return rounded(asof.impute_cold_start(prior, ["asof_avg_rating"]))


QUERIES = {
    name: _one_feature(name)
    for name in (
        "avg_star_rating", "review_count", "burst_ratio", "rating_deviation", "category_diversity",
        "account_age_at_review",
    )
} | {
    f.__name__: f
    for f in (
        burst_windows, burst_windows_one_day, behavior_features, behavior_features_events, standardize_fit,
        standardize_apply, split_feature_sets, asof_avg_rating, asof_avg_rating_events, asof_review_count,
        rolling_burst_ratio, rolling_burst_ratio_events, reviewer_rating_deviation, category_entropy,
        impute_cold_start,
    )
}


def bursts_sql(source: str, days: int, prefix: str = "", extra: str = "") -> str:
    """CTE ``{prefix}bursts``: every row with its greedy window, the anchors found by recursion.

    ``extra`` names a column that separates independent tables stacked in ``source``.
    """
    key = f"{extra}, user_id" if extra else "user_id"
    same = " AND ".join(f"a.{k} = r.{k}" for k in key.split(", "))
    return f"""
    {prefix}anchors AS (
      SELECT {key}, min(date) AS anchor FROM {source} GROUP BY {key}
      UNION ALL
      SELECT {', '.join('a.' + k for k in key.split(', '))}, min(r.date) FROM {prefix}anchors a JOIN {source} r
        ON {same} AND r.date >= a.anchor + INTERVAL {days + 1} DAY
      GROUP BY {', '.join('a.' + k for k in key.split(', '))}, a.anchor),
    {prefix}placed AS (
      SELECT {', '.join('r.' + k for k in key.split(', '))}, r.review_id, max(a.anchor) AS window_start,
             count(*) AS window_no
      FROM {source} r JOIN {prefix}anchors a ON {same} AND a.anchor <= r.date GROUP BY ALL),
    {prefix}bursts AS (
      SELECT *, count(*) OVER (PARTITION BY {key}, window_no) AS window_size FROM {prefix}placed)"""


def features_sql(source: str, days: int = 30, prefix: str = "", extra: str = "") -> str:
    """CTE ``{prefix}features``: the six features of every row of ``source``."""
    user = f"{extra}, r.user_id" if extra else "r.user_id"
    product = f"{extra}, r.product_id" if extra else "r.product_id"
    if extra:
        user, product = f"r.{user}", f"r.{product}"
    split = f"r.{extra}, " if extra else ""
    ratio_key = f"{extra}, user_id" if extra else "user_id"
    same = f"b.{extra} = r.{extra} AND " if extra else ""
    return f"""{bursts_sql(source, days, prefix, extra)},
    {prefix}ratios AS (
      SELECT review_id, {ratio_key},
             avg(CASE WHEN window_size >= 2 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY {ratio_key}) AS burst_ratio
      FROM {prefix}bursts),
    {prefix}diversity AS (
      SELECT {split}r.user_id, count(DISTINCT product_id)::DOUBLE / greatest(count(product_id), 1) AS diversity
      FROM {source} r GROUP BY {user}),
    {prefix}features AS (
      SELECT {split}r.review_id,
             avg(r.rating) OVER (PARTITION BY {user}) AS avg_star_rating,
             count(*) OVER (PARTITION BY {user})::DOUBLE AS review_count,
             b.burst_ratio,
             abs(r.rating - avg(r.rating) OVER (PARTITION BY {product})) AS rating_deviation,
             d.diversity AS category_diversity,
             floor((epoch_us(r.date) - min(epoch_us(r.date)) OVER (PARTITION BY {user})) / 86400000000.0::DOUBLE)
               AS account_age_at_review,
             r.label
      FROM {source} r JOIN {prefix}ratios b ON {same}b.review_id = r.review_id
      JOIN {prefix}diversity d ON {same.replace('b.', 'd.')}d.user_id = r.user_id)"""


def _feature_list(table: str = "") -> str:
    dot = f"{table}." if table else ""
    return ", ".join(f"{r6(dot + f)} AS {f}" for f in BEHAVIOR_FEATURES)


_FEATURES = f"WITH RECURSIVE {REVIEWS_SQL}, {features_sql('reviews')}"

_STATS = ", ".join(
    f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END AS s_{f}"
    for f in BEHAVIOR_FEATURES
)
_SCALED = ", ".join(f"{r6(f'({f} - m_{f}) / s_{f}')} AS {f}" for f in BEHAVIOR_FEATURES)

_BURST_SELECT = """
    SELECT review_id, user_id, window_no, window_start, window_size,
           CAST(CASE WHEN window_size >= 2 THEN 1 ELSE 0 END AS INTEGER) AS in_burst FROM bursts"""

_ASOF = """
    SELECT r.review_id, {0} AS asof_avg_rating
    FROM {1} r LEFT JOIN {1} p ON p.user_id = r.user_id AND p.date < r.date GROUP BY r.review_id"""


def _rolling(source: str, days: int, k: float) -> str:
    return f"""
        counts AS (
          SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(date)
                 RANGE BETWEEN {days * 86_400_000_000 - 1} PRECEDING AND CURRENT ROW) AS c FROM {source}),
        cuts AS (SELECT user_id, avg(c) + {k}::DOUBLE * stddev_pop(c) AS cut, count(*) AS n FROM counts GROUP BY user_id)
        SELECT u.user_id, u.n AS n_reviews,
               {r6('avg(CASE WHEN c.c > u.cut + 1e-9 THEN 1.0 ELSE 0.0 END)')} AS rolling_burst_ratio
        FROM counts c JOIN cuts u ON c.user_id = u.user_id GROUP BY u.user_id, u.n"""


ORACLES = {
    name: f"{_FEATURES} SELECT review_id, {r6(name)} AS {name} FROM features"
    for name in (
        "avg_star_rating", "review_count", "burst_ratio", "rating_deviation", "category_diversity",
        "account_age_at_review",
    )
} | {
    "burst_windows": f"WITH RECURSIVE {REVIEWS_SQL}, {bursts_sql('reviews', 30)} {_BURST_SELECT}",
    "burst_windows_one_day": (
        f"WITH RECURSIVE {EVENT_REVIEWS_SQL}, {bursts_sql('event_reviews', 1)} {_BURST_SELECT}"
    ),
    "behavior_features": f"{_FEATURES} SELECT review_id, {_feature_list()} FROM features",
    "behavior_features_events": f"""
        WITH RECURSIVE {EVENT_REVIEWS_SQL}, {features_sql('event_reviews', 1)}
        SELECT review_id, {_feature_list()} FROM features""",
    "standardize_fit": f"{_FEATURES}, stats AS (SELECT {_STATS} FROM features) "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {r6(f'm_{f}')} AS mean, {r6(f's_{f}')} AS scale FROM stats"
        for f in BEHAVIOR_FEATURES
    ),
    "standardize_apply": f"""
        {_FEATURES}, stats AS (SELECT {_STATS} FROM features)
        SELECT review_id, {_SCALED} FROM features, stats""",
    "split_feature_sets": f"""
        WITH RECURSIVE {REVIEWS_SQL},
        cut AS (SELECT date AS cutoff FROM reviews ORDER BY date
                LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) FROM reviews)),
        split AS (SELECT r.*, CASE WHEN date <= cutoff THEN 'train' ELSE 'test' END AS split FROM reviews r, cut),
        {features_sql('split', 30, '', 'split')},
        stats AS (SELECT {_STATS} FROM features WHERE split = 'train')
        SELECT review_id, split, 16 AS width, {_SCALED} FROM features, stats""",
    "asof_avg_rating": f"WITH {REVIEWS_SQL} {_ASOF.format(r6('avg(p.rating)'), 'reviews')}",
    "asof_avg_rating_events": f"WITH {EVENT_REVIEWS_SQL} {_ASOF.format(r6('avg(p.rating)'), 'event_reviews')}",
    "asof_review_count": f"""
        WITH {REVIEWS_SQL}
        SELECT r.review_id, count(p.review_id) + 1 AS asof_review_count
        FROM reviews r LEFT JOIN reviews p ON p.user_id = r.user_id AND p.date < r.date GROUP BY r.review_id""",
    "rolling_burst_ratio": f"WITH {REVIEWS_SQL}, {_rolling('reviews', 30, 2.0)}",
    "rolling_burst_ratio_events": f"WITH {EVENT_REVIEWS_SQL}, {_rolling('event_reviews', 1, 1.5)}",
    "reviewer_rating_deviation": f"""
        WITH {REVIEWS_SQL},
        means AS (SELECT product_id, avg(rating) AS m FROM reviews WHERE label = 0 GROUP BY product_id)
        SELECT user_id, {r6('avg(abs(rating - m))')} AS reviewer_rating_deviation
        FROM reviews r JOIN means p ON r.product_id = p.product_id GROUP BY user_id""",
    "category_entropy": f"""
        WITH {REVIEWS_SQL},
        pairs AS (SELECT user_id, product_id, count(*) AS n FROM reviews GROUP BY ALL),
        shares AS (SELECT user_id, n::DOUBLE / sum(n) OVER (PARTITION BY user_id) AS p FROM pairs)
        SELECT user_id, {r6('-sum(p * ln(p))')} AS category_entropy FROM shares GROUP BY user_id""",
    "impute_cold_start": f"""
        WITH {REVIEWS_SQL},
        prior AS (SELECT r.review_id, avg(p.rating) AS a FROM reviews r
                  LEFT JOIN reviews p ON p.user_id = r.user_id AND p.date < r.date GROUP BY r.review_id)
        SELECT review_id, {r6('coalesce(a, (SELECT median(a) FROM prior))')} AS asof_avg_rating FROM prior""",
}
