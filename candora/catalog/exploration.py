"""Exploratory tables."""

from __future__ import annotations

from candora.catalog.behavior import features_sql
from candora.catalog.preparation import SPACE
from candora.catalog.views import REVIEWS_SQL, TEXT_REVIEWS_SQL, r6, reviews, rounded, text_reviews
from candora.operators import behavior, cleaning, eda
from candora.schema import BEHAVIOR_FEATURES


def _labelled_lengths(spark, sf):
    return cleaning.text_lengths(cleaning.clean_reviews(text_reviews(spark, sf)))


def _features(spark, sf):
    return behavior.behavior_features(reviews(spark, sf), keep=["label"])


def describe_by_label(spark, sf):
    return rounded(eda.describe_by_label(_labelled_lengths(spark, sf)))


def label_distribution(spark, sf):
    return rounded(eda.label_distribution(reviews(spark, sf)))


def length_histogram(spark, sf):
    return rounded(eda.length_histogram(_labelled_lengths(spark, sf)))


def length_cdf(spark, sf):
    return rounded(eda.length_cdf(_labelled_lengths(spark, sf)))


def rating_distribution(spark, sf):
    return rounded(eda.rating_distribution(reviews(spark, sf)))


def rating_box_stats(spark, sf):
    return rounded(eda.rating_box_stats(reviews(spark, sf)))


def top_reviewers(spark, sf):
    return rounded(eda.top_reviewers(reviews(spark, sf)))


def monthly_volume(spark, sf):
    return rounded(eda.monthly_volume(reviews(spark, sf)))


def feature_correlation(spark, sf):
    return rounded(eda.feature_correlation(_features(spark, sf)))


def feature_density(spark, sf):
    return rounded(eda.feature_density(_features(spark, sf)))


def feature_means_by_label(spark, sf):
    return rounded(eda.feature_means_by_label(_features(spark, sf)))


QUERIES = {
    f.__name__: f
    for f in (
        describe_by_label, label_distribution, length_histogram, length_cdf, rating_distribution, rating_box_stats,
        top_reviewers, monthly_volume, feature_correlation, feature_density, feature_means_by_label,
    )
}

_LENGTHS = f"""
    WITH {TEXT_REVIEWS_SQL},
    cleaned AS (
      SELECT CAST(label AS INTEGER) AS label, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS text
      FROM text_reviews WHERE label IS NOT NULL),
    lengths AS (
      SELECT label, len(list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda w: w <> '')) AS text_length,
             length(text) AS char_length FROM cleaned WHERE text <> ''),
    clipped AS (SELECT label, least(text_length, 500) AS v FROM lengths)"""

_FEATURES = f"WITH RECURSIVE {REVIEWS_SQL}, {features_sql('reviews')}"


def _describe(measure: str) -> str:
    return f"""
        SELECT label, '{measure}' AS measure, count(*) AS count, {r6(f'avg({measure})')} AS mean,
               {r6(f'stddev_samp({measure})')} AS std, CAST(min({measure}) AS DOUBLE) AS min,
               CAST(max({measure}) AS DOUBLE) AS max, {r6(f'quantile_cont({measure}, 0.25)')} AS p25,
               {r6(f'quantile_cont({measure}, 0.5)')} AS p50, {r6(f'quantile_cont({measure}, 0.75)')} AS p75
        FROM lengths GROUP BY label"""


_PAIRS = [(a, b) for a in (*BEHAVIOR_FEATURES, "label") for b in (*BEHAVIOR_FEATURES, "label")]

ORACLES = {
    "describe_by_label": f"{_LENGTHS} {_describe('text_length')} UNION ALL {_describe('char_length')}",
    "label_distribution": f"""
        WITH {REVIEWS_SQL}
        SELECT label, count(*) AS n, {r6('count(*) * 100.0::DOUBLE / (SELECT count(*) FROM reviews)')} AS pct
        FROM reviews GROUP BY label""",
    "length_histogram": f"""
        {_LENGTHS},
        frame AS (SELECT label, min(v)::DOUBLE AS lo, (max(v) - min(v)) / 60.0::DOUBLE AS width, count(*) AS n FROM clipped GROUP BY label),
        edges AS (SELECT *, lo + bin * width AS a, lo + (bin + 1) * width AS b FROM frame, range(0, 60) t(bin)),
        filled AS (
          SELECT label, least(CAST(floor((v - lo) / width) AS BIGINT), 59) AS bin, count(*) AS c
          FROM clipped JOIN frame USING (label) GROUP BY ALL)
        SELECT e.label, CAST(e.bin AS INTEGER) AS bin, {r6('a')} AS bin_start, coalesce(c, 0) AS count,
               {r6('coalesce(c, 0) / (n * width)')} AS density
        FROM edges e LEFT JOIN filled f ON e.label = f.label AND e.bin = f.bin""",
    "length_cdf": f"""
        {_LENGTHS},
        steps AS (SELECT label, v, cume_dist() OVER (PARTITION BY label ORDER BY v) AS c FROM clipped)
        SELECT DISTINCT label, CAST(v AS INTEGER) AS length, {r6('c')} AS cdf FROM steps""",
    "rating_distribution": f"""
        WITH {REVIEWS_SQL}
        SELECT rating, count(*) FILTER (label = 0) AS n_genuine, count(*) FILTER (label = 1) AS n_fake,
               {r6('count(*) FILTER (label = 0) * 100.0::DOUBLE / (SELECT count(*) FROM reviews WHERE label = 0)')} AS pct_genuine,
               {r6('count(*) FILTER (label = 1) * 100.0::DOUBLE / (SELECT count(*) FROM reviews WHERE label = 1)')} AS pct_fake
        FROM reviews GROUP BY rating""",
    "rating_box_stats": f"""
        WITH {REVIEWS_SQL},
        q AS (SELECT label, quantile_cont(rating, 0.25) AS q1, quantile_cont(rating, 0.5) AS median,
                     quantile_cont(rating, 0.75) AS q3 FROM reviews GROUP BY label)
        SELECT r.label, {r6('q1')} AS q1, {r6('median')} AS median, {r6('q3')} AS q3,
               min(rating) FILTER (rating >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
               max(rating) FILTER (rating <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
               count(*) FILTER (rating < q1 - 1.5 * (q3 - q1) OR rating > q3 + 1.5 * (q3 - q1)) AS n_outliers
        FROM reviews r JOIN q ON r.label = q.label GROUP BY r.label, q1, median, q3""",
    "top_reviewers": f"""
        WITH {REVIEWS_SQL}
        SELECT user_id, count(label) AS review_count, CAST(sum(label) AS BIGINT) AS fake_count,
               {r6('sum(label)::DOUBLE / count(label)')} AS fake_rate
        FROM reviews GROUP BY user_id ORDER BY review_count DESC, user_id LIMIT 20""",
    "monthly_volume": f"""
        WITH {REVIEWS_SQL},
        months AS (SELECT strftime(date, '%Y-%m') AS month, count(*) FILTER (label = 0) AS n_genuine,
                          count(*) FILTER (label = 1) AS n_fake, avg(label) AS f FROM reviews GROUP BY month)
        SELECT month, n_genuine, n_fake, {r6('f')} AS fake_fraction,
               {r6('(f + lag(f) OVER (ORDER BY month) + lead(f) OVER (ORDER BY month)) / 3')} AS rolling_fraction,
               {r6('avg(f) OVER ()')} AS overall_mean
        FROM months""",
    "feature_correlation": f"""
        {_FEATURES},
        long AS ({' UNION ALL '.join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS corr FROM features" for a, b in _PAIRS)})
        SELECT feature_a, feature_b, {r6('corr')} AS corr,
               CASE WHEN feature_b = 'label' AND feature_a <> 'label' THEN CAST(row_number() OVER (
                 PARTITION BY feature_b = 'label' AND feature_a <> 'label' ORDER BY corr DESC, feature_a) AS INTEGER) END AS rank
        FROM long""",
    "feature_density": f"""
        {_FEATURES},
        long AS ({' UNION ALL '.join(f"SELECT label, '{f}' AS feature, {f'ln(1 + {f})' if f == 'review_count' else f} AS v FROM features" for f in BEHAVIOR_FEATURES)}),
        counts AS (SELECT label, feature, v, count(*) AS n FROM long GROUP BY ALL),
        frame AS (SELECT label, feature, count(*) AS total, pow(count(*), -0.2::DOUBLE) * stddev_samp(v) * 0.8::DOUBLE AS h,
                         min(v) AS lo, max(v) AS hi FROM long GROUP BY label, feature),
        grid AS (SELECT *, lo - 3 * h + p * (hi - lo + 6 * h) / 199 AS x FROM frame, range(0, 200) t(p))
        SELECT g.label, g.feature, CAST(p AS INTEGER) AS point, {r6('x')} AS x,
               {r6('sum(n * exp(-pow((x - v) / h, 2) / 2)) / (total * h * sqrt(2 * pi()))')} AS density
        FROM grid g JOIN counts c ON g.label = c.label AND g.feature = c.feature
        GROUP BY g.label, g.feature, p, x, total, h""",
    "feature_means_by_label": f"{_FEATURES} "
    + " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, {r6(f'avg({f}) FILTER (label = 0)')} AS genuine, {r6(f'avg({f}) FILTER (label = 1)')} AS fake,
            {r6(f'avg({f}) FILTER (label = 1) - avg({f}) FILTER (label = 0)')} AS delta,
            round((avg({f}) FILTER (label = 1) - avg({f}) FILTER (label = 0)) / abs(avg({f}) FILTER (label = 0)) * 100, 1) AS pct_difference
            FROM features"""
        for f in BEHAVIOR_FEATURES
    ),
}
