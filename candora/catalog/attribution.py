"""Shapley attributions of a fixed linear score over the vectors, and of a small network."""

from __future__ import annotations

from pyspark.sql import functions as F

from candora.catalog.learning import fixed_layers
from candora.catalog.views import VECTORS_SQL, r6, rounded, vectors
from candora.operators import attribution, mlp, splits
from candora.schema import BEHAVIOR_FEATURES

TEXT_WIDTH = 58
WEIGHTS = [((j * 37) % 19 - 9) / 10 for j in range(64)]
NAMES = attribution.fused_names(TEXT_WIDTH)


def _attributed(spark, sf):
    rows = vectors(spark, sf)
    return attribution.shapley_linear(rows, rows, WEIGHTS, NAMES)


def shapley_sampling(spark, sf):
    rows = vectors(spark, sf)
    background = splits.sample_n(rows, 50)
    score = mlp.forward_function(fixed_layers())
    attr = attribution.shapley_sampling(rows, background, score, NAMES)
    return attr.groupBy("review_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("phi"), 6).alias("total"))


def shapley_coalitions(spark, sf):
    """Values by coalitions of a linear score: exact, with errors of 0."""
    import numpy as np

    rows = vectors(spark, sf)
    weights = np.array(WEIGHTS)
    found = attribution.shapley_coalitions(rows, splits.sample_n(rows, 20), lambda x: x @ weights, NAMES, pairs=96)
    return rounded(found.select("review_id", "feature", "phi", "error"))


def shapley_linear(spark, sf):
    return rounded(_attributed(spark, sf))


def global_importance(spark, sf):
    return rounded(attribution.global_importance(_attributed(spark, sf), top=5))


def branch_importance(spark, sf):
    return rounded(attribution.branch_importance(_attributed(spark, sf)))


def branch_by_volume(spark, sf):
    return rounded(attribution.branch_by_volume(_attributed(spark, sf)))


def row_explanation(spark, sf):
    return rounded(attribution.row_explanation(_attributed(spark, sf)))


def value_attr_relation(spark, sf):
    return rounded(attribution.value_attr_relation(_attributed(spark, sf)))


QUERIES = {
    f.__name__: f
    for f in (
        shapley_sampling, shapley_coalitions, shapley_linear, global_importance, branch_importance, branch_by_volume, row_explanation,
        value_attr_relation,
    )
}

_NAMED = ", ".join(f"({j}, '{n}', '{b}', {w}::DOUBLE)" for j, ((n, b), w) in enumerate(zip(NAMES, WEIGHTS, strict=True), 1))

_ATTR = f"""
    WITH {VECTORS_SQL},
    named(j, feature, branch, w) AS (VALUES {_NAMED}),
    cells AS (SELECT review_id, label, unnest(features) AS x, generate_subscripts(features, 1) AS j FROM vectors),
    means AS (SELECT j, avg(x) AS m FROM cells GROUP BY j),
    attr AS (SELECT review_id, label, feature, branch, x AS value, w * (x - m) AS phi
             FROM cells JOIN means USING (j) JOIN named USING (j))"""

_LAYERS = fixed_layers()


def _network(vector: str) -> str:
    (w1, b1), (w2, b2) = _LAYERS
    units = [
        f"{w2[0][j]} * greatest(0.0::DOUBLE, list_dot_product({vector}, {[float(w) for w in w1[j]]}::DOUBLE[]) + {b1[j]})"
        for j in range(len(b1))
    ]
    return f"{' + '.join(units)} + {b2[0]}"


ORACLES = {
    # the efficiency property: attributions add up to the score minus the mean background score
    "shapley_sampling": f"""
        WITH {VECTORS_SQL},
        background AS (SELECT * FROM vectors ORDER BY md5('42|' || review_id), review_id LIMIT 50),
        base AS (SELECT avg({_network('features')}) AS b FROM background)
        SELECT review_id, CAST(64 AS BIGINT) AS n, {r6(f"({_network('features')}) - b")} AS total FROM vectors, base""",
    "shapley_coalitions": f"""
        WITH {VECTORS_SQL},
        background AS (SELECT * FROM vectors ORDER BY md5('42|' || review_id), review_id LIMIT 20),
        named(j, feature, branch, w) AS (VALUES {_NAMED}),
        means AS (SELECT j, avg(x) AS m FROM (
          SELECT unnest(features) AS x, generate_subscripts(features, 1) AS j FROM background) GROUP BY j),
        cells AS (SELECT review_id, unnest(features) AS x, generate_subscripts(features, 1) AS j FROM vectors)
        SELECT review_id, feature, {r6('w * (x - m)')} AS phi, 0.0::DOUBLE AS error FROM cells JOIN means USING (j) JOIN named USING (j)""",
    "shapley_linear": f"""
        {_ATTR} SELECT review_id, label, feature, branch, {r6('value')} AS value, {r6('phi')} AS phi FROM attr""",
    "global_importance": f"""
        {_ATTR},
        ranked AS (
          SELECT feature, branch, avg(abs(phi)) AS a, avg(phi) AS s,
                 row_number() OVER (ORDER BY avg(abs(phi)) DESC, feature) AS rk FROM attr GROUP BY feature, branch)
        SELECT feature, branch, {r6('a')} AS mean_abs_phi, {r6('s')} AS mean_phi, CAST(rk AS INTEGER) AS rank
        FROM ranked WHERE rk <= 5""",
    "branch_importance": f"""
        {_ATTR}, b AS (SELECT branch, avg(abs(phi)) AS a FROM attr GROUP BY branch)
        SELECT branch, {r6('a')} AS mean_abs_phi, {r6('a / sum(a) OVER () * 100')} AS pct FROM b""",
    "branch_by_volume": f"""
        {_ATTR},
        volumes AS (SELECT review_id, value AS v FROM attr WHERE feature = 'review_count'),
        cuts AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM volumes),
        placed AS (SELECT review_id, CASE WHEN v <= q1 THEN 'quartile 1' WHEN v <= q2 THEN 'quartile 2' WHEN v <= q3 THEN 'quartile 3'
                          ELSE 'quartile 4' END AS bucket FROM volumes, cuts),
        shares AS (SELECT bucket, count(DISTINCT review_id) AS n, avg(abs(phi)) FILTER (branch = 'text') AS t,
                          avg(abs(phi)) FILTER (branch = 'behavior') AS b
                   FROM attr JOIN placed USING (review_id) GROUP BY bucket)
        SELECT bucket, n AS n_reviews, {r6('t / (t + b) * 100')} AS text_pct, {r6('b / (t + b) * 100')} AS behavior_pct
        FROM shares WHERE n >= 5""",
    "row_explanation": f"""
        {_ATTR},
        parts AS (SELECT review_id, label, CASE WHEN branch = 'text' THEN 'text' ELSE feature END AS component, sum(phi) AS phi
                  FROM attr GROUP BY ALL)
        SELECT review_id, label, component, {r6('phi')} AS phi,
               CAST(row_number() OVER (PARTITION BY review_id ORDER BY abs(phi) DESC, component) AS INTEGER) AS rank
        FROM parts""",
    "value_attr_relation": f"""
        {_ATTR}
        SELECT feature, label, count(*) AS n,
               CASE WHEN stddev_pop(phi) > 0 THEN {r6('corr(value, phi)')} END AS corr, {r6('avg(phi)')} AS mean_phi
        FROM attr WHERE branch = 'behavior' GROUP BY feature, label""",
}
assert len(NAMES) == 64 and NAMES[TEXT_WIDTH][0] == BEHAVIOR_FEATURES[0]
