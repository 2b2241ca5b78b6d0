"""Tokens, vocabulary, TF-IDF, embeddings, PCA."""

from __future__ import annotations

from pyspark.sql import functions as F

from candora.catalog.views import TEXT_REVIEWS_SQL, r6, rounded, text_reviews, vectors
from candora.operators import text


def tokenize_words(spark, sf):
    rows = text.tokenize_words(text_reviews(spark, sf))
    return rows.select(
        "review_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")
    )


def word_ngrams(spark, sf):
    rows = text.word_ngrams(text_reviews(spark, sf))
    return rows.select(
        "review_id", F.size("terms").alias("n_terms"), F.md5(F.array_join("terms", "|")).alias("digest")
    )


def build_vocabulary(spark, sf):
    return text.build_vocabulary(text_reviews(spark, sf))


def tfidf(spark, sf):
    """Fitted on the labelled texts, applied to all of them."""
    rows = text_reviews(spark, sf)
    model = text.tfidf_fit(rows.filter(F.col("label").isNotNull()))
    return rounded(text.tfidf_transform(rows, model).select("review_id", "term", "weight"))


def hashed_embedding(spark, sf):
    rows = text_reviews(spark, sf)
    model = text.tfidf_fit(rows.filter(F.col("label").isNotNull()))
    return rounded(text.hashed_tfidf(rows, model, 64))


def text_embedding(spark, sf):
    embedded = text.text_embedding(text_reviews(spark, sf), text.hashing_encoder(64), 64)
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x))
    return rounded(embedded.select("review_id", F.size("features").alias("width"), norm.alias("norm")))


def pca_fit_transform(spark, sf):
    """Fitted on genuine rows, applied to all rows."""
    rows = vectors(spark, sf)
    model = text.pca_fit(rows.filter(F.col("label") == 0), 16)
    reduced = text.pca_transform(rows, model)
    return rounded(reduced.select("review_id", *[F.col("features")[i].alias(f"pc{i:02d}") for i in range(16)]))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_words, word_ngrams, build_vocabulary, tfidf, hashed_embedding, text_embedding,
        pca_fit_transform,
    )
}

_TOKENS = r"""
    tokens AS (
      SELECT review_id, label, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]{2,}') AS toks
      FROM text_reviews)"""

_TERMS = f"""{_TOKENS},
    terms AS (
      SELECT review_id, label, unnest(toks) AS term FROM tokens
      UNION ALL
      SELECT review_id, label, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS term
      FROM tokens WHERE len(toks) >= 2),
    counts AS (SELECT review_id, label, term, count(*) AS tf FROM terms GROUP BY ALL)"""


def _vocabulary(where: str = "") -> str:
    return f"""
    vocabulary AS (
      SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM counts {where} GROUP BY term
      HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT 50000)"""


_WEIGHTS = f"""{_TERMS}, {_vocabulary('WHERE label IS NOT NULL')},
    n AS (SELECT count(*) AS n FROM text_reviews WHERE label IS NOT NULL),
    raw AS (
      SELECT review_id, c.term, (1 + ln(tf)) * (ln((1.0::DOUBLE + n) / (1 + v.df)) + 1) AS w
      FROM counts c JOIN vocabulary v ON c.term = v.term, n),
    weights AS (
      SELECT review_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY review_id)) AS weight FROM raw)"""

ORACLES = {
    # unit length wherever there is a token
    "text_embedding": r"""
        SELECT doc_id AS review_id, 64 AS width,
               CASE WHEN regexp_matches(lower(text), '[\p{L}\p{N}_]{2,}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm
        FROM documents""",
    "tokenize_words": f"""
        WITH {TEXT_REVIEWS_SQL}, {_TOKENS}
        SELECT review_id, CAST(len(toks) AS INTEGER) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM tokens""",
    "word_ngrams": f"""
        WITH {TEXT_REVIEWS_SQL}, {_TOKENS},
        grams AS (
          SELECT review_id,
                 list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS g
          FROM tokens)
        SELECT review_id, CAST(len(g) AS INTEGER) AS n_terms, md5(array_to_string(g, '|')) AS digest FROM grams""",
    "build_vocabulary": f"WITH {TEXT_REVIEWS_SQL}, {_TERMS}, {_vocabulary()} SELECT term, df, cf FROM vocabulary",
    "tfidf": f"WITH {TEXT_REVIEWS_SQL}, {_WEIGHTS} SELECT review_id, term, {r6('weight')} AS weight FROM weights",
    "hashed_embedding": f"""
        WITH {TEXT_REVIEWS_SQL}, {_WEIGHTS}
        SELECT review_id, CAST(CAST('0x' || md5(term)[1:8] AS BIGINT) % 64 AS INTEGER) AS position,
               {r6("sum(CASE WHEN md5(term)[9] BETWEEN '0' AND '7' THEN -weight ELSE weight END)")} AS value
        FROM weights GROUP BY ALL""",
}
