"""Canonical review schema and feature names."""

# Canonical review columns, in order.
REVIEW_COLUMNS = [
    "review_id", "user_id", "product_id", "rating", "text", "label", "date", "dataset",
]

# Accepted source header names, in order of preference.
COLUMN_ALIASES = {
    "user_id": ["reviewerID", "user_id", "reviewer_id", "userId"],
    "product_id": ["asin", "product_id", "productId", "business_id"],
    "text": ["reviewText", "text", "review_text", "content"],
    "rating": ["overall", "rating", "stars", "star_rating"],
    "date": ["unixReviewTime", "date", "reviewTime", "timestamp"],
    "label": ["label", "spam", "fake", "fraudulent"],
}

# Behaviour feature names, in vector order.
BEHAVIOR_FEATURES = [
    "avg_star_rating",
    "review_count",
    "burst_ratio",
    "rating_deviation",
    "category_diversity",
    "account_age_at_review",
]

DAY_MICROS = 86_400_000_000
