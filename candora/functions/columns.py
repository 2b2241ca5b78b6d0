"""Column expressions shared by the operators; all of them stay inside code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970-01-01 for a date or timestamp column (session time zone: UTC)."""
    if isinstance(df.schema[name].dataType, T.TimestampType):
        return F.unix_micros(name)
    return F.unix_micros(F.col(name).cast("timestamp"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division with 0.0 where the denominator is zero."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(
        numerator.cast("double") / denominator.cast("double")
    )


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def stable_bce(logit: Column, label: Column) -> Column:
    """Binary cross-entropy from a logit without overflow."""
    return (
        F.greatest(logit, F.lit(0.0)) - logit * label.cast("double") + F.log1p(F.exp(-F.abs(logit)))
    )


def focal(logit: Column, label: Column, gamma: float, alpha: tuple[float, float]) -> Column:
    """Focal loss of one row; ``alpha`` = (weight of class 0, weight of class 1)."""
    probability = sigmoid(logit)
    positive = label == 1
    p_true = F.when(positive, probability).otherwise(F.lit(1.0) - probability)
    weight = F.when(positive, F.lit(float(alpha[1]))).otherwise(F.lit(float(alpha[0])))
    return weight * F.pow(F.lit(1.0) - p_true, F.lit(float(gamma))) * stable_bce(logit, label)


def dot(vector: Column, weights: Sequence[float]) -> Column:
    """Inner product of an array column with fixed weights."""
    constant = F.array(*[F.lit(float(w)) for w in weights])
    products = F.zip_with(vector, constant, lambda x, w: x.cast("double") * w)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


WHITESPACE = r"(?U)[\s\x1c-\x1f]+"  # Unicode white space and the four ASCII separators


def words(text: Column) -> Column:
    """Whitespace-separated words; runs collapse, empties disappear."""
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")


def strip(text: Column) -> Column:
    """Text without leading and trailing white space."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def hash_uniform(seed: int | str, *parts: Column) -> Column:
    """Deterministic uniform number in [0, 1) from the md5 of the seed and the given columns."""
    digest = keyed_md5(seed, *parts)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def keyed_md5(seed: int | str, *parts: Column) -> Column:
    """md5 hex of ``seed|part|part…``: a stable, engine-independent shuffle key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def pad_vector(vector: Column, width: int) -> Column:
    """Zero-pad an array to ``width``; wider arrays stay as they are."""
    missing = F.greatest(F.lit(width) - F.size(vector), F.lit(0))
    return F.concat(vector, F.array_repeat(F.lit(0.0), missing))
