"""Similarity kernels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from amberlode.functions import text as T

EARTH_KM = 6371.0


def dice(a: Column, b: Column) -> Column:
    """2 * |common| / (|a| + |b|) of two arrays of distinct trigrams; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half = lambda x: F.pow(F.sin(x / 2), 2)
    a = half(F.radians(lat2 - lat1)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(F.radians(lng2 - lng1))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def jaro_winkler_score(a: str, b: str) -> float:
    """On code points; 0 if either is empty; the common prefix of up to four always boosts, by a tenth each."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    left, right_at = [], []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                right_at.append(j)
                break
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != b[j] for x, j in zip(left, sorted(right_at)))
    jaro = (m / len(a) + m / len(b) + (m - moved / 2) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """No built-in function has these semantics; Arrow batches keep the cost down."""
    return pd.Series([jaro_winkler_score(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


def name_similarity(a: Column, b: Column) -> Column:
    """Of two compact names: 1 if equal, else the larger of 0.95 * Jaro-Winkler and trigram Dice; short names count 0.85."""
    score = F.greatest(0.95 * jaro_winkler(a, b), dice(T.trigrams(a), T.trigrams(b)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.when(F.least(F.length(a), F.length(b)) < 4, 0.85 * score).otherwise(score))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    """A zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))
