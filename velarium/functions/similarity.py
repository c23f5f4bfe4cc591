"""String similarities. Set and edit measures are column expressions; those that Spark lacks run
as Arrow batches over candidate pairs, never over all pairs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def bigrams(c: Column) -> Column:
    """Distinct two-character substrings."""
    return F.when(F.length(c) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: c.substr(i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Twice the common bigrams over all bigrams, in lower case; equal strings give 1, strings
    without bigrams 0."""
    x, y = bigrams(F.lower(a)), bigrams(F.lower(b))
    n = F.size(x) + F.size(y)
    return F.when(F.lower(a) == F.lower(b), 1.0).when(n == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / n)


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for two empty strings."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 0.0).otherwise(F.levenshtein(a, b) / n)


def char_overlap(a: Column, b: Column) -> Column:
    """Share of the shorter string's characters that the longer one holds."""
    short = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    long = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n = F.length(short)
    return F.when(n == 0, 0.0).otherwise((n - F.length(F.call_function("translate", short, long, F.lit("")))) / n)


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    hits = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    other = [c for c, u in zip(b, used) if u]
    m, swaps = len(hits), sum(x != y for x, y in zip(hits, other)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + 0.1 * same * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def composite(a: Column, b: Column) -> Column:
    return 0.4 * sequence_ratio(a, b) + 0.4 * jaro_winkler(a, b) + 0.2 * (1 - edit_distance(a, b))


def _grams(c: Column) -> Column:
    return F.when(F.length(c) >= 2, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: c.substr(i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def dice_multiset(a: Column, b: Column) -> Column:
    """Bigrams with repeats: twice the sum of the lesser counts over all bigrams."""
    x, y = _grams(F.lower(a)), _grams(F.lower(b))
    n = F.size(x) + F.size(y)

    def count(arr: Column, g: Column) -> Column:
        return F.size(F.filter(arr, lambda v: v == g))

    both = F.aggregate(F.array_distinct(x), F.lit(0), lambda t, g: t + F.least(count(x, g), count(y, g)))
    return F.when(F.lower(a) == F.lower(b), 1.0).when(n == 0, 0.0).otherwise(2.0 * both / n)


def dice_joined(a: Column, b: Column) -> Column:
    """Set bigrams without spaces and hyphens; two empty strings give 1."""
    x, y = (F.regexp_replace(c, "[ -]", "") for c in (a, b))
    return F.when((x == "") & (y == ""), 1.0).otherwise(dice(x, y))
