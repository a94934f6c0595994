"""Scoring methods, bounds, confusion counts and metrics as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_punctuation

#: Least score of a match, by method.
THRESHOLDS = {"exact": 1.0, "soft": 1.0, "levenshtein": 0.8}


def exact(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b).cast("double")


def soft(a: Column, b: Column) -> Column:
    return exact(strip_punctuation(a), strip_punctuation(b))


def shared_chars(a: Column, b: Column) -> Column:
    """How many characters both have, each as often as the fewer times."""

    def times(s: Column, c: Column) -> Column:
        return F.char_length(s) - F.char_length(F.replace(s, c, F.lit("")))

    return F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))


#: Multiples of the least possible distance, and what is added, for the bands that are tried before the whole matrix.
BANDS = ((1, 0), (2, 16), (8, 64))


def edit_distance(a: Column, b: Column) -> Column:
    """The exact edit distance, in bands as wide as the differing characters ask for; the matrix of long texts as the last resort."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    gap = F.abs(F.char_length(a) - F.char_length(b))
    inside = F.startswith(a, b) | F.startswith(b, a) | F.endswith(a, b) | F.endswith(b, a)

    def banded(low: Column) -> Column:
        tried = [F.nullif(F.call_function("levenshtein", a, b, low * k + more), F.lit(-1)) for k, more in BANDS]
        return F.coalesce(*tried, F.levenshtein(a, b))

    low = F.get(F.transform(F.array(longest - shared_chars(a, b)), banded), F.lit(0))
    return F.when(inside, gap).when(longest <= 64, F.levenshtein(a, b)).otherwise(low)


def levenshtein(a: Column, b: Column) -> Column:
    """Edit similarity of values, such as names and lines."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def levenshtein_of_texts(a: Column, b: Column) -> Column:
    """The same of whole texts, by edit_distance()."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - edit_distance(a, b) / longest)


def char_count_bound(a: Column, b: Column) -> Column:
    """Characters that both have, each as often as the fewer times, over the longer length; no edit similarity is above it."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(F.equal_null(a, b), 1.0).otherwise(shared_chars(a, b) / longest)


def length_bound(a: Column, b: Column) -> Column:
    """No edit similarity is above the ratio of the lengths."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(F.least(F.char_length(a), F.char_length(b)) / longest)


def confusion(expected: Column, actual: Column, score: Column, threshold: float) -> dict[str, Column]:
    """One of the four counts is 1: a mismatch is a false positive, only a missing value a false negative; null is no value."""
    some, got = F.coalesce(expected, F.lit("")) != "", F.coalesce(actual, F.lit("")) != ""
    tp = some & got & F.coalesce(score >= threshold, F.lit(False))
    return {
        "tp": tp.cast("long"),
        "fp": (~tp & got).cast("long"),
        "fn": (some & ~got).cast("long"),
        "tn": (~some & ~got).cast("long"),
    }


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def is_close(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    """Whether a differs from b by a tolerance at most; two nulls don't."""
    return F.coalesce(F.abs(a - b) <= absolute + relative * F.abs(b), a.isNull() & b.isNull())


def metrics(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall with mismatches in its denominator, and their harmonic mean; 0 where undefined."""
    precision = ratio(tp, tp + fp)
    recall = F.when(tp + fn > 0, ratio(tp, tp + fn + fp)).otherwise(0.0)
    return {"accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall)}
