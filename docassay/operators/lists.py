"""Scoring of lists: in order, out of order, as sets; exact matching needs no pairing of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partial_list_counts(expected: Column, actual: Column) -> Column:
    """Items by place, the shorter list padded with empty ones: tp, fp, fn, tn summed over places, and the mean score."""
    none = F.array().cast("array<string>")
    pairs = F.zip_with(F.coalesce(expected, none), F.coalesce(actual, none), lambda a, b: F.struct(F.coalesce(a, F.lit("")).alias("a"), F.coalesce(b, F.lit("")).alias("b")))

    def count(test) -> Column:
        return F.size(F.filter(pairs, test)).cast("long")

    same = count(lambda p: p["a"] == p["b"])
    n = F.size(pairs)
    return F.struct(
        count(lambda p: (p["a"] != "") & (p["a"] == p["b"])).alias("tp"),
        count(lambda p: (p["b"] != "") & (p["a"] != p["b"])).alias("fp"),
        count(lambda p: (p["a"] != "") & (p["b"] == "")).alias("fn"),
        count(lambda p: (p["a"] == "") & (p["b"] == "")).alias("tn"),
        F.when(n == 0, 1.0).otherwise(same / n).alias("score"),
    )


def list_score(expected: Column, actual: Column) -> Column:
    """1 if the lists have the same items in order, else 0; a null list is empty."""
    none = F.array().cast("array<string>")
    return (F.coalesce(expected, none) == F.coalesce(actual, none)).cast("double")


def _sums(items: DataFrame) -> DataFrame:
    """(key, tp, e, a): matches of equal items and how many items both sides have; rows without item only name a key."""
    each = items.groupBy("key", "item").agg(F.count_if((F.col("side") == "expected") & F.col("item").isNotNull()).alias("e"), F.count_if((F.col("side") == "actual") & F.col("item").isNotNull()).alias("a"))
    return each.groupBy("key").agg(F.sum(F.least("e", "a")).alias("tp"), F.sum("e").alias("e"), F.sum("a").alias("a"))


def unordered_counts(items: DataFrame) -> DataFrame:
    """(key, tp, fp, fn, score) from (key, side, item): matches of equal items, each used once.

    The smaller of an item's numbers on both sides are matches; what is left of the actual items is false positive,
    and expected items beyond the actual ones' number are missing. Without items the score is 1: give such a key a row
    whose item is null.
    """
    longer = F.greatest("e", "a")
    return _sums(items).select("key", "tp", (F.col("a") - F.col("tp")).alias("fp"), F.greatest(F.col("e") - F.col("a"), F.lit(0).cast("long")).alias("fn"), F.when(longer == 0, 1.0).otherwise(F.col("tp") / F.nullif(longer, F.lit(0).cast("long"))).alias("score"))


def unordered_whole(items: DataFrame, none: Column | None = None) -> DataFrame:
    """(key, score) from (key, side, item): share of matches of equal items if both sides have as many, else 0; without items `none`, or 1."""
    return _sums(items).select("key", F.when(F.col("e") != F.col("a"), 0.0).when(F.col("e") == 0, F.lit(1.0) if none is None else none).otherwise(F.col("tp") / F.nullif("e", F.lit(0).cast("long"))).alias("score"))
