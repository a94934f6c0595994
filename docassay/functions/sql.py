"""The library's functions for SQL: temporary functions of a session; and scoring methods by functions of Spark."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import IGNORED

_SPACE = "regexp_replace({}, '(?U)\\\\s+', ' ')"
_SOFT = "translate({}, " + "concat(" + ", ".join(f"chr({ord(c)})" if ord(c) < 256 else f"decode(unhex('{ord(c):08x}'), 'UTF-32')" for c in IGNORED) + "), '')"
_LONGEST = "greatest(char_length(a), char_length(b))"
#: Name, arguments, result, body. Scores are from 0 to 1; a null is no value.
FUNCTIONS = (
    ("normalize_whitespace", "s STRING", "STRING", _SPACE.format("s")),
    ("strip_punctuation", "s STRING", "STRING", _SOFT.format("s")),
    ("score_exact", "a STRING, b STRING", "DOUBLE", "CAST(a <=> b AS DOUBLE)"),
    ("score_soft", "a STRING, b STRING", "DOUBLE", f"CAST({_SOFT.format('a')} <=> {_SOFT.format('b')} AS DOUBLE)"),
    ("score_levenshtein", "a STRING, b STRING", "DOUBLE", f"CASE WHEN {_LONGEST} = 0 THEN 1D ELSE 1 - levenshtein(a, b) / CAST({_LONGEST} AS DOUBLE) END"),
    ("match_kind", "expected STRING, actual STRING, score DOUBLE, threshold DOUBLE", "STRING", "CASE WHEN coalesce(expected, '') <> '' AND coalesce(actual, '') <> '' AND coalesce(score >= threshold, false) THEN 'tp' WHEN coalesce(actual, '') <> '' THEN 'fp' WHEN coalesce(expected, '') <> '' THEN 'fn' ELSE 'tn' END"),
    ("precision_of", "tp BIGINT, fp BIGINT", "DOUBLE", "coalesce(try_divide(CAST(tp AS DOUBLE), CAST(tp + fp AS DOUBLE)), 0D)"),
    ("recall_of", "tp BIGINT, fp BIGINT, fn BIGINT", "DOUBLE", "CASE WHEN tp + fn > 0 THEN coalesce(try_divide(CAST(tp AS DOUBLE), CAST(tp + fn + fp AS DOUBLE)), 0D) ELSE 0D END"),
)


def define(spark: SparkSession, name: str, arguments: str, result: str, body: str) -> None:
    """A temporary function of the session; it replaces one of that name."""
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"not a name for a function: {name!r}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")


def register(spark: SparkSession) -> list[str]:
    """Defines all FUNCTIONS; their names."""
    for f in FUNCTIONS:
        define(spark, *f)
    return [f[0] for f in FUNCTIONS]


def measure(name: str):
    """A measure of two columns by a function that Spark evaluates itself, built in or registered from Java, for a method of one's own.

    Values are measured in lambdas, where Spark has no functions that are defined in SQL.
    """

    def of(a: Column, b: Column) -> Column:
        return F.call_function(name, a, b).cast("double")

    return of
