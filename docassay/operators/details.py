"""Flat rows of scores: one for each sub-score for the details, one for each statistic for the summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of both tables, in order.
DETAILS = ("prediction_file", "target_file", "field_name", "evaluation_method", "scoring_type", "tp", "fp", "fn", "tn", "expected", "actual", "expected_context", "actual_context")
SUMMARY = ("document_count", "evaluation_method", "scoring_type", "field_name", "stats_name", "tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def flatten_details(scored: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """A row for each of `sub_scores`; for `match_score` if they are null; none if they are empty.

    Both hold structs with tp, fp, fn, tn, expected and actual, and may hold the contexts. Files become their names.
    """
    rows = scored if fields is None else scored.where(F.col("field_name").isin(*fields))
    each = rows.withColumn("s", F.explode(F.coalesce("sub_scores", F.array("match_score"))))
    held = set(each.schema["s"].dataType.names)
    values = [F.col(f"s.{c}") if c in held else F.lit(None).cast("string").alias(c) for c in DETAILS[5:]]
    return each.select(basename(F.col("prediction_file")).alias("prediction_file"), basename(F.col("target_file")).alias("target_file"), "field_name", F.col("scoring_method").alias("evaluation_method"), "scoring_type", *values)


def flatten_summary(summary: DataFrame, document_count: int, scoring_type: str | None = None) -> DataFrame:
    """The summary's rows under the columns of its table."""
    made = summary.withColumnsRenamed({"scoring_method": "evaluation_method"}).withColumn("document_count", F.lit(document_count).cast("long"))
    if "scoring_type" not in made.columns:
        made = made.withColumn("scoring_type", F.lit(scoring_type))
    return made.select(*SUMMARY)


def full_outer_compare(one: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Details of two tools beside each other; the second's other columns end in _other."""
    renamed = other.withColumnsRenamed({c: f"{c}_other" for c in other.columns if c not in keys})
    return one.join(renamed, list(keys), "full_outer")


def win_loss(compared: DataFrame, by: str) -> DataFrame:
    """For each `by`: matches of the other only, of the first only, and of neither where something was expected."""
    mine, theirs, nothing = (F.coalesce(F.col(c), F.lit(0)) for c in ("tp", "tp_other", "tn"))
    return compared.groupBy(by).agg(
        F.count_if((mine == 0) & (theirs == 1)).alias("improved"),
        F.count_if((mine == 1) & (theirs == 0)).alias("worse"),
        F.count_if((nothing == 0) & (mine == 0) & (theirs == 0)).alias("both_wrong"),
    )


def tool_pairs(details: DataFrame, keys: Sequence[str], tool: str = "tool") -> DataFrame:
    """Each two tools' details side by side, the lesser name first; the second's other columns end in _other."""
    own = [c for c in details.columns if c not in keys]
    other = details.withColumnsRenamed({c: f"{c}_other" for c in own})
    return details.join(other, list(keys)).where(F.col(tool) < F.col(f"{tool}_other"))


def first_per_group(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """(by, value): the value of each group's first row by `order`."""
    return rows.groupBy(by).agg(F.min_by(value, order).alias(value))
