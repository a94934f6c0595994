"""From scores to confusion counts, and on to metrics by field, micro and macro averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores

COUNTS = ("tp", "fp", "fn")
METRICS = ("accuracy", "precision", "recall", "f1")


def scored(pairs: DataFrame, method: str, score: Column, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """Adds the method, its score and confusion counts to pairs."""
    made = pairs.withColumn("scoring_method", F.lit(method)).withColumn("score", score)
    return made.withColumns(scores.confusion(F.col(expected), F.col(actual), F.col("score"), scores.THRESHOLDS[method]))


def _keys(df: DataFrame) -> list[str]:
    """What summaries are grouped by: the scoring type, where there is one, and the method."""
    return [c for c in ("scoring_type", "scoring_method") if c in df.columns]


def by_field(scored_pairs: DataFrame) -> DataFrame:
    """Counts of each (scoring_type, scoring_method, field_name), true negatives from the group's total over all its fields."""
    keys = _keys(scored_pairs)
    summed = scored_pairs.groupBy(*keys, "field_name").agg(*(F.sum(c).alias(c) for c in COUNTS))
    total = F.sum(F.col("tp") + F.col("fn") + 2 * F.col("fp")).over(Window.partitionBy(*keys))
    return summed.withColumn("tn", total - F.col("tp") - F.col("fp") - F.col("fn"))


def with_metrics(counts: DataFrame) -> DataFrame:
    return counts.withColumns(scores.metrics(*(F.col(c) for c in (*COUNTS, "tn"))))


def summary(scored_pairs: DataFrame, field_names: Sequence[str] | None = None) -> DataFrame:
    """Rows by field, and a micro (of summed counts) and a macro (mean of metrics) row of each scoring type and method.

    Only the fields of field_names count; a group without any of them still has its micro and macro rows, of zeros.
    Counts are summed by field in one pass; grouping sets over that small table give both averages beside its rows.
    """
    keys = _keys(scored_pairs)
    is_wanted = F.lit(True) if field_names is None else F.col("field_name").isin(*field_names)
    summed = scored_pairs.groupBy(*keys, "field_name").agg(*(F.sum(c).alias(c) for c in COUNTS)).withColumn("wanted", is_wanted)
    total = F.sum(F.when(F.col("wanted"), F.col("tp") + F.col("fn") + 2 * F.col("fp"))).over(Window.partitionBy(*keys))
    fields = with_metrics(summed.withColumn("tn", total - F.col("tp") - F.col("fp") - F.col("fn")))
    of = lambda f, c: F.coalesce(f(F.when(F.col("wanted"), F.col(c))), F.lit(0)).alias(c)
    both = [of(F.sum, c) for c in (*COUNTS, "tn")], [of(F.avg, m) for m in METRICS]
    sets = fields.groupingSets([[*keys, "field_name"], keys], *keys, "field_name").agg(F.grouping("field_name").alias("over_all"), F.coalesce(F.max("wanted"), F.lit(False)).alias("wanted"), *both[0], *both[1])
    counts, means = F.struct(*(F.col(c) for c in (*COUNTS, "tn"))), F.struct(*(F.col(m) for m in METRICS))
    micro = F.struct(*(F.col(c) for c in (*COUNTS, "tn")), *(c.alias(m) for m, c in scores.metrics(*(F.col(c) for c in (*COUNTS, "tn"))).items()))

    def row(name: str, has_counts: bool, metrics: Column) -> Column:
        held = [(counts[c] if has_counts else F.lit(None).cast("long")).alias(c) for c in (*COUNTS, "tn")]
        return F.struct(F.lit(name).alias("stats_name"), *held, *(metrics[m].alias(m) for m in METRICS))

    each = F.when(F.col("over_all") == 0, F.array(row("by-field", True, means))).otherwise(F.array(row("micro", True, micro), row("macro", False, means)))
    return sets.where((F.col("over_all") == 1) | F.col("wanted")).select(*keys, "field_name", F.explode(each).alias("s")).select(*keys, "field_name", "s.*")


def state(scored_pairs: DataFrame) -> DataFrame:
    """The counts of a batch of scored pairs by type, method and field: what a summary needs of it, to be stored beside other batches'."""
    return scored_pairs.groupBy(*_keys(scored_pairs), "field_name").agg(*(F.sum(c).alias(c) for c in COUNTS))


def merged(*states: DataFrame) -> DataFrame:
    """One state of several; summary() of it is that of all their pairs, none of which is scored again."""
    whole = states[0]
    for s in states[1:]:
        whole = whole.unionByName(s)
    return state(whole)


def in_order(summary_rows: DataFrame, field_names: Sequence[str]) -> DataFrame:
    """The rows of a summary by group, in it by the order of field_names, then micro, then macro."""
    place = F.array_position(F.array(*map(F.lit, field_names)), F.col("field_name"))
    rank = F.when(F.col("stats_name") == "micro", 1).when(F.col("stats_name") == "macro", 2).otherwise(0)
    return summary_rows.orderBy(*_keys(summary_rows), rank, place)
