"""Shared shape of metric tables: one row per group plus one overall row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OVERALL, GROUP = "overall", "group"


def with_overall(sums: DataFrame, group: str | None) -> DataFrame:
    """Add the overall row to additive per-group sums.

    The overall row is summed from the per-group rows, so the input is
    aggregated once; the shared shuffle is reused by the planner. It exists
    even where there is no group at all.
    """
    measures = [c for c in sums.columns if c != group]
    # The only zero-row case is the empty input, where every count is 0.
    totals = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(sums.schema[c].dataType).alias(c)
                        for c in measures])
    overall = totals.select(
        F.lit(OVERALL).alias("level"), F.lit(None).cast("string").alias("slice"), *measures)
    if group is None:
        return overall
    per_group = sums.select(
        F.lit(GROUP).alias("level"), F.col(group).cast("string").alias("slice"), *measures)
    return overall.unionByName(per_group)


def f1_of(precision: Column, recall: Column) -> Column:
    """Harmonic mean; zero where both are zero."""
    return F.coalesce(
        F.try_divide(F.lit(2.0) * precision * recall, precision + recall), F.lit(0.0))


def precision_recall_f1(n_found: Column, n_gold: Column, n_right: Column) -> tuple[Column, ...]:
    """Set scores: both sides empty count as perfect, one empty side as zero."""
    both_empty = (n_found == 0) & (n_gold == 0)
    precision = F.coalesce(F.try_divide(n_right.cast("double"), n_found), F.lit(0.0))
    recall = F.coalesce(F.try_divide(n_right.cast("double"), n_gold), F.lit(0.0))
    return tuple(
        F.when(both_empty, F.lit(1.0)).otherwise(score)
        for score in (precision, recall, f1_of(precision, recall))
    )
