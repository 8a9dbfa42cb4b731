"""One-to-one matching of year intervals with a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline import registry as R
from plumbline.functions import text as T
from plumbline.operators.scores import precision_recall_f1

SPELLS_TYPE = "array<struct<start_year:int,end_year:int>>"


def compatible(a_start: Column, a_end: Column, b_start: Column, b_end: Column,
               tolerance: int) -> Column:
    """Starts and ends within ``tolerance``; an unknown year fits anything.

    The first spell needs at least one year.
    """

    def close(x: Column, y: Column) -> Column:
        return x.isNull() | y.isNull() | (F.abs(x - y) <= tolerance)

    return (a_start.isNotNull() | a_end.isNotNull()) & close(a_start, b_start) & close(a_end, b_end)


def _years_only(spells: Column) -> Column:
    return F.transform(
        spells,
        lambda s: F.struct(s["start_year"].cast("int").alias("start_year"),
                           s["end_year"].cast("int").alias("end_year")),
    )


def n_matched(predicted: Column, gold: Column, tolerance: int) -> Column:
    """Predictions in order each take the first free compatible gold spell.

    A fold over the predicted array whose state is the list of free gold spells.
    """
    free = _years_only(gold)

    def take(state: Column, spell: Column) -> Column:
        fits = F.transform(
            state,
            lambda g: compatible(spell["start_year"], spell["end_year"],
                                 g["start_year"], g["end_year"], tolerance))
        position = F.array_position(fits, True).cast("int")
        # One-element transform binds the position to a name.
        return F.transform(
            F.array(position),
            lambda i: F.when(
                i > 0, F.concat(F.slice(state, F.lit(1), i - 1),
                                F.slice(state, i + 1, F.size(state) - i))
            ).otherwise(state),
        )[0]

    left = F.aggregate(_years_only(predicted), free, take)
    return F.size(free) - F.size(left)


def score_lists(predictions: DataFrame, gold: DataFrame, predicted: str = "predicted",
                relevant: str = "gold", key: str = R.CASE_ID,
                tolerance: int = R.TOLERANCE_YEARS) -> DataFrame:
    """Per-case scores for one list of spells per row on each side.

    Every prediction gives a row; ``skipped`` marks a null list or a case
    without gold.
    """
    found = predictions.select(F.col(key).cast("string").alias(key), F.col(predicted).alias("_p"))
    wanted = gold.select(F.col(key).cast("string").alias(key), F.col(relevant).alias("_g"))
    joined = found.join(wanted, key, "left")
    both = F.col("_p").isNotNull() & F.col("_g").isNotNull()
    return _scored(joined.select(
        key,
        F.coalesce(F.size("_p"), F.lit(0)).cast("long").alias("n_predicted"),
        F.coalesce(F.size("_g"), F.lit(0)).cast("long").alias("n_gold"),
        F.coalesce(F.when(both, n_matched(F.col("_p"), F.col("_g"), tolerance)), F.lit(0))
        .cast("long").alias("n_matched"),
        (~both).alias("skipped"),
    ), key)


def _scored(df: DataFrame, key: str) -> DataFrame:
    p, r, f = precision_recall_f1(F.col("n_predicted"), F.col("n_gold"), F.col("n_matched"))
    return df.select(
        key, T.metric(p).alias("precision"), T.metric(r).alias("recall"),
        T.metric(f).alias("f1"), "n_predicted", "n_gold", "n_matched", "skipped")


def score_rows(predictions: DataFrame, gold: DataFrame, order: str, key: str = R.CASE_ID,
               tolerance: int = R.TOLERANCE_YEARS) -> DataFrame:
    """The same for one predicted spell per row (key, start_year, end_year, order).

    A key may have any number of predicted rows. Two predictions with the same
    years fit the same gold spells, and once one of them finds nothing free no
    later one does, so of each (key, years) only as many rows as the key has gold
    spells can match; and a row
    that fits no gold spell at all never matches. Those two rules bound the list
    folded per key without changing the result. All rows count as predicted.
    """
    rows = predictions.select(
        F.col(key).cast("string").alias(key), F.col("start_year").cast("int"),
        F.col("end_year").cast("int"), F.col(order).alias("_o"))
    totals = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_predicted"))
    early = Window.partitionBy(key, "start_year", "end_year").orderBy("_o")
    lists = gold.select(F.col(key).cast("string").alias(key), F.col("gold").alias("_g"))
    sizes = lists.select(key, F.size("_g").alias("_n"))
    kept = (
        rows.join(sizes, key).withColumn("_r", F.row_number().over(early))
        .filter(F.col("_r") <= F.col("_n")).drop("_r", "_n")
    )
    useful = kept.join(lists, key).filter(F.exists(
        "_g", lambda g: compatible(F.col("start_year"), F.col("end_year"),
                                   g["start_year"], g["end_year"], tolerance)))
    folded = useful.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_o", "start_year", "end_year"))).alias("_p"))
    joined = totals.join(lists, key, "left").join(folded, key, "left")
    nothing = F.array().cast(SPELLS_TYPE)
    matched = n_matched(F.coalesce(_years_only(F.col("_p")), nothing), F.col("_g"), tolerance)
    return _scored(joined.select(
        key, "n_predicted",
        F.coalesce(F.size("_g"), F.lit(0)).cast("long").alias("n_gold"),
        F.coalesce(F.when(F.col("_p").isNotNull(), matched), F.lit(0)).cast("long")
        .alias("n_matched"),
        F.col("_g").isNull().alias("skipped"),
    ), key)


def compatible_pairs(predictions: DataFrame, gold: DataFrame, key: str = R.CASE_ID,
                     tolerance: int = R.TOLERANCE_YEARS) -> DataFrame:
    """How many gold spells each predicted year pair fits, per key.

    Both sides are reduced to distinct year pairs with counts before they
    meet, so a key with many rows gives only as many pairs as it has years.
    """

    def years(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(
            F.col(key).cast("string").alias(key),
            F.col("start_year").alias(f"{side}_start"), F.col("end_year").alias(f"{side}_end"),
        ).agg(F.count(F.lit(1)).alias(f"n_{side}"))

    found, wanted = years(predictions, "pred"), years(gold, "gold")
    fits = compatible(F.col("pred_start"), F.col("pred_end"),
                      F.col("gold_start"), F.col("gold_end"), tolerance)
    return found.join(wanted, key).filter(fits)


