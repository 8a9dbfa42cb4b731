"""Distributions of per-case scores and list lengths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

_QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
_SLICES = 1 << 16


def quantiles(df: DataFrame, group: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """(group, name…): exact quantiles of each group, interpolated between two ranks.

    Equal values are counted first. Their range is cut into slices, counts per slice tell in which
    ones the wanted ranks lie, and only the values of those are put in order. No group meets in
    one task but by its slices and the values of a slice. Null values are left out.
    """
    number = F.col(value).cast("double")
    counted = df.filter(number.isNotNull()).groupBy(
        F.col(group).alias("_g"), number.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranges = counted.groupBy(F.col("_g").alias("_h")).agg(
        F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_n").alias("_whole"))
    place = F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low")) * _SLICES
    sliced = counted.join(ranges, F.col("_g").eqNullSafe(F.col("_h"))).withColumn(
        "_slice", F.least(F.lit(_SLICES - 1), F.coalesce(F.floor(place), F.lit(0))).cast("int"))
    by_slice = Window.partitionBy("_h").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy("_h", "_slice", "_whole").agg(F.sum("_n").alias("_m")).withColumn(
        "_before", F.coalesce(F.sum("_m").over(by_slice), F.lit(0)))

    def ranks(q: float) -> tuple[Column, Column, Column]:
        """Both ranks, from 0, and how far the quantile lies between them."""
        at = (F.col("_whole") - 1) * F.lit(q)
        return F.floor(at), F.ceil(at), at - F.floor(at)

    def inside(rank: Column, first: str, n: str) -> Column:
        return (rank >= F.col(first)) & (rank < F.col(first) + F.col(n))

    needed = [r for q in wanted.values() for r in ranks(q)[:2]]
    hit = sizes.filter(reduce(Column.__or__, [inside(r, "_before", "_m") for r in needed])).select(
        F.col("_h").alias("_k"), F.col("_slice").alias("_s"), "_before")
    running = Window.partitionBy("_k", "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ordered = sliced.join(hit, F.col("_h").eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_s"))).withColumn(
        "_first", F.col("_before") + F.coalesce(F.sum("_n").over(running), F.lit(0)))

    def picked(rank: Column) -> Column:
        return F.max(F.when(inside(rank, "_first", "_n"), F.col("_v")))

    ends = ordered.groupBy(F.col("_k").alias(group), "_whole").agg(*[
        picked(r).alias(f"_{name}{i}") for name, q in wanted.items() for i, r in enumerate(ranks(q)[:2])])
    return ends.select(group, *[
        (F.col(f"_{name}0") + (F.col(f"_{name}1") - F.col(f"_{name}0")) * ranks(q)[2]).alias(name)
        for name, q in wanted.items()])


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles, maximum per column.

    Quartiles are exact and interpolated, as in a pandas description, by selection
    of ranks (see ``quantiles``); the rest is one pass for all columns.
    """
    measures = []
    for i, c in enumerate(columns):
        measures.append(F.struct(
            F.lit(c).alias("measure"), F.count(c).alias("n"), F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
        ).alias(f"_{i}"))
    rows = df.agg(*measures).select(F.inline(F.array(*[f"_{i}" for i in range(len(columns))])))
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "measure", "_value")
    return rows.join(quantiles(long, "measure", "_value", _QUARTILES), "measure", "left").select(
        "measure", "n", "mean", "std", "min", *_QUARTILES, "max")


def histogram(df: DataFrame, columns: list[str], bins: int = 20, low: float = 0.0,
              high: float = 1.0) -> DataFrame:
    """(measure, bin, n) over equal-width bins; the top edge is in the last bin."""
    long = df.unpivot([], columns, "measure", "value").filter("value is not null")
    bucket = F.least(F.lit(bins), F.width_bucket("value", F.lit(low), F.lit(high), F.lit(bins)))
    return long.groupBy("measure", bucket.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def box_plot(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles and range of a score per group."""
    rows = df.groupBy(group).agg(
        F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    found = quantiles(df, group, value, _QUARTILES).withColumnRenamed(group, "_group")
    return rows.join(found, F.col(group).eqNullSafe(F.col("_group")), "left").select(
        group, "n", "low", *_QUARTILES, "high")


def list_lengths(df: DataFrame, column: str) -> DataFrame:
    """Mean and largest length of an array column."""
    size = F.size(column)
    return df.agg(F.avg(size).alias("mean_length"), F.max(size).cast("long").alias("max_length"))


def mean_of_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """Unweighted mean of per-group values and the number of groups."""
    return df.agg(F.avg(value).alias("mean"), F.count_distinct(group).alias("n_groups"))


def worst_cases(per_case: DataFrame, n: int = 20, score: str = "f1",
                key: str = "case_id") -> DataFrame:
    """The ``n`` lowest scores; ties by key."""
    return per_case.orderBy(score, key).limit(n)


def stacked(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """Union of equally shaped tables with a column telling them apart."""
    return reduce(DataFrame.unionByName,
                  [df.withColumn(name, F.lit(label)) for label, df in parts.items()])
