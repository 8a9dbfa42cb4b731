"""Retrieved sets against gold sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import registry as R
from plumbline.functions import text as T
from plumbline.operators.scores import precision_recall_f1

_COUNTS = ("n_retrieved", "n_gold", "n_correct")


def url_set(df: DataFrame, column: str) -> Column:
    """Set of URLs from an array column or a pipe-separated text column."""
    kind = df.schema[column].dataType.typeName()
    return T.text_set(F.col(column)) if kind == "array" else T.pipe_set(F.col(column))


def _scored(df: DataFrame, key: str) -> DataFrame:
    p, r, f = precision_recall_f1(*[F.col(c) for c in _COUNTS])
    return df.select(
        key, T.metric(p).alias("precision"), T.metric(r).alias("recall"),
        T.metric(f).alias("f1"), *_COUNTS, "skipped",
    )


def score_arrays(predictions: DataFrame, gold: DataFrame, key: str = R.CASE_ID,
                 retrieved: str = R.URLS_RETRIEVED, relevant: str = R.URLS_GOLD) -> DataFrame:
    """Per-case scores where each side holds one set per row.

    Every prediction gives a row; ``skipped`` marks those without gold URLs.
    Gold cases without a prediction do not appear.
    """
    found = predictions.select(
        F.col(key).cast("string").alias(key), url_set(predictions, retrieved).alias("_p"))
    wanted = gold.select(
        F.col(key).cast("string").alias(key), url_set(gold, relevant).alias("_g")
    ).filter(F.size("_g") > 0)
    joined = found.join(wanted, key, "left")
    return _scored(
        joined.select(
            key,
            F.size("_p").cast("long").alias("n_retrieved"),
            F.coalesce(F.size("_g"), F.lit(0)).cast("long").alias("n_gold"),
            F.coalesce(F.size(F.array_intersect("_p", "_g")), F.lit(0)).cast("long")
            .alias("n_correct"),
            F.col("_g").isNull().alias("skipped"),
        ), key)


def score_rows(predictions: DataFrame, gold: DataFrame, key: str, item: str,
               cases: DataFrame | None = None) -> DataFrame:
    """The same where each side holds one row per item.

    No set is ever collected: items are matched by ``(key, item)`` and then
    counted per key with map-side sums, so a key with very many items is spread
    over all tasks. ``cases`` adds predicted keys that retrieved nothing.
    """

    def side(df: DataFrame, is_found: int) -> DataFrame:
        return df.select(
            F.col(key).cast("string").alias(key), F.col(item).cast("string").alias("_item"),
            F.lit(is_found).alias("_p"), F.lit(1 - is_found).alias("_g"),
            F.lit(is_found).alias("_case"),
        )

    tagged = side(predictions, 1).unionByName(side(gold, 0))
    items = tagged.groupBy(key, "_item").agg(
        F.max("_p").alias("_p"), F.max("_g").alias("_g"), F.max("_case").alias("_case"))
    if cases is not None:
        items = items.unionByName(cases.select(
            F.col(key).cast("string").alias(key), F.lit(None).cast("string").alias("_item"),
            F.lit(0).alias("_p"), F.lit(0).alias("_g"), F.lit(1).alias("_case")))
    counted = items.groupBy(key).agg(
        F.sum("_p").alias("n_retrieved"), F.sum("_g").alias("n_gold"),
        F.sum(F.col("_p") * F.col("_g")).alias("n_correct"), F.max("_case").alias("_case"))
    return _scored(
        counted.filter("_case = 1").withColumn("skipped", F.col("n_gold") == 0), key)


def macro(per_case: DataFrame) -> DataFrame:
    """Mean of the rounded per-case scores; zeros where nothing was scored."""
    scored = ~F.col("skipped")
    return per_case.agg(
        *[T.metric(F.coalesce(F.avg(F.when(scored, F.col(c))), F.lit(0.0))).alias(c)
          for c in ("precision", "recall", "f1")],
        F.count_if(scored).alias("n_evaluated"),
        F.count_if(F.col("skipped")).alias("n_skipped"),
    )
