"""Single-valued fields: alignment, accuracy, error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import registry as R
from plumbline.functions import text as T
from plumbline.operators.cleaning import DropReport
from plumbline.operators.scores import with_overall


def last_rows(predictions: DataFrame, key: str, columns: list[str], order: str | None = None,
              report: DropReport | None = None) -> DataFrame:
    """One row per key with all ``columns`` of its last prediction by ``order``.

    Rows of a table have no order of their own. Without an order column a key may have several
    rows only if they are equal; different ones stop the job, as any choice would be a guess.
    ``report`` counts the predictions that a later one replaces, under ``replaced``.
    """
    row = F.struct(*[F.col(c) for c in columns])
    if order:
        picked = F.max_by(row, F.col(order))
    else:
        several = F.lit(f"several predictions for one {key}; name the column that orders them: ")
        picked = F.when(F.min(row) == F.max(row), F.max(row)).otherwise(
            F.raise_error(F.concat(several, F.coalesce(F.first(F.col(key).cast("string")), F.lit("")))))
    found = predictions.groupBy(F.col(key).cast("string").alias(key)).agg(
        picked.alias("_row"), (F.count(F.lit(1)) - 1).alias("_earlier"))
    if report:
        found = report.watch_sum(found, "replaced", F.col("_earlier"))
    return found.select(key, *[F.col(f"_row.{c}").alias(c) for c in columns])


def last_prediction(predictions: DataFrame, key: str, value: str, order: str | None = None,
                    report: DropReport | None = None) -> DataFrame:
    """(key, pred): the last prediction per key; see ``last_rows``."""
    return last_rows(predictions, key, [value], order, report).withColumnRenamed(value, "pred")


def align(test: DataFrame, predictions: DataFrame, variable: str, key: str = R.CASE_ID,
          group: str | None = R.COUNTRY, order: str | None = None,
          report: DropReport | None = None) -> DataFrame:
    """Every test case with its prediction: (key, slice, gold, pred, has_pred)."""
    has_group = group is not None and group in test.columns
    country = F.col(group).cast("string") if has_group else F.lit(None).cast("string")
    gold = test.select(
        F.col(key).cast("string").alias(key),
        F.when(country.isNull() | (country == ""), F.lit(R.UNKNOWN_COUNTRY))
        .otherwise(country).alias("slice"),
        F.col(variable).alias("gold"),
    )
    found = last_prediction(predictions, key, variable, order, report).withColumn(
        "has_pred", F.lit(True))
    return gold.join(found, key, "left").withColumn("has_pred", F.coalesce("has_pred", F.lit(False)))


def accuracy(aligned: DataFrame, group: str | None = None, similarity: bool | Column = True,
             errors: bool = False) -> DataFrame:
    """Exact-match accuracy with missing values as a class of their own.

    One row per group and one overall. Rows are counted per distinct value pair
    first; a pair then has one row per group, and these are put beside it, so that
    the similarity function sees it once. ``similarity`` may be a condition on the
    group column that says where it is wanted. ``errors`` adds the columns of
    ``mean_error`` from the same counts. Rows with a false ``has_pred`` only count
    as missing.
    """
    groups = [group] if group else []
    values = aligned.select(
        *groups, _has_prediction(aligned).alias("_has"),
        F.col("gold").cast("string").alias("_g"), F.col("pred").cast("string").alias("_p"))
    pairs = values.groupBy(*groups, "_has", "_g", "_p").agg(F.count(F.lit(1)).alias("_n"))
    gold, pred = T.normalise_value(F.col("_g")), T.normalise_value(F.col("_p"))
    usable = (gold != R.NA_SENTINEL) & (pred != R.NA_SENTINEL)
    if similarity is False:
        pairs = pairs.withColumn("_sim", F.lit(None).cast("double"))
    else:
        wanted = F.lit(True) if similarity is True else similarity
        place = F.struct(*groups, "_has", "_n", wanted.alias("_wanted"))
        pairs = pairs.groupBy("_g", "_p").agg(F.collect_list(place).alias("_places")).withColumn(
            "_once", F.when(usable & F.exists("_places", lambda x: x["_wanted"]),
                            T.char_similarity(F.col("_p"), F.col("_g")))
        ).select("_g", "_p", "_once", F.inline("_places")).withColumn(
            "_sim", F.when(F.col("_wanted"), F.col("_once")))
    error = F.abs(T.to_number(F.col("_p")) - T.to_number(F.col("_g"))) if errors else F.lit(None)
    flags = pairs.select(
        *groups, "_has", "_n", (gold == pred).alias("_eq"), "_sim",
        (gold == R.NA_SENTINEL).alias("_gna"), (pred == R.NA_SENTINEL).alias("_pna"),
        F.when(usable, error).cast("double").alias("_e"))
    has = F.col("_has")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(has & condition, F.col("_n"))), F.lit(0))

    eq, gna, pna = F.col("_eq"), F.col("_gna"), F.col("_pna")
    sums = flags.groupBy(*groups).agg(
        total(F.lit(True)).alias("n_total"),
        total(eq).alias("n_correct"),
        total(~pna).alias("n_predicted"),
        total(eq & ~pna).alias("_n_predicted_correct"),
        total(eq & gna).alias("n_na_correct"),
        total(gna).alias("n_na_gold"),
        total(pna).alias("n_na_pred"),
        total(~gna & ~pna).alias("_n_sim"),
        F.coalesce(F.sum(F.when(has, F.col("_sim") * F.col("_n"))), F.lit(0.0)).alias("_sim_sum"),
        F.coalesce(F.sum(F.when(~has, F.col("_n"))), F.lit(0)).alias("n_missing"),
        total(F.col("_e").isNotNull()).alias("n_with_error"),
        total(F.col("_e") == 0).alias("_exact"),
        F.coalesce(F.sum(F.col("_e") * F.col("_n")), F.lit(0.0)).alias("_error"),
    )
    scored = with_overall(sums, group)
    extra = [
        T.metric(T.ratio(F.col("_error"), F.col("n_with_error"))).alias("mae"),
        T.metric(T.ratio(F.col("_exact"), F.col("n_with_error"))).alias("exact"), "n_with_error",
    ] if errors else []
    sim = F.lit(None).cast("double") if similarity is False else F.col("_sim_sum")
    return scored.select(
        "level", "slice",
        T.metric(T.ratio(F.col("n_correct"), F.col("n_total"))).alias("accuracy"),
        T.metric(T.ratio(F.col("_n_predicted_correct"), F.col("n_predicted")))
        .alias("accuracy_when_predicted"),
        T.metric(T.ratio(sim, F.col("_n_sim"))).alias("char_similarity"),
        T.metric(T.ratio(sim, F.col("n_predicted"))).alias("char_similarity_when_predicted"),
        "n_correct", "n_total", "n_predicted", "n_na_correct", "n_na_gold", "n_na_pred",
        "n_missing", *extra,
    )


def _has_prediction(aligned: DataFrame) -> Column:
    return F.col("has_pred") if "has_pred" in aligned.columns else F.lit(True)


def similarity_as_headline(scores: DataFrame) -> DataFrame:
    """Free-text places are judged by similarity instead of exact match."""
    return scores.withColumn("accuracy", F.col("char_similarity")).withColumn(
        "accuracy_when_predicted", F.col("char_similarity_when_predicted"))


def mean_error(aligned: DataFrame, group: str | None = None) -> DataFrame:
    """Mean absolute error and exact rate; unusable pairs are counted, not scored."""
    groups = [group] if group else []
    gold, pred = F.col("gold"), F.col("pred")
    usable = (T.normalise_value(gold) != R.NA_SENTINEL) & (T.normalise_value(pred) != R.NA_SENTINEL)
    error = F.when(usable, F.abs(T.to_number(pred) - T.to_number(gold)))
    has = F.col("_has")
    rows = aligned.select(*groups, error.alias("_e"), _has_prediction(aligned).alias("_has"))
    sums = rows.groupBy(*groups).agg(
        F.count("_e").alias("n_total"),
        F.count_if(has & F.col("_e").isNull()).alias("n_skipped"),
        F.count_if(~has).alias("n_missing"),
        F.count_if(F.col("_e") == 0).alias("_exact"),
        F.coalesce(F.sum("_e"), F.lit(0.0)).alias("_error"),
    )
    return with_overall(sums, group).select(
        "level", "slice",
        T.metric(T.ratio(F.col("_error"), F.col("n_total"))).alias("mae"),
        T.metric(T.ratio(F.col("_exact"), F.col("n_total"))).alias("accuracy"),
        "n_total", "n_skipped", "n_missing",
    )


def long_values(df: DataFrame, variables: list[str], key: str = R.CASE_ID,
                keep: tuple[str, ...] = (), name: str = "value") -> DataFrame:
    """Columns to rows: (key, keep…, variable, value as text)."""
    texts = df.select(
        F.col(key).cast("string").alias(key), *keep,
        *[F.col(v).cast("string").alias(v) for v in variables])
    return texts.unpivot([key, *keep], variables, "variable", name)


def mismatch_report(predictions: DataFrame, gold: DataFrame, variables: list[str],
                    key: str = R.CASE_ID, mismatches_only: bool = True) -> DataFrame:
    """Predicted and gold value side by side; rows with any difference.

    Values are compared as lower-cased, trimmed text; null equals null.
    """
    left = predictions.select(
        F.col(key).cast("string").alias(key), *[F.col(v).alias(f"{v}_pred") for v in variables])
    right = gold.select(
        F.col(key).cast("string").alias(key), *[F.col(v).alias(f"{v}_gold") for v in variables])
    merged = left.join(right, key).select(
        key, *[c for v in variables for c in (f"{v}_pred", f"{v}_gold")])
    if not mismatches_only:
        return merged

    def shown(column: str) -> Column:
        return F.lower(T.strip(F.coalesce(F.col(column).cast("string"), F.lit("none"))))

    differs = [shown(f"{v}_pred") != shown(f"{v}_gold") for v in variables]
    return merged.filter(reduce(Column.__or__, differs))
