"""Multi-class scores from a confusion table.

Rows are counted once into ``(group, gold, pred, n)``; everything else works on
that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline import registry as R
from plumbline.functions import text as T, vectors as V
from plumbline.operators.cleaning import DropReport, semi_by_id
from plumbline.operators.scores import GROUP, OVERALL

# Ranges into which a vocabulary is cut before it is numbered.
_LABEL_CUTS = 255


def align(predictions: DataFrame, gold: DataFrame, test: DataFrame, gold_col: str,
          indexed: bool = True, key: str = R.CASE_ID, index: str = R.SPELL_INDEX,
          predicted: str = R.PREDICTED_CODE, group: str | None = None,
          report: DropReport | None = None) -> DataFrame:
    """Predictions of test cases with their gold code: (key…, pred, gold).

    Rows of other cases are left out; ``report`` counts them under ``outside_test``. With ``group`` the case's value of that
    column of ``test`` is added as ``slice``. ``gold`` is null where no non-empty gold
    code exists; such rows count as skipped. Repeated predictions all stay.
    """
    keys = [key, index] if indexed else [key]

    def keyed(df: DataFrame, value: str, name: str) -> DataFrame:
        columns = [F.col(key).cast("string").alias(key)]
        if indexed:
            columns.append(F.col(index).cast("int").alias(index))
        return df.select(*columns, T.strip(F.coalesce(F.col(value).cast("string"), F.lit("")))
                         .alias(name))

    codes = keyed(gold, gold_col, "gold").filter(F.col("gold") != "")
    # A key repeated in gold keeps one code; cleaned silver has none repeated.
    unique = codes.groupBy(*keys).agg(F.max("gold").alias("gold"))
    found = keyed(predictions, predicted, "pred")
    if report is not None:
        found = semi_by_id(found, test, key, report, "outside_test")
    if group is None:
        return semi_by_id(found, test, key).join(unique, keys, "left")
    # One inner join keeps the test cases and looks their group up.
    cases = test.groupBy(F.col(key).cast("string").alias(key)).agg(
        F.max(T.strip(F.col(group))).alias("slice"))
    return found.join(cases, key).join(unique, keys, "left")


def attach_group(df: DataFrame, lookup: DataFrame, key: str = R.CASE_ID,
                 group: str = R.COUNTRY, default: str = R.UNKNOWN_COUNTRY,
                 name: str = "slice") -> DataFrame:
    """Look a group up by key; ``default`` where it is not known."""
    mapping = lookup.select(
        F.col(key).cast("string").alias("_key"), T.strip(F.col(group)).alias("_group"))
    mapping = mapping.groupBy("_key").agg(F.max("_group").alias("_group"))
    return (
        df.join(mapping, F.col(key).cast("string") == F.col("_key"), "left")
        .withColumn(name, F.coalesce("_group", F.lit(default))).drop("_key", "_group")
    )


def confusion(aligned: DataFrame, group: str | None = None) -> DataFrame:
    """(slice, gold, pred, n); ``slice`` is null without a group."""
    part = F.col(group).cast("string") if group else F.lit(None).cast("string")
    return aligned.groupBy(part.alias("slice"), "gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def scored_pairs(counts: DataFrame) -> DataFrame:
    """Pairs with a gold code; the others are skipped predictions."""
    return counts.filter(F.col("gold").isNotNull())


def class_scores(counts: DataFrame, by_group: bool = False) -> DataFrame:
    """Precision, recall, F1 and support of every gold or predicted label.

    Predictions without a gold code come back as one row with a null label.
    """
    right = F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("long")

    def side(label, support, predicted, tp, skipped) -> Column:
        return F.struct(
            label.alias("label"), support.alias("support"), predicted.alias("predicted"),
            tp.cast("long").alias("tp"), skipped.alias("skipped"))

    n = F.col("n")
    sides = F.when(
        F.col("gold").isNull(), F.array(side(F.col("gold"), zero, zero, zero, n))
    ).otherwise(F.array(
        side(F.col("gold"), n, zero, right, zero), side(F.col("pred"), zero, n, zero, zero)))
    labels = counts.select("slice", F.inline(sides))
    sums = [F.sum(c).alias(c) for c in ("support", "predicted", "tp", "skipped")]
    if by_group:
        summed = labels.groupingSets(
            [[F.col("label")], [F.col("slice"), F.col("label")]], "slice", "label"
        ).agg(*sums, F.grouping("slice").alias("_all"))
        level = F.when(F.col("_all") == 1, OVERALL).otherwise(GROUP)
    else:
        summed = labels.groupBy("label").agg(*sums).withColumn("slice", F.lit(None).cast("string"))
        level = F.lit(OVERALL)
    return summed.select(
        level.alias("level"), "slice", "label",
        T.ratio0(F.col("tp"), F.col("predicted")).alias("precision"),
        T.ratio0(F.col("tp"), F.col("support")).alias("recall"),
        T.ratio0(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        "support", "tp", "skipped",
    )


def per_class(counts: DataFrame) -> DataFrame:
    """Rounded per-label scores over all rows."""
    return class_scores(counts).filter("label is not null").select(
        "label", *[T.metric(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


def summary(counts: DataFrame, by_group: bool = False) -> DataFrame:
    """Accuracy, macro and weighted F1 overall and, if wanted, per group.

    A group whose predictions were all skipped has no row.
    """
    scored = class_scores(counts, by_group)
    measures = [
        T.metric(T.ratio(F.sum("tp"), F.sum("support"))).alias("accuracy"),
        T.metric(F.avg(F.when(F.col("label").isNotNull(), F.col("f1")))).alias("macro_f1"),
        T.metric(T.ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")))
        .alias("weighted_f1"),
        F.coalesce(F.sum("support"), F.lit(0)).alias("n_total"),
        F.count("label").alias("n_classes"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("n_skipped"),
    ]
    # No group key, so the row exists even where nothing was scored.
    whole = scored.filter(F.col("level") == OVERALL).agg(*measures).select(
        F.lit(OVERALL).alias("level"), F.lit(None).cast("string").alias("slice"), "*")
    if not by_group:
        return whole
    parts = scored.filter(F.col("level") == GROUP).groupBy("level", "slice").agg(
        *measures).filter("n_total > 0")
    return whole.unionByName(parts)


def semantic_similarity(counts: DataFrame, label_vectors: DataFrame, label: str = "label",
                        vector: str = "vector") -> DataFrame:
    """Mean cosine of predicted and gold label vectors.

    Works on distinct label pairs weighted by their counts. A label with several
    vectors counts with the smallest. The mean is null if a pair lacks a vector.
    """
    pairs = scored_pairs(counts).groupBy("gold", "pred").agg(F.sum("n").alias("n"))
    vectors = label_vectors.groupBy(F.col(label).alias("_l")).agg(
        V.unit(F.min(vector)).alias("_v"))
    pairs = pairs.join(vectors.toDF("gold", "_gv"), "gold", "left").join(
        vectors.toDF("pred", "_pv"), "pred", "left")
    lacking = F.count_if(F.col("_gv").isNull() | F.col("_pv").isNull())
    mean = F.sum(V.dot(F.col("_gv"), F.col("_pv")) * F.col("n")) / F.sum("n")
    return pairs.agg(F.when(lacking == 0, T.metric(mean)).alias("semantic_similarity"))


def normalised_confusion(counts: DataFrame, labels: list[str] | None = None,
                         with_total: bool = False) -> DataFrame:
    """(gold, pred, n, rate): rate is the share of the gold label's rows.

    With ``labels`` only pairs of those labels are counted. ``with_total`` adds the
    rows of the gold label as ``total``.
    """
    pairs = scored_pairs(counts).groupBy("gold", "pred").agg(F.sum("n").alias("n"))
    if labels is not None:
        pairs = pairs.filter(F.col("gold").isin(labels) & F.col("pred").isin(labels))
    totals = pairs.groupBy("gold").agg(F.sum("n").alias("_total"))
    return pairs.join(totals, "gold").select(
        "gold", "pred", "n", T.metric(F.col("n") / F.col("_total")).alias("rate"),
        *([F.col("_total").alias("total")] if with_total else []))


def top_confusions(rates: DataFrame, above: float = R.CONFUSION_REPORT_RATE) -> DataFrame:
    """Pairs of different labels whose rate, unrounded where ``total`` is known, is higher."""
    rate = F.col("n") / F.col("total") if "total" in rates.columns else F.col("rate")
    return rates.filter((F.col("gold") != F.col("pred")) & (rate > above)).drop("total")


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values."""
    return df.select(F.col(column).alias("label")).filter("label is not null").distinct()


def label_union(aligned: DataFrame) -> DataFrame:
    """Gold and predicted labels, numeric labels first in numeric order."""
    labels = vocabulary(aligned, "gold").unionByName(vocabulary(aligned, "pred")).distinct()
    return labels.select("label", label_order(F.col("label")).alias("sort_key"))


def label_order(label: Column) -> Column:
    """Integer value of a digits-only label, 999 for any other."""
    return F.coalesce(F.when(label.rlike(r"^\d+$"), label.try_cast("int")), F.lit(999))


def label_index(df: DataFrame, column: str) -> DataFrame:
    """Sorted vocabulary with 0-based ids.

    The labels with the smallest hashes cut the vocabulary into ranges. Labels are numbered
    inside their range, and the counts of the ranges before it are added; only those counts
    meet in one window.
    """
    labels = vocabulary(df, column)
    cuts = labels.orderBy(F.xxhash64("label"), "label").limit(_LABEL_CUTS).agg(
        F.collect_list("label").alias("cuts"))
    ranged = labels.crossJoin(F.broadcast(cuts)).select(
        "label", F.size(F.filter("cuts", lambda c: c <= F.col("label"))).alias("_range"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    local = Window.partitionBy("_range").orderBy("label")
    return ranged.withColumn("_local", F.row_number().over(local)).join(before, "_range").select(
        "label", (F.col("_before") + F.col("_local") - 1).cast("int").alias("label_id"))


def merge_gold(predictions: DataFrame, gold: DataFrame, gold_col: str,
               keys: tuple[str, ...] = (R.CASE_ID, R.SPELL_INDEX),
               predicted: str = R.PREDICTED_CODE) -> DataFrame:
    """Inner join of predictions and gold codes: (keys…, pred, gold)."""
    codes = gold.select(*keys, F.col(gold_col).cast("string").alias("gold"))
    found = predictions.select(*keys, F.col(predicted).cast("string").alias("pred"))
    return found.join(codes.filter("gold is not null"), list(keys))
