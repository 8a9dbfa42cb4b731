"""Row and column cleaning for label tables."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from plumbline import registry as R
from plumbline.functions import text as T


class DropReport:
    """Counts of rows each cleaning step removed.

    The counts ride along with the job that uses the cleaned table
    (``df.observe``), so they cost no extra pass. ``counts()`` waits for the
    first action on that table.
    """

    def __init__(self) -> None:
        self._steps: dict[str, Observation] = {}

    def watch(self, df: DataFrame, step: str, dropped: Column) -> DataFrame:
        observation = Observation(f"{step}-{id(self)}")
        self._steps[step] = observation
        return df.observe(
            observation, F.coalesce(F.count_if(dropped), F.lit(0)).alias("n_dropped")
        )

    def watch_sum(self, df: DataFrame, step: str, dropped: Column) -> DataFrame:
        """The same for rows that stand for several."""
        observation = Observation(f"{step}-{id(self)}")
        self._steps[step] = observation
        return df.observe(observation, F.coalesce(F.sum(dropped), F.lit(0)).alias("n_dropped"))

    def counts(self) -> dict[str, int]:
        return {step: obs.get["n_dropped"] for step, obs in self._steps.items()}


def _drop(df: DataFrame, unwanted: Column, step: str, report: DropReport | None) -> DataFrame:
    flag = F.coalesce(unwanted, F.lit(False))
    watched = report.watch(df, step, flag) if report else df
    return watched.filter(~flag)


def drop_blank_keys(df: DataFrame, key: str = R.CASE_ID,
                    report: DropReport | None = None) -> DataFrame:
    """Drop rows whose key is null, empty or blank."""
    blank = F.col(key).isNull() | (T.strip(F.col(key).cast("string")) == "")
    return _drop(df, blank, "blank_key", report)


def drop_flagged(df: DataFrame, flag: str = R.MISSING_TYPE,
                 report: DropReport | None = None) -> DataFrame:
    """Drop rows flagged as incomplete; no-op where the flag column is absent."""
    if flag not in df.columns:
        return df
    return _drop(df, T.strip(F.col(flag)) != "", "flagged", report)


def year_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "year" in c.lower() or c in ("edu_start", "edu_end")]


def coerce_years(df: DataFrame) -> DataFrame:
    """Year columns to nullable ints, chosen by name."""
    return df.withColumns({c: T.year_of(c) for c in year_columns(df)})


def label_columns(df: DataFrame) -> list[str]:
    return [v.input_col for v in R.ANNOTATION_VARIABLES.values()
            if v.indexed and v.input_col in df.columns]


def has_text(column: str) -> Column:
    return T.strip(F.coalesce(F.col(column).cast("string"), F.lit(""))) != ""


def coerce_spell_index(df: DataFrame, report: DropReport | None = None) -> DataFrame:
    """Index to int; rows with label content but no valid index are dropped.

    Rows without any label content keep a null index. Where the table has no
    label column at all, a null index alone is enough to drop the row.
    """
    if R.SPELL_INDEX not in df.columns:
        return df
    typed = df.withColumn(R.SPELL_INDEX, T.to_year(F.col(R.SPELL_INDEX)))
    labels = label_columns(typed)
    content = reduce(Column.__or__, map(has_text, labels)) if labels else F.lit(True)
    return _drop(typed, F.col(R.SPELL_INDEX).isNull() & content, "bad_index", report)


def duplicated_keys(df: DataFrame, key: str, index: str, relevant: Column | None = None) -> DataFrame:
    """Keys that hold some ``(key, index)`` more than once."""
    rows = df if relevant is None else df.filter(relevant)
    pairs = rows.groupBy(key, index).agg(F.count(F.lit(1)).alias("n"))
    return pairs.filter("n > 1").select(key).distinct()


def drop_duplicated_cases(df: DataFrame, key: str = R.CASE_ID, index: str = R.SPELL_INDEX,
                          groups: dict[str, Column] | None = None) -> DataFrame:
    """Drop every row of a key that repeats an index inside any row group.

    ``groups`` names the row groups by a predicate; by default one group per
    label column that is filled. All groups are counted in one aggregation.
    """
    if index not in df.columns:
        return df
    if groups is None:
        groups = {c: has_text(c) for c in label_columns(df)}
        if not groups:
            return df
    counted = df.groupBy(key, index).agg(
        *[F.count_if(cond).alias(f"n_{i}") for i, cond in enumerate(groups.values())]
    )
    repeated = reduce(Column.__or__, [F.col(f"n_{i}") > 1 for i in range(len(groups))])
    return df.join(counted.filter(repeated).select(key).distinct(), key, "left_anti")


def check_unique_columns(df: DataFrame) -> DataFrame:
    """A wide table repeats an index only by repeating a column name."""
    repeated = sorted({c for c in df.columns if df.columns.count(c) > 1})
    if repeated:
        raise ValueError(f"duplicate column name(s): {repeated}")
    return df


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the smallest ``order``.

    An aggregation, not a window: each map task keeps one row per key before
    the shuffle, so a key that repeats very often does not fill one task.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    picked = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, order).alias("_row"))
    return picked.select("_row.*")


def load_cases(df: DataFrame, order: str, ids: DataFrame | None = None,
               limit: int | None = None) -> DataFrame:
    """Complete rows with a key, first row per key, optionally only given ids."""
    cases = keep_first(drop_blank_keys(drop_flagged(df)), R.CASE_ID, order)
    if ids is not None:
        cases = cases.join(ids.select(R.CASE_ID).distinct(), R.CASE_ID, "left_semi")
    return cases.orderBy(R.CASE_ID).limit(limit) if limit else cases


def drop_blank_text(df: DataFrame, column: str, report: DropReport | None = None) -> DataFrame:
    return _drop(df, T.is_blank(F.col(column)), f"blank_{column}", report)


def select_available(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """The wanted columns that exist; a warning names the others."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        warnings.warn(f"column(s) not found: {missing}; they are left out")
    return df.select(*[c for c in columns if c in df.columns])


def select_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Key first, then the wanted features."""
    return select_available(df, [R.CASE_ID, *[f for f in features if f != R.CASE_ID]])


def atomic_column(df: DataFrame, variable: str) -> DataFrame:
    """Key and gold value of one atomic variable."""
    if variable not in R.ATOMIC_VARIABLES:
        raise ValueError(
            f"'{variable}' is not a known atomic variable; valid: {sorted(R.ATOMIC_VARIABLES)}"
        )
    return df.select(R.CASE_ID, variable)


def annotation_inputs(silver: DataFrame, variable: str, gold_ids: DataFrame) -> DataFrame:
    """Rows with a label for ``variable`` whose key is in ``gold_ids``."""
    spec = annotation_spec(variable)
    if spec.input_col not in silver.columns:
        raise ValueError(f"column '{spec.input_col}' not found; available: {silver.columns}")
    filled = silver.filter(has_text(spec.input_col))
    columns = [R.CASE_ID]
    if spec.indexed and R.SPELL_INDEX in silver.columns:
        columns.append(R.SPELL_INDEX)
    columns.append(spec.input_col)
    columns += [c for c in ("workplace_label", spec.gold_col)
                if c in silver.columns and c not in columns]
    return semi_by_id(filled, gold_ids).select(*columns)


def annotation_spec(variable: str | None) -> R.AnnotationVariable:
    if variable not in R.ANNOTATION_VARIABLES:
        raise ValueError(
            f"Unknown annotation variable '{variable}'; valid: {sorted(R.ANNOTATION_VARIABLES)}"
        )
    return R.ANNOTATION_VARIABLES[variable]


def semi_by_id(df: DataFrame, ids: DataFrame, key: str = R.CASE_ID,
               report: DropReport | None = None, step: str = "unmatched") -> DataFrame:
    """Rows whose key, as text, is among ``ids``; ``report`` counts the others."""
    wanted = ids.select(F.col(key).cast("string").alias("_id")).distinct()
    found = F.col(key).cast("string") == F.col("_id")
    if report is None:
        return df.join(wanted, found, "left_semi")
    return _drop(df.join(wanted, found, "left"), F.col("_id").isNull(), step, report).drop("_id")


def anti_by_id(df: DataFrame, ids: DataFrame, key: str = R.CASE_ID) -> DataFrame:
    """Rows whose key, as text, is not among ``ids``."""
    unwanted = ids.select(F.col(key).cast("string").alias("_id")).distinct()
    return df.join(unwanted, F.col(key).cast("string") == F.col("_id"), "left_anti")


def union_filled(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by name; columns a table lacks are filled with the empty text."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, first)
    return whole.fillna("")
