"""Wide slots to arrays and rows, and back. Slot arrays need no shuffle."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as t

from plumbline import registry as R
from plumbline.functions import text as T


def slot_numbers(df: DataFrame, prefix: str) -> list[int]:
    """The numbers n of the columns ``<prefix>_<n>``, ascending."""
    found = (re.fullmatch(rf"{prefix}_(\d+)", c) for c in df.columns)
    return sorted(int(m[1]) for m in found if m)


def _slot(df: DataFrame, name: str, otherwise: Column) -> Column:
    return F.col(name) if name in df.columns else otherwise


def spell_slots(df: DataFrame, blank: tuple[str, ...] = ("", "nan"),
                years=None) -> Column:
    """Filled career slots as array<struct<spell_index,start_year,end_year,position>>.

    Every slot that has a column counts. Int year columns are kept; ``years`` turns text into an int, by default with
    the loader rule.
    """
    years = years or T.to_year

    def year(name: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast("int")
        kind = df.schema[name].dataType
        return F.col(name).cast("int") if isinstance(kind, t.IntegralType) else years(F.col(name))

    slots = [
        F.struct(
            F.lit(n).alias("spell_index"),
            year(f"career_start_year_{n}").alias("start_year"),
            year(f"career_end_year_{n}").alias("end_year"),
            F.col(f"career_position_{n}").cast("string").alias("position"),
        )
        for n in slot_numbers(df, "career_position")
    ]
    if not slots:
        return F.array().cast(
            "array<struct<spell_index:int,start_year:int,end_year:int,position:string>>")
    return F.filter(
        F.array(*slots),
        lambda s: s["position"].isNotNull() & ~T.strip(s["position"]).isin(*blank),
    )


def pinned(value: Column) -> Column:
    """A per-row value as generator output, to be selected once.

    Filters on it stay above the generator. Pushed below, a filter on a value made
    of dozens of renamed slot columns makes the planner derive constraints for
    every combination of names.
    """
    return F.explode(F.array(value))


def career_spells(df: DataFrame) -> DataFrame:
    """Wide gold to one row per filled career slot."""
    return (
        df.select(R.CASE_ID, F.explode(spell_slots(df)).alias("s"))
        .select(
            R.CASE_ID,
            F.col("s.spell_index").alias(R.SPELL_INDEX),
            F.col("s.start_year").alias("career_start_year"),
            F.col("s.end_year").alias("career_end_year"),
            F.col("s.position").alias("career_position"),
        )
    )


def dated(spells: Column) -> Column:
    """Spells with at least one year."""
    return F.filter(spells, lambda s: s["start_year"].isNotNull() | s["end_year"].isNotNull())


def spell_anchors(df: DataFrame) -> Column:
    """Filled slots with a year: array<struct<spell_index,start_year,end_year,category>>."""
    spells = dated(spell_slots(df, years=T.truncated_year))
    return F.transform(
        spells,
        lambda s: F.struct(
            s["spell_index"].alias("spell_index"), s["start_year"].alias("start_year"),
            s["end_year"].alias("end_year"), T.strip(s["position"]).alias("category"),
        ),
    )


def education_anchor(df: DataFrame) -> Column:
    """struct<edu_degree,edu_start,edu_end,subjects>, null without a subject."""
    nothing = F.lit(None).cast("string")

    def filled(name: str) -> Column:
        text = T.strip(_slot(df, name, nothing).cast("string"))
        return F.when(~text.isin("", "nan"), text)

    slots = [
        F.struct(
            F.lit(n).alias("subject_index"),
            filled(f"uni_subject_{n}").alias("code"),
            filled(f"uni_name_{n}").alias("uni_name"),
        )
        for n in slot_numbers(df, "uni_subject") or [1]
    ]
    subjects = F.filter(F.array(*slots), lambda s: s["code"].isNotNull())
    return F.when(
        F.size(subjects) > 0,
        F.struct(
            F.coalesce(filled("edu_degree"), F.lit("unknown")).alias("edu_degree"),
            T.truncated_year(_slot(df, "edu_start", nothing)).alias("edu_start"),
            T.truncated_year(_slot(df, "edu_end", nothing)).alias("edu_end"),
            subjects.alias("subjects"),
        ),
    )


def gold_spell_lists(df: DataFrame) -> DataFrame:
    """Key and its dated spells for scoring; keys without one are left out."""
    positive = F.transform(spell_slots(df), lambda s: F.struct(
        s["spell_index"].alias("spell_index"), *[
            F.when(s[y] > 0, s[y]).alias(y) for y in ("start_year", "end_year")],
        s["position"].alias("position")))
    return (
        df.select(F.col(R.CASE_ID).cast("string").alias(R.CASE_ID),
                  pinned(dated(positive)).alias("gold"))
        .filter(F.size("gold") > 0)
    )


def collect_spells(df: DataFrame, key: str = R.CASE_ID) -> DataFrame:
    """Long spells to one list per key, ordered by index, that keeps every row.

    Rows without an index come first. A list holds the spells of one case.
    """
    spell = F.struct(
        F.col(R.SPELL_INDEX).alias("spell_index"),
        F.col("start_year"), F.col("end_year"), F.col("position"),
    )
    return df.groupBy(F.col(key).alias(key)).agg(
        F.array_sort(F.collect_list(spell)).alias("spells"))


def predicted_spells(df: DataFrame, column: str) -> Column:
    """Predicted list for scoring: dated entries with positive years, order kept.

    A null list stays null: that row is counted as skipped.
    """
    element = df.schema[column].dataType
    if not (isinstance(element, t.ArrayType) and isinstance(element.elementType, t.StructType)):
        raise ValueError(f"'{column}' must be an array of structs, got {element.simpleString()}")
    fields = {f.name: f.dataType for f in element.elementType.fields}

    def year(entry: Column, name: str) -> Column:
        if name not in fields:
            return F.lit(None).cast("int")
        return T.positive_int(entry[name], numeric=isinstance(fields[name], t.NumericType))

    entries = F.transform(
        F.filter(F.col(column), lambda e: e.isNotNull()),
        lambda e: F.struct(
            year(e, "start_year").alias("start_year"), year(e, "end_year").alias("end_year"),
            (e["position"].cast("string") if "position" in fields
             else F.lit(None).cast("string")).alias("position"),
        ),
    )
    return dated(entries)


def pivot_mean(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Mean of ``value`` per row and column; ``columns`` fixes the output columns."""
    return df.groupBy(row).pivot(column, columns).agg(F.avg(value))


def pivot_first(df: DataFrame, row: str, column: str, values: list[str],
                columns: list[str]) -> DataFrame:
    """One value per row and column for several measures (``<column>_<measure>``)."""
    aggregates = [F.max(v).alias(v) for v in values]
    wide = df.groupBy(row).pivot(column, columns).agg(*aggregates)
    if len(values) > 1:
        return wide
    return wide.select(row, *[F.col(c).alias(f"{c}_{values[0]}") for c in columns])
