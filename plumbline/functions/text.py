"""Text and code columns: normalising, prefixes, similarity."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F, types as t

from plumbline import registry as R

# A decimal number as pandas and Python read it. Java's parser also takes
# "12d" or "0x1p3", so the text is checked before it is cast.
_NUMBER = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_INTEGER = r"^[+-]?\d+$"


def strip(value: Column) -> Column:
    """Trim every Unicode blank, not only the space."""
    return F.btrim(value, F.lit(R.WHITESPACE))


def is_blank(value: Column) -> Column:
    return value.isNull() | strip(value.cast("string")).isin(*R.BLANK_TEXT)


def normalise_value(value: Column) -> Column:
    """Trim, lower-case, and fold every missing marker to one sentinel."""
    text = F.lower(strip(value.cast("string")))
    return F.when(value.isNull() | text.isin(*R.NA_VARIANTS), F.lit(R.NA_SENTINEL)).otherwise(text)


def normalise_chars(value: Column) -> Column:
    """Lower-case, drop bracketed parts and punctuation, collapse blanks."""
    text = F.lower(value.cast("string"))
    text = F.regexp_replace(text, r"(?d)\(.*?\)", "")
    text = F.regexp_replace(text, r"""['\-.,/"]""", "")
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


@F.pandas_udf(t.DoubleType())
def _sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if a is None or b is None else SequenceMatcher(None, a, b).ratio()
            for a, b in zip(left, right)
        ],
        dtype="float64",
    )


def char_similarity(left: Column, right: Column) -> Column:
    """Ratcliff-Obershelp ratio of two normalised texts; null if one is null.

    Spark has no such function. Equal or empty texts are decided by built-in
    expressions and reach Python as nulls.
    """
    a, b = normalise_chars(left), normalise_chars(right)
    needs_python = (a != b) & (a != "") & (b != "")
    ratio = _sequence_ratio(F.when(needs_python, a), F.when(needs_python, b))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(ratio)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed and written out only once.

    Nested column expressions would otherwise repeat their argument at every
    level, which makes plans over many columns very large.
    """
    return F.transform(F.array(value), body)[0]


def to_number(value: Column) -> Column:
    """Text to double; null for anything that is no decimal number."""
    return F.regexp_extract(strip(value.cast("string")), _NUMBER, 0).try_cast("double")


def to_year(value: Column) -> Column:
    """Loader rule: a number without a fraction becomes an int, the rest null."""
    return bind(to_number(value), lambda n: F.when(n == F.floor(n), n.try_cast("int")))


def year_of(column: str) -> Column:
    """``to_year`` of a named column, as one SQL expression.

    A wide table has dozens of year columns; one expression each keeps the
    building of the plan fast.
    """
    return F.expr(
        f"transform(array(try_cast(regexp_extract(btrim(cast(`{column}` as string), "
        f"'{R.WHITESPACE}'), '{_NUMBER}', 0) as double)), "
        "n -> case when n = floor(n) then try_cast(n as int) end)[0]")


def truncated_year(value: Column) -> Column:
    """Anchor rule: any number, its fraction cut off."""
    return to_number(value).try_cast("int")


def positive_int(value: Column, numeric: bool = False) -> Column:
    """Scoring rule: a positive int, else null.

    ``numeric`` says the column already holds numbers, which are truncated; text
    must be written as an integer.
    """
    if numeric:
        number = value.try_cast("int")
    else:
        number = F.regexp_extract(strip(value.cast("string")), _INTEGER, 0).try_cast("int")
    return bind(number, lambda n: F.when(n > 0, n))


def sector(code: Column) -> Column:
    """First digit of a code such as ``105 = Minister``; other text unchanged."""
    head = strip(F.element_at(F.split(code, "="), 1))
    return F.when(head.rlike(r"^\d+$"), F.substring(head, 1, 1)).otherwise(code)


def numeric_prefix(code: Column) -> Column:
    """Leading digits of a code such as ``03 – Social sciences``; else unchanged."""
    digits = F.regexp_extract(strip(code), r"^(\d+)", 1)
    return F.when(digits != "", digits).otherwise(code)


def degree_prefix(code: Column) -> Column:
    """Leading digits, blanks before them allowed; else unchanged."""
    digits = F.regexp_extract(code.cast("string"), r"(?U)^\s*(\d+)", 1)
    return F.when(digits != "", digits).otherwise(code)


def pipe_set(value: Column) -> Column:
    """``a | b||a`` to the set of its trimmed, non-empty parts."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), r"\|"), strip)
    return F.array_distinct(F.filter(parts, lambda part: part != ""))


def text_set(value: Column) -> Column:
    """The same for an array of texts."""
    parts = F.transform(F.coalesce(value, F.array().cast("array<string>")), strip)
    return F.array_distinct(F.filter(parts, lambda part: part.isNotNull() & (part != "")))


def experiment_folder(path: Column) -> Column:
    """Second last part of a path; the path itself if it has one part."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(path)


def joined_text(title: Column, workplace: Column) -> Column:
    """``title | workplace``; a missing workplace leaves an empty second part."""
    return F.concat(title, F.lit(" | "), F.coalesce(workplace, F.lit("")))


def one_line(value: Column) -> Column:
    """Line breaks to blanks, ends trimmed; what the register stores."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return strip(F.regexp_replace(text, r"[\n\r\u2028\u2029\x0b\f]", " "))


def metric(value: Column) -> Column:
    """Round a score. Half-even, as Python rounds."""
    return F.bround(value, R.METRIC_DIGITS)


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, null where the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def ratio0(part: Column, whole: Column) -> Column:
    """``part / whole``, zero where the whole is zero."""
    return F.coalesce(ratio(part, whole), F.lit(0.0))
