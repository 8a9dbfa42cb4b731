"""Gold and silver tables from CSV or Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators import cleaning as C
from plumbline.sources import records

_BOM = "\ufeff"


def _existing(read, path: str, what: str) -> DataFrame:
    """Run a read; a missing path becomes a clear ``FileNotFoundError``."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(
                f"{what} not found: {path}. Pass the path of an existing table."
            ) from error
        raise


def detect_separator(spark: SparkSession, path: str) -> str:
    """``;`` if the first line holds more of them than commas, else ``,``."""
    first = _existing(lambda: spark.read.text(path).first(), path, "table")
    line = first[0] if first else ""
    return ";" if line.count(";") > line.count(",") else ","


def read_text_table(spark: SparkSession, path: str, separator: str = ",",
                    what: str = "table", multiline: bool = True, parallel: bool = True,
                    order: str | None = None) -> DataFrame:
    """CSV with a header, every column text, empty fields as the empty text.

    A byte-order mark before the first name is removed. ``multiline`` allows
    line breaks in quoted fields; a file is still read by many tasks (see ``records``).
    Turn ``parallel`` off for a file whose quotes are not balanced: then one task reads
    it. ``order`` adds a column of that name with the position of a row in its source.
    """
    df = _existing(
        lambda: spark.read.csv(path, sep=separator, header=True, inferSchema=False,
                               quote='"', escape='"', multiLine=multiline, encoding="UTF-8",
                               emptyValue="", enforceSchema=False),
        path, what)
    names = [c.lstrip(_BOM) for c in df.columns]
    if multiline and parallel:
        rows = records.parsed(records.records(spark, path), names, separator, header=True)
        place = [records.place().alias(order)] if order else []
        return rows.select(*place, *[F.coalesce(rows[c], F.lit("")).alias(c) for c in names])
    if order:
        df = df.select(F.struct("_metadata.file_path", "_metadata.file_block_start",
                                F.monotonically_increasing_id()).alias(order), "*")
        return df.toDF(order, *names).fillna("", names)
    return df.toDF(*names).fillna("")


def read_table(spark: SparkSession, path: str, separator: str = ",", fmt: str | None = None,
               what: str = "table", multiline: bool = True) -> DataFrame:
    """Text table from CSV, or a table stored as Parquet."""
    if (fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")) == "parquet":
        return _existing(lambda: spark.read.parquet(path), path, what)
    return read_text_table(spark, path, separator, what, multiline)


def clean_gold(df: DataFrame, report: C.DropReport | None = None) -> DataFrame:
    """Blank keys and flagged rows out, years to ints, column names unique."""
    df = C.check_unique_columns(df)
    df = C.drop_blank_keys(df, report=report)
    df = C.drop_flagged(df, report=report)
    return C.coerce_years(df)


def load_gold(spark: SparkSession, path: str, fmt: str | None = None,
              report: C.DropReport | None = None) -> DataFrame:
    """Cleaned gold table, one row per case."""
    return clean_gold(read_table(spark, path, ";", fmt, "gold table"), report)


def clean_silver(df: DataFrame, report: C.DropReport | None = None) -> DataFrame:
    """Blank keys, bad indices and cases with a repeated index out."""
    df = C.drop_blank_keys(df, report=report)
    df = C.coerce_spell_index(df, report=report)
    return C.drop_duplicated_cases(df)


def load_silver(spark: SparkSession, path: str, education_path: str | None = None,
                fmt: str | None = None, report: C.DropReport | None = None) -> DataFrame:
    """Cleaned silver table; the education table, if it exists, is added by name."""
    df = read_table(spark, path, ",", fmt, "silver table")
    if education_path is not None:
        try:
            education = read_table(spark, education_path, ",", fmt, "education table")
        except FileNotFoundError:
            pass
        else:
            df = C.union_filled(df, education)
    return clean_silver(df, report)


def load_raw_cases(spark: SparkSession, path: str) -> DataFrame:
    """Uncleaned gold CSV of either separator with its source order in ``_order``.

    The order is that of file names, then of records in a file.
    """
    return read_text_table(spark, path, detect_separator(spark, path), "gold table", order="_order")
