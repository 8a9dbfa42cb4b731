"""Keyed caches: compute what is missing, append it, read one row per key.

Every append carries the time and the run that wrote it. Two runs that append the same key at once
leave two rows, of which reading keeps one; a failed answer is kept beside the good ones, is never
preferred to one, and is asked again until it has failed a given number of times.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ATTEMPTS = 3
_STAMPS = "_written timestamp, _run string"


def _appended(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every row that was ever appended; empty where none was. Rows of older files have no stamp."""
    whole = f"{schema}, {_STAMPS}"
    try:
        return spark.read.schema(whole).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], whole)
        raise


def _is_good(error: str | None) -> Column:
    return F.col(error).isNull() if error else F.lit(True)


def _by_key(rows: DataFrame, keys: list[str], error: str | None) -> DataFrame:
    """One row per key: the last good one, else the last failure; and how many failed."""
    values = F.struct(*[F.col(c) for c in rows.columns])
    order = F.struct(_is_good(error), F.coalesce("_written", F.lit(0).cast("timestamp")),
                     F.coalesce("_run", F.lit("")))
    return rows.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(
        F.max_by(values, order).alias("_row"), F.count_if(~_is_good(error)).alias("_failed"))


def read_cache(spark: SparkSession, path: str, schema: str, keys: list[str] | None = None,
               error: str | None = None) -> DataFrame:
    """The cached table, with ``keys`` one row for each of them; empty where none was written yet.

    ``error`` names the column that is null in good answers.
    """
    rows = _appended(spark, path, schema)
    columns = [c for c in rows.columns if c not in ("_written", "_run")]
    if keys is None:
        return rows.select(*columns)
    return _by_key(rows, keys, error).select(*[F.col(f"_row.{c}").alias(c) for c in columns])


def misses(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct wanted keys that are not cached."""
    return wanted.select(*keys).distinct().join(cached.select(*keys), keys, "left_anti")


def _settled(rows: DataFrame, keys: list[str], error: str | None, attempts: int) -> DataFrame:
    """Keys that are not asked again: answered, or failed often enough."""
    found = _by_key(rows, keys, error)
    done = F.col("_failed") >= attempts
    if error:
        done = done | F.col(f"_row.{error}").isNull()
    else:
        done = F.lit(True)
    return found.filter(done).select(*[F.col(f"_row.{k}").alias(k) for k in keys])


def through_cache(wanted: DataFrame, keys: list[str], path: str, schema: str,
                  compute: Callable[[DataFrame], DataFrame], error: str | None = None,
                  attempts: int = ATTEMPTS) -> DataFrame:
    """Cached results of ``wanted``; ``compute`` runs on missing keys only.

    Results are written before they are used, so a lost executor never repeats a
    call that was already answered and stored. Rows whose ``error`` is not null are
    failures: their keys are asked again by later calls, up to ``attempts`` in all.
    """
    spark = wanted.sparkSession
    fresh = compute(misses(wanted, _settled(_appended(spark, path, schema), keys, error, attempts), keys))
    columns = read_cache(spark, path, schema).columns
    fresh.select(*columns, F.current_timestamp().alias("_written"), F.lit(uuid.uuid4().hex).alias("_run")
                 ).write.mode("append").parquet(path)
    return read_cache(spark, path, schema, keys, error).join(
        wanted.select(*keys).distinct(), keys, "left_semi")
