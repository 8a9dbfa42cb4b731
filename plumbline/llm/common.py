"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import durable_dir, ship

PACKAGE = Path(__file__).resolve().parents[1]


def prepare(spark: SparkSession) -> None:
    """Send this package to the executors; once per application."""
    ship(spark, PACKAGE)


def bound_arrow_batches(spark: SparkSession, limit: int) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to ``limit``; never raise it.

    For rows of several MB: Spark would otherwise join up to 64 MB of them in one batch.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) <= limit:
        spark.conf.set(key, str(limit))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the folder that driver and executors share."""
    return f"{durable_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it from there.

    Cuts the lineage: what follows survives lost executors without repeating the work above.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns the operators read, under fixed names; other columns are left behind."""
    return docs.select(docs[doc_id].cast("long").alias("doc_id"),
                       docs[text].cast("string").alias("text"))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def utf8_values(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null gives the empty string."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


def list_array(parts: list[np.ndarray], dtype: np.dtype) -> pa.ListArray:
    """A list array from one numpy array per row."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(dtype, copy=False)))


def small_batches(batches: Iterator[pa.RecordBatch], column: str,
                  limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of one text column.

    One row may be larger than the limit; it then stands alone.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        sizes = np.array([len(v) for v in utf8_values(batch.column(at))], np.int64)
        groups = np.cumsum(sizes) // limit
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        for lo, hi in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)
