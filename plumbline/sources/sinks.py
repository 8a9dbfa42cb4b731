"""Outputs of the silver build and the results register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline import registry as R
from plumbline.functions.text import one_line


def append_silver(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_failures(rows: DataFrame, path: str) -> None:
    """Replace the failures; no failure leaves an empty table."""
    rows.write.mode("overwrite").parquet(path)


# Which summary column feeds which register column, per kind of result.
_SCORES = {
    "collection": ("precision", "recall", "f1"),
    "composite": ("precision", "recall", "f1"),
    "number": ("mae", "accuracy"),
    "text": ("accuracy",),
    "annotation": ("accuracy", "macro_f1", "weighted_f1", "semantic_similarity"),
}


def result_kind(task: str, columns: list[str]) -> str:
    if task != "extraction":
        return task
    if "mae" in columns:
        return "number"
    return "composite" if "precision" in columns else "text"


def register_row(summary: DataFrame, task: str, variable: str | None, metrics_json: Column,
                 contributor: str = "unknown", experiment_path: str = "", model: str = "unknown",
                 model_notes: str = "", timestamp: Column | None = None) -> DataFrame:
    """One register row per row of ``summary``, every column as clean text."""
    scores = _SCORES[result_kind(task, summary.columns)]
    stamp = timestamp if timestamp is not None else F.date_format(
        F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    values = {
        "timestamp": stamp, "contributor": F.lit(contributor),
        "experiment_path": F.lit(experiment_path), "task": F.lit(task),
        "variable": F.lit(variable or ""), "model": F.lit(model),
        "model_notes": F.lit(model_notes), "n_evaluated": F.col("n_evaluated"),
        "n_skipped": F.col("n_skipped"), "metrics_json": metrics_json,
        **{c: F.col(c) for c in scores if c in summary.columns},
    }
    return summary.select(
        *[one_line(values.get(c, F.lit(""))).alias(c) for c in R.REGISTER_COLUMNS])


def detail_table(details: DataFrame, section: str, key: str) -> DataFrame:
    """One section of an evaluation as rows (section, name, scores…); absent scores are null."""
    return details.select(
        F.lit(section).alias("section"), F.col(key).cast("string").alias("name"),
        *[(F.col(c) if c in details.columns else F.lit(None)).cast(kind).alias(c)
          for c, kind in R.DETAIL_SCORES.items()])


def append_details(rows: DataFrame, path: str, task: str, variable: str | None,
                   timestamp: Column, contributor: str = "unknown", experiment_path: str = "",
                   model: str = "unknown", model_notes: str = "") -> None:
    """Append detail rows under the identity of their register row."""
    identity = {
        "timestamp": timestamp, "contributor": F.lit(contributor),
        "experiment_path": F.lit(experiment_path), "task": F.lit(task),
        "variable": F.lit(variable or ""), "model": F.lit(model),
        "model_notes": F.lit(model_notes),
    }
    rows.select(*[one_line(v).alias(k) for k, v in identity.items()], "*").write.mode(
        "append").parquet(path)


def append_register(rows: DataFrame, path: str) -> None:
    """Append to the register: a folder of CSV files, every field quoted."""
    rows.select(*R.REGISTER_COLUMNS).write.mode("append").csv(
        path, header=True, quoteAll=True, escape='"')


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """The register; ``append_register`` leaves no line break in a field, so its files can be split."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in R.REGISTER_COLUMNS)).csv(
        path, header=True, quote='"', escape='"')
