"""Model inputs of the test side and tables of the training side."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline import registry as R
from plumbline.operators import cleaning as C
from plumbline.operators.splits import apply_split, split_ids


def check_task(task: str) -> None:
    if task not in R.TASKS:
        raise ValueError(f"Unknown task '{task}'. Valid options: {sorted(R.TASKS)}")


def _annotation_rows(gold: DataFrame, silver: DataFrame | None, variable: str | None,
                     side: str, report: C.DropReport | None = None) -> DataFrame:
    if variable is None:
        raise ValueError("'variable' is required for task='annotation'.")
    C.annotation_spec(variable)
    if silver is None:
        raise ValueError("a silver table is required for task='annotation'.")
    if report is not None:
        silver = C.semi_by_id(silver, gold, report=report, step="not_in_gold")
    # The ids of one side are a subset of the gold ids, so one join serves both.
    return C.annotation_inputs(silver, variable, split_ids(gold, side))


def load_inputs(task: str, gold: DataFrame, variable: str | None = None,
                silver: DataFrame | None = None, ordered: bool = True,
                report: C.DropReport | None = None) -> DataFrame:
    """Test-side inputs without labels for collection and extraction.

    ``gold`` and ``silver`` are cleaned tables. ``ordered`` sorts the result by
    its key; turn it off where the result feeds another job. ``report`` counts the
    silver rows of cases that gold does not have.
    """
    check_task(task)
    if task == "annotation":
        rows = _annotation_rows(gold, silver, variable, "test", report)
        keys = [c for c in (R.CASE_ID, R.SPELL_INDEX) if c in rows.columns]
    else:
        test = apply_split(gold, "test")
        keys = [R.CASE_ID]
        if task == "collection":
            rows = C.select_available(test, R.COLLECTION_INPUTS)
        else:
            rows = C.select_available(test, R.EXTRACTION_INPUTS)
            if R.TEXT_LOCAL in rows.columns:
                rows = C.drop_blank_text(rows, R.TEXT_LOCAL)
    return rows.orderBy(*keys) if ordered else rows


def load_training_data(task: str, features: list[str], gold: DataFrame,
                       variable: str | None = None, silver: DataFrame | None = None,
                       report: C.DropReport | None = None) -> DataFrame:
    """Training-side rows: the key and the wanted features."""
    check_task(task)
    if task == "annotation":
        rows = _annotation_rows(gold, silver, variable, "train", report)
    else:
        rows = apply_split(gold, "train")
    return C.select_features(rows, features)
