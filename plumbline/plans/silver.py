"""Build the silver label table by asking a model about each case."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import registry as R
from plumbline.functions import prompts, text as T
from plumbline.operators import cleaning as C, model_jobs as M
from plumbline.operators.reshape import education_anchor, pinned, spell_anchors
from plumbline.session import cut

CAREER_INSTRUCTIONS = (
    "Find the job title and the workplace of every listed career spell in the CV. Answer with "
    'JSON only: {"spells": [{"spell_index": 1, "job_description_label": "...", '
    '"workplace_label": "...", "extraction_failed": false}]}. Keep the given spell_index '
    "values. Use null and extraction_failed true where the CV does not say it."
)
EDUCATION_INSTRUCTIONS = (
    "Find the degree and field of study of every listed subject in the CV. Answer with JSON "
    'only: {"subjects": [{"subject_index": 1, "subject_label": "...", '
    '"extraction_failed": false}]}. Keep the given subject_index values. Use null and '
    "extraction_failed true where the CV does not say it."
)


@dataclass
class SilverBuild:
    silver: DataFrame
    failures: DataFrame


def build_silver(cases: DataFrame, client: Callable[[], M.CallModel], mode: str = "career",
                 done: DataFrame | None = None, failed: DataFrame | None = None,
                 retries: int = R.MODEL_RETRIES, wait: float = R.MODEL_RETRY_WAIT,
                 instructions: str | None = None) -> SilverBuild:
    """Silver rows and failures for ``cases`` (see ``cleaning.load_cases``).

    ``done``: silver rows of an earlier run; their cases are skipped. ``failed``:
    failures of an earlier run; only those (case, index) pairs are asked again,
    and failures of cases not in ``cases`` are kept.
    """
    if mode not in ("career", "education"):
        raise ValueError(f"mode must be 'career' or 'education', got '{mode}'")
    text_col = R.TEXT_ENGLISH if R.TEXT_ENGLISH in cases.columns else R.TEXT_LOCAL
    text = T.strip(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    work = cases
    if failed is not None:
        work = C.semi_by_id(work, failed)
    elif done is not None:
        work = C.anti_by_id(work, done)

    anchor = spell_anchors(work) if mode == "career" else education_anchor(work)
    shaped = work.select(
        T.strip(F.col(R.CASE_ID)).alias(R.CASE_ID), text.alias("_text"),
        pinned(anchor).alias("_anchor"))
    index = "spell_index" if mode == "career" else "subject_index"
    if failed is not None:
        shaped = _only_failed(shaped, failed, index, mode)
    items = F.col("_anchor") if mode == "career" else F.col("_anchor.subjects")
    shaped = shaped.withColumn("_items", items)
    blank = F.col("_text").isin("", "nan")
    without_text = shaped.filter(blank).select(
        R.CASE_ID, F.lit(R.ALL_INDICES).alias(R.SPELL_INDEX),
        F.lit(R.REASON_NO_TEXT).alias("reason"))

    write = prompts.career_prompt if mode == "career" else prompts.education_prompt
    asked = shaped.filter(~blank & (F.size("_items") > 0)).select(
        R.CASE_ID, "_items", write(F.col("_text"), F.col("_anchor")).alias("_prompt"))
    system = instructions or (
        CAREER_INSTRUCTIONS if mode == "career" else EDUCATION_INSTRUCTIONS)
    answered = M.call_model(asked, "_prompt", system, client, retries, wait)
    # Both outputs are read from the stored answers; no call is made twice.
    stored = cut(answered.select(R.CASE_ID, "_items", "response"))
    silver, refused = M.reconcile(stored, "_items", mode=mode)
    failures = without_text.unionByName(refused)
    if failed is not None:
        kept = C.anti_by_id(failed.select(*failures.columns), cases)
        failures = failures.unionByName(kept)
    return SilverBuild(silver, failures)


def _only_failed(shaped: DataFrame, failed: DataFrame, index: str, mode: str) -> DataFrame:
    """Keep the anchors that failed before; ``ALL`` stands for every anchor.

    A case has at most the fixed number of slots plus ``ALL``, so the set per
    case is small.
    """
    retry = failed.groupBy(F.col(R.CASE_ID).cast("string").alias("_id")).agg(
        F.collect_set(F.col(R.SPELL_INDEX).cast("string")).alias("_retry"))

    def wanted(item: Column) -> Column:
        return F.array_contains("_retry", R.ALL_INDICES) | F.array_contains(
            F.col("_retry"), item[index].cast("string"))

    joined = shaped.join(retry, F.col(R.CASE_ID) == F.col("_id"))
    if mode == "career":
        kept = F.filter("_anchor", wanted)
    else:
        kept = F.col("_anchor").withField("subjects", F.filter("_anchor.subjects", wanted))
    return joined.withColumn("_anchor", kept).drop("_id", "_retry")
