"""Whole jobs on the gold and silver tables."""

from __future__ import annotations

from catalog.base import (
    SQL_GOLD_SPLIT, SQL_SILVER, derived, gold_of, oracle, query, silver_of, sql_normal,
    sql_number, sql_spells,
)
from catalog.metrics import (
    _COUNTS, _FIELD_TABLES, _GREEDY, _LATEST, _MACRO, _SET_NAMES, _SPELL_NAMES, _SQL_SCORED,
    _SUMMARY, _URL_PRF, SQL_SIMILAR, _predicted_lists, _sql_similarity_scores, sql_normal_pairs,
)
from plumbline import registry as R
from plumbline.plans.evaluate import evaluate, evaluate_many
from plumbline.plans.inputs import load_inputs, load_training_data

_SILVER_TABLES = ["raw_gold", "raw_silver", "raw_silver_edu"]
_TEST = "(SELECT case_id FROM sides WHERE split = 'test')"


@query("load_collection_inputs", oracle(["raw_gold"], f"""
SELECT case_id, name_first, name_last, job_title, country_label FROM gold WHERE case_id IN {_TEST}""",
                                        SQL_GOLD_SPLIT))
def load_collection_inputs(spark, sf):
    return load_inputs("collection", gold_of(spark, sf))


@query("load_extraction_inputs", oracle(["raw_gold"], f"""
SELECT case_id, cv_local FROM gold WHERE case_id IN {_TEST} AND trim(cv_local) NOT IN ('', 'nan', '<NA>')""",
                                        SQL_GOLD_SPLIT))
def load_extraction_inputs(spark, sf):
    return load_inputs("extraction", gold_of(spark, sf))


@query("load_annotation_inputs", oracle(_SILVER_TABLES, f"""
SELECT case_id, spell_index, subject_label, workplace_label, uni_subject FROM silver
WHERE trim(subject_label) <> '' AND case_id IN {_TEST}""", SQL_GOLD_SPLIT + "," + SQL_SILVER))
def load_annotation_inputs(spark, sf):
    return load_inputs("annotation", gold_of(spark, sf), "uni_subject", silver_of(spark, sf))


@query("load_training_rows", oracle(_SILVER_TABLES, """
SELECT case_id, job_description_label, career_position FROM silver
WHERE trim(job_description_label) <> '' AND case_id IN (SELECT case_id FROM sides WHERE split = 'train')""",
                                    SQL_GOLD_SPLIT + "," + SQL_SILVER))
def load_training_rows(spark, sf):
    return load_training_data(
        "annotation", ["job_description_label", "career_position"], gold_of(spark, sf),
        "career_position", silver_of(spark, sf))


@query("evaluate_collection", oracle(
    ["raw_gold", "url_predictions"], "SELECT 'collection' AS task, CAST(NULL AS VARCHAR) AS variable, m.* FROM ("
    + _MACRO + ") AS m", SQL_GOLD_SPLIT + "," + _URL_PRF.replace(
        "FROM raw_gold WHERE trim(case_id) <> ''", f"FROM gold WHERE case_id IN {_TEST}")
    + ", scored AS (" + _SQL_SCORED.format(key="case_id", names=_SET_NAMES) + ")"))
def evaluate_collection(spark, sf):
    return evaluate(derived(spark, sf, "url_predictions"), "collection", gold=gold_of(spark, sf),
                    check_empty=False).summary


_FIELDS = _LATEST + """
aligned AS (SELECT g.country_label AS slice, CAST(g.{v} AS VARCHAR) AS gold, l.{v} AS pred,
                   l.case_id IS NOT NULL AS has_pred
            FROM gold AS g LEFT JOIN latest AS l USING (case_id) WHERE g.case_id IN """ + _TEST + """),
errors AS (SELECT *, CASE WHEN """ + sql_normal("gold") + " <> '__na__' AND " + sql_normal("pred") + (
    " <> '__na__' THEN abs(" + sql_number("pred") + " - " + sql_number("gold") + ") END AS e FROM aligned)")


@query("evaluate_birth_year", oracle(_FIELD_TABLES, """
SELECT 'extraction' AS task, 'birth_year' AS variable, round_even(avg(e), 6) AS mae,
  round_even(CAST(count(*) FILTER (e = 0) AS DOUBLE) / nullif(count(e), 0), 6) AS accuracy,
  CAST(count(e) AS BIGINT) AS n_evaluated, CAST(count(*) FILTER (e IS NULL) AS BIGINT) AS n_skipped,
  CAST(count(*) FILTER (NOT has_pred) AS BIGINT) AS n_missing FROM errors""",
                                     SQL_GOLD_SPLIT + "," + _FIELDS.format(v="birth_year")))
def evaluate_birth_year(spark, sf):
    return evaluate(derived(spark, sf, "field_answers"), "extraction", "birth_year",
                    gold=gold_of(spark, sf), order="run", check_empty=False).summary


@query("evaluate_birth_year_by_country", oracle(_FIELD_TABLES, """
SELECT slice AS country, round_even(CAST(count(*) FILTER (e = 0) AS DOUBLE) / nullif(count(e), 0), 6) AS accuracy,
  round_even(avg(e), 6) AS mae, CAST(count(e) AS BIGINT) AS n_evaluated
FROM errors WHERE has_pred GROUP BY slice""", SQL_GOLD_SPLIT + "," + _FIELDS.format(v="birth_year")))
def evaluate_birth_year_by_country(spark, sf):
    return evaluate(derived(spark, sf, "field_answers"), "extraction", "birth_year",
                    gold=gold_of(spark, sf), order="run", check_empty=False).per_country


@query("evaluate_birth_place", oracle(_FIELD_TABLES, f"""
SELECT 'extraction' AS task, 'birth_place' AS variable, n_total AS n_evaluated, n_missing AS n_skipped,
  * EXCLUDE (level, slice, n_total) FROM ({_sql_similarity_scores('overall', 'NULL', '')})""",
    SQL_GOLD_SPLIT + "," + _FIELDS.format(v="birth_place") + "," + sql_normal_pairs() + SQL_SIMILAR,
    recursive=True))
def evaluate_birth_place(spark, sf):
    return evaluate(derived(spark, sf, "field_answers"), "extraction", "birth_place",
                    gold=gold_of(spark, sf), order="run", check_empty=False).summary


_TEST_SPELLS = SQL_GOLD_SPLIT + "," + sql_spells(f"gold WHERE case_id IN {_TEST} AND", "test_spells").replace(
    "AND WHERE", "AND") + """,
dated AS (SELECT case_id, spell_index AS slot, CASE WHEN start_year > 0 THEN start_year END AS s,
                 CASE WHEN end_year > 0 THEN end_year END AS e FROM test_spells
          WHERE start_year > 0 OR end_year > 0)"""


@query("evaluate_career", oracle(["raw_gold", "spell_predictions"], """
SELECT 'extraction' AS task, 'career' AS variable, m.*, 1 AS tolerance_years FROM (""" + _MACRO + ") AS m",
    _TEST_SPELLS + ", " + _GREEDY[_GREEDY.index("golds AS"):] + ", scored AS (" + _SQL_SCORED.format(
        key="case_id", names=_SPELL_NAMES) + ")", recursive=True))
def evaluate_career(spark, sf):
    predictions = _predicted_lists(spark, sf).withColumnRenamed("predicted", "career")
    return evaluate(predictions, "extraction", "career", gold=gold_of(spark, sf),
                    check_empty=False).summary


_ANNOTATED = """
codes AS (SELECT case_id, spell_index, max({gold}) AS gold FROM silver
          WHERE trim({label}) <> '' AND case_id IN """ + _TEST + """ GROUP BY case_id, spell_index),
full_aligned AS (
  SELECT p.case_id, trim(p.predicted_code) AS pred, nullif(c.gold, '') AS gold, g.country_label
  FROM {predictions} AS p JOIN gold AS g ON g.case_id = p.case_id AND g.case_id IN """ + _TEST + """
  LEFT JOIN codes AS c ON c.case_id = p.case_id AND c.spell_index = p.spell_index),
aligned AS (SELECT {pred} AS pred, {goldx} AS gold, country_label FROM full_aligned)"""


def _annotated(gold: str, label: str, predictions: str, shorten: str, slice_: str = "country_label") -> str:
    return (SQL_GOLD_SPLIT + "," + SQL_SILVER + "," + _ANNOTATED.format(
        gold=gold, label=label, predictions=predictions, pred=shorten.format("pred"),
        goldx=shorten.format("gold")) + "," + _COUNTS.format(slice=slice_, source="aligned"))


_SECTOR_OF = "CASE WHEN regexp_full_match(trim(split_part({0}, '=', 1)), '[0-9]+') THEN substr(trim({0}), 1, 1) ELSE {0} END"
_PREFIX_OF = "coalesce(nullif(regexp_extract(trim({0}), '^([0-9]+)', 1), ''), {0})"
_ANNOTATION_SUMMARY = """
SELECT 'annotation' AS task, '{v}' AS variable, accuracy, macro_f1, weighted_f1, n_total AS n_evaluated, n_classes,
  (SELECT CAST(count(*) AS BIGINT) FROM aligned WHERE gold IS NULL) AS n_skipped,
  CAST(NULL AS DOUBLE) AS semantic_similarity, '{g}' AS granularity
FROM (""" + _SUMMARY.format(where="WHERE level = 'overall'") + ") AS s"
_CODE_TABLES = [*_SILVER_TABLES, "code_predictions"]


@query("evaluate_annotation_fine", oracle(
    _CODE_TABLES, _ANNOTATION_SUMMARY.format(v="career_position", g="fine"),
    _annotated("career_position", "job_description_label", "code_predictions", "{0}")))
def evaluate_annotation_fine(spark, sf):
    return evaluate(derived(spark, sf, "code_predictions"), "annotation", "career_position",
                    gold=gold_of(spark, sf), silver=silver_of(spark, sf), check_empty=False).summary


@query("evaluate_annotation_broad", oracle(
    _CODE_TABLES, _ANNOTATION_SUMMARY.format(v="career_position", g="broad"),
    _annotated("career_position", "job_description_label", "code_predictions", _SECTOR_OF)))
def evaluate_annotation_broad(spark, sf):
    return evaluate(derived(spark, sf, "code_predictions"), "annotation", "career_position",
                    gold=gold_of(spark, sf), silver=silver_of(spark, sf), granularity="broad",
                    check_empty=False).summary


@query("evaluate_annotation_by_country", oracle(
    _CODE_TABLES, """SELECT slice AS country, accuracy, macro_f1, weighted_f1, n_total AS n_evaluated FROM ("""
    + _SUMMARY.format(where="WHERE level = 'group'") + ")",
    _annotated("career_position", "job_description_label", "code_predictions", "{0}")))
def evaluate_annotation_by_country(spark, sf):
    return evaluate(derived(spark, sf, "code_predictions"), "annotation", "career_position",
                    gold=gold_of(spark, sf), silver=silver_of(spark, sf), check_empty=False).per_country


@query("evaluate_subjects_per_class", oracle(
    [*_SILVER_TABLES, "subject_predictions"], """
SELECT label, round_even(p, 6) AS "precision", round_even(r, 6) AS recall, round_even(f, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM class_scores WHERE level = 'overall'""",
    _annotated("uni_subject", "subject_label", "subject_predictions", _PREFIX_OF)))
def evaluate_subjects_per_class(spark, sf):
    return evaluate(derived(spark, sf, "subject_predictions"), "annotation", "uni_subject",
                    gold=gold_of(spark, sf), silver=silver_of(spark, sf), check_empty=False).per_class


_MANY = list(R.ATOMIC_VARIABLES)
_DEGREE_OF = r"coalesce(nullif(regexp_extract({0}, '^\s*([0-9]+)', 1), ''), {0})"
_MANY_SQL = ", ".join(f"CAST({v} AS VARCHAR) AS {v}" for v in _MANY)


@query("evaluate_many_fields", oracle(_FIELD_TABLES, f"""
SELECT variable,
  CASE WHEN judged THEN round_even(sum(sim) / nullif(count(sim), 0), 6)
       WHEN is_text THEN round_even(CAST(count(*) FILTER (has_pred AND gn = pn) AS DOUBLE)
         / nullif(count(*) FILTER (has_pred), 0), 6)
       ELSE round_even(CAST(count(*) FILTER (e = 0) AS DOUBLE) / nullif(count(e), 0), 6) END AS accuracy,
  CASE WHEN judged THEN round_even(sum(sim) / nullif(count(*) FILTER (has_pred AND pn <> '__na__'), 0), 6)
       WHEN is_text THEN round_even(CAST(count(*) FILTER (has_pred AND gn = pn AND pn <> '__na__') AS DOUBLE)
         / nullif(count(*) FILTER (has_pred AND pn <> '__na__'), 0), 6) END AS accuracy_when_predicted,
  CASE WHEN NOT is_text THEN round_even(avg(e), 6) END AS mae,
  CASE WHEN is_text THEN CAST(count(*) FILTER (has_pred) AS BIGINT) ELSE CAST(count(e) AS BIGINT) END AS n_evaluated,
  CASE WHEN is_text THEN CAST(count(*) FILTER (NOT has_pred) AS BIGINT)
       ELSE CAST(count(*) FILTER (e IS NULL) AS BIGINT) END AS n_skipped
FROM likened GROUP BY variable, is_text, judged""", SQL_GOLD_SPLIT + "," + _LATEST + f"""
wanted AS (SELECT case_id, variable, gold FROM (SELECT case_id, {_MANY_SQL} FROM gold WHERE case_id IN {_TEST})
           UNPIVOT INCLUDE NULLS (gold FOR variable IN ({', '.join(_MANY)}))),
found AS (SELECT case_id, variable, pred FROM (SELECT case_id, {_MANY_SQL} FROM latest)
          UNPIVOT INCLUDE NULLS (pred FOR variable IN ({', '.join(_MANY)}))),
paired AS (SELECT variable, variable NOT IN ('birth_year', 'edu_start', 'edu_end') AS is_text,
             variable IN ('birth_place', 'birth_country') AS judged, f.case_id IS NOT NULL AS has_pred,
             CASE WHEN variable = 'edu_degree' THEN {_DEGREE_OF.format('gold')} ELSE gold END AS gold,
             CASE WHEN variable = 'edu_degree' THEN {_DEGREE_OF.format('pred')} ELSE pred END AS pred
           FROM wanted AS w LEFT JOIN found AS f USING (case_id, variable)),
normal AS (SELECT *, {sql_normal('gold')} AS gn, {sql_normal('pred')} AS pn,
             CASE WHEN {sql_normal('gold')} <> '__na__' AND {sql_normal('pred')} <> '__na__'
             THEN abs({sql_number('pred')} - {sql_number('gold')}) END AS e FROM paired),"""
    + SQL_SIMILAR.replace("WHERE has_pred", "WHERE judged AND has_pred").replace(
        "CASE WHEN has_pred", "CASE WHEN judged AND has_pred"), recursive=True))
def evaluate_many_fields(spark, sf):
    return evaluate_many(derived(spark, sf, "field_answers"), gold_of(spark, sf), _MANY, order="run")
