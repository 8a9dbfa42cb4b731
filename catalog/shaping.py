"""Splits, samples and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    SLOTS, SQL_GOLD, derived, gold_of, oracle, query, sql_number, sql_spells, sql_split, table,
)
from plumbline.operators import reshape, splits


@query("stratified_split", oracle([], "SELECT c_custkey, split FROM sides", """
people AS (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
""" + sql_split("people", "c_custkey", "n_name")))
def stratified_split(spark, sf):
    people = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return splits.stratified_split(people, "c_custkey", "n_name")


# Sources hold few documents each per language; some strata have a single row.
@query("split_with_single_row_strata", oracle([], """
SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum
FROM sides JOIN documents USING (doc_id) GROUP BY split""", """
docs AS (SELECT doc_id, lang || ' ' || source || ' ' || CAST(length(text) // 900 AS VARCHAR) AS stratum
         FROM documents),
""" + sql_split("docs", "doc_id", "stratum").replace(
    "SELECT r.doc_id, CASE", "SELECT CAST(r.doc_id AS BIGINT) AS doc_id, CASE")))
def split_with_single_row_strata(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.concat_ws(" ", "lang", "source", F.expr("length(text) div 900").cast("string"))
        .alias("stratum"))
    sides = splits.stratified_split(docs, "doc_id", "stratum")
    return sides.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("doc_id").cast("long")).alias("id_sum"))


@query("single_row_strata", oracle([], """
SELECT stratum, CAST(min(doc_id) AS VARCHAR) AS doc_id FROM docs GROUP BY stratum HAVING count(*) = 1""", """
docs AS (SELECT doc_id, lang || ' ' || source || ' ' || CAST(length(text) // 900 AS VARCHAR) AS stratum
         FROM documents)"""))
def single_row_strata(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.concat_ws(" ", "lang", "source", F.expr("length(text) div 900").cast("string"))
        .alias("stratum"))
    return splits.single_row_strata(docs, "doc_id", "stratum")


@query("one_row_per_group", """
SELECT event_type, event_id FROM (
  SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type
    ORDER BY md5('42|' || CAST(event_id AS VARCHAR)), event_id) AS rn FROM events) WHERE rn = 1""")
def one_row_per_group(spark, sf):
    events = table(spark, sf, "events").select("event_type", "event_id")
    return splits.one_per_group(events, "event_type", F.col("event_id"))


@query("few_shot_pool", """
SELECT p_brand, p_partkey, p_name FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand
    ORDER BY md5('42|' || CAST(p_partkey AS VARCHAR)), p_partkey) AS rn FROM part)
WHERE rn = 1 ORDER BY md5('42|' || CAST(p_partkey AS VARCHAR)), p_partkey LIMIT 5""")
def few_shot_pool(spark, sf):
    parts = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name")
    return splits.few_shot_pool(parts, "p_brand", F.col("p_partkey"), 5)


@query("first_cases", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 50")
def first_cases(spark, sf):
    return splits.first_n(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 50, "o_orderkey")


@query("career_spells", oracle(["raw_gold"], """
SELECT case_id, spell_index, start_year AS career_start_year, end_year AS career_end_year,
       position AS career_position FROM gold_spells""", SQL_GOLD + "," + sql_spells("gold")))
def career_spells(spark, sf):
    return reshape.career_spells(gold_of(spark, sf))


def _truncated(column: str) -> str:
    return f"CAST(trunc({sql_number(column)}) AS INT)"


_ANCHORS = oracle(["raw_gold"], f"""
SELECT case_id, spell_index, start_year, end_year, category FROM (
  SELECT case_id, spell_index, {_truncated('start_year')} AS start_year,
         {_truncated('end_year')} AS end_year, trim(position) AS category FROM gold_spells)
WHERE start_year IS NOT NULL OR end_year IS NOT NULL""", sql_spells("raw_gold"))


@query("spell_anchors", _ANCHORS)
def spell_anchors(spark, sf):
    raw = derived(spark, sf, "raw_gold")
    return raw.select("case_id", F.inline(reshape.spell_anchors(raw)))


@query("education_anchors", oracle(["raw_gold"], f"""
SELECT name_last, CASE WHEN trim(edu_degree) IN ('', 'nan') THEN 'unknown' ELSE trim(edu_degree) END
         AS edu_degree,
       {_truncated('edu_start')} AS edu_start, {_truncated('edu_end')} AS edu_end, subject_index,
       code, uni_name
FROM (
  SELECT *, 1 AS subject_index, uni_subject_1 AS code, nullif(uni_name_1, '') AS uni_name FROM raw_gold
  UNION ALL
  SELECT *, 2 AS subject_index, uni_subject_2 AS code, nullif(uni_name_2, '') AS uni_name FROM raw_gold)
WHERE code NOT IN ('', 'nan')"""))
def education_anchors(spark, sf):
    raw = derived(spark, sf, "raw_gold")
    anchors = raw.select("name_last", reshape.pinned(reshape.education_anchor(raw)).alias("a"))
    return anchors.filter("a is not null").select(
        "name_last", "a.edu_degree", "a.edu_start", "a.edu_end", F.inline("a.subjects"))


@query("spell_lists", oracle(["spell_predictions"], """
SELECT case_id, CAST(count(*) AS INT) AS n,
       string_agg(CAST(pos AS VARCHAR) || ':' || coalesce(CAST(start_year AS VARCHAR), '?'), ',' ORDER BY pos)
         AS listing FROM spell_predictions GROUP BY case_id"""))
def spell_lists(spark, sf):
    rows = derived(spark, sf, "spell_predictions").withColumnRenamed("pos", "spell_index")
    lists = reshape.collect_spells(rows)
    return lists.select("case_id", F.size("spells").alias("n"), F.array_join(F.transform(
        "spells", lambda s: F.concat_ws(":", s["spell_index"].cast("string"),
                                        F.coalesce(s["start_year"].cast("string"), F.lit("?")))),
        ",").alias("listing"))


@query("predicted_spell_cleaning", oracle(["spell_rows"], """
SELECT case_id, CAST(count(*) FILTER (s IS NOT NULL OR e IS NOT NULL) AS INT) AS n_dated,
       CAST(sum(s) AS BIGINT) AS starts, CAST(sum(e) AS BIGINT) AS ends
FROM (SELECT case_id, TRY_CAST(nullif(start_text, '') AS INT) AS s,
             CASE WHEN regexp_full_match(end_text, '[0-9]+') THEN TRY_CAST(end_text AS INT) END AS e
      FROM spell_rows) GROUP BY case_id"""))
def predicted_spell_cleaning(spark, sf):
    rows = derived(spark, sf, "spell_rows").select(
        "case_id", F.col("slot").alias("spell_index"), F.col("start_text").alias("start_year"),
        F.col("end_text").alias("end_year"), F.col("code").alias("position"))
    lists = reshape.collect_spells(rows)
    found = lists.select("case_id", reshape.predicted_spells(lists, "spells").alias("p"))

    def total(field: str):
        values = F.filter(F.transform("p", lambda s: s[field]), lambda y: y.isNotNull())
        return F.when(F.size(values) > 0, F.aggregate(
            values, F.lit(0).cast("long"), lambda a, y: a + y))

    return found.select("case_id", F.size("p").alias("n_dated"), total("start_year").alias("starts"),
                        total("end_year").alias("ends"))


@query("missing_indices", oracle(["spell_rows", "code_predictions"], """
SELECT r.case_id, r.slot AS spell_index FROM spell_rows AS r LEFT JOIN code_predictions AS p
ON r.case_id = p.case_id AND r.slot = p.spell_index WHERE p.case_id IS NULL"""))
def missing_indices(spark, sf):
    expected = derived(spark, sf, "spell_rows").select("case_id", F.col("slot").alias("spell_index"))
    returned = derived(spark, sf, "code_predictions").select("case_id", "spell_index")
    return expected.join(returned, ["case_id", "spell_index"], "left_anti")


@query("unpivot_fields", oracle(["field_predictions"], """
SELECT case_id, variable, value FROM field_predictions
UNPIVOT INCLUDE NULLS (value FOR variable IN (birth_place, sex, edu_start))""".replace(
    "SELECT case_id, variable, value FROM field_predictions",
    "SELECT case_id, variable, value FROM (SELECT case_id, birth_place, sex, edu_start FROM field_predictions)")))
def unpivot_fields(spark, sf):
    from plumbline.operators.atomic import long_values

    return long_values(derived(spark, sf, "field_predictions"), ["birth_place", "sex", "edu_start"])


@query("wide_slot_count", oracle(["raw_gold"], "SELECT case_id, CAST(" + " + ".join(
    f"CASE WHEN trim(career_position_{n}) IN ('', 'nan') THEN 0 ELSE 1 END" for n in SLOTS
) + " AS INT) AS n_spells FROM gold", SQL_GOLD))
def wide_slot_count(spark, sf):
    gold = gold_of(spark, sf)
    return gold.select("case_id", F.size(reshape.spell_slots(gold)).alias("n_spells"))
