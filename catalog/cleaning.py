"""Scans, sinks, cleaners and projections."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, functions as F

from catalog.base import (
    SQL_GOLD, SQL_GOLD_SPLIT, SQL_SILVER, derived, gold_of, oracle, query, scratch, silver_of,
    sql_year, table,
)
from plumbline.functions import text as T
from plumbline.operators import cleaning as C
from plumbline.operators.splits import split_ids
from plumbline.sources import cache, sinks, tables

_GOLD_SHOWN = ["case_id", "country_label", "birth_year", "edu_start", "edu_end", "edu_degree",
               "career_position_3", "career_start_year_3", "career_end_year_3"]


@query("gold_csv_scan", oracle(["raw_gold"], f"SELECT {', '.join(_GOLD_SHOWN)} FROM gold", SQL_GOLD))
def gold_csv_scan(spark, sf):
    path = scratch(spark, "gold")
    derived(spark, sf, "raw_gold").write.csv(path, sep=";", header=True, escape='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False)
    return tables.load_gold(spark, path, "csv").select(*_GOLD_SHOWN)


@query("separator_detection", oracle(["raw_gold"], """
SELECT s.sep AS separator, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(nullif(missing_type, '')) AS BIGINT) AS n_flagged
FROM raw_gold, (VALUES (';'), (',')) AS s(sep) GROUP BY s.sep"""))
def separator_detection(spark, sf):
    parts = []
    for sep in (";", ","):
        path = scratch(spark, "cases")
        derived(spark, sf, "raw_gold").write.csv(path, sep=sep, header=True, escape='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False)
        found = tables.detect_separator(spark, path)
        parts.append(tables.load_raw_cases(spark, path).agg(
            F.lit(found).alias("separator"), F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("missing_type") != "").alias("n_flagged")))
    return parts[0].unionByName(parts[1])


_COPIES_SQL = """
copies AS (SELECT * REPLACE (CASE WHEN copy = 1 THEN 'copy of ' || job_title ELSE job_title END AS job_title),
    2 * CAST(name_last AS BIGINT) + CASE WHEN substr(md5(name_last), 9, 1) < '8' THEN copy ELSE 1 - copy END AS pos
  FROM raw_gold, (SELECT unnest([0, 1]) AS copy))"""


# Every case stands twice in a folder of several files; the row that comes first in them stays.
@query("first_case_in_source_order", oracle(["raw_gold"], """
SELECT case_id, arg_min(name_last, pos) AS name_last, arg_min(job_title, pos) AS job_title,
       arg_min(cv_links, pos) AS cv_links FROM copies
WHERE trim(case_id) <> '' AND trim(missing_type) = '' GROUP BY case_id""", _COPIES_SQL))
def first_case_in_source_order(spark, sf):
    swapped = F.when(F.substring(F.md5("name_last"), 9, 1) < "8", F.col("copy")).otherwise(1 - F.col("copy"))
    rows = derived(spark, sf, "raw_gold").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({
        "job_title": F.when(F.col("copy") == 1, F.concat(F.lit("copy of "), "job_title")).otherwise(F.col("job_title")),
        "at": 2 * F.col("name_last").cast("long") + swapped})
    path = scratch(spark, "ordered-cases")
    rows.repartitionByRange(4, "at").sortWithinPartitions("at").drop("at", "copy").write.csv(
        path, sep=";", header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return C.load_cases(tables.load_raw_cases(spark, path), "_order").select(
        "case_id", "name_last", "job_title", "cv_links")


_SILVER_SHOWN = ["case_id", "spell_index", "career_position", "job_description_label",
                 "uni_subject", "subject_label"]


@query("silver_csv_scan", oracle(["raw_silver", "raw_silver_edu"],
                                 f"SELECT {', '.join(_SILVER_SHOWN)} FROM silver", SQL_SILVER))
def silver_csv_scan(spark, sf):
    career, education = scratch(spark, "silver"), scratch(spark, "silver-edu")
    derived(spark, sf, "raw_silver").write.csv(career, header=True, escape='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False)
    derived(spark, sf, "raw_silver_edu").write.csv(education, header=True, escape='"', ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False)
    return tables.load_silver(spark, career, education, "csv").select(*_SILVER_SHOWN)


@query("silver_append_sink", oracle(["raw_silver"], """
SELECT spell_index, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT case_id) AS BIGINT) AS n_cases
FROM raw_silver GROUP BY spell_index"""))
def silver_append_sink(spark, sf):
    path = scratch(spark, "silver-out")
    rows = derived(spark, sf, "raw_silver")
    sinks.append_silver(rows.filter("spell_index = 'x'"), path)
    sinks.append_silver(rows.filter("spell_index <> 'x'"), path)
    return spark.read.parquet(path).groupBy("spell_index").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("case_id").alias("n_cases"))


@query("failures_overwrite_sink", oracle(["raw_gold"], """
SELECT case_id, 'ALL' AS spell_index, 'no_cv_text' AS reason FROM raw_gold
WHERE trim(cv_local) = 'nan'"""))
def failures_overwrite_sink(spark, sf):
    path = scratch(spark, "failures")
    gold = derived(spark, sf, "raw_gold")

    def failure(rows: DataFrame, reason: str) -> DataFrame:
        return rows.select("case_id", F.lit("ALL").alias("spell_index"), F.lit(reason).alias("reason"))

    sinks.write_failures(failure(gold, "api_call_failed_all_retries"), path)
    sinks.write_failures(
        failure(gold.filter(T.is_blank(F.col("cv_local"))), "no_cv_text"), path)
    return spark.read.parquet(path)


@query("register_append_and_scan", """
SELECT CAST(doc_id AS VARCHAR) AS run, source AS model, 'extraction' AS task,
       trim(regexp_replace(text, '[\\n\\r\\x0b\\f]', ' ', 'g'), ' ' || chr(9)) AS model_notes,
       CAST(n_chars AS VARCHAR) AS n_evaluated FROM documents""")
def register_append_and_scan(spark, sf):
    docs = table(spark, sf, "documents")
    path = scratch(spark, "register")
    summary = docs.select(
        "doc_id", "source", "text", F.col("n_chars").alias("n_evaluated"),
        F.lit(0).alias("n_skipped"), F.lit(1.0).alias("accuracy"))
    rows = sinks.register_row(summary, "extraction", "sex", F.lit("{}"), timestamp=F.lit("t"))
    keyed = summary.select(
        *[F.col(c) for c in ("doc_id", "source")], T.one_line(F.col("text")).alias("notes"),
        F.col("n_evaluated").cast("string"))
    full = keyed.select(*[
        {"experiment_path": F.concat(F.lit("runs/"), F.col("doc_id"), F.lit("/c.yaml")),
         "model": F.col("source"), "model_notes": F.col("notes"), "task": F.lit("extraction"),
         "n_evaluated": F.col("n_evaluated")}.get(c, F.lit("")).alias(c) for c in rows.columns])
    sinks.append_register(full.filter("source < 'src2'"), path)
    sinks.append_register(full.filter("source >= 'src2'"), path)
    return sinks.read_register(spark, path).select(
        T.experiment_folder(F.col("experiment_path")).alias("run"), "model", "task",
        F.coalesce("model_notes", F.lit("")).alias("model_notes"), "n_evaluated")


def _length_encoder():
    """A stand-in encoder: text length and number of blanks."""
    return lambda texts: [np.array([len(t), t.count(" ")], dtype=np.float32) for t in texts]


@query("embedding_cache", """
SELECT p_name AS text, CAST(length(p_name) AS DOUBLE) AS x, 
       CAST(length(p_name) - length(replace(p_name, ' ', '')) AS DOUBLE) AS y
FROM (SELECT DISTINCT p_name FROM part)""")
def embedding_cache(spark, sf):
    from plumbline.operators.model_jobs import embed

    path = scratch(spark, "vectors")
    names = table(spark, sf, "part").select(F.col("p_name").alias("text"), "p_size")
    result = None
    for wanted in (names.filter("p_size < 20"), names):  # the second run finds the first cached
        result = cache.through_cache(
            wanted, ["text"], path, "text string, vector array<float>",
            lambda missing: embed(missing, "text", _length_encoder))
    return result.select("text", F.col("vector")[0].cast("double").alias("x"),
                         F.col("vector")[1].cast("double").alias("y"))


def _search_worker():
    def fetch(text: str) -> list[str]:
        return [] if "1" in text else [text.upper(), "note"]

    def summarise(snippets: list[str], text: str) -> str:
        return f"{snippets[0]} ({len(snippets)})"

    return fetch, summarise


@query("response_cache", """
SELECT DISTINCT p_brand, p_type, CASE WHEN contains(p_brand, '1') THEN 'NA'
       ELSE upper(p_type || ' ' || p_brand) || ' (2)' END AS summary FROM part""")
def response_cache(spark, sf):
    from plumbline.operators.model_jobs import fetch_and_summarise

    path = scratch(spark, "answers")
    parts = table(spark, sf, "part")
    result = None
    for wanted in (parts.filter("p_size > 30"), parts):
        result = cache.through_cache(
            wanted, ["p_brand", "p_type"], path,
            "p_brand string, p_type string, snippets array<string>, summary string, error string",
            lambda missing: fetch_and_summarise(
                missing, F.concat_ws(" ", "p_type", "p_brand"), _search_worker), error="error")
    return result.drop("snippets", "error")


@query("fetch_and_summarise", """
SELECT DISTINCT p_brand, CASE WHEN contains(p_brand, '1') THEN 0 ELSE 2 END AS n_snippets,
       CASE WHEN contains(p_brand, '1') THEN 'NA' ELSE upper(p_brand) || ' (2)' END AS summary
FROM part""")
def fetch_summaries(spark, sf):
    from plumbline.operators.model_jobs import fetch_and_summarise

    keys = table(spark, sf, "part").select("p_brand")
    return fetch_and_summarise(keys, F.col("p_brand"), _search_worker).select(
        "p_brand", F.size("snippets").alias("n_snippets"), "summary")


@query("blank_key_drop", oracle(["raw_gold"], """
SELECT case_id, name_last FROM raw_gold WHERE trim(case_id) <> ''"""))
def blank_key_drop(spark, sf):
    return C.drop_blank_keys(derived(spark, sf, "raw_gold")).select("case_id", "name_last")


@query("flagged_row_drop", oracle(["raw_gold"], """
SELECT name_last, missing_type FROM raw_gold WHERE trim(missing_type) = ''"""))
def flagged_row_drop(spark, sf):
    return C.drop_flagged(derived(spark, sf, "raw_gold")).select("name_last", "missing_type")


@query("drop_counts", oracle(["raw_gold", "raw_silver"], """
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(*) FILTER (trim(case_id) = '') AS BIGINT) AS blank_key,
       CAST(count(*) FILTER (trim(case_id) <> '' AND trim(missing_type) <> '') AS BIGINT) AS flagged,
       (SELECT CAST(count(*) AS BIGINT) FROM raw_silver WHERE case_id NOT IN (
          SELECT case_id FROM raw_gold WHERE trim(case_id) <> '' AND trim(missing_type) = '')) AS not_in_gold
FROM raw_gold"""))
def drop_counts(spark, sf):
    raw = derived(spark, sf, "raw_gold")
    report = C.DropReport()
    kept = C.drop_flagged(C.drop_blank_keys(raw, report=report), report=report)
    n_kept = kept.count()
    counts = report.counts()
    joined = C.DropReport()
    silver = derived(spark, sf, "raw_silver")
    C.semi_by_id(silver, kept, report=joined, step="not_in_gold").count()
    return raw.agg(F.count(F.lit(1)).alias("n_rows")).filter(
        F.col("n_rows") == n_kept + sum(counts.values())
    ).select("n_rows", *[F.lit(v).cast("long").alias(k)
                         for k, v in {**counts, **joined.counts()}.items()])


@query("year_coercion", oracle(["raw_gold"], f"""
SELECT name_last, {sql_year('birth_year')} AS birth_year, {sql_year('edu_end')} AS edu_end,
       {sql_year('career_end_year_2')} AS career_end_year_2 FROM raw_gold"""))
def year_coercion(spark, sf):
    return C.coerce_years(derived(spark, sf, "raw_gold")).select(
        "name_last", "birth_year", "edu_end", "career_end_year_2")


@query("spell_index_coercion", oracle(["raw_silver"], """
SELECT case_id, TRY_CAST(spell_index AS INT) AS spell_index, job_description_label FROM raw_silver
WHERE spell_index <> 'x' OR trim(job_description_label) = ''"""))
def spell_index_coercion(spark, sf):
    return C.coerce_spell_index(derived(spark, sf, "raw_silver")).select(
        "case_id", "spell_index", "job_description_label")


@query("duplicated_case_drop", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (
  SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def duplicated_case_drop(spark, sf):
    return C.drop_duplicated_cases(
        table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"),
        "l_orderkey", "l_linenumber", {"line": F.lit(True)})


@query("duplicated_keys", """
SELECT DISTINCT l_orderkey FROM (
  SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'
  GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def duplicated_keys(spark, sf):
    return C.duplicated_keys(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber",
                             F.col("l_returnflag") == "R")


@query("unique_column_check", oracle(["raw_gold"], """
SELECT country_label, CAST(count(*) AS BIGINT) AS n FROM raw_gold GROUP BY country_label"""))
def unique_column_check(spark, sf):
    checked = C.check_unique_columns(derived(spark, sf, "raw_gold"))
    return checked.groupBy("country_label").agg(F.count(F.lit(1)).alias("n"))


@query("first_row_per_case", """
SELECT CAST(user_id AS VARCHAR) AS case_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events
  WHERE event_type <> 'error') WHERE rn = 1 AND user_id IN (SELECT c_custkey FROM customer)""")
def first_row_per_case(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("case_id"), "event_id", "event_type", "value",
        F.when(F.col("event_type") == "error", "1 = error").otherwise("").alias("missing_type"))
    ids = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("case_id"))
    return C.load_cases(events, "event_id", ids).drop("missing_type")


@query("blank_text_drop", oracle(["raw_gold"], """
SELECT case_id, cv_local FROM raw_gold WHERE trim(cv_local) NOT IN ('', 'nan', '<NA>')"""))
def blank_text_drop(spark, sf):
    return C.drop_blank_text(derived(spark, sf, "raw_gold"), "cv_local").select("case_id", "cv_local")


@query("feature_projection", oracle(["raw_gold"], """
SELECT case_id, sex, cv_local FROM raw_gold"""))
def feature_projection(spark, sf):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return C.select_features(derived(spark, sf, "raw_gold"), ["sex", "cv_local", "no_such"])


@query("atomic_column", oracle(["raw_gold"], "SELECT case_id, edu_start FROM gold", SQL_GOLD))
def atomic_column(spark, sf):
    return C.atomic_column(gold_of(spark, sf), "edu_start")


@query("annotation_inputs", oracle(["raw_gold", "raw_silver", "raw_silver_edu"], """
SELECT case_id, spell_index, job_description_label, workplace_label, career_position FROM silver
WHERE trim(job_description_label) <> '' AND case_id IN (SELECT case_id FROM gold)""",
                                    SQL_GOLD + "," + SQL_SILVER))
def annotation_inputs(spark, sf):
    return C.annotation_inputs(silver_of(spark, sf), "career_position", gold_of(spark, sf))


@query("union_filled", oracle(["raw_silver", "raw_silver_edu"], """
SELECT case_id, spell_index, career_position, '' AS uni_subject FROM raw_silver
UNION ALL SELECT case_id, spell_index, '', uni_subject FROM raw_silver_edu"""))
def union_filled(spark, sf):
    return C.union_filled(
        derived(spark, sf, "raw_silver"), derived(spark, sf, "raw_silver_edu")
    ).select("case_id", "spell_index", "career_position", "uni_subject")


@query("split_semi_join", oracle(["raw_gold"], """
SELECT case_id, country_label, edu_start FROM gold
WHERE case_id IN (SELECT case_id FROM sides WHERE split = 'test')""", SQL_GOLD_SPLIT))
def split_semi_join(spark, sf):
    gold = gold_of(spark, sf)
    return C.semi_by_id(gold, split_ids(gold, "test")).select("case_id", "country_label", "edu_start")


@query("resume_anti_join", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (
  SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')""")
def resume_anti_join(spark, sf):
    done = table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(
        F.col("l_orderkey").alias("o_orderkey"))
    return C.anti_by_id(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, "o_orderkey")


@query("retry_semi_join", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (
  SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F')""")
def retry_semi_join(spark, sf):
    failed = table(spark, sf, "lineitem").filter("l_returnflag = 'R' AND l_linestatus = 'F'").select(
        F.col("l_orderkey").alias("o_orderkey"))
    return C.semi_by_id(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey"), failed, "o_orderkey")


@query("joined_text", """
SELECT c_custkey, c_mktsegment || ' | ' || coalesce(n_name, '') AS input_text
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3""")
def joined_text(spark, sf):
    nations = table(spark, sf, "nation").filter("n_regionkey < 3")
    return table(spark, sf, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    ).dropna(subset=["c_mktsegment"]).select(
        "c_custkey", T.joined_text(F.col("c_mktsegment"), F.col("n_name")).alias("input_text"))
