"""Model-output jobs with deterministic stand-ins for the model."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from catalog.base import derived, oracle, query, table
from plumbline.operators import cleaning as C, model_jobs as M, splits
from plumbline.operators.classification import label_index
from plumbline.operators.reshape import education_anchor, pinned, spell_anchors
from plumbline.plans.silver import build_silver

# --- answers for reconcile, made in SQL so that the oracle can make them too --------------

_ANSWER_ITEM = """CASE WHEN h2 < '8' THEN '{"spell_index": ' || slot || ', "job_description_label": "job ' || slot
    || '", "workplace_label": null, "extraction_failed": false}'
  WHEN h2 < 'a' THEN '{"spell_index": ' || slot || ', "job_description_label": null, "workplace_label": null}'
  WHEN h2 < 'c' THEN '{"spell_index": ' || slot || ', "job_description_label": "x", "extraction_failed": true}'
  WHEN h2 < 'd' THEN '{"spell_index": "' || slot || '", "job_description_label": "text index"}'
  ELSE '{"spell_index": ' || (slot + 900) || ', "job_description_label": "unasked"}' END"""
_ASKED = """
asked AS (SELECT case_id, slot, code, h2 FROM spell_rows
          WHERE (start_text <> '' OR end_text <> '') AND case_id IN (SELECT case_id FROM raw_gold)),
silent AS (SELECT case_id FROM asked WHERE substr(md5(case_id), 1, 1) = '0')"""
_RECONCILE_TABLES = ["raw_gold", "spell_rows"]


def _reconciled(spark, sf):
    raw = derived(spark, sf, "raw_gold").filter("trim(case_id) <> ''")
    anchors = raw.select("case_id", pinned(spell_anchors(raw)).alias("anchors")).filter("size(anchors) > 0")
    items = derived(spark, sf, "spell_rows").select("case_id", "slot", F.expr(_ANSWER_ITEM).alias("item"))
    # At most one item per calendar year of the data.
    answers = items.groupBy("case_id").agg(F.concat(
        F.lit('{"spells": ['), F.array_join(F.array_sort(F.collect_list("item")), ", "), F.lit("]}"))
        .alias("answer"))
    silent = F.substring(F.md5("case_id"), 1, 1) == "0"
    rows = anchors.join(answers, "case_id").withColumn("response", F.when(~silent, F.col("answer")))
    return M.reconcile(rows, "anchors")


@query("reconcile_silver", oracle(_RECONCILE_TABLES, """
SELECT case_id, slot AS spell_index, code AS career_position, 'job ' || slot AS job_description_label,
       '' AS workplace_label FROM asked WHERE h2 < '8' AND case_id NOT IN (SELECT case_id FROM silent)""", _ASKED))
def reconcile_silver(spark, sf):
    return _reconciled(spark, sf)[0]


@query("reconcile_failures", oracle(_RECONCILE_TABLES, """
SELECT case_id, CAST(slot AS VARCHAR) AS spell_index,
  CASE WHEN case_id IN (SELECT case_id FROM silent) THEN 'api_call_failed_all_retries'
       WHEN h2 < 'c' THEN 'extraction_failed_by_model' ELSE 'spell_not_returned_by_model' END AS reason
FROM asked WHERE h2 >= '8' OR case_id IN (SELECT case_id FROM silent)""", _ASKED))
def reconcile_failures(spark, sf):
    return _reconciled(spark, sf)[1]


@query("reconcile_subjects", oracle(["raw_silver_edu", "raw_gold"], """
SELECT case_id, CAST(spell_index AS INT) AS spell_index, uni_subject, 'Label ' || uni_subject AS subject_label
FROM raw_silver_edu WHERE spell_index = '1'"""))
def reconcile_subjects(spark, sf):
    raw = derived(spark, sf, "raw_gold").filter("trim(case_id) <> ''")
    rows = raw.select("case_id", pinned(education_anchor(raw)).alias("a")).filter("a is not null").select(
        "case_id", F.col("a.subjects").alias("subjects"))
    response = F.concat(F.lit('{"subjects": [{"subject_index": 1, "subject_label": "Label '),
                        F.col("subjects")[0]["code"], F.lit('"}]}'))
    only_second = F.col("subjects")[0]["subject_index"] == 2
    rows = rows.withColumn("response", F.when(only_second, F.lit('{"subjects": []}')).otherwise(response))
    return M.reconcile(rows, "subjects", mode="education")[0]


# --- model calls ----------------------------------------------------------------------------

def _flaky_client():
    """Answers in JSON; fails for some texts, and once for others."""
    seen: set[str] = set()

    def call(system: str, prompt: str) -> str:
        if "Brand#1" in prompt:
            raise RuntimeError("refused")
        if prompt not in seen and "bolt" in prompt:
            seen.add(prompt)
            return "not json"
        return "```json\n" + json.dumps({"n": len(prompt), "system": system}) + "\n```"

    return call


@query("model_calls", """
SELECT p_partkey, contains(p_brand, 'Brand#1') AS failed,
  CASE WHEN NOT contains(p_brand, 'Brand#1') THEN CAST(length(p_name || ' ' || p_brand) AS VARCHAR) END AS n
FROM part""")
def model_calls(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("prompt"))
    answered = M.call_model(parts, "prompt", "s", _flaky_client, retries=3, wait=0.0)
    return answered.select("p_partkey", F.col("error").isNotNull().alias("failed"),
                           F.get_json_object("response", "$.n").alias("n"))


@query("model_classification", """
SELECT p_partkey, CASE WHEN contains(p_brand, 'Brand#1') THEN '' WHEN contains(p_name, 'bolt') THEN 'not json'
  ELSE upper(p_name) END AS response FROM part""")
def model_classification(spark, sf):
    def client():
        def call(system: str, prompt: str) -> str:
            if "Brand#1" in prompt:
                raise RuntimeError("refused")
            return "not json" if "bolt" in prompt else prompt.split(" Brand")[0].upper()

        return call

    parts = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("prompt"))
    return M.classify(parts, "prompt", "s", client).select("p_partkey", "response")


@query("distinct_text_embedding", """
SELECT DISTINCT p_name AS text, CAST(length(p_name) AS DOUBLE) AS x FROM part""")
def distinct_text_embedding(spark, sf):
    def encoder():
        return lambda texts: [[len(t), 1.0] for t in texts]

    names = table(spark, sf, "part").select(F.col("p_name").alias("text"))
    return M.embed(names, "text", encoder).select("text", F.col("vector")[0].cast("double").alias("x"))


@query("encoder_scoring", """
SELECT p_partkey, label AS predicted_code FROM part JOIN (
  SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT p_type AS label FROM part))
ON id = length(p_name) % 3""")
def encoder_scoring(spark, sf):
    def scorer():
        return lambda texts: [[1.0 if i == len(t) % 3 else 0.5 for i in range(6)] for t in texts]

    parts = table(spark, sf, "part")
    scored = M.score_labels(parts.select("p_partkey", "p_name"), "p_name", scorer, label_index(parts, "p_type"))
    return scored.select("p_partkey", "predicted_code")


# --- silver builds ---------------------------------------------------------------------------

def _reading_client():
    """Answers every asked anchor from its own line; index 3 is forgotten."""
    line = re.compile(r"- (spell|subject)_index (\d+): (.*)")

    def call(system: str, prompt: str) -> str:
        spells, subjects = [], []
        for kind, index, rest in line.findall(prompt):
            if kind == "spell" and index != "3":
                spells.append({"spell_index": int(index), "job_description_label": rest[:4],
                               "workplace_label": None, "extraction_failed": index == "5"})
            elif kind == "subject":
                subjects.append({"subject_index": int(index), "subject_label": rest[:2]})
        return json.dumps({"spells": spells, "subjects": subjects})

    return call


def _cases(spark, sf):
    raw = derived(spark, sf, "raw_gold").withColumn("_order", F.col("name_last").cast("long"))
    raw = raw.withColumn("cv_english", F.col("cv_local"))
    return C.load_cases(raw, "_order")


_BUILD = """
cases AS (SELECT * FROM raw_gold WHERE trim(case_id) <> '' AND trim(missing_type) = ''),
spoken AS (SELECT r.*, substr(coalesce(nullif(start_text, ''), '?') || ' – ', 1, 4) AS shown
           FROM spell_rows AS r JOIN cases AS c USING (case_id)
           WHERE (start_text <> '' OR end_text <> '') AND trim(cv_local) NOT IN ('', 'nan'))"""
_BUILD_TABLES = ["raw_gold", "spell_rows"]


@query("career_silver_build", oracle(_BUILD_TABLES, """
SELECT case_id, slot AS spell_index, code AS career_position, shown AS job_description_label,
       '' AS workplace_label FROM spoken WHERE slot NOT IN (3, 5)""", _BUILD))
def career_silver_build(spark, sf):
    return build_silver(_cases(spark, sf), _reading_client, wait=0.0).silver


_FAILED = """
failed AS (
  SELECT case_id, 'ALL' AS spell_index, 'no_cv_text' AS reason FROM cases WHERE trim(cv_local) IN ('', 'nan')
  UNION ALL
  SELECT case_id, CAST(slot AS VARCHAR), CASE slot WHEN 3 THEN 'spell_not_returned_by_model'
         ELSE 'extraction_failed_by_model' END FROM spoken WHERE slot IN (3, 5))"""


@query("career_silver_failures", oracle(_BUILD_TABLES, "SELECT * FROM failed", _BUILD + "," + _FAILED))
def career_silver_failures(spark, sf):
    return build_silver(_cases(spark, sf), _reading_client, wait=0.0).failures


@query("career_silver_retry", oracle(_BUILD_TABLES, """
SELECT case_id, spell_index, reason FROM failed WHERE spell_index = 'ALL'
UNION ALL SELECT case_id, spell_index, 'done' FROM failed WHERE spell_index <> 'ALL'""", _BUILD + "," + _FAILED))
def career_silver_retry(spark, sf):
    def patient_client():
        def call(system: str, prompt: str) -> str:
            found = re.findall(r"- spell_index (\d+):", prompt)
            return json.dumps({"spells": [
                {"spell_index": int(i), "job_description_label": "done"} for i in found]})

        return call

    cases = _cases(spark, sf)
    first = build_silver(cases, _reading_client, wait=0.0)
    second = build_silver(cases, patient_client, failed=first.failures, wait=0.0)
    done = second.silver.select("case_id", F.col("spell_index").cast("string"),
                                F.col("job_description_label").alias("reason"))
    return second.failures.unionByName(done)


@query("education_silver_build", oracle(["raw_gold", "raw_silver_edu"], """
SELECT case_id, CAST(e.spell_index AS INT) AS spell_index, e.uni_subject, substr(e.uni_subject, 1, 2) AS subject_label
FROM raw_silver_edu AS e JOIN raw_gold AS g USING (case_id)
WHERE trim(missing_type) = '' AND trim(cv_local) NOT IN ('', 'nan')"""))
def education_silver_build(spark, sf):
    return build_silver(_cases(spark, sf), _reading_client, "education", wait=0.0).silver


@query("resumed_silver_build", oracle(_BUILD_TABLES, """
SELECT case_id, CAST(count(*) AS BIGINT) AS n FROM spoken WHERE slot NOT IN (3, 5)
AND case_id NOT IN (SELECT case_id FROM spell_rows WHERE h1 = '0') GROUP BY case_id""", _BUILD))
def resumed_silver_build(spark, sf):
    done = derived(spark, sf, "spell_rows").filter("h1 = '0'").select("case_id")
    built = build_silver(_cases(spark, sf), _reading_client, done=done, wait=0.0)
    return built.silver.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


@query("few_shot_messages", """
SELECT c_custkey, 8 AS n_messages FROM customer""")
def few_shot_messages(spark, sf):
    from plumbline.functions.prompts import message_list, user_turn

    customers = table(spark, sf, "customer")
    pool = splits.few_shot_pool(customers, "c_mktsegment", F.col("c_custkey"), 3)
    # Three rows: the pool holds the wanted number of shots.
    shots = pool.agg(F.collect_list(F.struct(
        user_turn(F.col("c_name"), F.col("c_mktsegment")).alias("user"),
        F.col("c_mktsegment").alias("assistant")))).scalar()
    rows = customers.withColumn("_shots", shots)
    messages = message_list(F.lit("s"), F.col("_shots"), user_turn(F.col("c_name"), F.col("c_mktsegment")))
    return rows.select("c_custkey", messages.alias("m")).select("c_custkey", F.size("m").alias("n_messages"))
