"""Scalar functions, parsing, prompts and code resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import derived, oracle, query, sql_normal, sql_similarity, table
from plumbline import registry as R
from plumbline.functions import parsing as P, prompts, text as T
from plumbline.operators import codes


@query("normalise_values", oracle(["raw_gold"], f"""
SELECT name_last, {sql_normal('birth_year')} AS birth_year, {sql_normal('birth_place')} AS birth_place,
       {sql_normal('edu_degree')} AS edu_degree FROM raw_gold"""))
def normalise_values(spark, sf):
    return derived(spark, sf, "raw_gold").select(
        "name_last", *[T.normalise_value(F.col(c)).alias(c)
                       for c in ("birth_year", "birth_place", "edu_degree")])


_SQL_CHARS = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\([^\n]*?\)', '', 'g'),
  '[''\-.,/"]', '', 'g'), '\s+', ' ', 'g'))"""


@query("normalise_chars", f"""
SELECT doc_id, {_SQL_CHARS.format('text')} AS plain FROM documents""")
def normalise_chars(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.normalise_chars(F.col("text")).alias("plain"))


@query("char_similarity", oracle([], """
SELECT p_name, p_type, CAST(count(*) AS BIGINT) AS n, round_even(any_value(sim), 6) AS similarity
FROM part JOIN alike ON x = p_name AND y = p_type GROUP BY p_name, p_type""",
                                 "wanted AS (SELECT p_name AS x, p_type AS y FROM part),"
                                 + sql_similarity("wanted"), recursive=True))
def char_similarity(spark, sf):
    parts = table(spark, sf, "part").groupBy("p_name", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return parts.select(
        "p_name", "p_type", "n",
        T.metric(T.char_similarity(F.col("p_name"), F.col("p_type"))).alias("similarity"))


@query("sector_collapse", oracle(["code_predictions"], r"""
SELECT case_id, spell_index, CASE WHEN regexp_full_match(trim(split_part(predicted_code, '=', 1)), '[0-9]+')
  THEN substr(trim(split_part(predicted_code, '=', 1)), 1, 1) ELSE predicted_code END AS sector
FROM code_predictions"""))
def sector_collapse(spark, sf):
    return derived(spark, sf, "code_predictions").select(
        "case_id", "spell_index", T.sector(F.col("predicted_code")).alias("sector"))


@query("code_prefix", oracle(["raw_silver_edu"], r"""
SELECT o_orderkey AS id, coalesce(nullif(regexp_extract(trim(o_orderpriority), '^([0-9]+)', 1), ''),
       o_orderpriority) AS prefix FROM orders
UNION ALL
SELECT CAST(case_id AS BIGINT) AS id, coalesce(nullif(regexp_extract(trim(uni_subject), '^([0-9]+)', 1), ''),
       uni_subject) AS prefix FROM raw_silver_edu"""))
def code_prefix(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), T.numeric_prefix(F.col("o_orderpriority")).alias("prefix"))
    subjects = derived(spark, sf, "raw_silver_edu").select(
        F.col("case_id").cast("long").alias("id"), T.numeric_prefix(F.col("uni_subject")).alias("prefix"))
    return orders.unionByName(subjects)


@query("degree_prefix", oracle(["raw_gold"], r"""
SELECT name_last, coalesce(nullif(regexp_extract(edu_degree, '^\s*([0-9]+)', 1), ''), edu_degree)
  AS degree FROM raw_gold"""))
def degree_prefix(spark, sf):
    return derived(spark, sf, "raw_gold").select(
        "name_last", T.degree_prefix(F.col("edu_degree")).alias("degree"))


@query("pipe_sets", r"""
SELECT page_id, CAST(len(parts) AS INT) AS n_parts, list_aggregate(list_sort(parts), 'string_agg', '|')
  AS parts FROM (
  SELECT page_id, list_distinct(list_filter(list_transform(
    string_split(regexp_replace(url, '[/?&=.]', ' | ', 'g'), '|'), lambda x: trim(x)), lambda x: x <> ''))
    AS parts FROM pages)""")
def pipe_sets(spark, sf):
    parts = T.pipe_set(F.regexp_replace("url", "[/?&=.]", " | "))
    return table(spark, sf, "pages").select(
        "page_id", F.size(parts).alias("n_parts"), F.array_join(F.array_sort(parts), "|").alias("parts"))


@query("positive_years", oracle(["spell_rows"], r"""
SELECT case_id, slot, CASE WHEN regexp_full_match(trim(end_text), '[+-]?[0-9]+')
    AND TRY_CAST(end_text AS INT) > 0 THEN TRY_CAST(end_text AS INT) END AS end_year,
  CASE WHEN slot - 3 > 0 THEN slot - 3 END AS shifted FROM spell_rows"""))
def positive_years(spark, sf):
    return derived(spark, sf, "spell_rows").select(
        "case_id", "slot", T.positive_int(F.col("end_text")).alias("end_year"),
        T.positive_int(F.col("slot") - 3, numeric=True).alias("shifted"))


_SECTOR_VALUES = ", ".join(
    "('{}', '{}')".format(k, v.replace("'", "''")) for k, v in R.SECTORS.items())


@query("sector_labels", oracle(["spell_rows"], f"""
SELECT substr(code, 1, 1) AS sector, min(substr(code, 1, 1) || ' = ' || s.label) AS shown,
       CAST(count(*) AS BIGINT) AS n
FROM spell_rows LEFT JOIN (VALUES {_SECTOR_VALUES}) AS s(k, label) ON s.k = substr(code, 1, 1)
GROUP BY substr(code, 1, 1)"""))
def sector_labels(spark, sf):
    rows = derived(spark, sf, "spell_rows").select(T.sector(F.col("code")).alias("sector"))
    counted = rows.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("shown", prompts.sector_label(F.col("sector")))


@query("experiment_folders", """
SELECT page_id, CASE WHEN len(string_split(replace(url, '\\', '/'), '/')) >= 2
  THEN list_extract(string_split(replace(url, '\\', '/'), '/'), -2) ELSE url END AS folder,
  host AS one_part FROM (SELECT *, split_part(url, '/', 3) AS host FROM pages)""")
def experiment_folders(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", T.experiment_folder(F.col("url")).alias("folder"),
        T.experiment_folder(F.split_part("url", F.lit("/"), F.lit(3))).alias("one_part"))


_ANSWER = """CASE event_type WHEN 'click' THEN '```json' || chr(10) || props || chr(10) || '```'
  WHEN 'view' THEN 'The answer is ' || props || ' as asked' WHEN 'error' THEN '{"k": ' || '}'
  WHEN 'signup' THEN props ELSE 'no answer' END"""


@query("json_objects", """
SELECT event_id, CASE WHEN event_type IN ('click', 'view', 'signup')
  THEN json_extract_string(props, '$.k') END AS k FROM events""")
def json_objects(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.expr(_ANSWER.replace(
        "chr(10)", "'\\n'")).alias("answer"))
    return events.select("event_id", P.json_field(P.json_object(F.col("answer")), "k").alias("k"))


@query("fenced_answers", """
SELECT event_id, CASE event_type WHEN 'click' THEN props WHEN 'view' THEN 'The answer is ' || props || ' as asked'
  WHEN 'error' THEN '{"k": }' WHEN 'signup' THEN props ELSE 'no answer' END AS body FROM events""")
def fenced_answers(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.expr(_ANSWER.replace(
        "chr(10)", "'\\n'")).alias("answer"))
    return events.select("event_id", P.fenced_body(F.col("answer")).alias("body"))


@query("json_spells", """
SELECT event_id, CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS n,
  CASE WHEN event_type IN ('click', 'view') AND k > 0 THEN k END AS start_year,
  CASE WHEN event_type = 'click' THEN 'p' || k END AS position
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""")
def json_spells(spark, sf):
    k = F.get_json_object("props", "$.k")
    answer = (
        F.when(F.col("event_type") == "click", F.concat(
            F.lit('```json\n[{"start_year": "'), k, F.lit('", "end_year": null, "position": "p'), k,
            F.lit('"}, "noise", {"start_year": 1990.5}]\n```')))
        .when(F.col("event_type") == "view", F.concat(
            F.lit('Here: [{"start_year": '), k, F.lit(".7}] done")))
        .when(F.col("event_type") == "error", F.lit("[{broken]"))
        .otherwise(F.col("props")))
    spells = P.json_spells(answer)
    first = F.try_element_at(spells, F.lit(1))
    return table(spark, sf, "events").select(
        "event_id", F.size(spells).alias("n"), first["start_year"].alias("start_year"),
        first["position"].alias("position"))


# --- code resolution -----------------------------------------------------------

_VOCAB = "vocab AS (SELECT DISTINCT code FROM spell_rows)"
_FREE_TEXT = """CASE WHEN h2 < '3' THEN ' "' || code || '" ' WHEN h2 < '6' THEN 'Code ' || substr(code, 1, 3) || '.'
  WHEN h2 < '9' THEN 'it is ' || upper(split_part(code, ' = ', 2)) || ' clearly'
  WHEN h2 < 'b' THEN substr(split_part(code, ' = ', 2), 2, 4)
  WHEN h2 < 'd' THEN 'x' || substr(code, 1, 3) || 'y' WHEN h2 = 'd' THEN ' ' ELSE 'none of these' END"""


def _free_text(spark, sf):
    rows = derived(spark, sf, "spell_rows")
    return rows.select("case_id", "slot", F.expr(_FREE_TEXT).alias("answer")), rows.select(
        F.col("code").alias("label"))


@query("resolve_codes_fine", oracle(["spell_rows"], r"""
SELECT case_id, slot, coalesce(
  (SELECT code FROM vocab WHERE code = t),
  (SELECT full_code FROM numbers WHERE regexp_matches(t, '\b' || num || '\b') ORDER BY first_code LIMIT 1),
  (SELECT min(code) FROM vocab WHERE contains(lower(t), lower(split_part(code, ' = ', 2)))
     OR contains(lower(split_part(code, ' = ', 2)), lower(t))), t) AS predicted_code
FROM answers""", _VOCAB + f""",
numbers AS (SELECT split_part(code, ' = ', 1) AS num, min(code) AS first_code, max(code) AS full_code
            FROM vocab GROUP BY 1),
answers AS (SELECT case_id, slot, trim(trim({_FREE_TEXT}), '"''') AS t FROM spell_rows)"""))
def resolve_codes_fine(spark, sf):
    answers, vocab = _free_text(spark, sf)
    return codes.resolve_codes(answers, "answer", vocab, "fine").drop("answer")


_SECTOR_TEXT = """CASE WHEN h2 < '4' THEN substr(code, 1, 1) WHEN h2 < '8' THEN substr(code, 1, 3) || ' maybe'
  WHEN h2 < 'c' THEN '"Sector ' || substr(code, 1, 1) || '"' ELSE 'unclear ' || code END"""
_SECTOR_VOCAB = "vocab AS (SELECT DISTINCT substr(code, 1, 1) AS code FROM spell_rows)"


def _sector_text(spark, sf):
    rows = derived(spark, sf, "spell_rows")
    return rows.select("case_id", "slot", F.expr(_SECTOR_TEXT).alias("answer")), rows.select(
        F.substring("code", 1, 1).alias("label"))


@query("resolve_sector_prefix", oracle(["spell_rows"], """
SELECT case_id, slot, coalesce((SELECT code FROM vocab WHERE code = t),
  (SELECT min(code) FROM vocab WHERE starts_with(t, code)), t) AS predicted_code FROM answers""",
    _SECTOR_VOCAB + f", answers AS (SELECT case_id, slot, trim({_SECTOR_TEXT}) AS t FROM spell_rows)"))
def resolve_sector_prefix(spark, sf):
    answers, vocab = _sector_text(spark, sf)
    return codes.resolve_codes(answers, "answer", vocab, "sector_prefix").drop("answer")


@query("resolve_sector_number", oracle(["spell_rows"], r"""
SELECT case_id, slot, coalesce((SELECT code FROM vocab WHERE code = t),
  (SELECT code FROM vocab WHERE code = regexp_extract(t, '\b([0-9]+)\b', 1)), t) AS predicted_code
FROM answers""", _SECTOR_VOCAB + f""",
answers AS (SELECT case_id, slot, trim(trim({_SECTOR_TEXT}), '"''') AS t FROM spell_rows)"""))
def resolve_sector_number(spark, sf):
    answers, vocab = _sector_text(spark, sf)
    return codes.resolve_codes(answers, "answer", vocab, "sector_number").drop("answer")


_SUBJECT_TEXT = """CASE WHEN c_mktsegment = 'BUILDING' THEN uni_subject WHEN c_mktsegment = 'MACHINERY'
  THEN substr(uni_subject, 1, 2) || ' only' ELSE 'a degree in ' || subject_label END"""


@query("resolve_subjects", oracle(["raw_silver_edu"], r"""
SELECT case_id, spell_index, coalesce((SELECT code FROM vocab WHERE code = t),
  (SELECT max(code) FROM vocab WHERE regexp_extract(code, '^([0-9]+)', 1) = regexp_extract(t, '^([0-9]+)', 1)
     AND regexp_extract(t, '^([0-9]+)', 1) <> ''),
  (SELECT min(code) FROM vocab WHERE contains(lower(t), lower(split_part(code, ' – ', 2)))
     OR contains(lower(split_part(code, ' – ', 2)), lower(t))), t) AS predicted_code
FROM answers""", f"""vocab AS (SELECT DISTINCT uni_subject AS code FROM raw_silver_edu),
answers AS (SELECT case_id, spell_index, trim({_SUBJECT_TEXT}) AS t FROM raw_silver_edu
            JOIN customer ON CAST(c_custkey AS VARCHAR) = case_id)"""))
def resolve_subjects(spark, sf):
    rows = derived(spark, sf, "raw_silver_edu").join(
        table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("case_id"), "c_mktsegment"),
        "case_id")
    answers = rows.select("case_id", "spell_index", F.expr(_SUBJECT_TEXT).alias("answer"))
    vocab = rows.select(F.col("uni_subject").alias("label"))
    return codes.resolve_codes(answers, "answer", vocab, "subject").drop("answer")


# --- prompts --------------------------------------------------------------------

@query("career_prompts", oracle(["raw_gold", "spell_rows"], """
SELECT case_id, 'CV TEXT:' || chr(10) || min(cv_local) || chr(10) || chr(10)
  || 'CAREER SPELL ANCHORS TO EXTRACT:' || chr(10)
  || string_agg('  - spell_index ' || slot || ': ' || coalesce(nullif(start_text, ''), '?') || ' – '
     || coalesce(nullif(replace(end_text, '.0', ''), ''), '?') || '  [category: ' || code || ']',
     chr(10) ORDER BY slot)
  || chr(10) || chr(10) || 'Where years overlap, the category says which of the roles is meant.'
  || chr(10) || 'Answer with the JSON object alone.' AS prompt
FROM raw_gold JOIN spell_rows USING (case_id) WHERE start_text <> '' OR end_text <> '' GROUP BY case_id"""))
def career_prompts(spark, sf):
    from plumbline.operators.reshape import pinned, spell_anchors

    raw = derived(spark, sf, "raw_gold").filter("trim(case_id) <> ''")
    rows = raw.select("case_id", "cv_local", pinned(spell_anchors(raw)).alias("a")).filter(F.size("a") > 0)
    return rows.select("case_id", prompts.career_prompt(F.col("cv_local"), F.col("a")).alias("prompt"))


@query("education_prompts", oracle(["raw_gold", "raw_silver_edu"], """
SELECT case_id, 'CV TEXT:' || chr(10) || min(cv_local) || chr(10) || chr(10) || 'EDUCATION ANCHOR:'
  || chr(10) || 'Degree level: ' || min(CASE WHEN trim(edu_degree) = '' THEN 'unknown' ELSE trim(edu_degree) END)
  || chr(10) || 'Period: ' || min(edu_start) || ' – ' || min(replace(edu_end, '.0', ''))
  || chr(10) || chr(10) || 'SUBJECT ANCHORS TO EXTRACT:' || chr(10)
  || string_agg('  - subject_index ' || spell_index || ': ' || uni_subject
     || CASE WHEN spell_index = '1' THEN '  [university: ' || uni_name_1 || ']' ELSE '' END,
     chr(10) ORDER BY spell_index)
  || chr(10) || chr(10) || 'Answer with the JSON object alone.' AS prompt
FROM raw_gold JOIN raw_silver_edu USING (case_id) GROUP BY case_id"""))
def education_prompts(spark, sf):
    from plumbline.operators.reshape import education_anchor, pinned

    raw = derived(spark, sf, "raw_gold").filter("trim(case_id) <> ''")
    rows = raw.select("case_id", "cv_local", pinned(education_anchor(raw)).alias("a")).filter("a is not null")
    return rows.select("case_id", prompts.education_prompt(F.col("cv_local"), F.col("a")).alias("prompt"))


@query("context_blocks", """
SELECT conv_id, turn, CASE WHEN text IN ('', 'NA') THEN '' ELSE chr(10) || 'About the workplace: ' || text END
  || CASE WHEN role = 'user' THEN chr(10) || 'About the role: ' || role ELSE '' END AS block
FROM conversations""")
def context_blocks(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", prompts.context_block(
        F.col("text"), F.when(F.col("role") == "user", F.col("role")).otherwise("NA")).alias("block"))


@query("message_lists", """
SELECT conv_id, turn, 6 AS n_messages, 'Job title: ' || role || chr(10) || 'Workplace: '
  || CASE WHEN text = '' THEN 'unknown' ELSE text END AS last_message FROM conversations""")
def message_lists(spark, sf):
    shots = table(spark, sf, "part").select(
        F.concat(F.lit("Job title: "), "p_name").alias("user"), F.col("p_brand").alias("assistant"),
        "p_partkey").orderBy("p_partkey").limit(2)
    pool = shots.agg(F.array_sort(F.collect_list(F.struct("p_partkey", "user", "assistant")))).scalar()
    messages = prompts.message_list(
        F.lit("system"), F.col("_shots"), prompts.user_turn(F.col("role"), F.col("text")))
    rows = table(spark, sf, "conversations").withColumn("_shots", pool)
    return rows.select("conv_id", "turn", messages.alias("m")).select(
        "conv_id", "turn", F.size("m").alias("n_messages"),
        F.try_element_at("m", F.lit(-1))["content"].alias("last_message"))
