"""Query registry, table access and derived tables.

Derived tables turn the driver tables into the label data model. Their SQL is
written once in the part of the language Spark and DuckDB share: Spark runs it to
get the inputs of a query, and the oracle puts it in front as common table
expressions.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from plumbline.session import durable_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared durable folder."""
    return f"{durable_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_SCHEMAS: dict[str, StructType] = {}


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """Parquet scan; the schema of a path is looked up once."""
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _scan(spark, f"{sf_dir}/{name}.parquet")


YEARS = range(1995, 2002)
SLOTS = [y - 1994 for y in YEARS]

DERIVED: dict[str, str] = {}

# One row per customer and order year.
DERIVED["person_years"] = """
SELECT CAST(o_custkey AS STRING) AS case_id, CAST(year(o_orderdate) - 1994 AS INT) AS slot,
       CAST(year(o_orderdate) AS INT) AS y, min(o_orderpriority) AS prio,
       max(o_orderstatus) AS status, CAST(count(*) AS INT) AS n
FROM {orders} GROUP BY o_custkey, year(o_orderdate)
"""

# A career spell per customer and year; some years are unknown.
DERIVED["spell_rows"] = """
SELECT case_id, slot, y,
       substr(prio, 1, 1) || CASE status WHEN 'F' THEN '01' WHEN 'O' THEN '02' ELSE '03' END
         || ' = ' || lower(substr(prio, 3)) || ' ' || lower(status) AS code,
       CASE WHEN status = 'P' AND n = 1 THEN '' ELSE CAST(y AS STRING) END AS start_text,
       CASE WHEN status = 'O' THEN '' WHEN status = 'P' AND n = 1 THEN ''
            WHEN n = 2 THEN CAST(y + 1 AS STRING) || '.0'
            ELSE CAST(y + least(n, 4) - 1 AS STRING) END AS end_text,
       substr(md5(case_id || '|' || CAST(slot AS STRING)), 1, 1) AS h1,
       substr(md5(case_id || '|' || CAST(slot AS STRING)), 2, 1) AS h2
FROM {person_years}
"""

_WIDE = ",\n".join(
    f"max(CASE WHEN slot = {n} THEN code END) AS p{n}, "
    f"max(CASE WHEN slot = {n} THEN start_text END) AS s{n}, "
    f"max(CASE WHEN slot = {n} THEN end_text END) AS e{n}, "
    f"max(CASE WHEN slot = {n} THEN 'http://cv.example/' || case_id || '/' || CAST(y AS STRING) END)"
    f" AS u{n}"
    for n in SLOTS)
DERIVED["wide_spells"] = f"SELECT case_id, {_WIDE} FROM {{spell_rows}} GROUP BY case_id"

_CAREER = ",\n".join(
    f"coalesce(p{n}, '') AS career_position_{n}, coalesce(s{n}, '') AS career_start_year_{n}, "
    f"coalesce(e{n}, '') AS career_end_year_{n}" for n in SLOTS)
_LINKS = ", ".join(f"u{n}" for n in SLOTS)

# The wide gold table as it would stand in a file: every column text.
DERIVED["raw_gold"] = f"""
SELECT CASE WHEN c_acctbal BETWEEN 50 AND 100 THEN ' ' ELSE CAST(c_custkey AS STRING) END AS case_id,
       split_part(c_name, '#', 1) AS name_first, split_part(c_name, '#', 2) AS name_last,
       lower(c_mktsegment) AS job_title, n_name AS country_label,
       CASE WHEN c_acctbal < -900 THEN '4 = partial record' ELSE '' END AS missing_type,
       concat_ws(' | ', {_LINKS}) AS cv_links,
       CASE WHEN c_acctbal < -500 THEN ' nan ' ELSE 'CV of ' || c_name END AS cv_local,
       CASE substr(md5(c_name), 1, 1) WHEN '0' THEN '99' WHEN '1' THEN '' WHEN '2' THEN '/'
            WHEN '3' THEN '19x7'
            ELSE CAST(1930 + CAST(floor(abs(c_acctbal) / 200) AS INT) AS STRING) END AS birth_year,
       CASE substr(md5(c_name), 2, 1) WHEN '0' THEN 'unknown'
            ELSE c_mktsegment || ' City (' || n_name || ')' END AS birth_place,
       '17 = ' || n_name AS birth_country,
       CASE WHEN substr(md5(c_name), 3, 1) < '8' THEN '0 = male' ELSE '1 = female' END AS sex,
       CAST(1950 + CAST(floor(abs(c_acctbal) / 250) AS INT) AS STRING) AS edu_start,
       CAST(1954 + CAST(floor(abs(c_acctbal) / 250) AS INT) AS STRING) || '.0' AS edu_end,
       CASE c_mktsegment WHEN 'BUILDING' THEN '6 = Bachelor' WHEN 'MACHINERY' THEN ' 7 = Master'
            WHEN 'FURNITURE' THEN '8. Doctor' WHEN 'HOUSEHOLD' THEN '' ELSE '99' END AS edu_degree,
       CASE c_mktsegment WHEN 'BUILDING' THEN '03 – Social sciences: Economics'
            WHEN 'MACHINERY' THEN '07 – Engineering' WHEN 'FURNITURE' THEN '04 – Law'
            WHEN 'HOUSEHOLD' THEN 'nan' ELSE '10 – Natural sciences' END AS uni_subject_1,
       n_name || ' University' AS uni_name_1,
       CASE WHEN substr(md5(c_name), 4, 1) < '5' THEN '04 – Law' ELSE '' END AS uni_subject_2,
       '' AS uni_name_2,
       {_CAREER}
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey
LEFT JOIN {{wide_spells}} ON case_id = CAST(c_custkey AS STRING)
"""

# Silver rows for the career spells, with faults a cleaner has to find.
DERIVED["raw_silver"] = """
SELECT case_id, CASE WHEN h1 = '0' THEN 'x' ELSE CAST(slot AS STRING) END AS spell_index,
       code AS career_position,
       CASE WHEN h1 = '1' THEN ' ' ELSE split_part(code, ' = ', 2) END AS job_description_label,
       'office ' || substr(code, 1, 1) AS workplace_label
FROM {spell_rows}
UNION ALL
SELECT case_id, CAST(slot AS STRING) AS spell_index, code AS career_position,
       'second ' || code AS job_description_label, '' AS workplace_label
FROM {spell_rows} WHERE h1 = '2' AND h2 = '2'
"""

# Education rows of the silver table.
DERIVED["raw_silver_edu"] = """
SELECT case_id, '1' AS spell_index, uni_subject_1 AS uni_subject,
       'Degree of ' || split_part(uni_subject_1, ' – ', 2) AS subject_label
FROM {raw_gold} WHERE trim(case_id) <> '' AND uni_subject_1 <> 'nan'
UNION ALL
SELECT case_id, '2' AS spell_index, uni_subject_2 AS uni_subject,
       CASE WHEN sex = '0 = male' THEN '' ELSE 'Degree of Law' END AS subject_label
FROM {raw_gold} WHERE trim(case_id) <> '' AND uni_subject_2 <> ''
"""

# A classifier that is right for most spells.
DERIVED["code_predictions"] = """
SELECT case_id, slot AS spell_index,
       CASE WHEN h2 < 'a' THEN code
            WHEN h2 < 'c' THEN '1' || substr(code, 2)
            WHEN h2 < 'e' THEN '301 = medium f'
            WHEN h2 = 'e' THEN '' ELSE '999 = no such code' END AS predicted_code
FROM {spell_rows} WHERE h1 <> 'f'
UNION ALL
SELECT case_id, slot + 50 AS spell_index, code AS predicted_code
FROM {spell_rows} WHERE h1 = 'a' AND h2 = 'a'
"""

DERIVED["subject_predictions"] = """
SELECT case_id, CAST(spell_index AS INT) AS spell_index,
       CASE WHEN substr(md5(case_id), 5, 1) < 'b' THEN substr(uni_subject, 1, 2)
            ELSE '07 – Engineering' END AS predicted_code
FROM {raw_silver_edu}
"""

# Predicted spells: gold years shifted, some left out, some unknown.
DERIVED["spell_predictions"] = """
SELECT case_id, 8 - slot AS pos,
       CASE WHEN h1 IN ('0', '1') THEN NULL WHEN h1 < '6' THEN y + 1 WHEN h1 < '8' THEN y - 2
            ELSE y END AS start_year,
       CASE WHEN h2 IN ('0', '1') THEN NULL WHEN h2 < '5' THEN y + 2 ELSE y END AS end_year,
       code AS position
FROM {spell_rows} WHERE h2 <> 'f'
"""

# Extracted fields: right, wrong, missing or differently written.
DERIVED["field_predictions"] = """
SELECT case_id,
       CASE WHEN h < '4' THEN birth_year WHEN h < '8' THEN '1955' WHEN h < 'a' THEN NULL
            ELSE birth_year END AS birth_year,
       CASE WHEN h < '4' THEN upper(birth_place) WHEN h < '8' THEN job_title || ' town'
            WHEN h < 'a' THEN '' ELSE birth_place END AS birth_place,
       birth_country,
       CASE WHEN h = '7' THEN '1 = female' ELSE sex END AS sex,
       CASE WHEN h = '3' THEN NULL ELSE edu_start END AS edu_start,
       CAST(CAST(edu_end AS DOUBLE) + 1 AS STRING) AS edu_end,
       CASE WHEN h < '8' THEN substr(trim(edu_degree), 1, 1) ELSE edu_degree END AS edu_degree
FROM (SELECT *, substr(md5(name_last), 6, 1) AS h FROM {raw_gold}) AS g
WHERE trim(case_id) <> '' AND h <> 'f'
"""

# The same with earlier runs whose answers later ones replace; their texts are larger.
DERIVED["field_answers"] = """
SELECT case_id, birth_year, birth_place, birth_country, sex, edu_start, edu_end, edu_degree, 10 AS run
FROM {field_predictions}
UNION ALL
SELECT case_id, '9' AS birth_year, 'zz ' || birth_place AS birth_place, 'zz' AS birth_country, '9 = other' AS sex,
       '9' AS edu_start, '9' AS edu_end, '9 = zz' AS edu_degree, 9 AS run
FROM {field_predictions} WHERE substr(md5(case_id), 8, 1) < '6'
"""

DERIVED["url_predictions"] = """
SELECT case_id,
       CASE WHEN substr(md5(case_id), 7, 1) < '8' THEN cv_links
            WHEN substr(md5(case_id), 7, 1) < 'c'
            THEN split_part(cv_links, ' | ', 1) || '|http://other.example/a||' || split_part(cv_links, ' | ', 2)
            ELSE '' END AS retrieved_urls
FROM {raw_gold} WHERE trim(case_id) <> ''
UNION ALL
SELECT 's' || CAST(s_suppkey AS STRING) AS case_id, 'http://x.example/' AS retrieved_urls FROM {supplier}
"""

# A rule that predicts the quality label of a document from its length.
DERIVED["document_quality"] = """
SELECT d.doc_id, d.lang, d.source, CAST(l.quality AS STRING) AS gold,
       CASE WHEN d.n_chars > 700 THEN '1' ELSE '0' END AS pred
FROM {labels} AS l JOIN {documents} AS d ON l.doc_id = d.doc_id
"""

BASE_TABLES = {
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
}


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


# Tables a user would hold in storage. They are written once per application and
# read from there, so that a query plan starts at a scan of the label tables.
STORED = {
    "spell_rows", "raw_gold", "raw_silver", "raw_silver_edu", "code_predictions",
    "subject_predictions", "spell_predictions", "field_predictions", "field_answers",
    "url_predictions",
}
_PATHS: dict[tuple[str, str, str], str] = {}


def _in_slots(spells: DataFrame) -> DataFrame:
    """The rows as they are; fails at a year that has no column in the wide table."""
    error = F.raise_error(F.concat(
        F.lit(f"spell outside the years {YEARS[0]} to {YEARS[-1]}: "),
        F.coalesce(F.col("y").cast("string"), F.lit("no year"))))
    return spells.withColumn(
        "slot", F.when(F.col("slot").isin(SLOTS), F.col("slot")).otherwise(error))


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a Spark DataFrame."""
    if name in BASE_TABLES:
        return table(spark, sf_dir, name)
    sql = DERIVED[name]
    if name == "wide_spells":
        return spark.sql(sql, spell_rows=_in_slots(derived(spark, sf_dir, "spell_rows")))
    if name not in STORED:
        return spark.sql(sql, **{n: derived(spark, sf_dir, n) for n in _needs(sql)})
    where = (spark.sparkContext.applicationId, sf_dir, name)
    if where not in _PATHS:
        path = scratch(spark, name)
        spark.sql(sql, **{n: derived(spark, sf_dir, n) for n in _needs(sql)}).write.parquet(path)
        _PATHS[where] = path
    return _scan(spark, _PATHS[where])


def _expressions(names: list[str], seen: dict[str, str]) -> None:
    for name in names:
        if name in BASE_TABLES or name in seen:
            continue
        sql = DERIVED[name]
        _expressions(_needs(sql), seen)
        seen[name] = sql.format(**{n: n for n in _needs(sql)})


def oracle(names: list[str], body: str, extra: str = "", recursive: bool = False) -> str:
    """DuckDB SQL: derived tables ``names``, then ``extra`` expressions, then ``body``."""
    seen: dict[str, str] = {}
    _expressions(names, seen)
    parts = [f"{name} AS ({sql.strip()})" for name, sql in seen.items()]
    if extra.strip():
        parts.append(extra.strip().rstrip(","))
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body.strip()


# --- oracle fragments ---------------------------------------------------------

BLANKS = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"


def sql_number(column: str) -> str:
    """Text to double, null for anything that is no number."""
    return (f"CASE WHEN regexp_full_match(trim({column}), "
            f"'[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') "
            f"THEN TRY_CAST(trim({column}) AS DOUBLE) END")


def sql_year(column: str) -> str:
    number = sql_number(column)
    return f"CASE WHEN {number} = floor({number}) THEN CAST({number} AS INT) END"


def sql_normal(column: str) -> str:
    text = f"lower(trim(CAST({column} AS VARCHAR)))"
    return (f"CASE WHEN {column} IS NULL OR {text} IN ('', 'nan', '<na>', '/', '99', 'none', "
            f"'n/a', 'na', 'unknown') THEN '__na__' ELSE {text} END")


def sql_similarity(source: str, name: str = "alike") -> str:
    """Expressions that end in ``name``(x, y, sim) for the distinct pairs (x, y) of ``source``.

    The ratio of matching characters: the longest common block, the first of them in x and then in
    y, and again on both sides of it. Texts of 200 and more characters, where frequent characters
    are left out, are not covered. Needs a recursive WITH.
    """
    def normal(column: str) -> str:
        bare = f"regexp_replace(lower({column}), '\\(.*?\\)', '', 'g')"
        bare = f"""regexp_replace({bare}, '[''\\-.,/"]', '', 'g')"""
        return f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"

    def longest(a: str, b: str) -> str:
        return (f"list_max(flatten([[CASE WHEN contains({b}, substr({a}, i, k)) THEN {{'k': k, 'n': -i}} END "
                f"FOR k IN range(1, len({a}) - i + 2)] FOR i IN range(1, len({a}) + 1)]))")

    return f"""
{name}_texts AS (SELECT DISTINCT x, y, {normal('x')} AS a0, {normal('y')} AS b0 FROM {source}),
{name}_blocks(a0, b0, a, b, m) AS (
  SELECT a0, b0, a0, b0, {longest('a0', 'b0')}
  FROM (SELECT DISTINCT a0, b0 FROM {name}_texts WHERE a0 <> b0 AND a0 <> '' AND b0 <> '')
  UNION ALL
  SELECT a0, b0, s.a, s.b, {longest('s.a', 's.b')}
  FROM (SELECT a0, b0, unnest([{{'a': left(a, i - 1), 'b': left(b, j - 1)}},
                               {{'a': substr(a, i + k), 'b': substr(b, j + k)}}]) AS s
        FROM (SELECT *, m.k AS k, -m.n AS i, strpos(b, substr(a, -m.n, m.k)) AS j
              FROM {name}_blocks WHERE m IS NOT NULL))
  WHERE s.a <> '' AND s.b <> ''),
{name} AS (
  SELECT x, y, CASE WHEN a0 = b0 THEN 1.0 WHEN a0 = '' OR b0 = '' THEN 0.0
    ELSE CAST(2 * coalesce(n, 0) AS DOUBLE) / (len(a0) + len(b0)) END AS sim
  FROM {name}_texts LEFT JOIN (SELECT a0, b0, sum(m.k) AS n FROM {name}_blocks GROUP BY a0, b0) USING (a0, b0))
"""


def sql_split(source: str, key: str, stratum: str, name: str = "sides") -> str:
    """Expressions that end in ``name``(key, split): the stratified split."""
    return f"""
{name}_strata AS (
  SELECT coalesce({stratum}, '') AS s, count(*) AS c FROM {source} GROUP BY 1),
{name}_total AS (
  SELECT CAST(sum(c) AS BIGINT) AS n,
         CAST(sum(c) - ceil(CAST(sum(c) AS DOUBLE) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS tr
  FROM {name}_strata WHERE c > 1),
{name}_share AS (
  SELECT s, c, tr, (tr * c) // n AS base,
         row_number() OVER (ORDER BY (tr * c) % n DESC, c DESC, md5('42|' || s), s) AS rk
  FROM {name}_strata, {name}_total WHERE c > 1),
{name}_alloc AS (
  SELECT s, c - base - CASE WHEN rk <= tr - sum(base) OVER () THEN 1 ELSE 0 END AS n_test
  FROM {name}_share),
{name} AS (
  SELECT r.{key}, CASE WHEN rn <= coalesce(n_test, 0) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT CAST({key} AS VARCHAR) AS {key}, coalesce({stratum}, '') AS s,
               row_number() OVER (PARTITION BY coalesce({stratum}, '')
                 ORDER BY md5('42|' || CAST({key} AS VARCHAR)), CAST({key} AS VARCHAR)) AS rn
        FROM {source}) AS r LEFT JOIN {name}_alloc AS a ON r.s = a.s)
"""


_YEAR_COLUMNS = ["birth_year", "edu_start", "edu_end",
                 *[f"career_{k}_year_{n}" for n in SLOTS for k in ("start", "end")]]
# Cleaned gold, as expressions after ``raw_gold``.
SQL_GOLD = f"""
gold AS (
  SELECT * REPLACE ({", ".join(f"({sql_year(c)}) AS {c}" for c in _YEAR_COLUMNS)})
  FROM raw_gold WHERE trim(case_id) <> '' AND trim(missing_type) = '')
"""
SQL_GOLD_SPLIT = SQL_GOLD + ", " + sql_split("gold", "case_id", "country_label")

_SPELLS_UNION = " UNION ALL ".join(
    f"SELECT case_id, {n} AS spell_index, career_start_year_{n} AS start_year, "
    f"career_end_year_{n} AS end_year, career_position_{n} AS position FROM {{src}} "
    f"WHERE trim(career_position_{n}) NOT IN ('', 'nan')" for n in SLOTS)


def sql_spells(source: str, name: str = "gold_spells") -> str:
    """Expression: long spells of a wide table with filled positions."""
    return f"{name} AS ({_SPELLS_UNION.format(src=source)})"


# Cleaned silver with the education rows merged.
SQL_SILVER = f"""
merged AS (
  SELECT case_id, spell_index, career_position, job_description_label, workplace_label,
         '' AS uni_subject, '' AS subject_label FROM raw_silver
  UNION ALL
  SELECT case_id, spell_index, '', '', '', uni_subject, subject_label FROM raw_silver_edu),
indexed AS (
  SELECT * REPLACE (({sql_year("spell_index")}) AS spell_index) FROM merged
  WHERE trim(case_id) <> ''),
valid AS (
  SELECT * FROM indexed WHERE spell_index IS NOT NULL
    OR (trim(job_description_label) = '' AND trim(subject_label) = '')),
repeated AS (
  SELECT case_id FROM valid WHERE trim(job_description_label) <> ''
  GROUP BY case_id, spell_index HAVING count(*) > 1
  UNION SELECT case_id FROM valid WHERE trim(subject_label) <> ''
  GROUP BY case_id, spell_index HAVING count(*) > 1),
silver AS (SELECT * FROM valid WHERE case_id NOT IN (SELECT case_id FROM repeated))
"""


def gold_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.sources.tables import clean_gold

    return clean_gold(derived(spark, sf_dir, "raw_gold"))


def silver_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.operators.cleaning import union_filled
    from plumbline.sources.tables import clean_silver

    return clean_silver(union_filled(
        derived(spark, sf_dir, "raw_silver"), derived(spark, sf_dir, "raw_silver_edu")))
