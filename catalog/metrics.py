"""Alignment, scores and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import derived, oracle, query, sql_normal, sql_number, sql_similarity, table
from plumbline.functions import text as T, vectors as V
from plumbline.operators import atomic, classification as K, retrieval, sets, spells, stats

# --- sets --------------------------------------------------------------------------

_SQL_PRF = """
CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN np = 0 OR ng = 0 THEN 0.0 ELSE CAST(nc AS DOUBLE) / np END AS p,
CASE WHEN np = 0 AND ng = 0 THEN 1.0 WHEN np = 0 OR ng = 0 THEN 0.0 ELSE CAST(nc AS DOUBLE) / ng END AS r"""
_SQL_SCORED = """
SELECT {key}, round_even(CAST(p AS DOUBLE), 6) AS "precision", round_even(CAST(r AS DOUBLE), 6) AS recall,
       CASE WHEN p + r > 0 THEN round_even(2.0 * p * r / (p + r), 6) ELSE 0.0 END AS f1,
       CAST(np AS BIGINT) AS {names[0]}, CAST(ng AS BIGINT) AS {names[1]},
       CAST(nc AS BIGINT) AS {names[2]}, skipped FROM prf"""
_SET_NAMES = ("n_retrieved", "n_gold", "n_correct")


def _sql_urls(column: str) -> str:
    return (f"list_distinct(list_filter(list_transform(string_split(coalesce({column}, ''), '|'), "
            "lambda x: trim(x)), lambda x: x <> ''))")


_URL_PRF = f"""
found AS (SELECT case_id, {_sql_urls('max(retrieved_urls)')} AS pu FROM url_predictions GROUP BY case_id),
wanted AS (SELECT case_id, {_sql_urls('cv_links')} AS gu FROM raw_gold WHERE trim(case_id) <> ''),
sized AS (SELECT f.case_id, len(pu) AS np, coalesce(len(gu), 0) AS ng,
            coalesce(len(list_intersect(pu, gu)), 0) AS nc, gu IS NULL AS skipped
          FROM found AS f LEFT JOIN (SELECT * FROM wanted WHERE len(gu) > 0) AS w USING (case_id)),
prf AS (SELECT *, {_SQL_PRF} FROM sized)"""
_URL_SCORED = _URL_PRF + ", scored AS (" + _SQL_SCORED.format(key="case_id", names=_SET_NAMES) + ")"
_URL_TABLES = ["raw_gold", "url_predictions"]


def _url_scores(spark, sf):
    gold = derived(spark, sf, "raw_gold").filter("trim(case_id) <> ''")
    return sets.score_arrays(derived(spark, sf, "url_predictions"), gold)


@query("set_scores_per_case", oracle(_URL_TABLES, "SELECT * FROM scored", _URL_SCORED))
def set_scores_per_case(spark, sf):
    return _url_scores(spark, sf)


_MACRO = """
SELECT coalesce(round_even(avg("precision") FILTER (NOT skipped), 6), 0.0) AS "precision",
       coalesce(round_even(avg(recall) FILTER (NOT skipped), 6), 0.0) AS recall,
       coalesce(round_even(avg(f1) FILTER (NOT skipped), 6), 0.0) AS f1,
       CAST(count(*) FILTER (NOT skipped) AS BIGINT) AS n_evaluated,
       CAST(count(*) FILTER (skipped) AS BIGINT) AS n_skipped FROM scored"""


@query("set_scores_macro", oracle(_URL_TABLES, _MACRO, _URL_SCORED))
def set_scores_macro(spark, sf):
    return sets.macro(_url_scores(spark, sf))


@query("url_set_overlap", oracle(_URL_TABLES, """
SELECT case_id, CAST(nc AS INT) AS n_common, CAST(np + ng - nc AS INT) AS n_either FROM sized
WHERE NOT skipped""", _URL_PRF))
def url_set_overlap(spark, sf):
    found = derived(spark, sf, "url_predictions")
    gold = derived(spark, sf, "raw_gold").filter("trim(case_id) <> '' and cv_links <> ''")
    pairs = found.select("case_id", sets.url_set(found, "retrieved_urls").alias("p")).join(
        gold.select("case_id", sets.url_set(gold, "cv_links").alias("g")), "case_id")
    common = F.size(F.array_intersect("p", "g"))
    return pairs.select("case_id", common.alias("n_common"), F.size(F.array_union("p", "g")).alias("n_either"))


@query("set_scores_from_rows", oracle([], _SQL_SCORED.format(
    key="CAST(l_orderkey AS VARCHAR) AS l_orderkey", names=_SET_NAMES), f"""
sized AS (
  SELECT l_orderkey, count(DISTINCT l_partkey) FILTER (l_quantity > 20) AS np,
         count(DISTINCT l_partkey) FILTER (l_returnflag <> 'R') AS ng,
         count(DISTINCT l_partkey) FILTER (both_sides) AS nc
  FROM (SELECT *, bool_or(l_quantity > 20) OVER w AND bool_or(l_returnflag <> 'R') OVER w AS both_sides
        FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_partkey))
  GROUP BY l_orderkey HAVING count(*) FILTER (l_quantity > 20) > 0),
prf AS (SELECT *, ng = 0 AS skipped, {_SQL_PRF} FROM sized)"""))
def set_scores_from_rows(spark, sf):
    lines = table(spark, sf, "lineitem")
    return sets.score_rows(lines.filter("l_quantity > 20"), lines.filter("l_returnflag <> 'R'"),
                           "l_orderkey", "l_partkey")


# --- atomic fields --------------------------------------------------------------------

_FIELD_TABLES = ["raw_gold", "field_answers"]
_LATEST = """
latest AS (SELECT * FROM field_answers QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY run DESC) = 1),
"""
_ALIGNED = _LATEST + """
aligned AS (
  SELECT g.case_id, CASE WHEN coalesce(country_label, '') = '' THEN 'unknown' ELSE country_label END AS slice,
         g.{v} AS gold, l.{v} AS pred, l.case_id IS NOT NULL AS has_pred
  FROM raw_gold AS g LEFT JOIN latest AS l USING (case_id) WHERE trim(g.case_id) <> '')"""


def _aligned(spark, sf, variable):
    gold = derived(spark, sf, "raw_gold").filter("trim(case_id) <> ''")
    return atomic.align(gold, derived(spark, sf, "field_answers"), variable, order="run")


@query("atomic_alignment", oracle(_FIELD_TABLES, "SELECT * FROM aligned", _ALIGNED.format(v="sex")))
def atomic_alignment(spark, sf):
    return _aligned(spark, sf, "sex")


@query("last_prediction_wins", """
SELECT CAST(user_id AS VARCHAR) AS user_id, arg_max(event_type, event_id) AS pred FROM events GROUP BY user_id""")
def last_prediction_wins(spark, sf):
    return atomic.last_prediction(table(spark, sf, "events"), "user_id", "event_type", "event_id")


def _sql_accuracy(source: str) -> str:
    def measures(level: str, part: str, group: str) -> str:
        def total(condition: str) -> str:
            return f"CAST(coalesce(count(*) FILTER (has_pred AND {condition}), 0) AS BIGINT)"

        n, npred = total("true"), total("pn <> '__na__'")
        return f"""
SELECT '{level}' AS level, {part} AS slice,
  round_even(CAST({total('gn = pn')} AS DOUBLE) / nullif({n}, 0), 6) AS accuracy,
  round_even(CAST({total("gn = pn AND pn <> '__na__'")} AS DOUBLE) / nullif({npred}, 0), 6)
    AS accuracy_when_predicted,
  {total('gn = pn')} AS n_correct, {n} AS n_total, {npred} AS n_predicted,
  {total("gn = pn AND gn = '__na__'")} AS n_na_correct, {total("gn = '__na__'")} AS n_na_gold,
  {total("pn = '__na__'")} AS n_na_pred,
  CAST(count(*) FILTER (NOT has_pred) AS BIGINT) AS n_missing FROM normal {group}"""

    return (f"WITH normal AS (SELECT *, {sql_normal('gold')} AS gn, {sql_normal('pred')} AS pn FROM {source})"
            + measures("overall", "NULL", "") + " UNION ALL "
            + measures("group", "slice", "GROUP BY slice"))


@query("atomic_accuracy", oracle(_FIELD_TABLES, f"SELECT * FROM ({_sql_accuracy('aligned')})",
                                 _ALIGNED.format(v="birth_place")))
def atomic_accuracy(spark, sf):
    return atomic.accuracy(_aligned(spark, sf, "birth_place"), "slice", similarity=False).drop(
        "char_similarity", "char_similarity_when_predicted")


# Over ``normal``, with the similarity of the pairs that both sides have.
SQL_SIMILAR = sql_similarity("""(
  SELECT pred AS x, gold AS y FROM normal WHERE has_pred AND gn <> '__na__' AND pn <> '__na__')""") + """,
likened AS (SELECT normal.*, CASE WHEN has_pred AND gn <> '__na__' AND pn <> '__na__' THEN sim END AS sim
            FROM normal LEFT JOIN alike ON pred = x AND gold = y)"""


def _sql_similarity_scores(level: str, part: str, group: str) -> str:
    both = "round_even(sum(sim) / nullif(count(sim), 0), 6)"
    predicted = "round_even(sum(sim) / nullif(count(*) FILTER (has_pred AND pn <> '__na__'), 0), 6)"

    def total(condition: str) -> str:
        return f"CAST(count(*) FILTER (has_pred AND {condition}) AS BIGINT)"

    return f"""
SELECT '{level}' AS level, {part} AS slice, {both} AS accuracy, {predicted} AS accuracy_when_predicted,
  {both} AS char_similarity, {predicted} AS char_similarity_when_predicted,
  {total('gn = pn')} AS n_correct, {total('true')} AS n_total, {total("pn <> '__na__'")} AS n_predicted,
  {total("gn = pn AND gn = '__na__'")} AS n_na_correct, {total("gn = '__na__'")} AS n_na_gold,
  {total("pn = '__na__'")} AS n_na_pred, CAST(count(*) FILTER (NOT has_pred) AS BIGINT) AS n_missing
FROM likened {group}"""


def sql_normal_pairs(source: str = "aligned") -> str:
    return f"""
normal AS (SELECT *, {sql_normal('gold')} AS gn, {sql_normal('pred')} AS pn FROM {source}),"""


@query("atomic_similarity", oracle(
    _FIELD_TABLES, _sql_similarity_scores("overall", "NULL", "") + " UNION ALL "
    + _sql_similarity_scores("group", "slice", "GROUP BY slice"),
    _ALIGNED.format(v="birth_place") + "," + sql_normal_pairs() + SQL_SIMILAR, recursive=True))
def atomic_similarity(spark, sf):
    return atomic.similarity_as_headline(
        atomic.accuracy(_aligned(spark, sf, "birth_place"), "slice"))


@query("degree_accuracy", oracle(_FIELD_TABLES, f"SELECT * FROM ({_sql_accuracy('degrees')})",
                                 _ALIGNED.format(v="edu_degree") + r""",
degrees AS (SELECT * REPLACE (
  coalesce(nullif(regexp_extract(gold, '^\s*([0-9]+)', 1), ''), gold) AS gold,
  coalesce(nullif(regexp_extract(pred, '^\s*([0-9]+)', 1), ''), pred) AS pred) FROM aligned)"""))
def degree_accuracy(spark, sf):
    aligned = _aligned(spark, sf, "edu_degree").withColumns(
        {c: T.degree_prefix(F.col(c)) for c in ("gold", "pred")})
    return atomic.accuracy(aligned, "slice", similarity=False).drop(
        "char_similarity", "char_similarity_when_predicted")


def _sql_error(source: str, gold: str, pred: str, group: str) -> str:
    def measures(level: str, part: str, by: str) -> str:
        return f"""
SELECT '{level}' AS level, {part} AS slice, round_even(avg(e), 6) AS mae,
  round_even(CAST(count(*) FILTER (e = 0) AS DOUBLE) / nullif(count(e), 0), 6) AS accuracy,
  CAST(count(e) AS BIGINT) AS n_total, CAST(count(*) FILTER (has_pred AND e IS NULL) AS BIGINT) AS n_skipped,
  CAST(count(*) FILTER (NOT has_pred) AS BIGINT) AS n_missing FROM errors {by}"""

    return f"""WITH errors AS (SELECT *, CASE WHEN {sql_normal(gold)} <> '__na__'
  AND {sql_normal(pred)} <> '__na__' THEN abs({sql_number(f'CAST({pred} AS VARCHAR)')}
  - {sql_number(f'CAST({gold} AS VARCHAR)')}) END AS e FROM {source})""" + measures(
        "overall", "NULL", "") + " UNION ALL " + measures("group", group, f"GROUP BY {group}")


@query("year_mean_error", oracle(_FIELD_TABLES, f"SELECT * FROM ({_sql_error('aligned', 'gold', 'pred', 'slice')})",
                                 _ALIGNED.format(v="birth_year")))
def year_mean_error(spark, sf):
    return atomic.mean_error(_aligned(spark, sf, "birth_year"), "slice")


@query("order_year_error", oracle([], f"SELECT * FROM ({_sql_error('years', 'gold', 'pred', 'o_orderpriority')})", """
shipped AS (SELECT l_orderkey, min(year(l_shipdate)) AS pred FROM lineitem GROUP BY l_orderkey),
years AS (SELECT o_orderpriority, year(o_orderdate) AS gold, pred, pred IS NOT NULL AS has_pred
          FROM orders LEFT JOIN shipped ON l_orderkey = o_orderkey)"""))
def order_year_error(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("case_id"), "o_orderpriority", F.year("o_orderdate").alias("year"))
    shipped = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(
        F.min(F.year("l_shipdate")).alias("year"))
    aligned = atomic.align(orders, shipped, "year", group="o_orderpriority")
    return atomic.mean_error(aligned, "slice")


@query("mismatch_report", oracle(_FIELD_TABLES, """
SELECT g.case_id, p.sex AS sex_pred, g.sex AS sex_gold, p.edu_end AS edu_end_pred, g.edu_end AS edu_end_gold
FROM field_predictions AS p JOIN raw_gold AS g USING (case_id)
WHERE lower(trim(p.sex)) <> lower(trim(g.sex)) OR lower(trim(p.edu_end)) <> lower(trim(g.edu_end))"""))
def mismatch_report(spark, sf):
    return atomic.mismatch_report(
        derived(spark, sf, "field_predictions"), derived(spark, sf, "raw_gold"), ["sex", "edu_end"])


# --- intervals -------------------------------------------------------------------------

_GOLD_SPELLS = """
dated AS (
  SELECT case_id, slot, CAST(nullif(start_text, '') AS INT) AS s,
         CAST(CAST(nullif(end_text, '') AS DOUBLE) AS INT) AS e
  FROM spell_rows WHERE start_text <> '' OR end_text <> '')"""
_GREEDY = _GOLD_SPELLS + """,
golds AS (SELECT case_id, list({'i': slot, 's': s, 'e': e} ORDER BY slot) AS free,
                 count(*) AS ng FROM dated GROUP BY case_id),
preds AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS k,
                 start_year AS s, end_year AS e FROM spell_predictions
          WHERE start_year IS NOT NULL OR end_year IS NOT NULL),
npreds AS (SELECT case_id, count(k) AS np FROM
           (SELECT DISTINCT case_id FROM spell_predictions) LEFT JOIN preds USING (case_id) GROUP BY case_id),
steps AS (
  SELECT case_id, CAST(0 AS BIGINT) AS k, free FROM golds
  UNION ALL
  SELECT t.case_id, t.k + 1, CASE WHEN len(fit) = 0 THEN t.free
         ELSE list_filter(t.free, lambda f: f.i <> fit[1].i) END
  FROM (SELECT w.case_id, w.k, w.free, list_filter(w.free, lambda f:
            (p.s IS NULL OR f.s IS NULL OR abs(p.s - f.s) <= 1)
            AND (p.e IS NULL OR f.e IS NULL OR abs(p.e - f.e) <= 1)) AS fit
        FROM steps AS w JOIN preds AS p ON p.case_id = w.case_id AND p.k = w.k + 1) AS t),
left_over AS (SELECT case_id, arg_max(len(free), k) AS n_free FROM steps GROUP BY case_id),
sized AS (SELECT case_id, np, coalesce(ng, 0) AS ng, coalesce(ng - n_free, 0) AS nc, ng IS NULL AS skipped
          FROM npreds LEFT JOIN golds USING (case_id) LEFT JOIN left_over USING (case_id)),
prf AS (SELECT *, """ + _SQL_PRF + " FROM sized)"
_SPELL_NAMES = ("n_predicted", "n_gold", "n_matched")
_SPELL_TABLES = ["spell_rows", "spell_predictions"]
_SPELL_SCORED = _GREEDY + ", scored AS (" + _SQL_SCORED.format(key="case_id", names=_SPELL_NAMES) + ")"


def _gold_lists(spark, sf):
    from plumbline.operators.reshape import gold_spell_lists

    return gold_spell_lists(derived(spark, sf, "raw_gold").filter("trim(case_id) <> ''"))


def _predicted_lists(spark, sf):
    from plumbline.operators.reshape import collect_spells, predicted_spells

    rows = derived(spark, sf, "spell_predictions").withColumnRenamed("pos", "spell_index")
    lists = collect_spells(rows)
    return lists.select("case_id", predicted_spells(lists, "spells").alias("predicted"))


# Customers without a usable key have no row in the wide gold table.
_SPELL_GOLD_KEYS = """, keyed AS (SELECT case_id FROM raw_gold WHERE trim(case_id) <> '')"""


def _spell_scores(spark, sf):
    return spells.score_lists(_predicted_lists(spark, sf), _gold_lists(spark, sf))


_KEYED = [*_SPELL_TABLES, "raw_gold"]
_KEYED_SCORED = _SPELL_SCORED.replace(
    "FROM spell_rows WHERE start_text", "FROM spell_rows WHERE case_id IN (SELECT case_id FROM raw_gold) AND (start_text"
).replace("OR end_text <> '')", "OR end_text <> ''))")


@query("interval_match_per_case", oracle(_KEYED, "SELECT * FROM scored", _KEYED_SCORED, recursive=True))
def interval_match_per_case(spark, sf):
    return _spell_scores(spark, sf)


@query("interval_match_macro", oracle(_KEYED, _MACRO, _KEYED_SCORED, recursive=True))
def interval_match_macro(spark, sf):
    return sets.macro(_spell_scores(spark, sf))


@query("interval_match_from_rows", oracle(
    _KEYED, "SELECT * FROM scored", _KEYED_SCORED.replace(
        "np FROM\n", "np FROM\n").replace("count(k) AS np", "count(*) AS np").replace(
        "(SELECT DISTINCT case_id FROM spell_predictions) LEFT JOIN preds USING (case_id)",
        "spell_predictions"), recursive=True))
def interval_match_from_rows(spark, sf):
    rows = derived(spark, sf, "spell_predictions")
    return spells.score_rows(rows, _gold_lists(spark, sf), "pos")


@query("interval_pairs", oracle(_SPELL_TABLES, """
SELECT p.case_id, p.start_year AS pred_start, p.end_year AS pred_end, d.s AS gold_start, d.e AS gold_end,
       CAST(count(DISTINCT p.pos) AS BIGINT) AS n_pred, CAST(count(DISTINCT d.slot) AS BIGINT) AS n_gold
FROM spell_predictions AS p JOIN dated AS d USING (case_id)
WHERE (p.start_year IS NOT NULL OR p.end_year IS NOT NULL)
  AND (p.start_year IS NULL OR d.s IS NULL OR abs(p.start_year - d.s) <= 1)
  AND (p.end_year IS NULL OR d.e IS NULL OR abs(p.end_year - d.e) <= 1)
GROUP BY p.case_id, p.start_year, p.end_year, d.s, d.e""", _GOLD_SPELLS))
def interval_pairs(spark, sf):
    gold = derived(spark, sf, "spell_rows").select(
        "case_id", T.to_year(F.col("start_text")).alias("start_year"),
        T.to_year(F.col("end_text")).alias("end_year"))
    gold = gold.filter("start_year is not null or end_year is not null")
    return spells.compatible_pairs(derived(spark, sf, "spell_predictions"), gold)


# --- classification ----------------------------------------------------------------------

_COUNTS = """
counts AS (SELECT {slice} AS slice, gold, pred, count(*) AS n FROM {source} WHERE gold IS NOT NULL
           GROUP BY 1, 2, 3),
label_sides AS (
  SELECT slice, gold AS label, n AS support, 0 AS predicted, CASE WHEN gold = pred THEN n ELSE 0 END AS tp
  FROM counts
  UNION ALL SELECT slice, pred, 0, n, 0 FROM counts),
labels_of AS (
  SELECT 'overall' AS level, NULL AS slice, label, sum(support) AS support, sum(predicted) AS predicted,
         sum(tp) AS tp FROM label_sides GROUP BY label
  UNION ALL
  SELECT 'group', slice, label, sum(support), sum(predicted), sum(tp) FROM label_sides GROUP BY slice, label),
class_scores AS (
  SELECT *, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS p,
         CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS r,
         CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0.0 END AS f
  FROM labels_of)"""
_SUMMARY = """
SELECT level, slice, round_even(CAST(sum(tp) AS DOUBLE) / nullif(sum(support), 0), 6) AS accuracy,
       round_even(avg(f), 6) AS macro_f1,
       round_even(CAST(sum(f * support) AS DOUBLE) / nullif(sum(support), 0), 6) AS weighted_f1,
       CAST(sum(support) AS BIGINT) AS n_total, CAST(count(*) AS BIGINT) AS n_classes
FROM class_scores {where} GROUP BY level, slice"""
_QUALITY = _COUNTS.format(slice="lang", source="document_quality")


def _quality(spark, sf):
    return K.confusion(derived(spark, sf, "document_quality"), "lang")


@query("document_quality_scores", oracle(["document_quality"], _SUMMARY.format(where=""), _QUALITY))
def document_quality_scores(spark, sf):
    return K.summary(_quality(spark, sf), by_group=True).drop("n_skipped")


@query("class_report", oracle(["document_quality"], """
SELECT label, round_even(p, 6) AS "precision", round_even(r, 6) AS recall, round_even(f, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM class_scores WHERE level = 'overall'""", _QUALITY))
def class_report(spark, sf):
    return K.per_class(_quality(spark, sf))


_CODE_TABLES = ["spell_rows", "code_predictions", "raw_gold"]
_CODE_ALIGNED = """
aligned AS (
  SELECT p.case_id, p.spell_index, trim(p.predicted_code) AS pred, nullif(r.code, '') AS gold, g.country_label
  FROM code_predictions AS p JOIN (SELECT case_id, country_label FROM raw_gold WHERE trim(case_id) <> '') AS g
    ON g.case_id = p.case_id
  LEFT JOIN spell_rows AS r ON r.case_id = p.case_id AND r.slot = p.spell_index)"""


def _code_aligned(spark, sf):
    ids = derived(spark, sf, "raw_gold").filter("trim(case_id) <> ''")
    gold = derived(spark, sf, "spell_rows").select(
        "case_id", F.col("slot").alias("spell_index"), "code")
    return K.align(derived(spark, sf, "code_predictions"), gold, ids, "code")


@query("annotation_alignment", oracle(_CODE_TABLES, "SELECT case_id, spell_index, pred, gold FROM aligned",
                                      _CODE_ALIGNED))
def annotation_alignment(spark, sf):
    return _code_aligned(spark, sf)


@query("case_only_alignment", oracle(["raw_gold"], """
SELECT g.case_id, c.c_mktsegment AS pred, nullif(upper(g.job_title), '') AS gold
FROM raw_gold AS g JOIN customer AS c ON CAST(c.c_custkey AS VARCHAR) = g.case_id"""))
def case_only_alignment(spark, sf):
    gold = derived(spark, sf, "raw_gold").filter("trim(case_id) <> ''").select(
        "case_id", F.upper("job_title").alias("segment"))
    predictions = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("predicted_code"))
    return K.align(predictions, gold, gold, "segment", indexed=False)


@query("country_lookup", oracle(_CODE_TABLES, """
SELECT p.case_id, p.spell_index, coalesce(trim(g.country_label), 'unknown') AS slice
FROM code_predictions AS p LEFT JOIN (SELECT * FROM raw_gold WHERE country_label < 'NATION_5') AS g
ON g.case_id = p.case_id"""))
def country_lookup(spark, sf):
    lookup = derived(spark, sf, "raw_gold").filter("country_label < 'NATION_5' and trim(case_id) <> ''")
    return K.attach_group(
        derived(spark, sf, "code_predictions").select("case_id", "spell_index"), lookup)


@query("code_scores_by_country", oracle(
    _CODE_TABLES, _SUMMARY.format(where=""),
    _CODE_ALIGNED + "," + _COUNTS.format(slice="country_label", source="aligned")))
def code_scores_by_country(spark, sf):
    aligned = K.attach_group(_code_aligned(spark, sf), derived(spark, sf, "raw_gold"))
    return K.summary(K.confusion(aligned, "slice"), by_group=True).drop("n_skipped")


@query("broad_sector_scores", oracle(
    _CODE_TABLES, _SUMMARY.format(where="WHERE level = 'overall'"), _CODE_ALIGNED + r""",
broad AS (SELECT CASE WHEN regexp_full_match(trim(split_part(pred, '=', 1)), '[0-9]+') THEN substr(pred, 1, 1)
            ELSE pred END AS pred, substr(gold, 1, 1) AS gold FROM aligned),
""" + _COUNTS.format(slice="NULL", source="broad")))
def broad_sector_scores(spark, sf):
    aligned = _code_aligned(spark, sf).withColumns(
        {c: T.sector(F.col(c)) for c in ("gold", "pred")})
    return K.summary(K.confusion(aligned)).drop("n_skipped")


_RATES = """
rates AS (SELECT gold, pred, sum(n) AS n, CAST(sum(n) AS DOUBLE) / sum(sum(n)) OVER (PARTITION BY gold) AS rate
          FROM counts GROUP BY gold, pred)"""
_CODE_COUNTS = _CODE_ALIGNED + "," + _COUNTS.format(slice="NULL", source="aligned") + "," + _RATES


@query("confusion_rates", oracle(_CODE_TABLES, """
SELECT gold, pred, CAST(n AS BIGINT) AS n, round_even(rate, 6) AS rate FROM rates""", _CODE_COUNTS))
def confusion_rates(spark, sf):
    return K.normalised_confusion(K.confusion(_code_aligned(spark, sf)))


@query("confusion_rates_of_labels", oracle(_CODE_TABLES, """
SELECT gold, pred, CAST(n AS BIGINT) AS n, round_even(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY gold), 6) AS rate
FROM (SELECT substr(gold, 1, 1) AS gold, substr(pred, 1, 1) AS pred, sum(n) AS n FROM counts GROUP BY 1, 2)
WHERE gold BETWEEN '1' AND '9' AND pred BETWEEN '1' AND '5'""", _CODE_COUNTS))
def confusion_rates_of_labels(spark, sf):
    aligned = _code_aligned(spark, sf).withColumns(
        {c: F.substring(c, 1, 1) for c in ("gold", "pred")})
    return K.normalised_confusion(K.confusion(aligned), ["1", "2", "3", "4", "5"])


@query("top_confusions", oracle(_CODE_TABLES, """
SELECT gold, pred, CAST(n AS BIGINT) AS n, round_even(rate, 6) AS rate FROM rates
WHERE gold <> pred AND rate > 0.05""", _CODE_COUNTS))
def top_confusions(spark, sf):
    return K.top_confusions(K.normalised_confusion(K.confusion(_code_aligned(spark, sf)), with_total=True))


@query("prediction_gold_merge", oracle(["spell_rows", "code_predictions"], """
SELECT p.case_id, p.spell_index, p.predicted_code AS pred, r.code AS gold
FROM code_predictions AS p JOIN spell_rows AS r ON r.case_id = p.case_id AND r.slot = p.spell_index"""))
def prediction_gold_merge(spark, sf):
    gold = derived(spark, sf, "spell_rows").select("case_id", F.col("slot").alias("spell_index"), "code")
    return K.merge_gold(derived(spark, sf, "code_predictions"), gold, "code")


@query("label_vocabulary", "SELECT DISTINCT o_orderpriority AS label FROM orders")
def label_vocabulary(spark, sf):
    return K.vocabulary(table(spark, sf, "orders"), "o_orderpriority")


@query("label_union", oracle(_CODE_TABLES, """
SELECT label, CASE WHEN regexp_full_match(label, '[0-9]+') THEN CAST(label AS INT) ELSE 999 END AS sort_key
FROM (SELECT substr(gold, 1, 3) AS label FROM aligned WHERE gold IS NOT NULL
      UNION SELECT substr(pred, 1, 3) FROM aligned)""", _CODE_ALIGNED))
def label_union(spark, sf):
    aligned = _code_aligned(spark, sf).withColumns({c: F.substring(c, 1, 3) for c in ("gold", "pred")})
    return K.label_union(aligned)


@query("label_index", """
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS label_id
FROM (SELECT DISTINCT p_type || ' ' || p_brand AS label FROM part)""")
def label_index(spark, sf):
    parts = table(spark, sf, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("kind"))
    return K.label_index(parts, "kind")


_LABEL_PAIRS = """
pairs AS (SELECT a.label AS gold, b.label AS pred, count(*) AS n
          FROM embeddings AS a JOIN embeddings AS b ON b.vec_id = a.vec_id + 1 GROUP BY 1, 2),
anchors AS (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
units AS (SELECT label, CAST(v AS DOUBLE[]) AS v,
                 sqrt(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))) AS len FROM anchors)"""


@query("semantic_similarity", oracle([], """
SELECT round_even(sum(n * list_inner_product(g.v, p.v) / (g.len * p.len)) / sum(n), 6) AS semantic_similarity
FROM pairs JOIN units AS g ON g.label = pairs.gold JOIN units AS p ON p.label = pairs.pred""", _LABEL_PAIRS))
def semantic_similarity(spark, sf):
    vectors = table(spark, sf, "embeddings")
    shifted = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("pred"))
    aligned = vectors.select("vec_id", F.col("label").alias("gold")).join(shifted, "vec_id")
    anchors = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
    return K.semantic_similarity(K.confusion(aligned), anchors)


# --- distributions -------------------------------------------------------------------------

@query("score_description", oracle(_KEYED, """
SELECT measure, CAST(count(v) AS BIGINT) AS n, round_even(avg(v), 9) AS mean, round_even(stddev_samp(v), 9) AS std,
  min(v) AS "min", quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q75,
  max(v) AS "max"
FROM (SELECT 'f1' AS measure, f1 AS v FROM scored UNION ALL SELECT 'recall', recall FROM scored
      UNION ALL SELECT 'n_gold', CAST(n_gold AS DOUBLE) FROM scored) GROUP BY measure""",
                                   _KEYED_SCORED, recursive=True))
def score_description(spark, sf):
    return stats.describe(_spell_scores(spark, sf), ["f1", "recall", "n_gold"]).withColumns(
        {c: F.bround(c, 9) for c in ("mean", "std")})


@query("score_histogram", oracle(_KEYED, """
SELECT measure, CAST(least(20, floor(v * 20) + 1) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n
FROM (SELECT 'f1' AS measure, f1 AS v FROM scored UNION ALL SELECT 'precision', "precision" FROM scored)
GROUP BY 1, 2""", _KEYED_SCORED, recursive=True))
def score_histogram(spark, sf):
    return stats.histogram(_spell_scores(spark, sf), ["f1", "precision"])


@query("score_box_plot", """
SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, min(c_acctbal) AS low,
  quantile_cont(c_acctbal, 0.25) AS q25, quantile_cont(c_acctbal, 0.5) AS median,
  quantile_cont(c_acctbal, 0.75) AS q75, max(c_acctbal) AS high FROM customer GROUP BY c_mktsegment""")
def score_box_plot(spark, sf):
    return stats.box_plot(table(spark, sf, "customer"), "c_mktsegment", "c_acctbal")


@query("list_lengths", """
SELECT round_even(avg(len(string_split(text, ' '))), 6) AS mean_length,
       CAST(max(len(string_split(text, ' '))) AS BIGINT) AS max_length FROM documents""")
def list_lengths(spark, sf):
    words = table(spark, sf, "documents").select(F.split("text", " ").alias("words"))
    return stats.list_lengths(words, "words").withColumn("mean_length", F.bround("mean_length", 6))


@query("mean_of_groups", oracle(["document_quality"], """
SELECT round_even(avg(accuracy), 9) AS mean, CAST(count(DISTINCT slice) AS BIGINT) AS n_groups
FROM (""" + _SUMMARY.format(where="WHERE level = 'group'") + ")", _QUALITY))
def mean_of_groups(spark, sf):
    groups = K.summary(_quality(spark, sf), by_group=True).filter("level = 'group'")
    return stats.mean_of_groups(groups, "slice", "accuracy").withColumn("mean", F.bround("mean", 9))


@query("worst_cases", oracle(_KEYED, """
SELECT case_id, f1, n_gold FROM scored ORDER BY f1, case_id LIMIT 20""", _KEYED_SCORED, recursive=True))
def worst_cases(spark, sf):
    return stats.worst_cases(_spell_scores(spark, sf)).select("case_id", "f1", "n_gold")


# --- retrieval ---------------------------------------------------------------------------------

_HALVES = """
halves AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, substr(md5(CAST(vec_id AS VARCHAR)), 1, 1) AS h
           FROM embeddings),
sims AS (
  SELECT q.vec_id AS query_id, e.vec_id AS example_id,
         list_inner_product(q.v, e.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(e.v, e.v))
           + 1e-10) AS sim
  FROM halves AS q JOIN halves AS e ON {on} WHERE q.h < '8' AND e.h >= '8'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, example_id) AS rn
           FROM sims)"""
_NEAREST = """
SELECT query_id, example_id, round(sim, 6) AS similarity, CAST(rn AS INT) AS "rank" FROM ranked WHERE rn <= 5"""


def _halves(spark, sf):
    vectors = table(spark, sf, "embeddings").withColumn(
        "h", F.substring(F.md5(F.col("vec_id").cast("string")), 1, 1))
    return vectors.filter("h < '8'"), vectors.filter("h >= '8'")


@query("nearest_examples", oracle([], _NEAREST, _HALVES.format(on="q.label = e.label")))
def nearest_examples(spark, sf):
    queries, examples = _halves(spark, sf)
    return retrieval.nearest_examples(
        queries, examples, "vec_id", "vec_id", "label", "embedding"
    ).withColumn("similarity", F.round("similarity", 6))


# Labels 0 to 2 have no example, so their queries look at all of them.
@query("nearest_examples_of_all_groups", oracle([], _NEAREST, _HALVES.format(
    on="e.label > 2 AND (q.label = e.label OR q.label <= 2)")))
def nearest_examples_of_all_groups(spark, sf):
    queries, examples = _halves(spark, sf)
    return retrieval.nearest_examples(
        queries, examples.filter("label > 2"), "vec_id", "vec_id", "label", "embedding", fallback=True
    ).withColumn("similarity", F.round("similarity", 6))


@query("example_blocks", oracle([], """
SELECT query_id, chr(10) || 'Similar entries from the training data:' || chr(10)
  || string_agg('  ' || rn || '. "vector ' || example_id || '" | "" → ' || label, chr(10) ORDER BY rn)
  || chr(10) || chr(10) || 'Now classify:' AS block
FROM ranked JOIN halves ON example_id = vec_id WHERE rn <= 5 GROUP BY query_id""",
                                _HALVES.format(on="q.label = e.label")))
def example_blocks(spark, sf):
    from plumbline.functions.prompts import coded_example, example_block

    queries, examples = _halves(spark, sf)
    nearest = retrieval.nearest_examples(queries, examples, "vec_id", "vec_id", "label", "embedding")
    named = examples.select("vec_id", F.concat(F.lit("vector "), "vec_id").alias("title"),
                            F.col("label").cast("string").alias("code"))
    lists = retrieval.example_lists(nearest, named, "vec_id", ["title", "code"])
    return lists.select("query_id", example_block(
        F.col("examples"), lambda e: coded_example(e["title"], F.lit(""), e["code"])).alias("block"))


@query("cosine_to_group_anchor", oracle([], """
SELECT e.vec_id, round(list_inner_product(CAST(e.embedding AS DOUBLE[]), u.v)
  / (sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * u.len + 1e-10), 6)
  AS similarity FROM embeddings AS e JOIN units AS u USING (label)""", _LABEL_PAIRS))
def cosine_to_group_anchor(spark, sf):
    vectors = table(spark, sf, "embeddings")
    anchors = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("anchor"))
    return vectors.join(anchors, "label").select(
        "vec_id", F.round(V.cosine(F.col("embedding"), F.col("anchor")), 6).alias("similarity"))
