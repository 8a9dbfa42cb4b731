"""Register rows made from the tables, and the tables compared from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import derived, oracle, query, scratch, table
from catalog.metrics import _COUNTS, _SUMMARY
from plumbline.operators import classification as K, leaderboard as L, reshape
from plumbline.sources import sinks

# One run per document source: how well the length rule does on its documents.
_RUN_COUNTS = _COUNTS.format(slice="source", source="document_quality")
_RUN_SUMMARY = _SUMMARY.format(where="WHERE level = 'group'")
_RUNS = _RUN_COUNTS + ", summary_of AS (" + _RUN_SUMMARY + """),
register AS (
  SELECT 'runs/' || slice || '_' || CASE WHEN n.n < 10 THEN 'broad' ELSE 'fine' END || '/config.yaml'
           AS experiment_path,
         slice || '_' || CASE WHEN n.n < 10 THEN 'broad' ELSE 'fine' END AS run,
         'annotation' AS task, CASE WHEN n.n < 10 THEN 'career_position' ELSE 'uni_subject' END AS variable,
         slice AS model, 't' || n.n AS timestamp,
         round_even(greatest(accuracy - n.n / 100.0, 0), 6) AS accuracy, macro_f1, weighted_f1,
         n_total AS n_evaluated
  FROM summary_of, range(1, 13) AS n(n))"""


def _register(spark, sf):
    """Twelve submissions per source, later ones a little worse, kept as a register."""
    counts = K.confusion(derived(spark, sf, "document_quality"), "source")
    scores = K.summary(counts, by_group=True).filter("level = 'group'").withColumn(
        "n", F.explode(F.sequence(F.lit(1), F.lit(12))))
    early = F.col("n") < 10
    detail = F.to_json(F.struct(
        F.create_map(F.col("slice"), F.struct("accuracy", F.col("n_total").alias("n_evaluated")))
        .alias("per_country"),
        F.create_map(F.lit("1"), F.struct(F.col("macro_f1").alias("f1"), F.col("n_total").alias("support")))
        .alias("per_class"),
        F.col("macro_f1").alias("accuracy_when_predicted")))
    kind = F.when(early, "broad").otherwise("fine")
    return scores.select(
        F.concat(F.lit("t"), F.col("n").cast("string")).alias("timestamp"), F.lit("me").alias("contributor"),
        F.concat(F.lit("runs/"), "slice", F.lit("_"), kind, F.lit("/config.yaml")).alias("experiment_path"),
        F.lit("annotation").alias("task"),
        F.when(early, "career_position").otherwise("uni_subject").alias("variable"),
        F.col("slice").alias("model"), F.lit("").alias("model_notes"),
        F.col("n_total").cast("string").alias("n_evaluated"), F.lit("0").alias("n_skipped"),
        *[F.lit("").alias(c) for c in ("precision", "recall", "f1")],
        F.bround(F.greatest(F.col("accuracy") - F.col("n") / 100, F.lit(0.0)), 6).cast("string").alias("accuracy"),
        F.lit("").alias("mae"), F.col("macro_f1").cast("string"), F.col("weighted_f1").cast("string"),
        F.lit("").alias("semantic_similarity"), detail.alias("metrics_json"))


_SHOWN = "run, variable, model, accuracy, macro_f1, weighted_f1"


@query("register_rows", oracle(["document_quality"], """
SELECT 'annotation' AS task, slice AS model, CAST(n_total AS VARCHAR) AS n_evaluated,
       accuracy, macro_f1, weighted_f1, '' AS mae, '' AS semantic_similarity
FROM summary_of""", _RUN_COUNTS + ", summary_of AS (" + _RUN_SUMMARY + ")"))
def register_rows(spark, sf):
    counts = K.confusion(derived(spark, sf, "document_quality"), "source")
    scores = K.summary(counts, by_group=True).filter("level = 'group'").select(
        "*", F.col("n_total").alias("n_evaluated"))
    rows = sinks.register_row(scores, "annotation", "quality", F.to_json(F.struct("slice", "accuracy")))
    numbers = [F.get_json_object("metrics_json", "$.slice").alias("model"), "task", "n_evaluated",
               *[F.col(c).cast("double").alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")],
               "mae", "semantic_similarity"]
    return rows.select(*numbers)


@query("register_runs", oracle(["document_quality"], f"""
SELECT {_SHOWN}, CAST(n_evaluated AS DOUBLE) AS n_evaluated FROM register WHERE variable = 'career_position'""", _RUNS))
def register_runs(spark, sf):
    path = scratch(spark, "register")
    sinks.append_register(_register(spark, sf), path)
    return L.runs(sinks.read_register(spark, path), "annotation", "career_position").select(
        *_SHOWN.split(", "), "n_evaluated")


_BEST = _RUNS + """,
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY accuracy DESC, timestamp) AS rn
         FROM register WHERE accuracy > 0) WHERE rn = 1)"""


def _best(spark, sf):
    return L.best_runs(L.runs(_register(spark, sf), "annotation"), "accuracy")


@query("best_runs", oracle(["document_quality"], f"SELECT {_SHOWN}, timestamp FROM best", _BEST))
def best_runs(spark, sf):
    return _best(spark, sf).select(*_SHOWN.split(", "), "timestamp")


@query("best_runs_per_variable", oracle(["document_quality"], """
SELECT model, variable, max(accuracy) AS accuracy FROM register GROUP BY model, variable""", _RUNS))
def best_runs_per_variable(spark, sf):
    best = L.best_runs(L.runs(_register(spark, sf), "annotation"), "accuracy", ("model", "variable"),
                       positive=False)
    return best.select("model", "variable", "accuracy")


_FAMILIES = ["OSS", "Encoder", "Closed"]
_FAMILY = "CASE WHEN name < 'src12' THEN 'Encoder' WHEN name < 'src2' THEN 'Closed' ELSE 'OSS' END"
_BOARD = _BEST + f""",
names AS (SELECT DISTINCT source AS name FROM documents),
catalogue AS (SELECT {_FAMILY} AS family, name AS model, name || '_' || k AS run, k
              FROM names, (VALUES ('broad'), ('fine'), ('none')) AS v(k)),
board AS (SELECT c.family, c.model, c.run, c.k, round(b.accuracy, 4) AS accuracy, round(b.macro_f1, 4) AS macro_f1,
            CASE c.family WHEN 'OSS' THEN 1 WHEN 'Encoder' THEN 2 ELSE 3 END AS family_rank
          FROM catalogue AS c LEFT JOIN best AS b USING (run))"""


def _catalogue(spark, sf, kind):
    names = table(spark, sf, "documents").select(F.col("source").alias("name")).distinct()
    return names.select(F.expr(_FAMILY).alias("family"), F.col("name").alias("model"),
                        F.concat("name", F.lit(f"_{kind}")).alias("run"))


def _board(spark, sf, kind):
    return L.board(_catalogue(spark, sf, kind), _best(spark, sf), ["accuracy", "macro_f1"], _FAMILIES)


@query("catalogue_board", oracle(["document_quality"], """
SELECT family, model, run, accuracy, macro_f1, family_rank FROM board WHERE k = 'broad'
UNION ALL SELECT family, model, run, accuracy, macro_f1, family_rank FROM board WHERE k = 'none'""", _BOARD))
def catalogue_board(spark, sf):
    return _board(spark, sf, "broad").unionByName(_board(spark, sf, "none"))


@query("broad_fine_comparison", oracle(["document_quality"], """
SELECT a.family, a.model, a.accuracy AS accuracy_broad, a.macro_f1 AS macro_f1_broad,
       b.accuracy AS accuracy_fine, b.macro_f1 AS macro_f1_fine
FROM board AS a JOIN board AS b ON a.model = b.model AND a.k = 'broad' AND b.k = 'fine'""", _BOARD))
def broad_fine_comparison(spark, sf):
    return L.side_by_side(_board(spark, sf, "broad"), _board(spark, sf, "fine"), ["accuracy", "macro_f1"])


@query("ordered_families", oracle([], f"""
SELECT p_type, p_brand, CASE p_type WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 2 ELSE 3 END AS family_rank,
       CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_type, p_brand"""))
def ordered_families(spark, sf):
    parts = table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    named = parts.withColumns({"family": F.col("p_type"), "model": F.col("p_brand")})
    return L.ordered(named, ["SMALL", "LARGE"]).select(
        "p_type", "p_brand", F.col("family_rank").cast("int").alias("family_rank"), "n")


@query("country_details", oracle(["document_quality"], """
SELECT r.run, r.model AS name, s.accuracy, CAST(s.n_total AS BIGINT) AS n_evaluated
FROM register AS r JOIN summary_of AS s ON s.slice = r.model""", _RUNS))
def country_details(spark, sf):
    rows = L.runs(_register(spark, sf), "annotation")
    return L.detail_rows(rows, "per_country", ["run"]).select("run", "name", "accuracy", "n_evaluated")


@query("class_details", oracle(["document_quality"], """
SELECT run, '1' AS name, macro_f1 AS f1, n_evaluated AS support FROM register""", _RUNS))
def class_details(spark, sf):
    rows = L.runs(_register(spark, sf), "annotation")
    return L.detail_rows(rows, "per_class", ["run"]).select("run", "name", "f1", "support")


@query("event_details", """
SELECT event_id, event_type || json_extract_string(props, '$.k') AS name, value AS accuracy
FROM events WHERE event_type <> 'error'""")
def event_details(spark, sf):
    payload = F.when(F.col("event_type") == "error", F.lit('{"per_country": broken')).otherwise(F.to_json(
        F.struct(F.create_map(F.concat("event_type", F.get_json_object("props", "$.k")),
                              F.struct(F.col("value").alias("accuracy"))).alias("per_country"))))
    events = table(spark, sf, "events").select("event_id", payload.alias("metrics_json"))
    return L.detail_rows(events, "per_country", ["event_id"]).select("event_id", "name", "accuracy")


@query("detail_values", oracle(["document_quality"], """
SELECT run, timestamp, macro_f1 AS when_predicted FROM register""", _RUNS))
def detail_values(spark, sf):
    rows = L.runs(_register(spark, sf), "annotation")
    return rows.select("run", "timestamp", L.detail_value(rows, "accuracy_when_predicted").alias("when_predicted"))


@query("score_matrix", oracle(["document_quality"], """
SELECT model, max(accuracy) FILTER (variable = 'career_position') AS career_position,
       max(accuracy) FILTER (variable = 'uni_subject') AS uni_subject FROM register GROUP BY model""", _RUNS))
def score_matrix(spark, sf):
    rows = L.runs(_register(spark, sf), "annotation")
    return L.score_matrix(rows, ["model"], "accuracy", ["career_position", "uni_subject"])


@query("pivot_mean", """
SELECT p_brand, avg(p_size) FILTER (p_type = 'SMALL') AS "SMALL", avg(p_size) FILTER (p_type = 'LARGE') AS "LARGE"
FROM part WHERE p_type IN ('SMALL', 'LARGE') GROUP BY p_brand""")
def pivot_mean(spark, sf):
    parts = table(spark, sf, "part").filter("p_type in ('SMALL', 'LARGE')")
    return reshape.pivot_mean(parts, "p_brand", "p_type", "p_size", ["SMALL", "LARGE"])


@query("pivot_metrics", """
SELECT c_nationkey, max(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS "BUILDING_top",
  CAST(max(c_custkey) FILTER (c_mktsegment = 'BUILDING') AS BIGINT) AS "BUILDING_last",
  max(c_acctbal) FILTER (c_mktsegment = 'FURNITURE') AS "FURNITURE_top",
  CAST(max(c_custkey) FILTER (c_mktsegment = 'FURNITURE') AS BIGINT) AS "FURNITURE_last"
FROM customer GROUP BY c_nationkey""")
def pivot_metrics(spark, sf):
    customers = table(spark, sf, "customer").select(
        "c_nationkey", "c_mktsegment", F.col("c_acctbal").alias("top"), F.col("c_custkey").alias("last"))
    return reshape.pivot_first(customers, "c_nationkey", "c_mktsegment", ["top", "last"],
                               ["BUILDING", "FURNITURE"])


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


# The two pivots above show a part of the values; these show all of them.
@query("pivot_mean_all_types", "SELECT p_brand, " + ", ".join(
    f"avg(p_size) FILTER (p_type = '{v}') AS \"{v}\"" for v in _TYPES) + " FROM part GROUP BY p_brand")
def pivot_mean_all_types(spark, sf):
    return reshape.pivot_mean(table(spark, sf, "part"), "p_brand", "p_type", "p_size", _TYPES)


@query("pivot_metrics_all_segments", "SELECT c_nationkey, " + ", ".join(
    f"max(c_acctbal) FILTER (c_mktsegment = '{v}') AS \"{v}_top\", "
    f"CAST(max(c_custkey) FILTER (c_mktsegment = '{v}') AS BIGINT) AS \"{v}_last\"" for v in _SEGMENTS)
    + " FROM customer GROUP BY c_nationkey")
def pivot_metrics_all_segments(spark, sf):
    customers = table(spark, sf, "customer").select(
        "c_nationkey", "c_mktsegment", F.col("c_acctbal").alias("top"), F.col("c_custkey").alias("last"))
    return reshape.pivot_first(customers, "c_nationkey", "c_mktsegment", ["top", "last"], _SEGMENTS)
