"""Inputs and evaluation with perfect, wrong and empty predictions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline import evaluate, evaluate_many, load_inputs, load_training_data
from plumbline.operators.reshape import career_spells


def run(predictions, task, variable=None, **kw):
    return evaluate(predictions, task, variable, **kw)


def test_inputs_have_no_labels(gold, silver, test_cases):
    n_test = test_cases.count()
    collection = load_inputs("collection", gold)
    assert collection.columns == ["case_id", "name_first", "name_last", "job_title", "country_label"]
    assert collection.count() == n_test == 12
    assert load_inputs("extraction", gold).columns == ["case_id", "cv_local"]
    keys = [r.case_id for r in collection.collect()]
    assert keys == sorted(keys)
    annotation = load_inputs("annotation", gold, "career_position", silver)
    assert {r.case_id for r in annotation.collect()} <= set(keys)


def test_training_side_is_disjoint(gold, silver):
    test = {r.case_id for r in load_inputs("collection", gold).collect()}
    train = load_training_data("annotation", ["career_position"], gold, "career_position", silver)
    assert train.columns == ["case_id", "career_position"]
    assert not test & {r.case_id for r in train.collect()}
    assert load_training_data("extraction", ["sex"], gold).count() + len(test) == 61


def test_collection(gold, test_cases):
    perfect = test_cases.select("case_id", F.col("cv_links").alias("retrieved_urls"))
    row = run(perfect, "collection", gold=gold).summary.first()
    assert (row.f1, row.n_evaluated, row.n_skipped) == (1.0, 12, 0)
    empty = test_cases.select("case_id", F.array().cast("array<string>").alias("retrieved_urls"))
    assert run(empty, "collection", gold=gold).summary.first().recall == 0.0


def test_birth_year(gold, test_cases):
    off = test_cases.select("case_id", (F.col("birth_year") + 5).alias("birth_year"))
    result = run(off, "extraction", "birth_year", gold=gold)
    row = result.summary.first()
    assert (row.mae, row.accuracy, row.n_evaluated) == (5.0, 0.0, 12)
    assert {r.mae for r in result.per_country.collect()} == {5.0}
    half = off.orderBy("case_id").limit(5)
    row = run(half, "extraction", "birth_year", gold=gold).summary.first()
    assert (row.n_evaluated, row.n_missing, row.n_skipped) == (5, 7, 7)


def test_text_fields(gold, test_cases):
    degree = test_cases.select("case_id", F.lit("7").alias("edu_degree"))
    assert run(degree, "extraction", "edu_degree", gold=gold).summary.first().accuracy == 1.0
    place = test_cases.select("case_id", F.upper("birth_place").alias("birth_place"))
    result = run(place, "extraction", "birth_place", gold=gold)
    assert result.summary.first().accuracy == 1.0
    assert "mae" not in result.summary.columns


def test_last_prediction_counts(gold, test_cases):
    both = test_cases.select("case_id", F.explode(F.array(
        F.struct(F.lit(1).alias("o"), F.lit("9").alias("sex")),
        F.struct(F.lit(2).alias("o"), F.col("sex").alias("sex")))).alias("p")).select("case_id", "p.*")
    row = run(both, "extraction", "sex", gold=gold, order="o").summary.first()
    assert (row.accuracy, row.n_evaluated) == (1.0, 12)


def career_predictions(test_cases, shift=0):
    spells = career_spells(test_cases)
    return spells.groupBy("case_id").agg(F.collect_list(F.struct(
        (F.col("career_start_year") + shift).alias("start_year"),
        F.col("career_end_year").alias("end_year"),
        F.col("career_position").alias("position"))).alias("career"))


@pytest.mark.parametrize("shift, tolerance, f1", [(0, None, 1.0), (1, None, 1.0), (30, 1, 0.0), (3, 3, 1.0)])
def test_career(gold, test_cases, shift, tolerance, f1):
    result = run(career_predictions(test_cases, shift), "extraction", "career", gold=gold,
                 tolerance_years=tolerance)
    row = result.summary.first()
    assert (row.f1, row.tolerance_years) == (f1, 1 if tolerance is None else tolerance)
    assert result.per_case.count() == 12


def annotation_predictions(silver, code):
    return silver.filter("job_description_label <> ''").select(
        "case_id", "spell_index", code.alias("predicted_code"))


def test_annotation(spark, gold, silver):
    perfect = annotation_predictions(silver, F.col("career_position"))
    vectors = spark.createDataFrame([("105 = Minister", [1.0, 0.0]), ("401 = Parliament", [0.0, 2.0])],
                                    "label string, vector array<float>")
    result = run(perfect, "annotation", "career_position", gold=gold, silver=silver,
                 label_vectors=vectors)
    row = result.summary.first()
    assert (row.accuracy, row.macro_f1, row.weighted_f1, row.n_skipped) == (1.0, 1.0, 1.0, 0)
    assert row.semantic_similarity == 1.0
    assert {r.label for r in result.per_class.collect()} == {"105 = Minister", "401 = Parliament"}
    wrong = annotation_predictions(silver, F.lit("000 = wrong"))
    row = run(wrong, "annotation", "career_position", gold=gold, silver=silver).summary.first()
    assert (row.accuracy, row.semantic_similarity) == (0.0, None)
    shifted = perfect.withColumn("spell_index", F.col("spell_index") + 30)
    row = run(shifted, "annotation", "career_position", gold=gold, silver=silver).summary.first()
    assert (row.accuracy, row.n_evaluated) == (None, 0) and row.n_skipped > 0


def test_broad_and_prefix(gold, silver):
    broad = annotation_predictions(silver, F.substring("career_position", 1, 1))
    row = run(broad, "annotation", "career_position", gold=gold, silver=silver,
              granularity="broad").summary.first()
    assert (row.accuracy, row.granularity) == (1.0, "broad")
    subjects = silver.filter("subject_label <> ''").select(
        "case_id", "spell_index", F.substring("uni_subject", 1, 2).alias("predicted_code"))
    row = run(subjects, "annotation", "uni_subject", gold=gold, silver=silver).summary.first()
    assert (row.accuracy, row.n_classes) == (1.0, 2)


def test_register_row_of_an_evaluation(gold, silver):
    import json

    result = run(annotation_predictions(silver, F.col("career_position")), "annotation",
                 "career_position", gold=gold, silver=silver)
    row = result.register_row(contributor="me", experiment_path="runs/a/c.yaml", model="m").first()
    assert (row.task, row.accuracy, row.contributor) == ("annotation", "1.0", "me")
    detail = json.loads(row.metrics_json)
    assert detail["per_class"]["105 = Minister"]["f1"] == 1.0
    assert detail["per_country"]["BEL"]["accuracy"] == 1.0


def test_any_number_of_details_is_kept(spark, tmp_path):
    import json

    from plumbline.operators import leaderboard
    from plumbline.plans.evaluate import Evaluation
    from plumbline.sources import sinks

    n = 10_050
    labels = spark.range(n).select(
        F.format_string("%05d", "id").alias("label"), (F.col("id") / n).alias("precision"),
        F.lit(1.0).alias("recall"), F.lit(0.5).alias("f1"), F.col("id").alias("support"))
    countries = spark.range(n).select(
        F.format_string("C%05d", "id").alias("country"), (F.col("id") / n).alias("accuracy"),
        F.lit(0.5).alias("macro_f1"), F.lit(0.5).alias("weighted_f1"), F.col("id").alias("n_evaluated"))
    summary = spark.sql("select 'annotation' task, 'career_position' variable, 0.5D accuracy, "
                        "0.4D macro_f1, 0.6D weighted_f1, 10L n_evaluated, 0L n_skipped")
    result = Evaluation("annotation", "career_position", summary, None, labels, countries)
    whole = json.loads(result.register_row().first().metrics_json)
    assert len(whole["per_class"]) == len(whole["per_country"]) == n
    assert whole["per_class"]["10049"]["support"] == 10049
    register, details = str(tmp_path / "register"), str(tmp_path / "details")
    for model in ("a", "b"):
        result.store(register, details, experiment_path="runs/a/c.yaml", model=model)
    rows = sinks.read_register(spark, register).collect()
    assert sorted((r.model, r.accuracy, "per_class" in r.metrics_json) for r in rows) == [
        ("a", "0.5", False), ("b", "0.5", False)]
    stored = spark.read.parquet(details)
    got = leaderboard.stored_detail_rows(stored, "per_class", ["model"])
    want = labels.select("precision", "recall", "f1", "support")
    assert got.columns == ["model", "name", *want.columns]
    for model in ("a", "b"):
        assert {tuple(r) for r in got.filter(F.col("model") == model).drop("model").collect()} == {
            tuple(r) for r in labels.collect()}
    places = leaderboard.stored_detail_rows(stored, "per_country", ["timestamp", "model"])
    assert places.count() == 2 * n
    assert {(r.timestamp, r.model) for r in places.select("timestamp", "model").distinct().collect()} == {
        (r.timestamp, r.model) for r in rows}


def test_many_fields_equal_single_evaluations(gold, test_cases):
    fields = ["birth_year", "sex", "birth_place", "edu_degree"]
    predictions = test_cases.select(
        "case_id", (F.col("birth_year") + 1).alias("birth_year"), F.lit("0 = male").alias("sex"),
        F.substring("birth_place", 1, 4).alias("birth_place"), F.lit("7").alias("edu_degree"))
    together = {r.variable: r for r in evaluate_many(predictions, gold, fields).collect()}
    for field in fields:
        alone = run(predictions.select("case_id", field), "extraction", field, gold=gold).summary.first()
        assert together[field].accuracy == pytest.approx(alone.accuracy)
        assert together[field].n_evaluated == alone.n_evaluated
    assert together["birth_year"].mae == 1.0


@pytest.mark.parametrize("kwargs, message", [
    (dict(task="unknown_task", variable="sex"), "unknown_task"),
    (dict(task="extraction"), "variable"),
    (dict(task="annotation"), "variable"),
    (dict(task="extraction", variable="education"), "Unknown extraction"),
    (dict(task="annotation", variable="edu_start"), "Unknown annotation variable"),
    (dict(task="extraction", variable="sex", granularity="broad"), "granularity"),
    (dict(task="extraction", variable="birth_year"), "missing required"),
])
def test_validation(spark, gold, kwargs, message):
    predictions = spark.createDataFrame([("p1", "x")], "case_id string, sex string")
    with pytest.raises(ValueError, match=message):
        evaluate(predictions, gold=gold, **kwargs)


def test_predictions_need_key_and_rows(spark, gold):
    with pytest.raises(ValueError, match="case_id"):
        evaluate(spark.range(1), "collection", gold=gold)
    with pytest.raises(ValueError, match="empty"):
        evaluate(spark.createDataFrame([], "case_id string, sex string"), "extraction", "sex", gold=gold)
    with pytest.raises(TypeError):
        evaluate([1], "collection", gold=gold)
