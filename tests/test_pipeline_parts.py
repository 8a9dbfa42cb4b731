"""Sources, cleaning, split, reshape, parsing, codes, jobs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from plumbline import registry as R
from plumbline.functions import parsing as P, prompts, text as T
from plumbline.operators import cleaning as C, codes, model_jobs as M, reshape, retrieval, splits
from plumbline.plans.silver import build_silver
from plumbline.sources import cache, sinks, tables


# --- sources --------------------------------------------------------------------

def test_gold_csv_with_mark_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "gold.csv"
    path.write_text(
        '﻿case_id;country_label;missing_type;birth_year;cv_local\n'
        'p1;BEL;;1960;"line one\nline ""two"""\n'
        ' ;BEL;;1961;x\n'
        'p3;BEL;4 = partial;1962;x\n'
        'p4;BEL;;99.5;\n', encoding="utf-8")
    report = C.DropReport()
    rows = {r.case_id: r for r in tables.load_gold(spark, str(path), report=report).collect()}
    assert set(rows) == {"p1", "p4"}
    assert rows["p1"].cv_local == 'line one\nline "two"'
    assert (rows["p1"].birth_year, rows["p4"].birth_year) == (1960, None)
    assert rows["p4"].cv_local == ""
    assert report.counts() == {"blank_key": 1, "flagged": 1}


@pytest.mark.parametrize("header, expected", [("a;b;c", ";"), ("a,b;c,d", ","), ("abc", ",")])
def test_separator(spark, tmp_path, header, expected):
    path = tmp_path / "t.csv"
    path.write_text(header + "\n1\n")
    assert tables.detect_separator(spark, str(path)) == expected


def test_missing_source(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="gold table not found"):
        tables.load_gold(spark, str(tmp_path / "none.csv"))
    with pytest.raises(FileNotFoundError, match="silver table not found"):
        tables.load_silver(spark, str(tmp_path / "none.csv"))


def test_gold_from_parquet(spark, tmp_path):
    path = str(tmp_path / "gold.parquet")
    spark.createDataFrame([("a", "1960")], "case_id string, birth_year string").write.parquet(path)
    assert tables.load_gold(spark, path).first().birth_year == 1960


def test_silver_with_education_rows(spark, tmp_path):
    career, education = tmp_path / "s.csv", tmp_path / "e.csv"
    career.write_text("case_id,spell_index,career_position,job_description_label,workplace_label\n"
                      "p1,1,401,MP,House\np1,2,401,MP,\np2,x,1,Job,\np3,1,1,A,\np3,1,1,B,\n ,1,1,C,\n")
    education.write_text("case_id,spell_index,uni_subject,subject_label\np1,1,03,Law\np3,1,03,Law\n")
    df = tables.load_silver(spark, str(career), str(education))
    got = sorted((r.case_id, r.spell_index, r.subject_label) for r in df.collect())
    # p2 has a bad index, p3 repeats one and is dropped with all its rows.
    assert got == [("p1", 1, ""), ("p1", 1, "Law"), ("p1", 2, "")]
    alone = tables.load_silver(spark, str(career), str(tmp_path / "absent.csv"))
    assert alone.count() == 2


def test_register_round_trip(spark, tmp_path):
    summary = spark.createDataFrame([(0.5, 0.4, 0.6, 10, 2)],
                                    "accuracy double, macro_f1 double, weighted_f1 double, "
                                    "n_evaluated long, n_skipped long")
    row = sinks.register_row(summary, "annotation", "career_position", F.lit('{"a": "b,c"}'),
                             contributor="me\nyou", model_notes='say "hi" there', model="m")
    path = str(tmp_path / "register")
    sinks.append_register(row, path)
    sinks.append_register(row, path)
    rows = sinks.read_register(spark, path).collect()
    assert len(rows) == 2 and tuple(rows[0].__fields__) == R.REGISTER_COLUMNS
    assert rows[0].contributor == "me you" and rows[0].model_notes == 'say "hi" there'
    assert rows[0].metrics_json == '{"a": "b,c"}' and rows[0].macro_f1 == "0.4"


def test_cache_computes_only_misses(spark, tmp_path):
    path, asked = str(tmp_path / "cache"), []

    def compute(missing):
        asked.append(sorted(r.k for r in missing.collect()))
        return missing.withColumn("v", F.length("k"))

    for keys in (["a", "bb", "a"], ["bb", "ccc"]):
        df = spark.createDataFrame([(k,) for k in keys], "k string")
        got = cache.through_cache(df, ["k"], path, "k string, v int", compute)
        assert {r.k: r.v for r in got.collect()} == {k: len(k) for k in keys}
    assert asked == [["a", "bb"], ["ccc"]]


# --- cleaning --------------------------------------------------------------------

def test_duplicated_index_drops_the_case_per_group(spark):
    df = spark.createDataFrame([
        ("a", 1, "x", ""), ("a", 1, "", "y"),     # one row per group: fine
        ("b", 1, "x", ""), ("b", 1, "z", ""), ("b", 2, "x", ""),
    ], "case_id string, spell_index int, job_description_label string, subject_label string")
    assert {r.case_id for r in C.drop_duplicated_cases(df).collect()} == {"a"}


def test_index_without_content_is_kept(spark):
    df = spark.createDataFrame([("a", "x", ""), ("b", "x", "job"), ("c", "2.0", "job")],
                               "case_id string, spell_index string, job_description_label string")
    got = {r.case_id: r.spell_index for r in C.coerce_spell_index(df).collect()}
    assert got == {"a": None, "c": 2}


def test_keep_first_and_filters(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 3, "b"), (" ", 4, "x")],
                               "case_id string, o int, v string")
    ids = spark.createDataFrame([("a",)], "case_id string")
    assert [r.v for r in C.load_cases(df, "o", ids).collect()] == ["early"]
    assert C.load_cases(df, "o", limit=1).count() == 1


def test_unknown_feature_warns(gold):
    with pytest.warns(UserWarning, match="no_such"):
        assert C.select_features(gold, ["sex", "no_such"]).columns == ["case_id", "sex"]


def test_repeated_column_names_are_rejected(spark):
    df = spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("a"))
    with pytest.raises(ValueError, match="duplicate column"):
        C.check_unique_columns(df)


# --- split ------------------------------------------------------------------------

def test_split_properties(spark):
    rows = [(f"k{i}", f"g{i % 7}" if i % 50 else f"lone{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "case_id string, country_label string")
    sides = splits.stratified_split(df)
    first = {r.case_id: r.split for r in sides.collect()}
    assert len(first) == 2000
    n_test = sum(s == "test" for s in first.values())
    assert n_test == -(-1960 // 5)  # 40 single-row strata train only
    assert abs(n_test / 2000 - 0.2) < 0.02
    assert all(first[k] == "train" for k, g in rows if g.startswith("lone"))
    again = splits.stratified_split(df.repartition(3, "country_label")).collect()
    assert {r.case_id: r.split for r in again} == first
    shares = {}
    for k, g in rows:
        shares.setdefault(g, []).append(first[k] == "test")
    assert all(abs(sum(v) / len(v) - 0.2) < 0.01 for g, v in shares.items() if g.startswith("g"))


def test_split_of_one_hot_stratum_and_tiny_ones(spark):
    rows = [(f"h{i}", "hot") for i in range(900)] + [
        (f"t{i}-{j}", f"tiny{i}") for i in range(50) for j in range(2)]
    df = spark.createDataFrame(rows, "case_id string, country_label string")
    got = splits.stratified_split(df).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in got} == {"test": 200, "train": 800}


def test_few_shot_pool_has_one_row_per_group(gold):
    pool = splits.few_shot_pool(gold.select("case_id", "country_label"), "country_label",
                                F.col("case_id"), 3).collect()
    assert len(pool) == 3 and len({r.country_label for r in pool}) == 3


# --- reshape ------------------------------------------------------------------------

def wide(spark, **values):
    return spark.createDataFrame([tuple(values.values())],
                                 ", ".join(f"{k} string" for k in values))


@pytest.mark.parametrize("values, expected", [
    (dict(p="MP", s="2000", e="2004"), [(1, 2000, 2004)]),
    (dict(p="", s="2000", e="2004"), []),
    (dict(p="nan", s="2000", e="2004"), []),
    (dict(p="MP", s="", e=""), []),
    (dict(p="MP", s="1998", e=""), [(1, 1998, None)]),
    (dict(p="MP", s="", e="2010.0"), [(1, None, 2010)]),
    (dict(p="MP", s="x", e="2010.7"), [(1, None, 2010)]),
])
def test_spell_anchors(spark, values, expected):
    df = wide(spark, career_position_1=values["p"], career_start_year_1=values["s"],
              career_end_year_1=values["e"])
    got = df.select(reshape.spell_anchors(df).alias("a")).first().a
    assert [(a.spell_index, a.start_year, a.end_year) for a in got] == expected


def test_gap_keeps_the_index(spark):
    df = wide(spark, career_position_1="", career_start_year_1="2000", career_end_year_1="",
              career_position_2="401 = politics", career_start_year_2="2005", career_end_year_2="2009")
    got = df.select(reshape.spell_anchors(df).alias("a")).first().a
    assert [(a.spell_index, a.category) for a in got] == [(2, "401 = politics")]


def test_education_anchor(spark):
    df = wide(spark, edu_degree="", edu_start="2000", edu_end="x", uni_subject_1="Law",
              uni_name_1="KU Leuven", uni_subject_2="nan", uni_subject_3=" Economics ")
    a = df.select(reshape.education_anchor(df).alias("a")).first().a
    assert (a.edu_degree, a.edu_start, a.edu_end) == ("unknown", 2000, None)
    assert [(s.subject_index, s.code, s.uni_name) for s in a.subjects] == [
        (1, "Law", "KU Leuven"), (3, "Economics", None)]
    none = wide(spark, edu_degree="7 = Master")
    assert none.select(reshape.education_anchor(none).alias("a")).first().a is None


def test_predicted_spells_are_cleaned(spark):
    df = spark.createDataFrame(
        [([("2000", "2001"), ("2000.5", None), ("-1", "0"), (None, " 2005 ")],), (None,)],
        "career array<struct<start_year:string,end_year:string>>")
    rows = df.select(reshape.predicted_spells(df, "career").alias("p")).collect()
    assert [(s.start_year, s.end_year) for s in rows[0].p] == [(2000, 2001), (None, 2005)]
    assert rows[1].p is None
    with pytest.raises(ValueError, match="array of structs"):
        reshape.predicted_spells(df.select(F.lit("x").alias("career")), "career")


# --- scalars and parsing ---------------------------------------------------------------

@pytest.mark.parametrize("fn, value, expected", [
    (T.sector, "105 = Minister", "1"), (T.sector, "999", "9"), (T.sector, "x = y", "x = y"),
    (T.sector, "", ""),
    (T.numeric_prefix, "03 – Social", "03"), (T.numeric_prefix, "abc", "abc"),
    (T.numeric_prefix, " 3", "3"),
    (T.degree_prefix, "  6. Bachelor", "6"), (T.degree_prefix, "none", "none"),
    (T.normalise_value, " N/A ", "__na__"), (T.normalise_value, "\tParis\n", "paris"),
    (T.to_year, "2010.0", 2010), (T.to_year, "2010.5", None), (T.to_year, "12d", None),
    (T.to_year, " 1e3 ", 1000), (T.truncated_year, "-3.9", -3),
    (T.positive_int, "2010.0", None), (T.positive_int, "0", None), (T.positive_int, " 7 ", 7),
    (T.experiment_folder, "a\\b\\c.yaml", "b"), (T.experiment_folder, "alone", "alone"),
    (T.pipe_set, " a | b||a ", ["a", "b"]),
])
def test_scalar(spark, fn, value, expected):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(fn(F.col("v"))).first()[0] == expected


@pytest.mark.parametrize("text, expected", [
    ('```json\n{"a": 1}\n```', "1"), ('Sure: {"a": "x"} done', "x"), ("{'a': 1}", None),
    ("no", None), ('{"a": 1', None), ('{"a": {"b": 2}}', '{"b":2}'),
])
def test_json_object(spark, text, expected):
    df = spark.createDataFrame([(text,)], "v string")
    assert df.select(P.json_field(P.json_object(F.col("v")), "a")).first()[0] == expected


def test_json_spells(spark):
    text = '[{"start_year": 1990, "end_year": null, "position": "MP"}, "x", {"start_year": "1991.0"},' \
           ' {"start_year": 1992.9, "end_year": "1995"}]'
    df = spark.createDataFrame([(text,), ("none",), ("[bad",)], "v string")
    rows = [r.s for r in df.select(P.json_spells(F.col("v")).alias("s")).collect()]
    assert [tuple(s) for s in rows[0]] == [
        (1990, None, "MP"), (None, None, None), (1992, 1995, None)]
    assert rows[1] == [] and rows[2] == []


def test_prompts(spark):
    df = spark.sql("""select 'CV.' as text, array(named_struct('spell_index', 3, 'start_year', 1995,
        'end_year', cast(null as int), 'category', '401 = x')) as spells""")
    got = df.select(prompts.career_prompt(F.col("text"), F.col("spells"))).first()[0]
    assert "  - spell_index 3: 1995 – ?  [category: 401 = x]" in got
    edu = spark.sql("""select 'CV.' as text, named_struct('edu_degree', '7 = Master', 'edu_start',
        cast(null as int), 'edu_end', cast(null as int), 'subjects', array(named_struct(
        'subject_index', 3, 'code', 'Law', 'uni_name', cast(null as string)))) as a""")
    got = edu.select(prompts.education_prompt(F.col("text"), F.col("a"))).first()[0]
    assert "Period:" not in got and "university" not in got and "  - subject_index 3: Law\n" in got


# --- codes -----------------------------------------------------------------------------

FINE = ["105 = Minister A", "105 = Minister B", "401 = Politics, parliament", "999 = Missing"]


def resolve(spark, texts, vocab, rule):
    df = spark.createDataFrame([(x,) for x in texts], "answer string")
    v = spark.createDataFrame([(x,) for x in vocab], "label string")
    return {r.answer: r.predicted_code
            for r in codes.resolve_codes(df, "answer", v, rule).collect()}


def test_fine_rule(spark):
    minister_a, minister_b, politics, _ = FINE
    cases = {'"401 = Politics, parliament"': politics, "code 105": minister_b, "x401y": "x401y",
             "the MINISTER b role": minister_b, "parl": politics, "": minister_a,
             "unrelated": "unrelated", "999 or 105": minister_b, "401_": "401_", "mi": minister_a,
             "n": minister_a, "It is 401.": politics, "1050": "1050"}
    assert resolve(spark, list(cases), FINE, "fine") == cases


@pytest.mark.parametrize("rule, cases", [
    ("sector_prefix", {" 3 ": "3", "3 = Public": "3", "x3": "x3", "": "", '"1"': '"1"'}),
    ("sector_number", {'"3"': "3", "Sector 1.": "1", "code 77 or 1": "code 77 or 1", "31": "31"}),
])
def test_sector_rules(spark, rule, cases):
    assert resolve(spark, list(cases), ["1", "2", "3"], rule) == cases


def test_subject_rule(spark):
    vocab = ["03 – Social sciences", "04 – Law", "04 = Other law"]
    cases = {"03 – Social sciences": vocab[0], "04 whatever": vocab[1], "a Law degree": vocab[1],
             "science": vocab[0], "zzz": "zzz"}
    assert resolve(spark, list(cases), vocab, "subject") == cases


# --- retrieval ---------------------------------------------------------------------------

@pytest.mark.parametrize("block_rows", [3, 1024])
def test_nearest_equals_brute_force(spark, block_rows):
    import numpy as np
    rng = np.random.default_rng(5)
    ex = [(i, "hot" if i % 3 else f"g{i % 2}", rng.normal(size=4).astype("float32")) for i in range(40)]
    ex += [(100 + i, "hot", ex[1][2]) for i in range(9)]  # a group of copies
    qs = [(i, ["hot", "g0", "absent"][i % 3], rng.normal(size=4).astype("float32")) for i in range(12)]
    schema = "id long, grp string, v array<float>"
    e = spark.createDataFrame([(i, g, v.tolist()) for i, g, v in ex], schema)
    q = spark.createDataFrame([(i, g, v.tolist()) for i, g, v in qs], schema)
    for fallback in (False, True):
        got = {}
        near = retrieval.nearest_examples(q, e, "id", "id", "grp", "v", 3, fallback, block_rows)
        for r in near.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.example_id)
        want = {}
        for i, g, v in qs:
            pool = [x for x in ex if x[1] == g] or (ex if fallback else [])
            v = v.astype(float)
            sims = [(-round(float(np.dot(v, w.astype(float)) / (np.linalg.norm(v) * np.linalg.norm(w.astype(float)) + 1e-10)), 9), j)
                    for j, _, w in pool]
            if pool:
                want[i] = [j for _, j in sorted(sims)[:3]]
        assert got == want


# --- model jobs ------------------------------------------------------------------------

def reconcile(spark, answer, mode="career"):
    name = "spell_index" if mode == "career" else "subject_index"
    code = "category" if mode == "career" else "code"
    df = spark.createDataFrame([("c1", [(1, "A"), (2, "B")], answer)],
                               f"case_id string, anchors array<struct<{name}:int,{code}:string>>, response string")
    silver, failures = M.reconcile(df, "anchors", mode=mode)
    return silver.collect(), sorted((r.spell_index, r.reason) for r in failures.collect())


def item(i, job="MP", place="House", **kw):
    return {"spell_index": i, "job_description_label": job, "workplace_label": place, **kw}


def test_reconcile_career(spark):
    answer = json.dumps({"spells": [item(1, place=None), item(999), item("2"),
                                    item(2, failed=1, extraction_failed=True)]})
    silver, failures = reconcile(spark, answer)
    assert [tuple(r) for r in silver] == [("c1", 1, "A", "MP", "")]
    assert failures == [("2", "extraction_failed_by_model")]
    _, failures = reconcile(spark, json.dumps({"spells": [item(1, None, None)]}))
    assert failures == [("1", "extraction_failed_by_model"), ("2", "spell_not_returned_by_model")]
    _, failures = reconcile(spark, None)
    assert [f[1] for f in failures] == ["api_call_failed_all_retries"] * 2
    _, failures = reconcile(spark, "{}")
    assert [f[1] for f in failures] == ["spell_not_returned_by_model"] * 2


def test_reconcile_education(spark):
    answer = json.dumps({"subjects": [{"subject_index": 2, "subject_label": "Law"},
                                      {"subject_index": 1, "subject_label": None}]})
    silver, failures = reconcile(spark, answer, "education")
    assert [tuple(r) for r in silver] == [("c1", 2, "B", "Law")]
    assert failures == [("1", "extraction_failed_by_model")]


def test_silver_build_and_retry(spark, gold):
    # Workers cannot import this module, so the clients carry what they answer.
    one = json.dumps({"spells": [item(1)]})
    both = json.dumps({"spells": [item(1), item(2)]})

    def failing_second():
        def call(system, prompt):
            if "CV text 7\n" in prompt:
                raise RuntimeError("down")
            return one
        return call

    def answering():
        return lambda system, prompt: both

    cases = C.load_cases(gold.withColumn("o", F.col("case_id")).withColumn(
        "cv_english", F.when(F.col("case_id") == "p003", "").otherwise(F.col("cv_english"))), "o")
    built = build_silver(cases, failing_second, wait=0.0)
    assert built.silver.count() == 59
    reasons = {r.reason: r["count"] for r in built.failures.groupBy("reason").count().collect()}
    assert reasons == {"no_cv_text": 1, "api_call_failed_all_retries": 2,
                       "spell_not_returned_by_model": 39}
    # The second pass asks only for what failed, in cases already half done.
    again = build_silver(cases, answering, failed=built.failures, wait=0.0)
    assert {r.spell_index for r in again.silver.collect()} == {1, 2}
    assert again.silver.count() == 41
    assert [tuple(r) for r in again.failures.collect()] == [("p003", "ALL", "no_cv_text")]
    skipped = build_silver(cases, failing_second, done=built.silver, wait=0.0)
    assert skipped.silver.count() == 0


def test_model_jobs_spread_few_rows_over_tasks(spark):
    from pyspark import TaskContext

    rows = spark.range(40).select(F.format_string("p%d", "id").alias("text")).coalesce(1)

    def task():
        return str(TaskContext.get().partitionId())

    answered = M.classify(rows, "text", "s", lambda: lambda system, prompt: task())
    assert answered.select("response").distinct().count() > 1 and answered.count() == 40
    few = M.call_model(rows, "text", "s", lambda: lambda system, prompt: task(), expect_json=False,
                       parallelism=2)
    assert {r.response for r in few.collect()} == {"0", "1"}
    vectors = M.embed(rows, "text", lambda: lambda texts: [[float(task())]] * len(texts))
    assert len({r.vector[0] for r in vectors.collect()}) > 1
    notes = M.fetch_and_summarise(rows, F.col("text"), lambda: (lambda q: [q], lambda s, q: task()))
    assert len({r.summary for r in notes.collect()}) > 1
    labels = spark.createDataFrame([(str(i), i) for i in range(4)], "label string, label_id int")
    scored = M.score_labels(rows, "text", lambda: lambda texts: [
        [float(str(k) == task()) for k in range(4)] for _ in texts], labels)
    assert len({r.predicted_code for r in scored.collect()}) > 1
    for column in ("no text", 1.5):
        assert M.call_model(spark.range(3).select(F.lit(column).alias("x"), F.lit("p").alias("p")), "p", "s",
                            lambda: lambda system, prompt: "{}").count() == 3


def test_label_ids_are_numbered_by_range(spark):
    from plumbline.operators import classification as K

    values = [f"http://one.prefix/{i * 7919 % 3001}" for i in range(3001)] + ["", "ä", "日本", "Z", None, "Z"]
    df = spark.createDataFrame([(v,) for v in values], "kind string")
    index = K.label_index(df, "kind")
    want = sorted({v for v in values if v is not None}, key=str.encode)
    got = index.collect()
    assert [(r.label, r.label_id) for r in sorted(got, key=lambda r: r.label_id)] == [
        (v, i) for i, v in enumerate(want)]
    assert index.schema["label_id"].dataType.simpleString() == "int"
    # No window sees the whole vocabulary: the only one without a partition runs over counts.
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    whole = [line for line in plan.splitlines() if "row_number" in line and "Window" in line]
    assert whole and all("[_range" in line for line in whole)
    assert K.label_index(df.limit(0), "kind").count() == 0
    assert [tuple(r) for r in K.label_index(spark.createDataFrame([("x",)], "kind string"), "kind").collect()] == [
        ("x", 0)]
