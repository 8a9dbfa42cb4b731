"""Last predictions, similarity per distinct pair, and counts of dropped rows."""

from __future__ import annotations

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from catalog.base import sql_similarity
from plumbline import evaluate, evaluate_many
from plumbline.operators import atomic, cleaning as C
from plumbline.plans.inputs import load_training_data


@pytest.fixture(scope="module")
def repeated(test_cases):
    """Two runs for every test case; the earlier one has the larger texts."""
    runs = F.array(
        F.struct(F.lit(10).alias("run"), F.col("birth_year").cast("string").alias("birth_year"), "sex", "birth_place"),
        F.struct(F.lit(9).alias("run"), F.lit("9").alias("birth_year"), F.lit("9 = x").alias("sex"),
                 F.lit("Zzz").alias("birth_place")))
    return test_cases.select("case_id", F.inline(runs))


def test_nine_then_ten_scores_ten(spark):
    rows = spark.createDataFrame([("a", "9", 1), ("a", "10", 2), ("b", None, 5), ("b", "7", 4)],
                                 "case_id string, v string, at int")
    got = {r.case_id: r.pred for r in atomic.last_prediction(rows, "case_id", "v", "at").collect()}
    assert got == {"a": "10", "b": None}


def test_runs_replace_earlier_ones(gold, repeated):
    report = C.DropReport()
    result = evaluate(repeated, "extraction", "sex", gold=gold, order="run", report=report)
    assert result.summary.first().accuracy == 1.0
    assert report.counts() == {"replaced": repeated.count() // 2}
    for field in ("sex", "birth_place", "birth_year"):
        with pytest.raises(Exception, match="several predictions for one case_id"):
            evaluate(repeated, "extraction", field, gold=gold).summary.collect()
    many = evaluate_many(repeated, gold, ["sex", "birth_year", "birth_place"], order="run").collect()
    assert {r.variable: r.accuracy for r in many} == {"sex": 1.0, "birth_year": 1.0, "birth_place": 1.0}
    with pytest.raises(Exception, match="several predictions for one case_id"):
        evaluate_many(repeated, gold, ["sex"]).collect()


def test_equal_repeats_need_no_order(gold, repeated):
    copies = repeated.filter("run = 10").drop("run")
    result = evaluate(copies.unionByName(copies), "extraction", "sex", gold=gold)
    assert result.summary.first().accuracy == 1.0


def test_similarity_meets_each_pair_once(spark):
    rows = [(f"s{i % 40}", True, f"town {i % 3}", f"twon {i % 2}") for i in range(600)]
    aligned = spark.createDataFrame(rows, "slice string, has_pred boolean, gold string, pred string")
    seen = spark.sparkContext.accumulator(0)

    def ratio(left, right):
        def run(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch.map(len).astype("float64")

        return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(F.concat(left, right))

    kept = atomic.T.char_similarity
    atomic.T.char_similarity = ratio
    try:
        atomic.accuracy(aligned, "slice").collect()
    finally:
        atomic.T.char_similarity = kept
    assert seen.value == 6


def test_sql_similarity_is_the_ratio(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(12)
    pairs = [("".join(rng.choices("abcç (d).", k=rng.randint(0, 14))), "".join(rng.choices("abcç d-", k=rng.randint(0, 14))))
             for _ in range(150)]
    pairs += [("Ghent (Belgium)", "ghent"), ("", ""), ("abc", "abc"), ("abab", "baba"), ("private", "privateer of")]

    def plain(v):
        v = re.sub(r"['\-.,/\"]", "", re.sub(r"\(.*?\)", "", v.lower()))
        return re.sub(r"\s+", " ", v).strip()

    def want(x, y):
        a, b = plain(x), plain(y)
        return 1.0 if a == b else SequenceMatcher(None, a, b).ratio() if a and b else 0.0

    con = duckdb.connect()
    con.execute("create table pairs(x varchar, y varchar)")
    con.executemany("insert into pairs values (?, ?)", pairs)
    found = con.execute("WITH RECURSIVE " + sql_similarity("pairs") + " SELECT x, y, sim FROM alike").fetchall()
    assert {(x, y): pytest.approx(float(s)) for x, y, s in found} == {p: want(*p) for p in pairs}
    df = spark.createDataFrame(pairs, "x string, y string")
    from plumbline.functions import text as T
    got = df.select("x", "y", T.char_similarity(F.col("x"), F.col("y")).alias("s")).collect()
    assert all(r.s == pytest.approx(want(r.x, r.y)) for r in got)


def test_rows_without_gold_are_counted(spark, gold, silver):
    stray = silver.limit(1).withColumn("case_id", F.lit("nobody"))
    more = silver.unionByName(stray).unionByName(stray)
    report = C.DropReport()
    rows = load_training_data("annotation", ["career_position"], gold, "career_position", more, report)
    plain = load_training_data("annotation", ["career_position"], gold, "career_position", silver)
    assert rows.count() == plain.count()
    assert report.counts() == {"not_in_gold": 2}
