"""CSV records that span lines and splits; source order; caches, jobs and quantiles that keep values."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cleaning as C, model_jobs as M, stats
from plumbline.sources import cache, records, tables


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def written(path, rows, sep=",", bom="", end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(bom)
        csv.writer(f, delimiter=sep, lineterminator=end).writerows(rows)


def table_rows(n, seed):
    rng = random.Random(seed)
    parts = ["plain", "two\nlines", 'a "quoted" word', ",;", "", "é 日本", "x" * 90, "end\n\n", '"', "\n" * 5 + "deep" * 40]
    return [[str(i), rng.choice(parts) + rng.choice(parts), rng.choice(parts)] for i in range(n)]


@pytest.mark.parametrize("sep, bom, end", [(",", "", "\n"), (";", "﻿", "\n"), (",", "", "\r\n")])
def test_records_equal_the_one_task_reader(spark, tmp_path, small_splits, sep, bom, end):
    folder = tmp_path / "t"
    folder.mkdir()
    names = ["case_id", "long text", "c"]
    for i in range(2):
        written(folder / f"part-{i}.csv", [names, *table_rows(60, i)], sep, bom, end)
    many = tables.read_text_table(spark, str(folder), sep)
    assert many.columns == names
    assert records._lines(spark, str(folder)).rdd.getNumPartitions() > 8
    want = sorted(tuple(r) for i in range(2) for r in table_rows(60, i))
    assert sorted(tuple(r) for r in many.collect()) == want
    one = tables.read_text_table(spark, str(folder), sep, parallel=False)
    assert sorted(tuple(r) for r in one.collect()) == want


def test_order_is_that_of_the_source(spark, tmp_path, small_splits):
    folder = tmp_path / "t"
    folder.mkdir()
    rows = table_rows(80, 3)
    written(folder / "a.csv", [["case_id", "x", "y"], *rows[:30]])
    written(folder / "b.csv", [["case_id", "x", "y"], *rows[30:]])
    df = tables.load_raw_cases(spark, str(folder))
    assert [tuple(r) for r in df.orderBy("_order").drop("_order").collect()] == [tuple(r) for r in rows]


def test_first_row_of_two_files_stays(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    written(folder / "a.csv", [["case_id", "v"], ["1", "first"], ["1", "second"]])
    written(folder / "b.csv", [["case_id", "v"], ["1", "third"], *[[str(i), "x" * 2000] for i in range(2, 300)]])
    cases = C.load_cases(tables.load_raw_cases(spark, str(folder)), "_order")
    assert cases.filter("case_id = 1").first().v == "first"


def test_unbalanced_quotes_are_refused(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text('a,b\n1,"open\n2,x\n')
    with pytest.raises(Exception, match="quotes are not balanced"):
        tables.read_text_table(spark, str(path)).collect()


def test_short_rows_and_blank_lines(spark, tmp_path):
    path = tmp_path / "short.csv"
    path.write_text('a,b,c\n1\n\n2,"x",\n3,y,z\n')
    assert sorted(tuple(r) for r in tables.read_text_table(spark, str(path)).collect()) == [
        ("1", "", ""), ("2", "x", ""), ("3", "y", "z")]


# --- model jobs and caches -------------------------------------------------------------------

def test_other_columns_pass_a_model_call_unchanged(spark):
    rows = [(9007199254740993, "p"), (None, "q"), (-9007199254740993, None)]
    df = spark.createDataFrame(rows, "id long, prompt string").withColumns({
        "money": F.lit("12345678901234567890.123456789").cast("decimal(38,9)"),
        "when": F.lit("2020-01-02 03:04:05.678901").cast("timestamp"), "deep": F.array(F.struct(F.lit(None).cast("long").alias("n")))})
    got = M.call_model(df, "prompt", "s", lambda: lambda system, prompt: prompt or "none", expect_json=False)
    assert got.schema[:5] == df.schema[:5]
    assert sorted(map(repr, got.drop("response", "error").collect())) == sorted(map(repr, df.collect()))
    assert {r.id: r.response for r in got.collect()} == {9007199254740993: "p", None: "q", -9007199254740993: "none"}
    labels = spark.createDataFrame([("a", 0), ("b", 1)], "label string, label_id int")
    scored = M.score_labels(df, "prompt", lambda: lambda texts: [[0.1, 0.2] for _ in texts], labels)
    assert {(r.id, r.predicted_code) for r in scored.collect()} == {(i, "b") for i, _ in rows}
    keys = df.select("id", "prompt")
    found = M.fetch_and_summarise(keys, F.coalesce("prompt", F.lit("")), lambda: (lambda q: [q], lambda s, q: q))
    assert {r.id for r in found.collect()} == {i for i, _ in rows}


def test_calls_in_flight_are_limited_and_ordered(spark):
    def client():
        import threading
        import time
        lock, now = threading.Lock(), [0, 0]

        def call(system, prompt):
            with lock:
                now[0] += 1
                now[1] = max(now)
            time.sleep(0.02)
            with lock:
                now[0] -= 1
            return f"{prompt}:{now[1]}"

        return call

    df = spark.range(24).select(F.col("id").cast("string").alias("p")).coalesce(1)
    got = M.call_model(df, "p", "s", client, expect_json=False, parallelism=1, in_flight=3).collect()
    assert all(r.response.split(":")[0] == r.p for r in got)
    assert max(int(r.response.split(":")[1]) for r in got) == 3


def test_failed_fetches_are_asked_again(spark, tmp_path):
    path = str(tmp_path / "answers")
    schema = "k string, snippets array<string>, summary string, error string"
    df = spark.createDataFrame([("good",), ("bad",), ("void",)], "k string")

    def run(works: bool, wanted=df):
        def worker():
            def fetch(q):
                if q == "bad" and not works:
                    raise OSError("down")
                return [] if q == "void" else [q]
            return fetch, lambda s, q: q.upper()

        asked = []

        def compute(missing):
            asked.extend(sorted(r.k for r in missing.collect()))
            return M.fetch_and_summarise(missing, F.col("k"), worker)

        got = cache.through_cache(wanted, ["k"], path, schema, compute, error="error", attempts=3)
        return asked, {r.k: r.summary for r in got.collect()}

    assert run(False) == (["bad", "good", "void"], {"good": "GOOD", "bad": "NA", "void": "NA"})
    assert run(False)[0] == ["bad"]
    assert run(True) == (["bad"], {"good": "GOOD", "bad": "BAD", "void": "NA"})
    assert run(True)[0] == []
    for again in ([], ["bad"]):  # a key that fails for good is asked three times in all
        other = str(tmp_path / "other")
        path = other
        assert run(False)[0] == (["bad", "good", "void"] if not again else again)
    assert run(False)[0] == ["bad"] and run(False)[0] == []


def test_simultaneous_appends_give_one_row(spark, tmp_path):
    path = str(tmp_path / "twice")
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    for v in (1, 2):  # as two runs do that both found nothing
        df.select("k", F.lit(v).alias("v"), F.current_timestamp().alias("_written"),
                  F.lit(f"run{v}").alias("_run")).write.mode("append").parquet(path)
    got = cache.through_cache(df, ["k"], path, "k string, v int", lambda missing: missing.withColumn("v", F.lit(9)))
    assert sorted((r.k, r.v) for r in got.collect()) == [("a", 2), ("b", 2)]


def test_caches_without_stamps_are_read(spark, tmp_path):
    path = str(tmp_path / "old")
    spark.createDataFrame([("a", 1)], "k string, v int").write.parquet(path)
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    got = cache.through_cache(df, ["k"], path, "k string, v int", lambda missing: missing.withColumn("v", F.lit(9)))
    assert sorted((r.k, r.v) for r in got.collect()) == [("a", 1), ("b", 9)]


# --- quantiles --------------------------------------------------------------------------------

def test_quantiles_by_rank_equal_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    groups = {"flat": rng.random(501).round(2), "tail": rng.lognormal(0, 4, 400), "one": np.array([2.5]),
              "same": np.full(90, -1.25), None: rng.normal(size=64), "two": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("flat", None), ("void", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    wanted = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.g: tuple(r)[1:] for r in stats.quantiles(df, "g", "v", wanted).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g] == pytest.approx(tuple(np.quantile(values, list(wanted.values()))), rel=1e-12, abs=1e-15)
    plan = stats.describe(df, ["v"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    box = {r.g: (r.n, r.median) for r in stats.box_plot(df, "g", "v").collect()}
    assert box["void"] == (0, None) and box[None] == (64, pytest.approx(float(np.median(groups[None]))))
    assert stats.describe(df.limit(0), ["v"]).first().n == 0
