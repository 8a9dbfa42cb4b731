"""The split by cutoffs: equal to ranking every row, and no sort of all rows."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.operators import splits


def ranked(rows, test_size=0.2, seed=42):
    strata = defaultdict(list)
    for key, stratum in rows:
        strata[stratum or ""].append(str(key))
    sizes = {s: len(v) for s, v in strata.items() if len(v) > 1}
    total = sum(sizes.values())
    train = total - math.ceil(total * test_size)
    base = {s: train * n // total for s, n in sizes.items()}
    order = sorted(sizes, key=lambda s: (-(train * sizes[s] % total), -sizes[s],
                                         hashlib.md5(f"{seed}|{s}".encode()).hexdigest(), s))
    for s in order[:train - sum(base.values())]:
        base[s] += 1
    out = {}
    for s, keys in strata.items():
        keys.sort(key=lambda k: (hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k))
        n_test = sizes[s] - base[s] if s in sizes else 0
        out |= {k: "test" if i < n_test else "train" for i, k in enumerate(keys)}
    return out


@pytest.mark.parametrize("test_size", [0.05, 0.2, 0.5])
def test_cutoffs_equal_ranks(spark, test_size):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 12 + ["b", "c", "d", None, ""])) for i in range(3000)] + [(9000, "lone")]
    df = spark.createDataFrame(rows, "id long, g string").repartition(5)
    got = {r.id: r.split for r in splits.stratified_split(df, "id", "g", test_size).collect()}
    assert got == ranked(rows, test_size)
    whole = splits.with_split(df.withColumn("other", F.col("id") * 2), "id", "g", test_size)
    assert whole.columns == ["id", "g", "other", "split"]
    assert {(str(r.id), r.split) for r in whole.collect()} == set(got.items())


def test_repeated_and_missing_keys(spark):
    rows = [(i % 40, "a") for i in range(120)] + [(None, "a"), (None, None)]
    df = spark.createDataFrame(rows, "id long, g string")
    sides = splits.with_split(df, "id", "g")
    assert sides.count() == 120
    assert sides.groupBy("id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert splits.with_split(df.limit(0), "id", "g").count() == 0
    both = [splits.apply_split(df, side, "id", stratum="g").count() for side in ("test", "train")]
    assert sum(both) == 120 and min(both) > 0


def test_only_one_slice_is_put_in_order(spark):
    df = spark.range(100_000).select(F.col("id"), F.lit("hot").alias("g"))
    cuts = splits._cutoffs(df.select(F.col("id").cast("string").alias("id"), F.col("g").alias("_stratum")),
                           "id", 0.2, 42)
    assert cuts.count() == 1
    plan = splits.with_split(df, "id", "g")._jdf.queryExecution().optimizedPlan().toString()
    ranks = [line for line in plan.splitlines() if "row_number" in line and "_slice" in line]
    assert ranks  # rows of the slice in which the test side ends
    rows = splits._slice_sizes(splits._sliced(df, "id", 42), ["g"])
    assert rows.agg(F.max("_n")).first()[0] < 100


def test_single_rows_and_rows_outside_are_counted(spark, gold, silver, test_cases):
    from plumbline import evaluate
    from plumbline.operators import cleaning as C

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (None, "c"), (4, None)], "id long, g string")
    assert sorted(map(tuple, splits.single_row_strata(rows, "id", "g").collect())) == [("", "4"), ("b", "3")]
    assert [r.case_id for r in splits.single_row_strata(gold).collect()] == ["p060"]
    answers = silver.filter("job_description_label <> ''").select(
        "case_id", "spell_index", F.col("career_position").alias("predicted_code"))
    report = C.DropReport()
    result = evaluate(answers, "annotation", "career_position", gold=gold, silver=silver, report=report)
    inside = answers.join(test_cases.select("case_id"), "case_id").count()
    assert result.summary.first().accuracy == 1.0
    assert report.counts() == {"outside_test": answers.count() - inside}
