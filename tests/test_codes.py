"""Substring resolution keeps its candidate rows few."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from plumbline.operators import codes as C


def test_common_beginning_brings_no_rows_together(spark):
    rng = random.Random(9)
    names = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(1500)]
    texts = spark.createDataFrame([(f"ministry of {n}",) for n in names], "_low string")
    described = spark.createDataFrame(
        [(f"{i} = x", f"ministry of {n}") for i, n in enumerate(names)], "_c string, _d string")
    for pairs in (C.containing(texts, "_low", described, "_d"),
                  C.containing(described.select("_d"), "_d", texts, "_low")):
        # All pairs on the common beginning would be 2,250,000.
        assert 1500 <= pairs.count() < 15 * 1500
        assert pairs.filter(F.col("_low") == F.col("_d")).count() == 1500


def test_candidates_hold_every_containing_pair(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abç ", k=rng.randint(1, 12))) for _ in range(120)]
    left, right = words[:60], list(dict.fromkeys(words[60:] + ["a", "ab", words[0], words[1][:2] or "b"]))
    holders = spark.createDataFrame([(w,) for w in dict.fromkeys(left)], "h string")
    parts = spark.createDataFrame([(i, w) for i, w in enumerate(right)] + [(900, "a")], "i long, p string")
    got = C.containing(holders, "h", parts, "p").filter(F.col("h").contains(F.col("p")))
    assert sorted((r.h, r.i) for r in got.collect()) == sorted(
        (h, i) for h in dict.fromkeys(left) for i, p in [*enumerate(right), (900, "a")] if p in h)


def test_resolution_with_blank_and_short_descriptions(spark):
    vocabulary = spark.createDataFrame([("1 = Ok",), ("2 = o",), ("3 = Minister of State",), ("4 = ",)], "label string")
    df = spark.createDataFrame([("the minister of state here",), ("of st",), ("zzz",), ("",), ("OK",)], "t string")
    got = {r.t: r.predicted_code for r in C.resolve_codes(df, "t", vocabulary, "fine").collect()}
    assert got == {"the minister of state here": "2 = o", "of st": "2 = o", "zzz": "4 = ", "": "1 = Ok", "OK": "1 = Ok"}
    lesser = vocabulary.filter("label not in ('2 = o', '4 = ')")
    got = {r.t: r.predicted_code for r in C.resolve_codes(df, "t", lesser, "fine").collect()}
    assert got == {"the minister of state here": "3 = Minister of State", "of st": "3 = Minister of State",
                   "zzz": "zzz", "": "1 = Ok", "OK": "1 = Ok"}
