"""Hand-computed metric cases."""

from __future__ import annotations

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from plumbline.operators import atomic, classification as K, sets, spells
from plumbline.functions import text as T


def one(df, level="overall"):
    return df.filter(F.col("level") == level).first().asDict() if "level" in df.columns \
        else df.first().asDict()


# --- sets ---------------------------------------------------------------------

def score_sets(spark, predictions, gold):
    p = spark.createDataFrame(predictions, "case_id string, retrieved_urls array<string>")
    g = spark.createDataFrame(gold, "case_id string, cv_links array<string>")
    return sets.score_arrays(p, g)


@pytest.mark.parametrize("found, wanted, expected", [
    (["a", "b"], ["a", "b"], (1.0, 1.0, 1.0)),
    ([], ["a", "b"], (0.0, 0.0, 0.0)),
    (["a", "z"], ["a", "b"], (0.5, 0.5, 0.5)),
    (["a", "a", " a "], ["a"], (1.0, 1.0, 1.0)),
    (["a", "b", "c"], ["a"], (0.333333, 1.0, 0.5)),
])
def test_set_scores(spark, found, wanted, expected):
    row = score_sets(spark, [("p1", found)], [("p1", wanted)]).first()
    assert (row.precision, row.recall, row.f1) == pytest.approx(expected)


def test_both_sides_empty_is_perfect(spark):
    from plumbline.operators.scores import precision_recall_f1

    zero = F.lit(0)
    row = spark.range(1).select(*precision_recall_f1(zero, zero, zero)).first()
    assert tuple(row) == (1.0, 1.0, 1.0)


def test_unknown_case_is_skipped_and_gold_without_prediction_ignored(spark):
    per_case = score_sets(spark, [("p1", ["a"]), ("x", ["b"])], [("p1", ["a"]), ("p9", ["c"])])
    row = sets.macro(per_case).first()
    assert (row.n_evaluated, row.n_skipped, row.f1) == (1, 1, 1.0)


def test_macro_of_nothing_is_zero(spark):
    row = sets.macro(score_sets(spark, [("x", ["b"])], [("p1", ["a"])])).first()
    assert (row.precision, row.recall, row.f1, row.n_evaluated) == (0.0, 0.0, 0.0, 0)


def test_row_form_equals_array_form(spark):
    predictions = [("p1", ["a", "z"]), ("p2", ["q"]), ("p3", ["a", "b", "c"]), ("p4", ["k"])]
    gold = [("p1", ["a", "b"]), ("p2", ["q"]), ("p3", ["c"]), ("p9", ["r"])]
    arrays = score_sets(spark, predictions, gold)
    rows = sets.score_rows(
        spark.createDataFrame([(k, u) for k, v in predictions for u in v], "case_id string, u string"),
        spark.createDataFrame([(k, u) for k, v in gold for u in v], "case_id string, u string"),
        "case_id", "u")
    assert sorted(map(tuple, arrays.collect())) == sorted(map(tuple, rows.collect()))


def test_pipe_text_equals_array(spark):
    p = spark.createDataFrame([("p1", "a| b ||a")], "case_id string, retrieved_urls string")
    g = spark.createDataFrame([("p1", "b|a")], "case_id string, cv_links string")
    row = sets.score_arrays(p, g).first()
    assert (row.n_retrieved, row.n_correct, row.f1) == (2, 2, 1.0)


# --- atomic accuracy ------------------------------------------------------------

def accuracy(spark, predictions, gold, group=None):
    rows = list(zip(predictions, gold, group or ["g"] * len(gold)))
    df = spark.createDataFrame(rows, "pred string, gold string, slice string")
    return atomic.accuracy(df, "slice" if group else None)


@pytest.mark.parametrize("pred, gold, expected", [
    (["Paris", "Berlin"], ["Paris", "Berlin"], 1.0),
    (["London", "Rome"], ["Paris", "Berlin"], 0.0),
    (["paris", " BERLIN "], ["Paris", "Berlin"], 1.0),
    (["Paris", "Rome"], ["Paris", "Berlin"], 0.5),
    ([None], [None], 1.0),
    (["99"], ["n/a"], 1.0),
])
def test_accuracy(spark, pred, gold, expected):
    assert one(accuracy(spark, pred, gold))["accuracy"] == pytest.approx(expected)


def test_missing_gold_is_a_class(spark):
    row = one(accuracy(spark, ["Paris", "Berlin"], [None, "Berlin"]))
    assert (row["n_total"], row["n_na_gold"], row["accuracy"]) == (2, 1, 0.5)
    # The invented value scores zero similarity when predicted.
    assert row["char_similarity"] == 1.0
    assert row["char_similarity_when_predicted"] == 0.5


def test_accuracy_when_predicted(spark):
    row = one(accuracy(spark, ["", "x", "y"], ["", "x", "z"]))
    assert row["accuracy"] == pytest.approx(0.666667)
    assert row["accuracy_when_predicted"] == 0.5
    assert (row["n_na_correct"], row["n_predicted"]) == (1, 2)


def test_accuracy_of_nothing(spark):
    row = one(accuracy(spark, [], []))
    assert (row["accuracy"], row["n_total"]) == (None, 0)


def test_accuracy_per_group(spark):
    df = accuracy(spark, ["a", "b", "c"], ["a", "x", "c"], ["g1", "g1", "g2"])
    found = {r.slice: r.accuracy for r in df.filter("level = 'group'").collect()}
    assert found == {"g1": 0.5, "g2": 1.0}
    assert one(df)["accuracy"] == pytest.approx(0.666667)


SIMILAR = [
    ("L AQUILA (AQ)", "L'Aquila"), ("Saint-Étienne", "saint etienne"), ("", "x"), ("(a)", "[b]"),
    ("München", "Munich"), ("a.b-c", "abc"), ("abcd", "bcde"), ("x" * 150 + "yz" * 60, "yx" * 130),
    ("(only)", "(other)"),
]


def plain(s):
    import re
    s = re.sub(r"\(.*?\)", "", s.lower())
    return re.sub(r"\s+", " ", re.sub(r"['\-.,/\"]", "", s)).strip()


def test_char_similarity_is_difflib(spark):
    df = spark.createDataFrame(SIMILAR, "a string, b string")
    got = df.select("a", "b", T.char_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for row in got:
        a, b = plain(row.a), plain(row.b)
        want = 1.0 if a == b else 0.0 if not a or not b else SequenceMatcher(None, a, b).ratio()
        assert row.s == pytest.approx(want), (row.a, row.b)


# --- mean error -------------------------------------------------------------------

def error(spark, predictions, gold):
    df = spark.createDataFrame(list(zip(predictions, gold)), "pred string, gold string")
    return one(atomic.mean_error(df))


@pytest.mark.parametrize("pred, gold, mae, acc, n, skipped", [
    (["1975", "1980"], ["1975", "1980"], 0.0, 1.0, 2, 0),
    (["1980", "1985"], ["1975", "1980"], 5.0, 0.0, 2, 0),
    (["1975", "1982", "1984"], ["1975", "1980", "1980"], 2.0, 0.333333, 3, 0),
    ([None, "1980"], ["1975", "1980"], 0.0, 1.0, 1, 1),
    (["1975", "1980"], [None, "1980"], 0.0, 1.0, 1, 1),
    ([None], [None], None, None, 0, 1),
    (["abc", "99", "12d"], ["1975", "1980", "12"], None, None, 0, 3),
])
def test_mean_error(spark, pred, gold, mae, acc, n, skipped):
    row = error(spark, pred, gold)
    assert (row["mae"], row["accuracy"]) == (pytest.approx(mae), pytest.approx(acc))
    assert (row["n_total"], row["n_skipped"]) == (n, skipped)


# --- interval matching ------------------------------------------------------------

SPELL = "array<struct<start_year:int,end_year:int>>"


def greedy(predicted, gold, tolerance):
    """Plain restatement of the rule, for comparison."""
    free, hits = list(gold), 0
    for ps, pe in predicted:
        if ps is None and pe is None:
            continue
        for g in free:
            ok = all(x is None or y is None or abs(x - y) <= tolerance
                     for x, y in ((ps, g[0]), (pe, g[1])))
            if ok:
                free.remove(g)
                hits += 1
                break
    return hits


def match(spark, predicted, gold, tolerance=1):
    p = spark.createDataFrame([("p1", predicted)], f"case_id string, predicted {SPELL}")
    g = spark.createDataFrame([("p1", gold)], f"case_id string, gold {SPELL}")
    return spells.score_lists(p, g, tolerance=tolerance).first()


@pytest.mark.parametrize("predicted, gold, expected", [
    ([(2010, 2015), (2015, 2020)], [(2010, 2015), (2015, 2020)], (1, 1, 1)),
    ([(2010, 2015)], [(2010, 2015), (2015, 2020)], (1, 0.5, 0.666667)),
    ([(2010, 2015), (2016, 2020)], [(2010, 2015)], (0.5, 1, 0.666667)),
    ([(2011, 2015)], [(2010, 2015)], (1, 1, 1)),
    ([(2012, 2015)], [(2010, 2015)], (0, 0, 0)),
    ([(2010, None)], [(2010, None)], (1, 1, 1)),
    ([], [(2010, 2015)], (0, 0, 0)),
    ([(None, None)], [(2010, 2015)], (0, 0, 0)),
])
def test_interval_scores(spark, predicted, gold, expected):
    row = match(spark, predicted, gold)
    assert (row.precision, row.recall, row.f1) == pytest.approx(expected)


def _random_cases(seed, n, max_pred, max_gold):
    import random
    rnd = random.Random(seed)

    def year():
        return None if rnd.random() < 0.15 else rnd.randint(2000, 2006)

    return [
        (f"c{i}", [(year(), year()) for _ in range(rnd.randint(0, max_pred))],
         [g for g in ((year(), year()) for _ in range(rnd.randint(1, max_gold)))
          if g != (None, None)] or [(2000, 2001)])
        for i in range(n)
    ]


@pytest.mark.parametrize("tolerance", [0, 1, 2])
def test_fold_equals_plain_greedy(spark, tolerance):
    cases = _random_cases(7 + tolerance, 60, 8, 6)
    p = spark.createDataFrame([(c, q) for c, q, _ in cases], f"case_id string, predicted {SPELL}")
    g = spark.createDataFrame([(c, q) for c, _, q in cases], f"case_id string, gold {SPELL}")
    got = {r.case_id: r.n_matched for r in spells.score_lists(p, g, tolerance=tolerance).collect()}
    assert got == {c: greedy(q, w, tolerance) for c, q, w in cases}


def test_row_form_of_matching_equals_plain_greedy(spark):
    # Many repeated predictions, more than there are gold slots.
    cases = _random_cases(99, 25, 120, 4)
    rows = [(c, s, e, i) for c, q, _ in cases for i, (s, e) in enumerate(q)]
    p = spark.createDataFrame(rows, "case_id string, start_year int, end_year int, pos int")
    g = spark.createDataFrame([(c, q) for c, _, q in cases], f"case_id string, gold {SPELL}")
    got = {r.case_id: (r.n_matched, r.n_predicted)
           for r in spells.score_rows(p, g, "pos").collect()}
    assert got == {c: (greedy(q, w, 1), len(q)) for c, q, w in cases if q}


def test_null_list_and_unknown_case_are_skipped(spark):
    p = spark.createDataFrame([("p1", None), ("x", [(2000, 2001)]), ("p2", [(2000, 2001)])],
                              f"case_id string, predicted {SPELL}")
    g = spark.createDataFrame([("p1", [(2000, 2001)]), ("p2", [(2000, 2001)])],
                              f"case_id string, gold {SPELL}")
    row = sets.macro(spells.score_lists(p, g)).first()
    assert (row.n_evaluated, row.n_skipped, row.f1) == (1, 2, 1.0)


# --- classification ----------------------------------------------------------------

def classes(spark, predictions, gold, group=None):
    rows = list(zip(predictions, gold, group or ["g"] * len(gold)))
    df = spark.createDataFrame(rows, "pred string, gold string, slice string")
    return K.confusion(df, "slice")


def test_partial_classification(spark):
    counts = classes(spark, ["A", "B", "A"], ["A", "B", "C"])
    row = K.summary(counts).first()
    assert row.accuracy == pytest.approx(0.666667)
    # A: 2/3, B: 1, C: 0
    assert row.macro_f1 == pytest.approx(0.555556)
    assert row.weighted_f1 == pytest.approx(0.555556)
    assert (row.n_total, row.n_classes) == (3, 3)
    scores = {r.label: (r.precision, r.recall, r.support) for r in K.per_class(counts).collect()}
    assert scores == {"A": (0.5, 1.0, 1), "B": (1.0, 1.0, 1), "C": (0.0, 0.0, 1)}


def test_label_only_predicted_lowers_macro(spark):
    row = K.summary(classes(spark, ["A", "Z"], ["A", "A"])).first()
    assert (row.n_classes, row.macro_f1) == (2, pytest.approx(0.333333))
    assert row.weighted_f1 == pytest.approx(0.666667)


def test_nothing_to_classify(spark):
    row = K.summary(classes(spark, [], [])).first()
    assert (row.accuracy, row.macro_f1, row.n_total, row.n_classes) == (None, None, 0, 0)


def test_classification_per_group(spark):
    counts = classes(spark, ["A", "B", "A"], ["A", "B", "B"], ["x", "x", "y"])
    rows = {r.slice: r for r in K.summary(counts, True).collect()}
    assert rows["x"].accuracy == 1.0 and rows["x"].n_classes == 2
    assert rows["y"].accuracy == 0.0 and rows["y"].macro_f1 == 0.0
    assert rows[None].n_total == 3


def test_confusion_rates(spark):
    rates = K.normalised_confusion(classes(spark, ["A", "B", "B", "B"], ["A", "A", "A", "B"]))
    got = {(r.gold, r.pred): r.rate for r in rates.collect()}
    assert got == {("A", "A"): 0.333333, ("A", "B"): 0.666667, ("B", "B"): 1.0}
    assert [(r.gold, r.pred) for r in K.top_confusions(rates).collect()] == [("A", "B")]


def test_semantic_similarity(spark):
    counts = classes(spark, ["A", "B", "B"], ["A", "A", "B"])
    vectors = spark.createDataFrame([("A", [2.0, 0.0]), ("B", [1.0, 1.0])],
                                    "label string, vector array<float>")
    row = K.semantic_similarity(counts, vectors).first()
    assert row.semantic_similarity == pytest.approx((2 + 2 ** -0.5) / 3, abs=1e-6)


def test_label_order_puts_text_last(spark):
    df = spark.createDataFrame([("10", "2"), ("x", "2")], "gold string, pred string")
    got = {r.label: r.sort_key for r in K.label_union(df).collect()}
    assert got == {"10": 10, "2": 2, "x": 999}


def test_more_spells_than_twenty_all_count(spark):
    """Neither gold lists, predicted rows nor slots have a limit."""
    from plumbline.operators import reshape

    rows = [("c", k, 1900 + 3 * k, 1901 + 3 * k, "x") for k in range(1, 31)]
    long = spark.createDataFrame(
        rows, "case_id string, spell_index int, start_year int, end_year int, position string")
    lists = reshape.collect_spells(long)
    assert len(lists.first()["spells"]) == 30
    gold = lists.withColumnRenamed("spells", "gold")
    score = spells.score_rows(long, gold, "spell_index").first()
    assert (score["n_matched"], score["precision"], score["recall"]) == (30, 1.0, 1.0)
    wide = spark.createDataFrame([tuple(["c"] + [f"p{k}" for k in range(25)])],
                                 ["case_id", *[f"career_position_{k}" for k in range(1, 26)]])
    assert reshape.career_spells(wide).count() == 25
