"""Line rules in several scripts, one test per rule, and clashing column names."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import line_rules, mixture

RULES = line_rules.LineRules()

PROSE = [
    "Он сказал что она ушёл и пришёл потом сел и спал долго",
    "Il a dû et pû voir le crû du bû là",
    "Η γάτα κοιμάται στον ήλιο και ο σκύλος τρέχει στον κήπο",
    "我们 昨天 去 了 公园 看 花 然后 回家 吃饭",
    "הילד הלך לבית הספר עם אחותו הקטנה בבוקר",
    "ذهب الولد إلى المدرسة مع أخته الصغيرة في الصباح",
    "The child went to school with a small sister in the morning",
    "Our cookie recipe needs two eggs and flour",
    "She sent the newsletter to every member of the small club.",
    "Copyright is a right that authors have in many countries.",
]


@pytest.mark.parametrize("line", PROSE)
def test_running_text_stays_in_every_script(line):
    raw = line.encode()
    assert line_rules.line_fails(raw, len(raw.split()), RULES) is None
    held = line_rules.clean_document("\n".join(f"{line} {i}" for i in range(12)), RULES)
    assert held[8] == 0 and held[9].count("\n") == 11


@pytest.mark.parametrize("line, rule", [
    ("Home | News | Sport | About", "navigation"),
    ("Accueil » Actualités » Sport » Contact", "navigation"),
    ("Start • Neues • Sport • Kontakt • Mehr", "navigation"),
    ("a### b$$$ c&&& d***", "punctuation"),
    ("What!! Now?? Yes!! No??", "punctuation"),
    ("BUY NOW TODAY IN OUR GREAT SHOP", "punctuation"),
    ("(c) 2019 Some Company", "boilerplate"),
    ("All rights reserved by the owner of this page", "boilerplate"),
    ("Released under our Terms of Service for every visitor", "boilerplate"),
    ("Subscribe to our newsletter and get all the latest stories", "boilerplate"),
    ("Read more", "boilerplate"), ("Log in", "boilerplate"),
    ("You may click here to see | the next page of it", "boilerplate"),
])
def test_each_rule(line, rule):
    raw = line.encode()
    assert line_rules.line_fails(raw, len(raw.split()), RULES) == rule


def verdict(text):
    """Whether the method keeps a text: words, repetition, and how much its bad lines hold."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    marked = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    if len(words) < 50 or 100 * len(marked) > 50 * len(words):
        return False
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    bad = [x for x in lines if re.search(r" \| .* \| .* \| |[#$&*]{3}|rights reserved|^Read more$", x)]
    good = [x for x in lines if x not in bad]
    lost = sum(len(x.encode()) for x in bad)
    return lost <= 0.3 * sum(len(x.encode()) for x in lines) and sum(len(x.split()) for x in good) >= 50


def test_verdict_equals_brute_force(spark):
    prose = [" ".join(f"w{i}{c}{k}" for k in range(14)) + "." for i, c in enumerate("abcdefghij")]
    bad = ["Home | News | Sport | About us", "x### y$$$ z&&& q***", "All rights reserved here", "Read more"]
    texts = ["\n".join(prose[:n] + bad[:m] * r) for n in range(0, 10, 1) for m in range(5) for r in (1, 4, 9)]
    texts += ["\n".join(prose[:4]) + ("\n" + prose[0]) * k for k in range(5)]
    df = spark.createDataFrame([(i, t, True, "x") for i, t in enumerate(texts)],
                               "doc_id long, text string, kept boolean, n_words string").repartition(3)
    got = {r.doc_id: r.kept for r in line_rules.clean_lines(df).select("doc_id", "kept").collect()}
    assert got == {i: verdict(t) for i, t in enumerate(texts)}
    assert 10 < sum(got.values()) < len(got) - 10


def test_mixture_with_names_of_the_result(docs):
    named = docs.withColumns({"mix_tokens": F.lit("old"), "mix_domain": F.lit(1), "mix_epoch": F.lit(None),
                              "_mix_lang": F.lit("x"), "other": F.lit(7)})
    domain = F.coalesce("source", F.lit("none"))
    got, want = mixture.mix_sources(named, domain), mixture.mix_sources(docs, domain)
    assert got.columns == [*docs.columns, "other", "mix_domain", "mix_tokens", "mix_epoch"]
    assert sorted(map(repr, got.drop("other").collect())) == sorted(map(repr, want.collect()))
