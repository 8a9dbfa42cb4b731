"""Toxicity, source divergence and collocations against brute-force versions."""

from __future__ import annotations

import collections
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import coded, collocations, divergence, toxicity
from plumbline.llm.queries import op11_toxicity

SF = "/root/testdata/sf0.1"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_slices_cut_no_word():
    rng = random.Random(3)
    raw = b" ".join(bytes(rng.choices(b"abc", k=rng.randint(1, 9))) for _ in range(4000))
    size, coded._SLICE = coded._SLICE, 50
    try:
        for text in (raw, b"x" * 500, b"x" * 120 + b" y", b"", b" ", b"y " + b"x" * 300):
            parts = list(coded.slices(text))
            assert b"".join(parts) == text
            assert [w for p in parts for w in p.split()] == text.split()
    finally:
        coded._SLICE = size


# 11

def test_block_max_index_is_exact():
    rng = random.Random(5)
    vectors = []
    for _ in range(700):
        terms = rng.sample(range(60), rng.randint(1, 8))
        vectors.append(toxicity.unit_vector(tuple((t, rng.randint(1, 4)) for t in sorted(terms)),
                                            np.linspace(1, 3, 60)))
    vectors.sort(key=lambda v: sorted(v, key=lambda t: -v[t]))
    index = toxicity.BlockMaxIndex(vectors, block=16)
    for k in (1, 5, 40):
        for _ in range(60):
            query = rng.choice(vectors) if rng.random() < 0.3 else toxicity.unit_vector(
                tuple((t, 1) for t in sorted(rng.sample(range(60), 4))), np.linspace(1, 3, 60))
            every = [(-round(sum(w * v.get(t, 0.0) for t, w in query.items()), 12), i)
                     for i, v in enumerate(vectors)]
            want = [x for x in sorted(every) if x[0] < 0][:k]
            got = [(-x.cosine, x.entry) for x in index.nearest(query, k)]
            assert [c for c, _ in got] == pytest.approx([c for c, _ in want], abs=1e-9)
            assert {i for c, i in got if c < want[-1][0] - 1e-9} == {
                i for c, i in want if c < want[-1][0] - 1e-9}
    index.blocks_read = 0
    for v in vectors[:100]:
        index.nearest(v, 5)
    assert index.blocks_read < 100 * index.n_blocks / 2
    assert index.nearest({}, 5) == [] and toxicity.BlockMaxIndex([]).nearest({1: 1.0}, 5) == []


def test_votes_of_equal_vectors_share_the_places():
    terms = [b"awful"]
    rows = [(i, int(i < 30), False, ((0, 1),)) for i in range(40)]  # one entry of 40 examples
    rows += [(100 + i, 0, False, ((1, 1),)) for i in range(400)]
    model = toxicity.build_model(terms, rows, 30 / 440)
    assert len(model.index.vectors) == 2 and sorted(model.size) == [40, 400]
    assert model.vote(model.index.nearest(model.vector(((0, 1),)), 15)) == pytest.approx(0.75, abs=0.02)
    assert model.vote(model.index.nearest(model.vector(((1, 1),)), 15)) < 0.01
    assert model.vote([]) == model.base


def test_toxicity_edge_cases(spark, docs, no_docs):
    bad = [(i, f"calm words here {'nasty grim ' * (1 + i % 3)}and more calm words {i}") for i in range(40)]
    good = [(100 + i, f"calm words stand here, quiet and mild, day {i % 7} by day") for i in range(200)]
    extra = [(500, "a nasty GRIM thing"), (501, "mild day"), (502, ""), (503, None), (None, "nasty grim"),
             (501, "nasty grim words"), (504, "calm words " * 200_000 + "nasty"), (505, "12 ... !")]
    rows = spark.createDataFrame(bad + good + extra, "doc_id long, text string").select(
        "*", F.lit("s").alias("score"), F.lit(1).alias("evidence"), F.lit(0).alias("held_out"))
    labels = spark.createDataFrame(
        [(i, 1) for i, _ in bad] + [(i, 0) for i, _ in good] + [(3, 0), (None, 1), (7, None), (9, 5)],
        "doc_id long, toxic int")
    got = toxicity.rate_toxicity(rows, labels).collect()
    assert len(got) == 248
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert all(by[i][0].predicted == 1 for i, _ in bad) and not any(by[i][0].predicted for i, _ in good)
    assert by[500][0].predicted == 1 and by[None][0].predicted == 1 and by[None][0].held_out
    assert sorted(r.predicted for r in by[501]) == [0, 1]
    assert by[502][0].score == by[503][0].score == by[505][0].score
    assert by[504][0].predicted == 0 and by[502][0].evidence == []
    assert set(by[500][0].evidence) <= {i for i, _ in bad}
    assert toxicity.rate_toxicity(no_docs, labels).count() == 0
    none = toxicity.rate_toxicity(docs, labels.limit(0))
    assert {r.score for r in none.collect()} == {0.0}
    only = toxicity.rate_toxicity(rows, labels.filter("toxic = 0"))
    assert {r.predicted for r in only.collect()} == {0}


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = op11_toxicity(spark, SF).filter("held_out").join(labels, "doc_id").select(
        "score", "predicted", "toxic").toPandas()
    toxic = rows.toxic == 1
    ranks = rows.score.rank()
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.95
    assert rows.predicted[toxic].mean() > 0.9 and rows.predicted[~toxic].mean() < 0.01
    assert ((rows.score - rows.toxic) ** 2).mean() < 0.02


# 12

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audited(rows, least_docs=3, ranks=200):
    """(lang, source, part, item, value, rank) with Python's integers over every term and pair."""
    docs, counts, df = set(), collections.Counter(), collections.Counter()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        docs.add((lang, source))
        terms = TERM.findall((text or "").translate(LOWER))
        counts.update((lang, source, t) for t in terms)
        df.update((lang, t) for t in set(terms))
    out = []
    for lang in {x[0] for x in docs}:
        kept = [t for (x, t), n in df.items() if x == lang and n >= least_docs]
        sources = sorted(s for x, s in docs if x == lang)
        whole = {s: sum(counts[lang, s, t] for t in kept) + len(kept) for s in sources}
        every = sum(whole.values()) - len(kept) * len(sources) + len(kept)
        p = {(s, t): 1 + 10**9 * (counts[lang, s, t] + 1) // whole[s] for s in sources for t in kept}
        q = {t: 1 + 10**9 * (sum(counts[lang, s, t] for s in sources) + 1) // every for t in kept}
        for s in sources:
            pairs = [(sum((p[s, t] - p[o, t]) ** 2 // p[o, t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s, t] - q[t]) ** 2 // q[t], t) for t in kept
                     if counts[lang, s, t] and p[s, t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found)
                        if part == "pair" or i < ranks]
    return sorted(out)


def test_divergence_equals_brute_force(spark, docs, no_docs):
    def run(df, **how):
        return sorted(tuple(r) for r in divergence.audit_sources(df, **how).collect())

    rows = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    assert run(docs) == audited(rows)
    assert run(docs, least_docs=1, term_ranks=5) == audited(rows, 1, 5)
    assert run(no_docs) == []
    rng = random.Random(2)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)] + ["Ñu", "ñu", "日本"]
    odd = [(" ".join(rng.choices(words, [1 / (1 + i) for i in range(len(words))], k=rng.randint(1, 90))),
            rng.choice(["a", "b", None]), rng.choice(["x", "x", "x", "y", "z", None, "é"]))
           for _ in range(150)]
    odd += [("only one source", "lone", "x")] * 4 + [("1 2 3", "bare", "x"), (None, "bare", "y")]
    odd += [(odd[0][0], "a", "x")] * 60
    df = spark.createDataFrame([(*r, 1, 2) for r in odd],
                               "text string, lang string, source string, place long, n long").repartition(6)
    assert run(df) == audited(odd)


def test_divergence_walks_shared_paths(spark):
    """Equal term rows are one path with a multiplicity; blocks of few pairs give the same sums."""
    terms = [(t, s) for t in range(300) for s in range(6) if (t % 7) != s]
    df = spark.createDataFrame([(" ".join(f"t{chr(97 + t % 26)}{chr(97 + t // 26)}" for t, o in terms if o == s),
                                 "l", f"s{s}") for s in range(6)] * 3, "text string, lang string, source string")
    rows = divergence.term_rows(df)
    groups = divergence.group_table(df, rows)
    found = divergence.occurrences(rows, groups)
    got = sorted(tuple(r) for r in divergence.tree_corrections(found).groupBy(
        "lang", "place", "other").agg(F.sum("value")).collect())
    size, divergence._PAIRS_AT_ONCE = divergence._PAIRS_AT_ONCE, 8
    try:
        items = found.select("term", "place", "p", "absent").toPandas().sort_values(["term", "place"])
        paths = collections.Counter(tuple(map(tuple, g[["place", "p", "absent"]].values.tolist()))
                                    for _, g in items.groupby("term"))
        assert len(paths) < 10 < sum(paths.values())
        order = sorted(paths)
        flat = np.array([x for path in order for x in path], np.int64)
        sums = divergence._Sums()
        divergence._walk(np.zeros(len(order), np.int64), np.r_[0, np.cumsum([len(x) for x in order])],
                         *flat.T, np.array([paths[x] for x in order]), 8, sums)
        key, there, back = sums.total()
    finally:
        divergence._PAIRS_AT_ONCE = size
    want = sorted([("l", k // 8, k % 8, v) for k, v in zip(key.tolist(), there.tolist(), strict=True)]
                  + [("l", k % 8, k // 8, v) for k, v in zip(key.tolist(), back.tolist(), strict=True)])
    assert got == want


def test_share_is_exact(spark):
    numbers = [(0, 1), (6, 7), (10**15 - 1, 10**15), (123456789012345, 8 * 10**15), (3, 10**9), (0, 9 * 10**15)]
    df = spark.createDataFrame(numbers, "c long, whole long")
    got = [r[0] for r in df.select(divergence.share(F.col("c"), F.col("whole"))).collect()]
    assert got == [1 + 10**9 * (c + 1) // w for c, w in numbers]


# 13

def collocated(rows, support=10, ranks=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            lang = "und" if lang is None else lang
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    frequent = {p: a for p, a in f.items() if a >= support}
    out = collections.defaultdict(list)
    for (lang, *words), a in frequent.items():
        if len(words) == 1:
            continue
        cuts = [(10**6 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k, f[lang, *words[:k]],
                 f[lang, *words[k:]]) for k in range(1, len(words))]
        longer = [b for (x, *w), b in frequent.items() if x == lang and len(w) == 3 and len(words) == 2
                  and (w[:2] == words or w[1:] == words)]
        if not any(100 * b >= 50 * a for b in longer):
            score, _, left, right = min(cuts)
            out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items()
                  for i, (s, a, p, x, y) in enumerate(sorted(found)[:ranks]))


def chatter():
    rng = random.Random(8)
    words = ["a", "b", "c", "d", "éa", "|", "the", "of", "x-y", "日本"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"])
                     for _ in range(rng.randint(0, 80))), rng.choice(["en", "de", None, "und"]))
            for _ in range(120)]
    return rows + [("Hot PAIR of words; hot pair", "en")] * 90 + [("seldom met", "en"), (None, "en"), ("", None), (" \t. ,", "fr")]


def test_collocations_equal_brute_force(spark, no_docs):
    rows = chatter()
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows],
                               "text string, lang string, n long, phrase string, shard long").repartition(7)

    def run(d, **how):
        return sorted(tuple(r) for r in collocations.collocations(d, **how).collect())

    want = collocated(rows)
    assert len(want) > 50
    assert run(df) == want
    assert run(df, support=4, ranks=9, shards=1) == collocated(rows, 4, 9)
    assert run(df, support=25, shards=7) == collocated(rows, 25)
    assert run(no_docs) == []


def test_shards_miss_no_frequent_phrase(spark):
    rows = chatter()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    words = collocations.all_shards(collocations.shard_counts(df, 1))
    supports = collocations.local_supports(words).collect()
    for r in supports:
        assert len(r.sizes) == collocations.SHARDS and sum(r.sizes) == r.n
        assert all((x - 1) * r.n < 10 * size <= x * r.n for x, size in zip(r.least, r.sizes, strict=True) if size)
        assert sum(max(0, x - 1) for x in r.least) < 10
    assert sum(all(r.sizes) for r in supports) > 1  # languages lie in all shards
    local = collocations.locally_frequent(words, collocations.local_supports(words)).collect()
    assert any(not r.frequent for r in local)
    assert not [r for r in local if r.n >= 10 and not r.frequent]


def test_long_texts_and_small_blocks(spark):
    """Texts longer than a slice, many blocks and a full bit table leave the result as it is."""
    rng = random.Random(4)
    long = "".join(rng.choice(["up ", "down ", "left ", "right. ", "on\n"]) for _ in range(4000))
    df = spark.createDataFrame([(long, "en"), ("up down " * 30, "en")], "text string, lang string")
    parts = collocations.FrequentParts(np.full(8, 255, np.uint8))  # lets every phrase through

    def total(d):
        return sorted((r[0], r[1], sum(r[2:])) for r in collocations.all_shards(d).collect())

    for length in (2, 3):
        once = total(collocations.shard_counts(df, length, parts))
        assert once == total(collocations.shard_counts(df, length, parts, block_bytes=50))
        size, coded._SLICE = coded._SLICE, 64
        try:
            block = collocations._Block()
            block.add("en", 0, long.encode())
            block.add("en", 0, b"up down " * 30)
            cut = pa_total(block.counts(length, parts, 2))
        finally:
            coded._SLICE = size
        assert cut == once


def pa_total(batches):
    out = collections.Counter()
    for b in batches:
        for r in b.to_pylist():
            out[r["lang"], r["phrase"]] += r["n0"] + r["n1"]
    return sorted((*k, v) for k, v in out.items())


def test_many_words_in_one_block():
    """Codes too large for one number per phrase are counted in two steps."""
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 3, 4000) * 2_000_000
    here, shard = np.arange(3998), rng.integers(0, 3, 3998)
    for length in (1, 2, 3):
        want = collections.Counter((tuple(codes[i:i + length].tolist()), s) for i, s in enumerate(shard.tolist()))
        words, n = collocations._counted(codes, here, length, shard, 3)
        got = {(tuple(int(w[i]) for w in words), s): int(n[i, s])
               for i in range(len(n)) for s in range(3) if n[i, s]}
        assert got == want and len(words) == length


def test_exact_scores_beyond_64_bits(spark):
    big = [(9 * 10**13, 10**14, 95 * 10**12), (10, 10, 10), (10, 10**14, 10**14), (10**14, 10**14, 10**14)]
    df = spark.createDataFrame(big, "a long, l long, r long")
    got = [r[0] for r in df.select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert got == [10**6 * a * a // (x * y) for a, x, y in big]
