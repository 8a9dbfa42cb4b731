"""The training-data operators against brute-force versions on small tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import (
    bpe, digest, lang_codes, line_rules, minhash, mixture, quality_rank, suffix_dedup, token_orc, warc,
)
from plumbline.llm.common import scratch
from plumbline.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


# 1

def test_token_files(spark, docs, no_docs):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    folder = scratch(spark, "t-orc")
    token_orc.write_token_files(docs, folder, path, shards=3)
    read = token_orc.read_token_files(spark, folder)
    got = sorted((tuple(r) for r in token_orc.token_file_report(read).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in rows_of(docs)), key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in got] == list(np.cumsum([0, *(r[2] for r in got)])[:-1])
    want = collections.Counter()
    for i, t in rows_of(docs):
        ids = tokenizer.encode(t, add_special_tokens=False).ids + [0]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r[0], r[2], r[3]) for r in got) == want
    assert [r["doc_id"] for r in token_orc.read_documents(spark, folder, [203]).collect()] == [203]
    empty = scratch(spark, "t-orc")
    token_orc.write_token_files(no_docs, empty, path)
    assert token_orc.token_file_report(token_orc.read_token_files(spark, empty)).count() == 0


def test_added_tokens_in_texts(spark):
    """An unchanged tokenizer takes the end token that stands in a text as one id."""
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    end = "<|endoftext|>"
    texts = ["no token here", f"a {end} b", end, f"x{end}\n\ny  {end}  z", end + end, "<|endoftext",
             f"{end[:-1]} {end}", "", f" {end} don't  stop{end}日本 12 345.{end}", None, "after it all"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = scratch(spark, "t-orc")
    token_orc.write_token_files(rows, folder, path, shards=2)
    got = {r["doc_id"]: list(r["ids"]) for r in token_orc.read_token_files(spark, folder).collect()}
    assert got == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
                   for i, t in enumerate(texts)}
    assert got[2] == [50256, 0]
    starts = sorted((r["doc_id"], r["start"]) for r in token_orc.read_token_files(spark, folder).collect())
    assert [s for _, s in starts] == list(np.cumsum([0, *(len(got[i]) for i in range(len(texts)))])[:-1])


# 2

def test_quality_rank(spark, docs, no_docs):
    good = [(i, "A calm line of plain words, ended well. " * (1 + i % 7)) for i in range(60)]
    bad = [(100 + i, "NO### WAY$$$ %%% THAT&&& IS*** FINE!! " * (1 + i % 7)) for i in range(20)]
    rows = spark.createDataFrame([*good, *bad, (500, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, int(i < 100), 0) for i, _ in good + bad], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_rank.rank_quality(rows, labels).collect()}
    assert len(got) == 82
    assert all(got[i]["predicted"] == int(i < 100) for i, _ in good + bad)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0)
    assert quality_rank.rank_quality(no_docs, labels).count() == 0
    none = quality_rank.rank_quality(rows, labels.limit(0))
    assert {r["predicted"] for r in none.collect()} == {1}


# 3

def brute_components(rows):
    sets, nodes = [], sorted({i for i, _ in rows if i is not None})
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else
                    ({tuple(w)} if w else set()))
    up = {i: i for i in nodes}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, x), (b, y) in itertools.combinations(zip([i for i, _ in rows], sets, strict=True), 2):
        if None not in (a, b) and x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    return [(i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets, strict=True)]


def test_near_duplicates(docs, no_docs):
    found = minhash.near_duplicates(docs).collect()
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found], brute_components(rows_of(docs)))
    assert all(r["kept"] == (r["doc_id"] in (None, r["component_id"])) for r in found)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_links_that_a_star_misses(spark):
    """The smallest id is a poor centre: copies of one text resemble it but not each other."""
    base = [f"w{k}" for k in range(120)]
    rows = [(1000, " ".join(base))]
    for i in range(40):
        w = list(base)
        for k in range(3):
            w[(i * 11 + 37 * k) % 120] = f"x{i}{k}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], brute_components(rows))


def test_links_across_blocks(spark, monkeypatch):
    """Buckets of more members than a block holds: links between blocks are found as well."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 7)
    base = [f"w{k}" for k in range(120)]
    rows = [(1000, " ".join(base))]
    for i in range(40):
        w = list(base)
        for k in range(3):
            w[(i * 11 + 37 * k) % 120] = f"x{i}{k}"
        rows.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], brute_components(rows))


# 4

def test_language_codes(spark, no_docs):
    kinds = {"aa": "banana cabana ", "bb": "tülip kühl über ", "cc": "sixth rhythm myths "}
    rows = [(i, kinds[k] * (1 + i % 5), k) for i in range(150) for k in [list(kinds)[i % 3]]]
    rows += [(900, None, "aa"), (901, "123 456", "bb"), (902, "cabana", None), (None, "rhythm", "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in lang_codes.identify(df).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows[:150])
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0
    assert got[902]["lang_pred"] == "aa" and len(got) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2)
               for i, r in got.items())
    assert lang_codes.identify(no_docs).count() == 0
    lone = lang_codes.identify(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in lone.collect()} == {"und"}


def test_codewords_are_apart():
    for n in (2, 4, 9, 40):
        codes = lang_codes.codewords(n)
        assert len({tuple(c) for c in codes}) == n


# 5

@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))


def test_bpe(docs, no_docs, ranks):
    import public_tokenizers
    import tiktoken

    known = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows_of(docs):
        ids = known.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(t.encode()).hexdigest()))
    same([tuple(r) for r in bpe.encoding_report(docs, ranks).collect()], want)
    assert bpe.encoding_report(no_docs, ranks).count() == 0
    # Many blocks in one task, most texts larger than a block, and lists of pieces that start anew.
    for most_pieces in (8, 1 << 20):
        got = bpe.encoding_report(docs.coalesce(1), ranks, 16, most_pieces).collect()
        same([tuple(r) for r in got], want)
    held = bpe.encode_texts(docs.filter("doc_id = 203"), ranks).first()
    assert bytes(held["decoded"]) == b"one two" and held["ids"] == known.encode_ordinary("one two")


def test_heap_and_fold_agree(spark, ranks):
    words = [b"a" * 60, "ñez日本語ion".encode(), b"tiontiontion" * 9, b"x", b"", bytes(range(256))]
    shown = spark.createDataFrame([([w.hex().upper() for w in words], [list(w) for w in words])],
                                  "w array<string>, o array<array<int>>")
    got = shown.select(bpe.merge_fold(F.col("w"), F.col("o"), ranks)).first()[0]
    assert got == [bpe.merge_heap(w, ranks) for w in words]


# 6

def test_digest_edits(docs, no_docs, spark):
    rows = [(i, t) for i, t in rows_of(docs) if i is not None]
    unique = list({i: (i, t) for i, t in rows}.values())
    df = spark.createDataFrame(unique, "doc_id long, text string")
    got = {r["doc_id"]: r for r in digest.digest_edits(df, ranges=7).collect()}
    order = sorted(unique, reverse=True)
    assert len(got) == len(order)
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 3
        edited = (t[:len(t) - k] + after[:k]).encode()
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited).hexdigest())
        assert r["fingerprint"] == digest.digest(t.encode())
        assert r["near_next"] == digest.likeness(r["fingerprint"], digest.digest(after.encode()))
    assert digest.likeness(digest.digest(b"abc def"), digest.digest(b"abc def")) == 1
    assert digest.digest_edits(docs).count() == docs.count()
    assert digest.digest_edits(no_docs).count() == 0
    assert digest.digest_edits(df.limit(1)).count() == 1
    assert digest.add_digests(docs).count() == docs.count()


# 7

def brute_repeats(rows):
    seen, out = set(), []
    for i, t in rows:
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            key = raw[p:p + 100]
            if key in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(key)
        spans = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        left = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("block_bytes", [1500, 8 << 20])
def test_suffix_dedup(docs, no_docs, spark, block_bytes):
    rows = sorted({i: (i, t) for i, t in rows_of(docs) if i is not None}.values())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = suffix_dedup.remove_repeats(
        df, suffix_dedup._report, "doc_id long, n_bytes long, n_removed long, n_spans long, "
                                  "kept_sha256 string", block_bytes)
    same([tuple(r) for r in got.collect()], brute_repeats(rows))
    assert suffix_dedup.repeat_report(docs).count() == docs.count()
    assert suffix_dedup.repeat_report(no_docs).count() == 0
    left = suffix_dedup.remaining_texts(df, F.lit("note")).collect()
    assert {r["note"] for r in left} == {"note"} and len(left) == len(rows)


def test_periodic_text_across_segments(spark):
    rows = [(0, "ab" * 50_000 + "z"), (1, "xyz" + "ab" * 300), (2, "ü" * 400), (3, "q" + "ü" * 120)]
    got = suffix_dedup.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same([tuple(r) for r in got], brute_repeats(rows))


# 8

def test_line_rules(docs, no_docs):
    want = {}
    for i, t in rows_of(docs):
        words, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        count = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        marked = {k + d for k in range(len(words) - 2) if count[tuple(words[k:k + 3])] > 1 for d in range(3)}
        failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
        want.setdefault(i, []).append((len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)),
                                       dup, len(marked), failed))
    for r in line_rules.clean_lines(docs).collect():
        assert tuple(r)[1:7] in want[r["doc_id"]]
        assert not (r["base_failed"] and r["kept"])
    assert line_rules.clean_lines(no_docs).count() == 0


def test_line_rules_remove_lines():
    rules = line_rules.LineRules()
    one, two = (" ".join(f"{c}word{k}" for k in range(40)) + "." for c in "ab")
    text = f"{one}\nHome | News | Sport | About\nWe use cookies, read more\nBUY NOW TODAY IN OUR GREAT SHOP!!\n{two}"
    row = line_rules.clean_document(text, rules)
    assert row[6] is True and row[8] == 3 and row[9] == f"{one}\n{two}"
    assert line_rules.clean_document("A $$$ b### c%%% d&&& " * 30, rules)[6] is False


# 9

def test_warc(spark):
    big, small = "<p>" + "größe " * 400, "<p>tiny"
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "http://d", small),
            (5, "http://e", small), (6, "http://f", None), (7, "http://g", ""), (8, "h\r\nx", "y" * 900_000),
            (9, "http://i", "a\r\n\r\nb" * 300), (None, "http://n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn(
        "record_type", F.lit(0))
    got = {r["page_id"]: tuple(r)[1:] for r in warc.archive_pages(pages).collect()}
    for i, _, html in rows:
        body = (html or "").encode()
        revisit = html == big and i != 3
        assert got[i] == (len(body), hashlib.sha1(body).hexdigest(),
                          "revisit" if revisit else "response", 3 if revisit else None)
    folder = scratch(spark, "t-warc")
    manifest = warc.write_archives(warc.plan_records(pages), folder)
    chunks = warc.read_archives(spark, folder, manifest).filter("page_id = 8").orderBy("chunk_no").collect()
    assert len(chunks) == 4 and b"".join(bytes(c["chunk"]) for c in chunks) == b"y" * 900_000
    assert [c["last"] for c in chunks] == [False] * 3 + [True]
    assert warc.archive_pages(pages.limit(0)).count() == 0


# 10

def brute_share(nodes, budget):
    """Water-filling by whole tokens: name -> share."""
    open_, out = dict(nodes), {}
    while True:
        weight = sum(w for w, _ in open_.values())
        full = [n for n, (w, cap) in open_.items() if cap * weight <= w * budget]
        if not full:
            return out | {n: w * budget // weight for n, (w, _) in open_.items()}
        first = min(full, key=lambda n: (open_[n][1] / open_[n][0], n))
        out[first] = open_[first][1]
        budget -= open_.pop(first)[1]
        if not open_:
            return out


def test_mix_sources(spark, docs, no_docs):
    targets = mixture.Targets(domains={"odd": 3}, languages={"en": 5}, sources={"src2": 4},
                              budget_percent=120, max_epochs=2, seed="t")
    domain = F.when(F.col("source").isin("src1", "src3", "src5"), "odd").otherwise("even")
    got = mixture.mix_sources(docs, domain, targets)
    rows = [(r["doc_id"], len(WORD.findall(r["text"] or "")),
             ("odd" if r["source"] in ("src1", "src3", "src5") else "even", r["lang"] or "", r["source"] or ""))
            for r in docs.collect()]
    supply = collections.Counter()
    for _, n, leaf in rows:
        supply[leaf] += n
    budgets = {(): min(120 * sum(supply.values()) // 100, 2 * sum(supply.values()))}
    for depth, weights in enumerate((targets.domains, targets.languages, targets.sources), 1):
        below = {}
        for parent, budget in budgets.items():
            nodes = {}
            for leaf, n in supply.items():
                if leaf[:depth - 1] == parent:
                    w, cap = nodes.get(leaf[:depth], (weights.get(leaf[depth - 1], 1), 0))
                    nodes[leaf[:depth]] = (w, cap + 2 * n)
            below |= brute_share(nodes, budget)
        budgets = below
    want = []
    for leaf, n in supply.items():
        epochs = budgets[leaf] // n if n else 0
        rest, run, places = budgets[leaf] - epochs * n, 0, collections.defaultdict(list)
        for i, size, own in rows:
            if own == leaf:
                places[hashlib.md5(f"t|{epochs}|{'' if i is None else i}".encode()).hexdigest()].append((i, size))
        for place in sorted(places):
            run += sum(size for _, size in places[place])
            for i, size in places[place]:
                want += [(i, size, e) for e in range(epochs + (run <= rest))]
    same([(r["doc_id"], r["mix_tokens"], r["mix_epoch"]) for r in got.collect()], want)
    assert set(docs.columns) <= set(got.columns)
    assert mixture.mix_sources(no_docs, domain, targets).count() == 0
