"""The pipeline, stage by stage, and the registered queries of the subpackage."""

from __future__ import annotations

import hashlib
import zlib
from pathlib import Path

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from plumbline.llm import bpe, quality_rank
from plumbline.llm.queries import ORACLES, QUERIES, tokenizer_file
from test_operators import brute_components, same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), "t-stage")
        assert docs.columns == columns
        seen[name] = docs.toPandas()
    quality = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    first = seen["good_quality"]
    assert {i for i in quality[quality == 1].index} <= set(first.doc_id)
    near = seen["near_duplicates"]
    assert near.text.is_unique and set(near.doc_id) <= set(first.doc_id)
    cut = seen["repeated_passages"]
    assert (cut.n_chars == cut.text.str.len()).all() and set(cut.doc_id) <= set(near.doc_id)
    mixed = seen["source_mix"]
    texts = dict(zip(cut.doc_id, cut.text, strict=True))
    assert len(mixed) and all(texts[i] == t for i, t in zip(mixed.doc_id, mixed.text, strict=True))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in last) == sorted(
        (i, hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(mixed.doc_id, mixed.text, strict=True))


def brute_good(rows, labels):
    """Learn from all labelled rows that are not held out; keep what reaches the threshold."""
    marks: dict = {}
    for i, q in labels:
        if i is not None and q in (0, 1) and zlib.crc32(str(i).encode()) % 5:
            marks[i] = max(q, marks.get(i, 0))
    chosen = sorted((quality_rank.text_features((r[1] or "").encode()).tobytes(), marks[r[0]])
                    for r in rows if r[0] in marks)
    x = np.stack([np.frombuffer(f, np.float32) for f, _ in chosen]).astype(np.float64)
    better = np.array([q == 1 for _, q in chosen])
    bad = sum(q == 0 for q in marks.values()) / len(marks)
    model = quality_rank.set_threshold(quality_rank.fit_pairs(x, better), x, better, bad)
    scores = model.scores(np.stack([quality_rank.text_features((r[1] or "").encode()) for r in rows]))
    return [r for r, s in zip(rows, scores, strict=True) if s >= quality_rank.THRESHOLD]


def brute_cut(rows):
    """Passages of 100 bytes that stand before, in order of ids, go; broken characters stay."""
    seen, out = set(), []
    for i, t, lang, source, _ in sorted(rows):
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            key = raw[p:p + 100]
            if key in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(key)
        left, at = "", 0
        for c in t:
            size = len(c.encode())
            if not all(gone[at:at + size]):
                left += c
            at += size
        if left == t or left.strip():
            out.append((i, left, lang, source, len(left)))
    return out


def brute_mix(rows):
    """The SQL of operator 10 over the rows, with their texts."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create table docs (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into docs values (?, ?, ?, ?, ?)", [list(r) for r in rows])
    con.execute("create view documents as select * from docs")
    whole = {r[0]: r for r in rows}
    return [whole[i] for i, in con.execute(f"select doc_id from ({ORACLES['op10_mixture']})").fetchall()]


def brute_ids(rows):
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    known = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for i, t, *_ in rows:
        ids = known.encode_ordinary(t)
        out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(t.encode()).hexdigest()))
    return out


def test_every_stage_equals_brute_force(spark):
    """Each stage on what brute force gives for the stage before, and all of them together."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kinds = ", ".join(f"{c} {k}" for c, k in corpus_pipeline.COLUMNS.items())
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()]
    rows = [tuple(r) for r in table.select(*corpus_pipeline.COLUMNS).collect()]
    assert len({r[0] for r in rows}) == len(rows)
    brute = [
        lambda rows: brute_good(rows, labels),
        lambda rows: [r for r, (i, _, root) in zip(rows, brute_components([r[:2] for r in rows]), strict=True)
                      if i == root],
        brute_cut, brute_mix, brute_ids]
    for (name, stage), version in zip(corpus_pipeline.STAGES, brute, strict=True):
        df = spark.createDataFrame(rows, kinds)
        before, rows = len(rows), version(rows)
        assert rows, name
        same([tuple(r) for r in stage(spark, df, SF).collect()], rows)
        if name in ("good_quality", "near_duplicates"):
            assert len(rows) < before, name
    same([tuple(r) for r in corpus_pipeline.run(spark, SF).collect()], rows)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_are_registered():
    known = __spark_entry__.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) <= set(known) and "pipeline" in known
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(repr, cursor.fetchall()))
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want
