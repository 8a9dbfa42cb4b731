"""Held-out quality of the classifiers, and digests against an independent version."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pytest

from plumbline.llm import digest
from plumbline.llm.queries import op2_quality_rank, op4_lang_codes, op6_digest

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


@needs_tables
def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = op2_quality_rank(spark, SF).filter("held_out").join(labels, "doc_id").toPandas()
    good = rows.quality == 1
    ranks = rows.score.rank()
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95 and (rows.predicted == rows.quality).mean() > 0.9


@needs_tables
def test_languages_held_out(spark):
    langs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = op4_lang_codes(spark, SF).filter("held_out and lang_pred <> 'und'").join(langs, "doc_id").toPandas()
    assert len(rows) > 100 and (rows.lang_pred == rows.lang).mean() > 0.97


@needs_tables
def test_edited_fingerprints(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    got = {r.doc_id: r for r in op6_digest(spark, SF).collect()}
    assert set(got) == set(texts)
    for i in order:
        text, following, r = texts[i], texts[after[i]], got[i]
        k = len(text) // 3
        edited = (text[:len(text) - k] + following[:k]).encode()
        assert r.edited_sha256 == hashlib.sha256(edited).hexdigest()
        assert r.edited_fingerprint == digest.digest(edited)
        assert r.near_edited == digest.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == digest.likeness(r.fingerprint, got[after[i]].fingerprint)
    near = sum(r.near_edited > r.near_next for r in got.values())
    assert near > 0.9 * len(got)
