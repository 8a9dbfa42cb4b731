"""Operator 2 learns from every labelled row."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from plumbline.llm import quality_rank


def labelled(n_good: int, n_bad: int) -> list[tuple[int, str, int]]:
    rng = random.Random(5)
    parts = [["calm", "words", "of", "the", "river", "ended", "well."],
             ["NO###", "WAY$$$", "of", "words", "FINE!!", "the", "&&&"]]
    return [(i, " ".join(rng.choices(parts[i >= n_good], k=rng.randint(3, 12))), int(i < n_good))
            for i in range(n_good + n_bad)]


def learned(spark, rows):
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([r[::2] for r in rows], "doc_id long, quality int")
    return quality_rank.learn_quality(docs, labels)


def arrays(rows):
    used = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    x = np.stack([quality_rank.text_features(t.encode()) for _, t, _ in used]).astype(np.float64)
    return x, np.array([q == 1 for *_, q in used])


def test_quality_model_counts_every_labelled_row(spark):
    rows = labelled(4500, 4000)
    x, better = arrays(rows)
    model = learned(spark, rows)
    assert np.allclose(model.centre, x.mean(0), atol=1e-8)
    assert np.allclose(model.spread, x.std(0) + 1e-3, atol=1e-7)
    raw = model.raw(x).round(9)
    assert model.slope == pytest.approx(1 / raw.std(), rel=1e-6)
    kept = quality_rank.set_threshold(quality_rank.RankModel(
        model.centre, model.spread, model.weights, 0.0, 1.0), x, better, (~better).mean())
    assert model.threshold == pytest.approx(kept.threshold, abs=1e-8)


@pytest.mark.parametrize("n_good, n_bad", [(300, 200), (400, 9), (5, 300)])
def test_quality_blocks_hold_every_row(spark, monkeypatch, n_good, n_bad):
    rows = labelled(n_good, n_bad)
    rows += [(10_000 + i, rows[0][1], 1) for i in range(50)]
    x, better = arrays(rows)
    whole = quality_rank.set_threshold(quality_rank.fit_pairs(x, better), x, better, (~better).mean())
    one = learned(spark, rows)
    assert np.allclose(one.weights, whole.weights, atol=1e-6)
    assert one.threshold == pytest.approx(whole.threshold, abs=1e-6)
    monkeypatch.setattr(quality_rank, "BLOCK_ROWS", 16)
    monkeypatch.setattr(quality_rank, "BLOCK_PARTNERS", 8)
    monkeypatch.setattr(quality_rank, "_FEW", 3)
    monkeypatch.setattr(quality_rank, "_SLICES", 4)
    many = learned(spark, rows)
    cut = quality_rank.set_threshold(quality_rank.RankModel(
        many.centre, many.spread, many.weights, 0.0, 1.0), x, better, (~better).mean())
    assert many.threshold == pytest.approx(cut.threshold, abs=1e-8)
    distinct = {(f.tobytes(), bool(q)) for f, q in zip(x.astype(np.float32), better, strict=True)}
    table = spark.createDataFrame([(bytearray(f), int(q), 1) for f, q in distinct],
                                  "features binary, quality int, n long")
    sizes = {k: sum(q == k for _, q in distinct) for k in (0, 1)}
    lead = int(sizes[1] >= sizes[0])
    blocks = quality_rank._blocks(table, sizes, lead).collect()
    assert len(blocks) > 1
    seen = [(bytes(r["features"]), bool(r["quality"])) for b in blocks for r in b["rows"]]
    assert set(seen) == distinct
    assert sum(q == lead for _, q in seen) == sizes[lead]
    assert all({r["quality"] for r in b["rows"]} == {0, 1} for b in blocks)


def test_quality_joins_features_and_no_text(spark, monkeypatch):
    """Texts stay where they are read: a join by id that moved them took as much disk as the input."""
    plans, kept = {}, quality_rank.stored

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return kept(df, name)

    monkeypatch.setattr(quality_rank, "stored", noted)
    learned(spark, labelled(30, 20))
    above, below = plans["quality-rows"].split("Join Inner")
    assert "MapInArrow" not in above and "MapInArrow" in below
