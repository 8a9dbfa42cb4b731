"""Nearest examples by blocks: equal to comparing every pair, with most blocks left unread."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F, types as t

from plumbline.operators import retrieval as N

LONGS = (t.LongType(), t.LongType())
SCHEMA = "id long, grp string, v array<float>"


def brute(queries, examples, k, fallback=False):
    out = {}
    for i, g, v in queries:
        pool = [x for x in examples if x[1] == g] or (examples if fallback else [])
        v = np.asarray(v, np.float32).astype(float)
        sims = []
        for j, _, w in pool:
            w = np.asarray(w, np.float32).astype(float)
            sims.append((-round(float(v @ w / (np.linalg.norm(v) * np.linalg.norm(w) + 1e-10)), 9), j))
        if pool:
            out[i] = [j for _, j in sorted(sims)[:k]]
    return out


def clustered(n, seed, first, group="hot", spread=0.05):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(1).normal(size=(24, 16))
    return [(first + i, group, (centres[rng.integers(24)] + spread * rng.normal(size=16)).astype(
        "float32").tolist()) for i in range(n)]


def frames(spark, *sides):
    return [spark.createDataFrame(rows, SCHEMA).repartition(6) for rows in sides]


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.example_id)
    return out


def test_pruning_leaves_most_blocks_unread(spark):
    examples = clustered(2400, 2, 0)
    examples += [(5000 + i, "hot", examples[7][2]) for i in range(400)]  # many copies of one vector
    queries = clustered(200, 3, 0) + [(901, "none", [1.0] * 16)]
    q, e = frames(spark, queries, examples)
    shape = [N._scoped(q, e, "id", "id", "grp", "v", False)[i] for i in (0, 1)]
    blocks = [N._blocks(side, 40).cache() for side in shape]
    sizes = blocks[1].select(F.size("_ids")).collect()
    assert sum(n for n, in sizes) == len(examples) and max(n for n, in sizes) <= 120
    rounds = N.block_visits(*blocks, 5, LONGS)
    visited = [pairs.count() for pairs, _ in rounds]
    possible = blocks[0].filter("_scope = 'hot'").count() * blocks[1].count()
    assert possible > 300 and sum(visited) < possible / 3
    assert rounds[0][0].join(rounds[1][0], ["_scope", "_q_block", "_e_block"]).count() == 0
    union = rounds[0][1].unionByName(rounds[1][1])
    tasks = union.select("_scope", "_q_block", F.spark_partition_id().alias("p")).distinct()
    assert tasks.select("p").distinct().count() > 1  # the one hot group fills several tasks


@pytest.mark.parametrize("fallback", [False, True])
def test_rounds_equal_brute_force(spark, monkeypatch, fallback):
    monkeypatch.setattr(N, "_FEW_BLOCKS", 0)
    monkeypatch.setattr(N, "_CENTRES", 7)
    monkeypatch.setattr(N, "_QUERY_BLOCKS", 2)
    examples = clustered(500, 2, 0) + clustered(60, 5, 1000, "g1", 1.0) + clustered(3, 6, 2000, "few")
    examples += [(3000 + i, "hot", examples[7][2]) for i in range(60)] + [(3100, "hot", [0.0] * 16)]
    queries = (clustered(60, 3, 0) + clustered(20, 4, 100, "g1", 1.0) + clustered(5, 7, 200, "few")
               + clustered(9, 8, 300, "absent") + [(400, "hot", [0.0] * 16), (401, "hot", examples[7][2])])
    q, e = frames(spark, queries, examples)
    got = found(N.nearest_examples(q, e, "id", "id", "grp", "v", 5, fallback, 16))
    assert got == brute(queries, examples, 5, fallback)


def test_examples_are_copied_only_for_queries_without_a_group(spark):
    q, e = frames(spark, clustered(10, 3, 0), clustered(50, 2, 0))
    _, copied = N._scoped(q, e, "id", "id", "grp", "v", True)
    assert copied.count() == 50
    lone, _ = frames(spark, clustered(1, 3, 0, "absent"), clustered(1, 2, 0))
    _, copied = N._scoped(lone, e, "id", "id", "grp", "v", True)
    assert copied.groupBy("_scope").count().orderBy("_scope").collect() == [("*", 50), ("hot", 50)]


def test_text_ids_missing_vectors_and_empty_sides(spark):
    rows = [("a", "g", [1.0, 0.0]), ("b", "g", [0.0, 1.0]), ("c", "g", None)]
    df = spark.createDataFrame(rows, "id string, grp string, v array<float>")
    got = N.nearest_examples(df, df, "id", "id", "grp", "v", 1).orderBy("query_id").collect()
    assert [(r.query_id, r.example_id, r.rank) for r in got] == [("a", "a", 1), ("b", "b", 1)]
    assert N.nearest_examples(df.limit(0), df, "id", "id", "grp", "v", 1).count() == 0
    assert N.nearest_examples(df, df.limit(0), "id", "id", "grp", "v", 1, True).count() == 0
