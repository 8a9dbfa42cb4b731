"""Exact nearest labelled examples inside a group, by blocks of near vectors and a bound per block.

Vectors of a group are laid out in the order of a sign pattern (on which side of fixed random
planes they lie) and cut into blocks of a bounded number of rows, so a block holds vectors that
point about the same way and a pattern with many copies fills several blocks. A block is known by
its centre and radius: no vector in it can be nearer to a query than the angle to the centre less
the radius.

Two rounds carry the ``k`` best of each query along. In the first each query visits the block whose
centre is nearest. In the second a query block visits only those blocks whose bound reaches the
k-th similarity of one of its queries. All others are left unread, and the result is that of
comparing every pair. Where no group has more than ``_FEW_BLOCKS`` blocks there is little to leave
out, and every pair of blocks is compared at once.

No row per vector pair is made. Work on a group is keyed by its blocks, and the centres that query
blocks are compared with are copied for every few query blocks, so a group of any size is spread
over as many tasks as it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as t

from plumbline import registry as R
from plumbline.session import cut

_ANY = "*"
_BLOCK_ROWS = 1024
_RANK_DIGITS = 9
_PLANES = 16
_FEW_BLOCKS = 4
_CENTRES = 256  # centres that are compared at once
_QUERY_BLOCKS = 16  # query blocks that share one copy of centres
_SLACK = 1e-7  # above the error of angles, so that no bound is too small


# Blocks

def _units(flat, n: int) -> np.ndarray:
    vectors = np.asarray(flat, dtype=np.float64).reshape(n, -1)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def _with_pattern(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add ``_sign``, the sides of ``_PLANES`` planes as the bits of an integer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = np.asarray(batch.column(2).flatten(), np.float64).reshape(batch.num_rows, -1)
        planes = np.random.default_rng(71).normal(size=(vectors.shape[1], _PLANES))
        sign = (vectors @ planes > 0) @ (1 << np.arange(_PLANES)[::-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sign.astype(np.int32))],
                                         [*batch.schema.names, "_sign"])


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    """(_scope, _block, _ids, _flat): blocks of about ``rows`` vectors, numbered from 0 in each group.

    A pattern with at least half a block of vectors has blocks of its own, rarer patterns share
    blocks in their order. The block of a row depends on its content and the counts alone, so a
    recomputed task packs exactly the same blocks. The windows see at most 2^_PLANES patterns of a
    group.
    """
    schema = t.StructType([*df.schema.fields, t.StructField("_sign", t.IntegerType())])
    signed = df.filter(F.col("_vec").isNotNull()).mapInArrow(_with_pattern, schema)
    group = Window.partitionBy("_scope")
    earlier = group.orderBy("_sign").rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("_n") * 2 >= rows
    few = F.when(own, 0).otherwise(F.col("_n"))
    parts = F.when(own, F.ceil(F.col("_n") / rows)).otherwise(0)

    def before(of: Column) -> Column:
        return F.coalesce(F.sum(of).over(earlier), F.lit(0))

    sizes = signed.groupBy("_scope", "_sign").agg(F.count(F.lit(1)).alias("_n")).withColumns({
        "_shared": F.ceil(F.sum(few).over(group) / rows), "_few": before(few), "_own": before(parts)})
    places = sizes.select(
        "_scope", "_sign", F.when(own, F.col("_shared") + F.col("_own")).otherwise(
            F.floor(F.col("_few") / rows)).alias("_first"), F.greatest(parts, F.lit(1)).alias("_parts"))
    block = (F.col("_first") + F.pmod(F.xxhash64("_id"), F.col("_parts"))).cast("int")
    return signed.join(places, ["_scope", "_sign"]).groupBy("_scope", block.alias("_block")).agg(
        F.sort_array(F.collect_list(F.struct("_id", "_vec"))).alias("_rows")).select(
        "_scope", "_block", F.col("_rows._id").alias("_ids"), F.flatten("_rows._vec").alias("_flat"))


def _named(blocks: DataFrame, side: str) -> DataFrame:
    return blocks.select("_scope", *[F.col(c).alias(f"_{side}{c}") for c in ("_block", "_ids", "_flat")])


def _centres(blocks: DataFrame) -> DataFrame:
    """(_scope, _chunk, _blocks, _centres, _radii): centre and radius of up to ``_CENTRES`` blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, radii = [], []
            for ids, flat in zip(batch.column(2), batch.column(3), strict=True):
                units = _units(flat.values, len(ids))
                centre = units.sum(axis=0)
                length = np.linalg.norm(centre)
                centre = centre / length if length > 0 else centre
                centres.append(centre)
                radii.append(float(np.arccos(np.clip(units @ centre, -1, 1)).max()) + _SLACK)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tolist() for c in centres], pa.list_(pa.float64())),
                 pa.array(radii, pa.float64())], ["_scope", "_block", "_centre", "_radius"])

    known = blocks.mapInArrow(run, "_scope string, _block int, _centre array<double>, _radius double")
    chunk = F.floor(F.col("_block") / _CENTRES).cast("int")
    return known.groupBy("_scope", chunk.alias("_chunk")).agg(
        F.collect_list(F.struct("_block", "_centre", "_radius")).alias("_c")).select(
        "_scope", "_chunk", F.col("_c._block").alias("_blocks"),
        F.flatten("_c._centre").alias("_centres"), F.col("_c._radius").alias("_radii"))


# Scores

def _top_k(q_ids, q_flat, e_ids, e_flat, k: int, least=None):
    """Best ``k`` examples of each query in a block: positions and similarities; ties by example id.

    ``e_ids`` are in order. With ``least`` only similarities that reach it.
    """
    examples = np.asarray(e_flat, dtype=np.float64).reshape(len(e_ids), -1)
    queries = np.asarray(q_flat, dtype=np.float64).reshape(len(q_ids), -1)
    lengths = np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(examples, axis=1))
    sims = (queries @ examples.T) / (lengths + R.COSINE_EPSILON)
    ranked = np.round(sims, _RANK_DIGITS)
    if ranked.shape[1] > k:
        kth = -np.partition(-ranked, k - 1, axis=1)[:, k - 1:k]
        above, level = ranked > kth, ranked == kth
        room = k - above.sum(axis=1, keepdims=True)
        keep = above | (level & (np.cumsum(level, axis=1) <= room))
    else:
        keep = np.ones_like(ranked, dtype=bool)
    if least is not None:
        keep &= ranked >= least[:, None]
    q, e = np.nonzero(keep)
    return q, e, sims[q, e]


def _scored(pairs: DataFrame, queries: DataFrame, examples: DataFrame, k: int, best: DataFrame | None,
            types: tuple[t.DataType, t.DataType]) -> DataFrame:
    """(_scope, _q_block, query_id, example_id, similarity) of pairs (_scope, _q_block, _e_block)."""
    rows = pairs.join(_named(queries, "q"), ["_scope", "_q_block"])
    if best is not None:
        rows = rows.join(best, ["_scope", "_q_block"], "left")
    else:
        rows = rows.withColumn("_least", F.lit(None).cast("map<string,double>"))
    rows = rows.join(_named(examples, "e"), ["_scope", "_e_block"]).select(
        "_scope", "_q_block", "_q_ids", "_q_flat", "_e_ids", "_e_flat", "_least")
    schema = t.StructType([
        t.StructField("_scope", t.StringType()), t.StructField("_q_block", t.IntegerType()),
        t.StructField("query_id", types[0]), t.StructField("example_id", types[1]),
        t.StructField("similarity", t.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q_flat, e_ids, e_flat = (batch.column(c)[i].values for c in range(2, 6))
                least = _least(batch.column(6)[i], q_ids)
                q, e, similarity = _top_k(q_ids, q_flat, e_ids, e_flat, k, least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(q), pa.string()),
                     pa.array(np.full(len(q), batch.column(1)[i].as_py(), np.int32)),
                     q_ids.take(pa.array(q)), e_ids.take(pa.array(e)), pa.array(similarity)], schema.names)

    return rows.mapInArrow(run, schema)


def _least(carried: pa.Scalar, q_ids: pa.Array) -> np.ndarray | None:
    """The k-th similarity so far of each query of a block; a query with fewer than k has none."""
    if not carried.is_valid:
        return None
    known = dict(carried.as_py())
    return np.array([known.get(str(i), -np.inf) for i in q_ids.to_pylist()])


# Rounds

def _visits(queries: DataFrame, centres: DataFrame, best: DataFrame | None) -> DataFrame:
    """(_scope, _q_block, _e_block): the blocks that query blocks visit.

    Without ``best`` those with the nearest centre of a query, else those whose bound reaches
    the k-th similarity of a query.
    """
    parts = queries.groupBy("_scope").agg(
        F.ceil((F.max("_block") + 1) / _QUERY_BLOCKS).cast("int").alias("_copies"))
    chunks = centres.join(parts, "_scope").withColumn(
        "_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    rows = _named(queries, "q").join(parts, "_scope").withColumn(
        "_copy", F.pmod("_q_block", "_copies").cast("int")).drop("_copies")
    if best is not None:
        rows = rows.join(best, ["_scope", "_q_block"], "left")
    else:
        rows = rows.withColumn("_least", F.lit(None).cast("map<string,double>"))
    meetings = rows.join(chunks, ["_scope", "_copy"]).select(
        "_scope", "_q_block", "_q_ids", "_q_flat", "_least", "_blocks", "_centres", "_radii")
    nearest_only = best is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q_flat = batch.column(2)[i].values, batch.column(3)[i].values
                blocks, centres, radii = (np.asarray(batch.column(c)[i].values) for c in (5, 6, 7))
                angle = np.arccos(np.clip(
                    _units(q_flat, len(q_ids)) @ centres.reshape(len(blocks), -1).T, -1, 1))
                if nearest_only:
                    chosen = np.unique(angle.argmin(axis=1))
                else:
                    # Very short vectors have similarities near 0, whatever their angle.
                    bound = np.maximum(np.cos(np.maximum(angle - radii - _SLACK, 0)), 0)
                    least = _least(batch.column(4)[i], q_ids)
                    least = np.full(len(q_ids), -np.inf) if least is None else least
                    chosen = np.flatnonzero((bound + _SLACK >= least[:, None]).any(axis=0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(chosen), pa.string()),
                     pa.array(np.full(len(chosen), batch.column(1)[i].as_py(), np.int32)),
                     pa.array(blocks[chosen].astype(np.int32))], ["_scope", "_q_block", "_e_block"])

    return meetings.mapInArrow(run, "_scope string, _q_block int, _e_block int")


def _kth(scored: DataFrame, k: int) -> DataFrame:
    """(_scope, _q_block, _least): the k-th similarity, to nine digits, of queries that have k."""
    similarity = F.round("similarity", _RANK_DIGITS)
    order = Window.partitionBy("_scope", "_q_block", "query_id").orderBy(F.desc(similarity))
    kth = scored.select("_scope", "_q_block", "query_id", similarity.alias("_s"),
                        F.row_number().over(order).alias("_r")).filter(F.col("_r") == k)
    entry = F.struct(F.col("query_id").cast("string"), F.col("_s"))
    return kth.groupBy("_scope", "_q_block").agg(
        F.map_from_entries(F.collect_list(entry)).alias("_least"))


def block_visits(queries: DataFrame, examples: DataFrame, k: int,
                 types: tuple[t.DataType, t.DataType]) -> list[tuple[DataFrame, DataFrame]]:
    """The pairs of blocks that each of the two rounds reads, and what it found in them."""
    centres = _centres(examples)
    near = _visits(queries, centres, None)
    found = cut(_scored(near, queries, examples, k, None, types))
    best = _kth(found, k)
    rest = _visits(queries, centres, best).join(near, ["_scope", "_q_block", "_e_block"], "left_anti")
    return [(near, found), (rest, _scored(rest, queries, examples, k, best, types))]


def _scoped(queries: DataFrame, examples: DataFrame, query_id: str, example_id: str, group: str,
            vector: str, fallback: bool) -> tuple[DataFrame, DataFrame]:
    """(_scope, _id, _vec) of both sides. A query without a group looks at all examples; only if
    there is one are they copied."""

    def shaped(df: DataFrame, key: str) -> DataFrame:
        return df.select(
            F.col(group).cast("string").alias("_scope"), F.col(key).alias("_id"),
            F.col(vector).cast("array<float>").alias("_vec"))

    q, e = shaped(queries, query_id), shaped(examples, example_id)
    if not fallback:
        return q, e
    known = e.groupBy("_scope").agg(F.lit(True).alias("_known"))
    marked = q.join(known, "_scope", "left").withColumn(
        "_scope", F.when(F.col("_known"), F.col("_scope")).otherwise(_ANY)).drop("_known")
    lacking = marked.filter(F.col("_scope") == _ANY).select(F.lit(True)).limit(1).scalar()
    return marked, e.unionByName(e.filter(lacking).withColumn("_scope", F.lit(_ANY)))


def nearest_examples(queries: DataFrame, examples: DataFrame, query_id: str, example_id: str,
                     group: str, vector: str = "vector", k: int = R.NEAREST_K,
                     fallback: bool = False, block_rows: int = _BLOCK_ROWS) -> DataFrame:
    """(query_id, example_id, similarity, rank) of the ``k`` nearest examples.

    Only examples of the query's own group are considered. A query whose group
    has no example gets none, or with ``fallback`` the nearest of all groups.
    Similarities equal to nine digits are ranked by example id. Rows without a
    vector are left out.
    """
    types = (queries.schema[query_id].dataType, examples.schema[example_id].dataType)
    q, e = _scoped(queries, examples, query_id, example_id, group, vector, fallback)
    largest = e.groupBy("_scope").count().agg(F.max("count")).first()[0] or 0
    q_blocks, e_blocks = _blocks(q, block_rows), _blocks(e, block_rows)
    if largest <= _FEW_BLOCKS * block_rows:
        pairs = q_blocks.select("_scope", F.col("_block").alias("_q_block")).join(
            e_blocks.select("_scope", F.col("_block").alias("_e_block")), "_scope")
        scored = _scored(pairs, q_blocks, e_blocks, k, None, types)
    else:
        rounds = block_visits(cut(q_blocks), cut(e_blocks), k, types)
        scored = rounds[0][1].unionByName(rounds[1][1])
    best = Window.partitionBy("query_id").orderBy(
        F.desc(F.round("similarity", _RANK_DIGITS)), "example_id")
    return (
        scored.select("query_id", "example_id", "similarity")
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
    )


def example_lists(nearest: DataFrame, examples: DataFrame, example_id: str,
                  columns: list[str]) -> DataFrame:
    """Per query the ordered array of its nearest examples (at most k entries)."""
    details = examples.select(F.col(example_id).alias("example_id"), *columns)
    return (
        nearest.join(details, "example_id")
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("examples"))
    )
