"""Operator 3: near-duplicates by one-permutation hashing.

One hash of each five-word shingle fills ``BINS`` bins with their smallest values; empty bins
borrow from full ones by optimal densification. Bands of the signature are buckets, and each
bucket first proposes only the edges from its members to its smallest id. Links are confirmed on
the full shingle sets and joined to components. Buckets that still hold several components then
compare members of different components inside tasks, in blocks of bounded size, so links that a
star missed are found while pairs inside a component, which change nothing, are never made.

Copies with the same set stand for one class from the start and are never expanded into pairs.

Edge cases: null and empty texts, and texts of white space, have no shingle and link with
nothing; fewer than five words are one shingle; rows that share an id are one document whose
links are united; a row with a null id links with nothing, has no component and is kept; an
empty table gives no row; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import (
    id_text, list_array, prepare, shuffle_partitions, small_batches, stored, utf8_values,
)

WORDS, SIMILAR_PERCENT = 5, 75
BINS, BAND_ROWS = 128, 4
# Of 128 bins, two sets with similarity 0.75 agree in fewer than this many with odds of 1e-6.
LEAST_EQUAL = 72
BLOCK_ROWS = 1024
BLOCK_BYTES = 8 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _MULT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
# Where each empty bin looks for a value, attempt by attempt.
_PROBES = _RNG.integers(0, BINS, (BINS, 4096))
_BAND_KEYS = _RNG.integers(1, 1 << 63, (BINS // BAND_ROWS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}

MARKS = "doc_id long, n_shingles long, size long, set_key binary, bands array<long>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MULT
    x = (x ^ (x >> np.uint64(29))) * _BASE
    return x ^ (x >> np.uint64(32))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BACK)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def shingle_hashes(raw: bytes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a text."""
    words = raw.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    width = min(WORDS, len(words))
    first = starts[:len(words) - width + 1]
    last = (starts + sizes)[width - 1:]
    up, down = _power_table(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum(_BYTE[joined] * up[:len(joined)], out=sums[1:])
    found = _mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    return np.unique(found)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The densified one-permutation signature of a non-empty sorted set."""
    bins = (hashes >> np.uint64(57)).astype(np.int64)
    lead = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    values, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[lead]], full[bins[lead]] = hashes[lead], True
    empty = np.flatnonzero(~full)
    if len(empty):
        at, done = np.zeros(len(empty), np.int64), np.zeros(len(empty), bool)
        for lo, hi in ((0, 16), (16, 256), (256, 4096)):
            left = np.flatnonzero(~done)
            if not len(left):
                break
            hit = full[_PROBES[empty[left], lo:hi]]
            got = hit.any(1)
            at[left[got]] = _PROBES[empty[left[got]], lo + hit[got].argmax(1)]
            done[left[got]] = True
        at[~done] = bins[lead[0]]
        values[empty] = values[at]
    return _mixed(values)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """The bucket of each band of each signature."""
    bands = signatures.reshape(len(signatures), -1, BAND_ROWS)
    return _mixed((bands * _BAND_KEYS).sum(2)).view(np.int64)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    if 100 * min(len(x), len(y)) < SIMILAR_PERCENT * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
    return both > 0 and 100 * both >= SIMILAR_PERCENT * (len(x) + len(y) - both)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    for batch in small_batches(batches, "text"):
        counts, sizes, keys, bands = [], [], [], []
        for raw in utf8_values(batch.column(1)):
            hashes = shingle_hashes(raw)
            counts.append(len(hashes))
            sizes.append(len(raw))
            keys.append(hashlib.blake2b(hashes, digest_size=16).digest() if len(hashes) else None)
            bands.append(band_keys(signature(hashes)[None])[0] if len(hashes)
                         else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64()),
             pa.array(keys, pa.binary()), list_array(bands, np.int64)],
            [f.split()[0] for f in MARKS.split(", ")])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets are similar enough."""
    known: dict[bytes, np.ndarray] = {}

    def hashes(raw: bytes) -> np.ndarray:
        if raw not in known:
            if len(known) >= 64:
                known.clear()
            known[raw] = shingle_hashes(raw)
        return known[raw]

    for batch in small_batches(batches, "text_b"):
        keep = []
        for one, other in zip(utf8_values(batch.column(2)), utf8_values(batch.column(3)), strict=True):
            keep.append(similar(hashes(one), hashes(other)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(
            pa.array(keep, pa.bool_()))


def confirm(pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets; distinct and stored."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return stored(both.mapInArrow(_confirm, "a long, b long").distinct(), name)


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node it reaches) of every node of ``edges`` (a, b).

    Each round takes the smallest label of the neighbours and then the label of that label, so
    labels travel over paths in a logarithmic number of rounds. Rounds are written down.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "near-edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("component")), "near-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        found = stored(lower.join(jump, "component", "left").select(
            "node", "old", F.coalesce(F.least("component", "further"), "component").alias("component")),
            "near-labels")
        labels = found.select("node", "component")
        if found.filter("old <> component").limit(1).count() == 0:
            return labels


def _link_block(rows: list[tuple]) -> list[tuple]:
    """Links between members of different components in one pair of blocks of a bucket.

    A pair is compared in the first bucket that it shares, if its signatures agree in enough
    bins, on the full sets. A link joins its components at once, so the pairs it makes needless
    are skipped.
    """
    bucket, i_part, j_part = rows[0][:3]
    part, ids, comp, centre = (np.array([r[k] for r in rows]) for k in (3, 4, 5, 6))
    sets = [shingle_hashes((r[7] or "").encode()) for r in rows]
    full = np.stack([signature(x) for x in sets])
    keys, low = band_keys(full), full.astype(np.uint16)
    out = []
    for i in range(len(rows) - 1):
        j = np.arange(i + 1, len(rows))
        ok = (comp[j] != comp[i]) & (ids[j] != centre[i]) & (ids[i] != centre[j])
        if i_part != j_part:
            ok &= part[j] != part[i]
        j = j[ok]
        if not len(j):
            continue
        same = keys[j] == keys[i]
        j = j[keys[i][same.argmax(1)] == bucket]
        equal = (low[j] == low[i]).sum(1)
        j = j[np.argsort(-equal, kind="stable")[:(equal >= LEAST_EQUAL).sum()]]
        for k in j:
            if comp[k] != comp[i] and similar(sets[i], sets[k]):
                comp[comp == comp[k]] = comp[i]
                out.append((min(ids[i], ids[k]), max(ids[i], ids[k])))
    return out


def _link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found():
        key, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    yield from _link_block(rows) if rows else ()
                    key, rows = row[:3], []
                rows.append(row)
        yield from _link_block(rows) if rows else ()

    out = list(found())
    if out:
        a, b = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                         ["a", "b"])


def missed_links(members: DataFrame, texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a, b) that stars have missed, from buckets that still hold several components.

    A bucket is cut into blocks of bounded rows and bytes, and each pair of blocks is compared by
    one task; nothing but links leaves it.
    """
    spark = members.sparkSession
    labelled = stored(members.filter("n > 2").join(
        labels.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id")), "near-open")
    keys = stored(labelled.groupBy("bucket").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.sum("size").alias("bytes")).filter("lo <> hi").select("bucket", "bytes"), "near-open-keys")
    open_ = labelled.join(keys, "bucket").join(texts, "doc_id")
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), parts).cast("int")
    spread = open_.withColumn("part", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), parts - 1)))
    blocks = spread.select(
        "bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        "part", "doc_id", "component", "centre", "text")
    return (blocks.repartition(shuffle_partitions(spark), "bucket", "i", "j")
            .sortWithinPartitions("bucket", "i", "j", "doc_id")
            .mapInArrow(_link_blocks, "a long, b long").distinct())


def _any(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    spark = docs.sparkSession
    prepare(spark)
    rows = id_text(docs)
    marks = stored(rows.mapInArrow(_mark, MARKS), "near-marks")
    sets = marks.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = stored(sets.groupBy("set_key").agg(F.min("doc_id").alias("doc_id")), "near-classes")
    lead = sets.select("doc_id", "set_key", "size", "bands").join(classes, ["set_key", "doc_id"])
    banded = stored(lead.select("doc_id", F.explode("bands").alias("bucket"), "size")
                    .groupBy("doc_id", "bucket").agg(F.max("size").alias("size")), "near-bands")
    buckets = stored(banded.groupBy("bucket").agg(
        F.min("doc_id").alias("centre"), F.max("doc_id").alias("far"), F.count("*").alias("n"))
        .filter("centre <> far").drop("far"), "near-buckets")
    members = stored(banded.join(buckets, "bucket"), "near-members")
    texts = stored(rows.join(members.select("doc_id").distinct(), "doc_id"), "near-texts")

    # An id whose rows have several sets links those sets.
    shared = sets.join(classes.withColumnRenamed("doc_id", "lead"), "set_key").filter(
        "doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b"))
    stars = stored(members.filter("doc_id <> centre").select(
        F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct(), "near-pairs")
    links = confirm(stars, texts, "near-links")
    labels = components(links)
    found = stored(missed_links(members, texts, labels), "near-links")
    if _any(found):
        links = links.union(found)
        labels = components(links)
    # Members of a class hang on its smallest id; a repeated id may lie in several classes.
    joined = labels if not _any(_repeated_ids(sets)) else components(
        links.union(shared.distinct()))
    placed = classes.join(joined.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    by_set = stored(placed.select("set_key", F.coalesce("component", "doc_id").alias("component_id")),
                    "near-sets")
    out = marks.select("doc_id", "n_shingles", "set_key").join(by_set, "set_key", "left")
    component: Column = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(
        F.coalesce("component_id", "doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _repeated_ids(sets: DataFrame) -> DataFrame:
    return sets.groupBy("doc_id").agg(
        F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).filter("lo <> hi")
