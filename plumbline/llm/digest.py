"""Operator 6: quartile bucket digests.

Hashed byte triplets of a text are counted in buckets; the digest writes for each bucket which
quartile of the counts it falls in, and the length on a log scale. Two digests differ by the
quartile steps of their buckets and by their lengths; the bounded difference gives a likeness
from 0 to 1. Equal texts have equal digests.

Edge cases: a null text counts as the empty one; texts under three bytes have no triplet and the
digest of an empty bucket table with their length; two such digests of one length are alike (1).
In ``digest_edits`` rows go by descending id, null ids last, rows that share an id by the hash of
their text; the row after the last is the first; a lone row is its own next. An empty table gives
no row; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import (
    id_text, prepare, shuffle_partitions, small_batches, utf8_values,
)

BUCKETS = 256
FARTHEST = 1.5          # mean quartile steps at which the likeness is 0
_WEIGHTS = np.array([0.0, 1.0, 2.0, 4.0])   # a jump over all quartiles counts more
_SALT = np.random.default_rng(41).permutation(256).astype(np.uint32)
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")


def bucket_counts(raw: bytes) -> np.ndarray:
    """How many byte triplets fall in each bucket."""
    if len(raw) < 3:
        return np.zeros(BUCKETS, np.int64)
    b = np.frombuffer(raw, np.uint8)
    code = b[:-2].astype(np.uint32)
    code <<= 8
    code |= b[1:-1]
    code <<= 8
    code |= b[2:]
    code *= np.uint32(2654435761)
    code >>= np.uint32(24)
    return np.bincount(code, minlength=BUCKETS)


def digest(raw: bytes) -> str:
    """The digest: two hexadecimal digits for the length, then two bits per bucket."""
    counts = bucket_counts(raw)
    low, mid, high = np.sort(counts)[[BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4]]
    steps = (counts > low).astype(np.uint8) + (counts > mid) + (counts > high)
    quads = steps.reshape(-1, 4)
    packed = quads[:, 0] << 6 | quads[:, 1] << 4 | quads[:, 2] << 2 | quads[:, 3]
    length = min(255, int(round(8 * np.log2(1 + len(raw)))))
    return f"{length:02x}" + packed.astype(np.uint8).tobytes().hex()


def _steps(fingerprint: str) -> tuple[int, np.ndarray]:
    packed = np.frombuffer(bytes.fromhex(fingerprint[2:]), np.uint8)
    shifts = np.array([6, 4, 2, 0], np.uint8)
    return int(fingerprint[:2], 16), ((packed[:, None] >> shifts) & 3).ravel()


def likeness(one: str, other: str) -> float:
    """1 for equal digests, falling to 0 with the bounded difference score."""
    (n, a), (m, b) = _steps(one), _steps(other)
    steps = _WEIGHTS[np.abs(a.astype(np.int8) - b)].mean()
    return float(max(0.0, 1.0 - steps / FARTHEST - abs(n - m) / 128))


def add_digests(docs: DataFrame) -> DataFrame:
    """doc_id and the digest of each text."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(v) for v in utf8_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())],
                                             ["doc_id", "fingerprint"])

    return id_text(docs).mapInArrow(run, "doc_id long, fingerprint string")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range and place; each meets the row behind it in its range.

    ``lent`` rows only serve as the next of the last row of a range and give none themselves.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    held = None  # (range, doc_id, text, fingerprint)
    for batch in small_batches(batches, "text"):
        out = []
        for spot, doc_id, text, lent in zip(*(c.to_pylist() for c in batch.columns[:4]),
                                            strict=True):
            text = text or ""
            mark = digest(text.encode())
            if held is not None and held[0] == spot:
                _, held_id, held_text, held_mark = held
                k = len(held_text) // 3
                edited = (held_text[:len(held_text) - k] + text[:k]).encode()
                edited_mark = digest(edited)
                out.append((held_id, len(held_text), hashlib.sha256(edited).hexdigest(),
                            held_mark, edited_mark, likeness(held_mark, edited_mark),
                            likeness(held_mark, mark)))
            held = None if lent else (spot, doc_id, text, mark)
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
                 pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds,
                                                                         strict=True)], names)


def _placed(bounds: list[tuple[int, int]]):
    """Add the range of a row: how many bounds lie before its place in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect

        for batch in batches:
            spots = [bisect.bisect_right(bounds, place) for place in zip(
                batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(spots, pa.int32()), *batch.columns],
                ["spot", *batch.schema.names])

    return run


def digest_edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Digests of each text and of its edited text, and how alike it is to that and to the next.

    The edited text has its last third replaced by the first code points of the next document.
    Rows are cut into ranges of the order; the first row of each range is also lent to the range
    before, so every row meets its next without one task seeing all rows. Bounds and first rows
    are one small row per range.
    """
    spark = docs.sparkSession
    prepare(spark)
    # Descending id with null last is ascending ``place``; ties by the hash of the text.
    place = F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1))
    rows = id_text(docs).withColumns({"place": place, "tie": F.xxhash64("text")})
    n = ranges or 4 * shuffle_partitions(spark)
    cuts = rows.select(F.percentile_approx("place", [i / n for i in range(1, n)], 10 * n)).first()
    bounds = sorted({(c, -(1 << 63)) for c in (cuts[0] or [])})
    ids = rows.select("doc_id", "place", "tie")
    schema = "spot int, doc_id long, place long, tie long"
    firsts = sorted(ids.mapInArrow(_placed(bounds), schema).groupBy("spot").agg(
        F.min(F.struct("place", "tie")).alias("first")).collect())
    # Ranges without rows vanish: the range of a first row lends it to the one listed before.
    lender = {(r["first"]["place"], r["first"]["tie"]): firsts[i - 1]["spot"]
              for i, r in enumerate(firsts)}

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _placed(bounds)(batches):
            spots, doc_ids, places, ties, texts = (c for c in batch.columns)
            no = pa.array(np.zeros(batch.num_rows, bool))
            yield pa.RecordBatch.from_arrays([spots, doc_ids, texts, no, places, ties], names)
            for i, key in enumerate(zip(places.to_pylist(), ties.to_pylist(), strict=True)):
                if key in lender:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lender[key]], pa.int32()), doc_ids.slice(i, 1),
                         texts.slice(i, 1), pa.array([True]), places.slice(i, 1),
                         ties.slice(i, 1)], names)

    names = ["spot", "doc_id", "text", "lent", "place", "tie"]
    lent = rows.select("doc_id", "place", "tie", "text").mapInArrow(
        lend, "spot int, doc_id long, text string, lent boolean, place long, tie long")
    return (lent.repartition(shuffle_partitions(spark), "spot")
            .sortWithinPartitions("spot", "lent", "place", "tie")
            .select("spot", "doc_id", "text", "lent")
            .mapInArrow(_edits, SCHEMA))
