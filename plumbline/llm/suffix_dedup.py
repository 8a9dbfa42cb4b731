"""Operator 7: removal of repeated byte strings by a hash-ordered index of text windows.

A byte goes if a string of ``SPAN`` bytes that covers it also starts earlier in the table, in
the order of (doc_id, place). Documents are packed in ascending blocks; the order of blocks is
the order of batches. Every string of ``SPAN`` bytes holds one smallest ``GRAM``-byte hash; runs
of neighbouring strings with the same smallest hash are a block's entries, about one for each 26
bytes. Entries are ordered by hash and cut by ranges of it: one task holds one range of the index,
takes the blocks' sorted slices as batches, looks each up in the existing levels, and merges levels
of equal size geometrically (``LevelIndex``). This stands in for a suffix array: as the length that
counts is fixed, equal hashes of windows answer what the order of suffixes would, no suffix is
compared or match length scanned, and only hashes travel. Contested hashes are found by one sort of
a range instead of the levels. Rows sent are blocks times ranges, which grows with the square of a
large input.

Three exchanges make it exact with few bytes sent:
1. smallest hashes: those that only one run has cannot repeat and are done;
2. whole runs: a run that an earlier run equals is repeated as a whole; hashes whose runs differ,
   or of which a run is periodic, are contested;
3. single strings of contested runs.
Only hashes of 64 bits and one answer bit for each travel. A hash that fills the corpus is sent
once per block, so no key is hot.

Edge cases: a null text counts as the empty one; null ids sort first, rows that share an id by
the hash of their text, equal rows one after the other, so all but the first are repeats; texts
under ``SPAN`` bytes are never changed; an empty table gives no row; columns other than the id
and the text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import (
    prepare, scratch, shuffle_partitions, small_batches, stored, utf8_values,
)

SPAN, GRAM = 100, 50
BLOCK_BYTES = 8 << 20
SEGMENT = 64 << 10
BUCKET_BYTES = 24 << 20     # of text for each range of the index, at most
LEAST_BUCKET_BYTES = 2 << 20
_WIDE = SPAN - GRAM + 1
_RNG = np.random.default_rng(100)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _RNG.integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

BLOCKS = "block long, file string, at long, size long, text_bytes long"
REQUESTS = "bucket int, kind int, block long, file string, at long, size long, side string, keys binary"
ANSWERS = "bucket int, kind int, block long, file string, at long, size long, side string, bits binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(text: np.ndarray, top: int) -> list[np.ndarray]:
    """Hashes of all strings of 1, 2, 4, ... 2**top bytes."""
    out = [_BYTE[text]]
    for j in range(top):
        a, s = out[-1], 1 << j
        out.append(a[:-s] * _MULT[j] + a[s:] if len(a) > s else a[:0])
    return out


def _joined(powers: list[np.ndarray], length: int, starts: np.ndarray | None = None,
            count: int = 0) -> np.ndarray:
    """Hashes of the strings of ``length`` bytes at ``starts``, or at the first ``count`` places."""
    total, shift = None, 0
    for j in reversed(range(len(powers))):
        if length >> j & 1:
            part = powers[j][starts + shift] if starts is not None else (
                powers[j][shift:shift + count])
            total = part if total is None else total * _MULT[8 + j] + part
            shift += 1 << j
    return _mixed(total)


def _sliding(a: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbours."""
    reach = 1
    while reach * 2 <= width:
        a = pick(a[:-reach], a[reach:])
        reach *= 2
    rest = width - reach
    return pick(a[:len(a) - rest], a[rest:]) if rest else a


def _periodic(grams: np.ndarray, low: np.ndarray, ok: np.ndarray, first: np.ndarray,
              last: np.ndarray) -> np.ndarray:
    """Runs in which the smallest hash occurs twice: only they can hold one string twice.

    Two such places follow each other among the places that are smallest for some start.
    """
    pad = np.zeros(_WIDE - 1, np.uint64)
    most = _sliding(np.concatenate([pad, np.where(ok, low, 0), pad]), _WIDE, np.maximum)
    spots = np.flatnonzero(most == grams)
    same = np.r_[0, np.cumsum(grams[spots[1:]] == grams[spots[:-1]])]
    lo = np.searchsorted(spots, first)
    hi = np.searchsorted(spots, last + _WIDE - 1, side="right")
    return same[hi - 1] > same[lo]


def _segments(n: int) -> Iterator[tuple[int, int, int]]:
    """(first start, end of starts, end of bytes) of pieces; starts have a whole string after them."""
    for lo in range(0, max(0, n - SPAN + 1), SEGMENT):
        hi = min(lo + SEGMENT, n - SPAN + 1)
        yield lo, hi, hi + SPAN - 1


def runs(text: np.ndarray, ends: np.ndarray, with_hash: bool) -> tuple[np.ndarray, ...]:
    """Runs of starts with one smallest hash.

    Gives hashes, first starts, last starts, whether a run may hold one string twice, and (where
    asked for) hashes of whole runs.

    ``ends`` are the ends of the documents in ``text``; no string crosses one. Runs are cut at
    ``_WIDE`` starts, which only periodic texts exceed, and at the ends of segments.
    """
    open_ = np.ones(len(text), bool)
    for step in range(1, SPAN):
        stop = ends - step
        open_[stop[stop >= 0]] = False
    keys, firsts, lasts, loops, wholes = [], [], [], [], []
    for lo, hi, end in _segments(len(text)):
        powers = _powers(text[lo:end], 6 if with_hash else 5)
        n = hi - lo
        grams = _joined(powers, GRAM, count=n + _WIDE - 1)
        low = _sliding(grams, _WIDE, np.minimum)
        ok = open_[lo:hi]
        edge = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (ok[1:] != ok[:-1])])
        stop = np.r_[edge[1:], n]
        pick = ok[edge]
        edge, stop = edge[pick], stop[pick]
        long = stop - edge > _WIDE
        if long.any():
            parts = [np.arange(a, b, _WIDE) for a, b in zip(edge[long], stop[long], strict=True)]
            more = np.concatenate(parts)
            last = np.concatenate([np.r_[p[1:], b] for p, b in zip(parts, stop[long], strict=True)])
            edge, stop = np.r_[edge[~long], more], np.r_[stop[~long], last]
            order = np.argsort(edge)
            edge, stop = edge[order], stop[order]
        keys.append(low[edge])
        loops.append(_periodic(grams, low, ok, edge, stop - 1))
        firsts.append(edge + lo)
        lasts.append(stop - 1 + lo)
        if with_hash and len(edge):
            head, tail = _joined(powers, SPAN, edge), _joined(powers, SPAN, stop - 1)
            wholes.append(_mixed(head * _MULT[14] + tail * _MULT[15]
                                 + (stop - edge).astype(np.uint64)))
    none = np.zeros(0, np.int64)

    def flat(parts, empty):
        return np.concatenate(parts) if parts else empty

    return (flat(keys, none.astype(np.uint64)), flat(firsts, none), flat(lasts, none),
            flat(loops, none.astype(bool)),
            flat(wholes, none.astype(np.uint64)) if with_hash else None)


def string_hashes(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the whole strings at ascending ``starts``."""
    out = [np.zeros(0, np.uint64)]
    for lo, hi, end in _segments(len(text)):
        mine = starts[np.searchsorted(starts, lo):np.searchsorted(starts, hi)]
        if len(mine):
            out.append(_joined(_powers(text[lo:end], 6), SPAN, mine - lo))
    return np.concatenate(out)


class LevelIndex:
    """Sorted arrays of keys, each level larger than the next; equal sizes merge."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Which of the sorted keys an existing level has: one merge scan per level."""
        found = np.zeros(len(keys), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            found |= level[at] == keys
        return found

    def add(self, keys: np.ndarray) -> None:
        """Add a batch of sorted keys that no level holds."""
        if not len(keys):
            return
        while self.levels and len(self.levels[-1]) < 2 * len(keys):
            keys = np.concatenate([self.levels.pop(), keys])
            keys.sort(kind="stable")
        self.levels.append(keys)


# Blocks of documents in files of the shared folder.

def _pack(folder: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, base = pafs.FileSystem.from_uri(folder)
        part, name, out, at = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.blocks", None, 0
        packer, rows = zstandard.ZstdCompressor(3), []
        ids, texts, notes, held = [], [], [], 0

        def close():
            nonlocal out, at, ids, texts, notes, held
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}", compression=None)
            head = np.array([(i is not None, i or 0, len(t)) for i, t in zip(ids, texts, strict=True)],
                            np.int64)
            noted = json.dumps(notes).encode()
            body = packer.compress(np.array([len(ids), len(noted)], np.int64).tobytes()
                                   + head.tobytes() + noted + b"".join(texts))
            out.write(body)
            rows.append((part << 32 | len(rows), name, at, len(body), held))
            at += len(body)
            ids, texts, notes, held = [], [], [], 0

        for batch in small_batches(batches, "text", block_bytes):
            for i, t, note in zip(batch.column(0).to_pylist(), utf8_values(batch.column(1)),
                                  batch.column(2).to_pylist(), strict=True):
                if ids and held + len(t) > block_bytes:
                    close()
                ids.append(i)
                notes.append(note)
                texts.append(t)
                held += len(t)
        if ids:
            close()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in zip(*rows, strict=True)],
                [f.split()[0] for f in BLOCKS.split(", ")])

    return run


class _Block:
    def __init__(self, folder: str, file: str, at: int, size: int):
        import zstandard

        fs, base = pafs.FileSystem.from_uri(folder)
        with fs.open_input_file(f"{base}/{file}") as f:
            raw = zstandard.ZstdDecompressor().decompress(f.read_at(size, at))
        n, noted = np.frombuffer(raw, np.int64, 2).tolist()
        head = np.frombuffer(raw, np.int64, 3 * n, 16).reshape(-1, 3)
        self.ids = [i if known else None for known, i, _ in head.tolist()]
        self.notes = json.loads(raw[16 + 24 * n:16 + 24 * n + noted])
        self.text = np.frombuffer(raw, np.uint8, offset=16 + 24 * n + noted)
        self.ends = np.cumsum(head[:, 2])


def _save(folder: str, **arrays) -> str:
    """Keep what the next step on a block needs in a file that only this attempt writes."""
    fs, base = pafs.FileSystem.from_uri(folder)
    name = f"{uuid.uuid4().hex}.npz"
    with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
        buffer = pa.BufferOutputStream()
        np.savez(buffer, **arrays)
        f.write(buffer.getvalue())
    return name


def _load(folder: str, name: str):
    import io

    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{base}/{name}") as f:
        return np.load(io.BytesIO(f.read()))


# Requests of blocks, and the answers of index ranges.

def _sliced(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted keys are cut into ranges by their first bits; buckets are a power of two."""
    bounds = np.arange(1, buckets, dtype=np.uint64) << np.uint64(65 - buckets.bit_length())
    return np.r_[0, np.searchsorted(keys, bounds), len(keys)]


def _short(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The 32 bits after those that name the bucket. Order stays within a bucket.

    Two keys may share them; a key then passes for repeated and is judged in the next exchange.
    """
    return (keys << np.uint64(buckets.bit_length() - 1) >> np.uint64(32)).astype(np.uint32)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(
        columns, fields, strict=True)], [n for n, _ in fields])


def _ask(address: tuple, side: str, kind: int, keys: np.ndarray, buckets: int,
         sent: list[np.ndarray]) -> Iterator[tuple]:
    cuts = _sliced(keys, buckets)
    for b in range(buckets):
        lo, hi = cuts[b], cuts[b + 1]
        if hi > lo:
            yield (b, kind, *address, side, b"".join(x[lo:hi].tobytes() for x in sent))


def _grouped(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that come sorted, grouped by their first ``width`` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:width] != key:
                if rows:
                    yield key, rows
                key, rows = row[:width], []
            rows.append(row)
    if rows:
        yield key, rows


def _repeated(slices: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each slice, which keys another slice has too."""
    index, again = LevelIndex(), LevelIndex()
    for keys in slices:
        seen = index.holds(keys)
        index.add(keys[~seen])
        twice = keys[seen]
        again.add(twice[~again.holds(twice)])
    return (again.holds(keys) for keys in slices)


def _seen_before(slices: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each slice, which keys an earlier slice has."""
    index = LevelIndex()
    for keys in slices:
        seen = index.holds(keys)
        index.add(keys[~seen])
        yield seen


def _contested(slices: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each slice of (hash, a run), which hashes have several runs anywhere.

    The last bit of the run says that the block itself has several.
    """
    keys = np.concatenate([s[0] for s in slices])
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
    run = np.concatenate([s[1] for s in slices])[order]
    top = np.maximum.reduceat(run, starts)
    several = (np.minimum.reduceat(run, starts) != top) | (
        np.bitwise_or.reduceat(run, starts) & np.uint64(1) > 0)
    found = keys[order][starts][several]
    for s in slices:
        if len(found):
            at = np.minimum(np.searchsorted(found, s[0]), len(found) - 1)
            yield found[at] == s[0]
        else:
            yield np.zeros(len(s[0]), bool)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of the index after another; its slices come in the order of their blocks."""
    rules: list[tuple[int, type, Callable]] = [
        (1, np.uint32, _repeated), (1, np.uint64, _seen_before), (2, np.uint64, _contested),
        (1, np.uint64, _seen_before)]
    for (_, kind), rows in _grouped(batches, 2):
        width, dtype, rule = rules[kind]
        slices = [np.frombuffer(r[7], dtype) for r in rows]
        if width > 1:
            slices = [s.reshape(width, -1) for s in slices]
        out, held = [], 0
        for row, bits in zip(rows, rule(slices), strict=True):
            out.append((*row[:7], np.packbits(bits).tobytes()))
            held += len(out[-1][7]) + 100
            if held > 4 << 20:
                yield _batch(out, ANSWERS)
                out, held = [], 0
        yield _batch(out, ANSWERS)


def _exchange(requests: DataFrame) -> DataFrame:
    """Send requests to index ranges and the answers back to their blocks."""
    n = shuffle_partitions(requests.sparkSession)
    answers = (requests.repartition(n, "bucket")
               .sortWithinPartitions("bucket", "kind", "block").mapInArrow(_answer, ANSWERS))
    return (answers.repartition(n, "block").sortWithinPartitions("block", "kind", "bucket")
            .select("block", "kind", "file", "at", "size", "side", "bucket", "bits"))


def _bits(rows: list[tuple], kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The answers to ``keys`` of a kind, put together from the ranges."""
    cuts, out = _sliced(keys, buckets), np.zeros(len(keys), bool)
    for row in rows:
        if row[1] == kind:
            lo, hi = cuts[row[6]], cuts[row[6] + 1]
            out[lo:hi] = np.unpackbits(np.frombuffer(row[7], np.uint8), count=hi - lo)
    return out


def _flush(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += 200 + len(row[-1] or b"")
        if held > 8 << 20:
            yield _batch(out, schema)
            out, held = [], 0
    if out:
        yield _batch(out, schema)


def _first_requests(folder: str, buckets: int):
    def rows(batches):
        for batch in batches:
            for block, file, at, size, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = _Block(folder, file, at, size)
                keys = np.unique(runs(b.text, b.ends, False)[0])
                yield from _ask((block, file, at, size), "", 0, keys, buckets,
                                [_short(keys, buckets)])

    return lambda batches: _flush(rows(batches), REQUESTS)


def _second_requests(folder: str, buckets: int):
    def rows(batches):
        for (block,), answers in _grouped(batches, 1):
            _, _, file, at, size, *_ = answers[0]
            b = _Block(folder, file, at, size)
            keys, first, last, loop, whole = runs(b.text, b.ends, True)
            known, where, times = np.unique(keys, return_inverse=True, return_counts=True)
            keep = (_bits(answers, 0, known, buckets) | (times > 1))[where] | loop
            keys, first, last, whole, loop = (x[keep] for x in (keys, first, last, whole, loop))
            if not len(keys):
                continue
            wholes, of_whole, lead = _unique_first(whole)
            hashes, of_key = np.unique(keys, return_inverse=True)
            one = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
            most = np.zeros(len(hashes), np.uint64)
            np.minimum.at(one, of_key, whole)
            np.maximum.at(most, of_key, whole)
            several = one != most
            several[of_key[loop]] = True
            side = _save(folder, first=first.astype(np.int32), last=last.astype(np.int32),
                         of_whole=of_whole.astype(np.int32), of_key=of_key.astype(np.int32),
                         lead=lead, wholes=wholes, hashes=hashes)
            address = (block, file, at, size)
            yield from _ask(address, side, 1, wholes, buckets, [wholes])
            yield from _ask(address, side, 2, hashes, buckets, [
                hashes, one & ~np.uint64(1) | several.astype(np.uint64)])

    return lambda batches: _flush(rows(batches), REQUESTS)


def _unique_first(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the index of each value in them, and whether it is the first."""
    known, at, where = np.unique(values, return_index=True, return_inverse=True)
    lead = np.zeros(len(values), bool)
    lead[at] = True
    return known, where, lead


def _third_requests(folder: str, buckets: int):
    def rows(batches):
        for (block,), answers in _grouped(batches, 1):
            _, _, file, at, size, side, *_ = answers[0]
            s = _load(folder, side)
            before = _bits(answers, 1, s["wholes"], buckets)[s["of_whole"]]
            repeat = before | ~s["lead"]
            open_ = _bits(answers, 2, s["hashes"], buckets)[s["of_key"]] & ~repeat
            first, last = s["first"].astype(np.int64), s["last"].astype(np.int64)
            sizes = (last - first + 1)[open_]
            starts = np.repeat(first[open_] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            hashes, where, lead = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
            if len(starts):
                b = _Block(folder, file, at, size)
                hashes, where, lead = _unique_first(string_hashes(b.text, starts))
            kept = _save(folder, first=first[repeat].astype(np.int32),
                         last=last[repeat].astype(np.int32), starts=starts.astype(np.int32),
                         where=where.astype(np.int32), lead=lead, hashes=hashes)
            address = (block, file, at, size)
            # An empty request of its own kind brings the file back where no string is open.
            yield (block % buckets, 3, *address, kept, b"")
            yield from _ask(address, kept, 1, hashes, buckets, [hashes])

    return lambda batches: _flush(rows(batches), REQUESTS)


def _finish(folder: str, buckets: int, emit):
    """Each block with its answers becomes a row of ``emit`` for each document."""

    def rows(batches):
        for (block,), answers in _grouped(batches, 1):
            _, _, file, at, size, *_ = answers[0]
            b = _Block(folder, file, at, size)
            gone = np.zeros(len(b.text) + 1, np.int32)
            if side := next((r[5] for r in answers if r[5]), ""):
                s = _load(folder, side)
                repeat = _bits(answers, 1, s["hashes"], buckets)
                again = s["starts"][repeat[s["where"]] | ~s["lead"]]
                np.add.at(gone, s["first"], 1)
                np.add.at(gone, s["last"] + SPAN, -1)
                np.add.at(gone, again, 1)
                np.add.at(gone, again + SPAN, -1)
            mask = np.cumsum(gone[:-1]) > 0
            lo = 0
            for doc_id, note, hi in zip(b.ids, b.notes, b.ends.tolist(), strict=True):
                yield emit(doc_id, b.text[lo:hi], mask[lo:hi], note)
                lo = hi

    return rows


def remove_repeats(docs: DataFrame, emit, schema: str, block_bytes: int = BLOCK_BYTES,
                   note: Column | None = None) -> DataFrame:
    """Rows ``emit(doc_id, bytes, mask of removed bytes, note)`` of every document.

    ``note`` is a text of each row that comes back with it.
    """
    spark = docs.sparkSession
    prepare(spark)
    n, folder = shuffle_partitions(spark), scratch(spark, "suffix-blocks")
    noted = docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                        docs["text"].cast("string").alias("text"),
                        (F.lit(None) if note is None else note).cast("string").alias("note"))
    blocks = stored(noted.repartitionByRange(n, "doc_id", F.xxhash64("text"))
                    .sortWithinPartitions("doc_id", F.xxhash64("text"))
                    .mapInArrow(_pack(folder, block_bytes), BLOCKS), "suffix-manifest")
    total = blocks.agg(F.sum("text_bytes")).first()[0] or 0
    ranges = max(min(2 * n, total // LEAST_BUCKET_BYTES), -(-total // BUCKET_BYTES), 2)
    buckets = 1 << (ranges - 1).bit_length()
    spread = blocks.repartition(n, "block")
    first = _exchange(spread.mapInArrow(_first_requests(folder, buckets), REQUESTS))
    second = _exchange(first.mapInArrow(_second_requests(folder, buckets), REQUESTS))
    third = _exchange(second.mapInArrow(_third_requests(folder, buckets), REQUESTS))
    # Blocks in which nothing repeats have asked nothing more; the manifest names them.
    all_blocks = blocks.select("block", F.lit(-1).alias("kind"), "file", "at", "size",
                               F.lit("").alias("side"), F.lit(-1).alias("bucket"),
                               F.lit(b"").alias("bits"))
    finish = _finish(folder, buckets, emit)
    return (third.unionByName(all_blocks).repartition(n, "block").sortWithinPartitions("block", "kind", "bucket")
            .mapInArrow(lambda batches: _flush(finish(batches), schema), schema))


def _report(doc_id, raw: np.ndarray, mask: np.ndarray, note) -> tuple:
    edges = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0
    return (doc_id, len(raw), int(mask.sum()), edges,
            hashlib.sha256(raw[~mask].tobytes()).hexdigest())


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the sha256 of the remaining bytes."""
    return remove_repeats(docs, _report, "doc_id long, n_bytes long, n_removed long, "
                                         "n_spans long, kept_sha256 string")


def _text(doc_id, raw: np.ndarray, mask: np.ndarray, note) -> tuple:
    """The remaining text. A character of which a byte remains is kept whole."""
    if mask.any():
        inner = (raw & 0xC0) == 0x80
        lead = np.flatnonzero(~inner)
        whole = np.minimum.reduceat(mask, lead) if len(lead) else mask[:0]
        mask = np.repeat(whole, np.diff(np.r_[lead, len(raw)]))
    return doc_id, int(mask.sum()), note, raw[~mask].tobytes().decode()


def remaining_texts(docs: DataFrame, note: Column | None = None) -> DataFrame:
    """doc_id, bytes removed, note, and the text without repeats, cut at whole characters."""
    return remove_repeats(docs, _text, "doc_id long, n_removed long, note string, text string",
                          note=note)
