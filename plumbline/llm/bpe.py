"""Operator 5: byte-level BPE encoding and decoding with higher-order functions.

Texts are packed in blocks, each text as indices into a list of distinct pieces that grows along
the blocks of a task: a block carries the pieces that are new in its task. Spark higher-order
functions fold the ranked merges over the bytes of each such piece that is no token itself; ids of
a text are then put together by index. Decoding concatenates the bytes of the ids. No text is
shuffled. The list starts anew when it holds ``MOST_PIECES``, and small splits are read together,
``TASK_BYTES`` a task, as long as every core has a task; neither changes the result. Blocks are put
together from slices of ``SLICE_BYTES``. Spark would join blocks to Arrow batches of 64 MB; the bound
of the session, ``spark.sql.execution.arrow.maxBytesPerBatch``, is lowered to two blocks.

The ranks of pairs are a literal, found by the ids of both sides in a perfect hash table. It is bound
to a variable, so that its numbers stand once in the plan, whose text the driver keeps. A fold copies
its state at each step, so pieces over ``FOLD_BYTES`` bytes, where that would grow with the square of
their length, are merged by a heap with the same result.

Edge cases: null and empty texts have no id; ids of rows may be null or repeat; one text may be
larger than a block and then fills one alone; an empty table gives no row; columns other than
the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.chunks import cut
from plumbline.llm.common import bound_arrow_batches, id_text, prepare, small_batches

FOLD_BYTES = 200
BLOCK_BYTES = 4 << 20
SLICE_BYTES = 1 << 20
MOST_PIECES = 1 << 20
TASK_BYTES = 128 << 20
_BUCKETS = 16384
_SPREAD = (8191, 40503, 92821)
_ID_BITS = 20
_NONE = 1 << _ID_BITS
BLOCKS = ("doc_ids array<long>, sizes array<int>, codes array<int>, fresh boolean, "
          "counts array<int>, solved array<int>, octets array<array<int>>, long_at array<int>, long_words array<binary>")
_pieces: dict[str, object] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """Ranks by the hexadecimal bytes of a token."""
    buckets: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for token, rank in ranks.items():
        key = token.hex().upper()
        buckets[zlib.crc32(key.encode()) % _BUCKETS][key] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def start_literal(ranks: dict[bytes, int]) -> Column:
    """What a fold starts with, by byte and next byte; 256 stands for no next byte."""
    single = [ranks[bytes([b])] for b in range(256)]
    start = [ranks.get(bytes([a, b]), _NONE) << _ID_BITS | single[a] if b < 256 else
             _NONE << _ID_BITS | single[a] for a in range(256) for b in range(257)]
    return F.from_json(F.lit(json.dumps(start)), "array<long>")


def pair_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by the ids of two neighbours as a perfect hash table: shifts and slots.

    A key belongs to a group; the shift of its group moves it to a slot of its own, which
    holds the key and its rank in one number. Large groups choose their shift first.
    """
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                pairs[left, right] = rank
    size = 1 << max(4, int(len(pairs) * 1.4).bit_length())
    shifts, slots = np.zeros(max(size >> 3, 1), np.int64), np.full(size, -1, np.int64)
    groups: dict[int, list[tuple[int, int]]] = {}
    for left, right in pairs:
        groups.setdefault((left * _SPREAD[0] + right) % len(shifts), []).append((left, right))
    taken = bytearray(size)
    for group, keys in sorted(groups.items(), key=lambda g: -len(g[1])):
        homes = [(left * _SPREAD[1] + right * _SPREAD[2]) % size for left, right in keys]
        if len(set(homes)) < len(homes):
            raise ValueError("two pairs of one group share a slot; change the multipliers")
        shift = next(d for d in range(size) if not any(taken[(h + d) % size] for h in homes))
        shifts[group] = shift
        for (left, right), home in zip(keys, homes, strict=True):
            at = (home + shift) % size
            taken[at] = 1
            slots[at] = (left << _ID_BITS | right) << _ID_BITS | pairs[left, right]
    return shifts, slots


def _rank(ranks: Column, key: Column) -> Column:
    at = (F.pmod(F.crc32(key.cast("binary")), F.lit(_BUCKETS)) + 1).cast("int")
    return F.element_at(F.element_at(ranks, at), key)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def merge_fold(word: Column | None, octets: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of each piece: its own rank, or the fold of its ranked merges over its bytes.

    ``word`` has the pieces in hexadecimal, ``octets`` their bytes; without ``word`` the pieces are
    known to be no tokens. The state of a fold is one
    number for each part: the rank of the pair that it starts, then its id. The rank of a pair
    is the id of what the pair becomes.
    """
    start = start_literal(ranks)
    tables = pair_table(ranks)
    n_shifts, n_slots = map(len, tables)
    shifts, slots = (F.from_json(F.lit(json.dumps(t.tolist())), "array<long>") for t in tables)
    mask, none = F.lit((1 << _ID_BITS) - 1), F.lit(_NONE << _ID_BITS)

    def part(left: Column, right: Column, shifts: Column, slots: Column) -> Column:
        group = (left * _SPREAD[0] + right).bitwiseAND(n_shifts - 1).cast("int")
        at = (left * _SPREAD[1] + right * _SPREAD[2] + F.get(shifts, group)).bitwiseAND(n_slots - 1)
        key = F.shiftleft(left, _ID_BITS).bitwiseOR(right)
        return _let(F.get(slots, at.cast("int")), lambda slot: F.when(
            F.shiftright(slot, _ID_BITS) == key, F.shiftleft(slot.bitwiseAND(mask), _ID_BITS))
            .otherwise(none)).bitwiseOR(left)

    gone = F.lit(-1).cast("long")

    def merged(s: Column, best: Column, at: Column, *hashed: Column) -> Column:
        # ``at`` counts from 1: the pair is at at - 1 and at, its neighbours are beside it.
        new = F.shiftright(best, _ID_BITS)
        here = F.when(at + 1 < F.size(s), part(new, F.get(s, at + 1).bitwiseAND(mask), *hashed)).otherwise(
            none.bitwiseOR(new))
        return F.array_remove(F.transform(s, lambda x, i: F.when((i < at - 2) | (i > at), x).when(
            i == at - 1, here).when(i == at - 2, part(x.bitwiseAND(mask), new, *hashed)).otherwise(
                gone)), gone)

    def step(s: Column, *hashed: Column) -> Column:
        return _let(F.array_min(s), lambda best: F.when(best >= none, s).otherwise(_let(
            F.array_position(s, best).cast("int"), lambda at: merged(s, best, at, *hashed))))

    def fold(octet: Column, *hashed: Column) -> Column:
        rest = F.slice(octet, F.lit(2), F.size(octet))
        first = F.zip_with(octet, rest, lambda a, b: F.element_at(
            start, a * 257 + F.coalesce(b, F.lit(256)) + 1))
        return F.aggregate(rest, first, lambda s, _: step(s, *hashed), lambda s: F.transform(
            s, lambda x: x.bitwiseAND(mask).cast("int")))

    def folds(*hashed: Column) -> Column:
        if word is None:
            return F.transform(octets, lambda octet: fold(octet, *hashed))
        names = rank_literal(ranks)
        return F.zip_with(word, octets, lambda w, octet: _let(_rank(names, w), lambda own: F.when(
            own.isNotNull(), F.array(own)).otherwise(fold(octet, *hashed))))

    return _let(shifts, lambda by_group: _let(slots, lambda at: folds(by_group, at)))


def merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long piece, by a heap of pairs; n log n in its length."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def pair(i: int):
        j = end[i]
        if j < n and (rank := ranks.get(word[i:end[j]])) is not None:
            return rank, i, j, end[j]
        return None

    heap = [x for i in range(n) if (x := pair(i))]
    heapq.heapify(heap)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not (alive[i] and alive[j] and end[i] == j and end[j] == stop):
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            prev[stop] = i
        for k in (i, prev[i]):
            if k >= 0 and (x := pair(k)):
                heapq.heappush(heap, x)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = end[i]
    return out


def _pattern():
    if "pattern" not in _pieces:
        import public_tokenizers
        import regex

        _pieces["pattern"] = regex.compile(public_tokenizers.PATTERN)
    return _pieces["pattern"]


class _Block:
    """Some texts as indices into ``words``, to which new pieces are added."""

    def __init__(self, words: dict[str, int]):
        self.words, self.known = words, len(words)
        self.ids, self.sizes, self.codes, self.bytes = [], [], [], 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        pattern, words = _pattern(), self.words
        chunks = cut(texts)
        coded = chunks.values.dictionary_encode()
        codes = np.array(coded.indices, np.int64)
        at = np.asarray(chunks.offsets, np.int64)
        heads = chunks.values.take(chunks.offsets[:-1]).to_pylist()
        listed = [" " + c for c in coded.dictionary.to_pylist()] + heads
        codes[at[:-1]] = len(coded.dictionary) + np.arange(len(heads))
        parts = []
        for c in listed:
            body = c[1:]
            if body.isascii() and body.isalpha() and c[0] == " ":
                found = (c,)
            else:
                found = pattern.findall(c)
            parts.append([words.setdefault(w, len(words)) for w in found])
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.array([w for p in parts for w in p], np.int32)
        taken = sizes[codes]
        shift = (np.cumsum(sizes) - sizes)[codes] - (np.cumsum(taken) - taken)
        self.codes.append(flat[np.repeat(shift, taken) + np.arange(taken.sum())])
        ends = np.r_[0, np.cumsum(taken)]
        self.sizes.append(ends[at[1:]] - ends[at[:-1]])
        self.ids.append(ids)
        self.bytes += int(pc.sum(pc.binary_length(texts)).as_py() or 0)

    def row(self, solved: dict[bytes, bytes]) -> pa.RecordBatch:
        """One row; ``solved`` has the ids of tokens, ready to be joined."""
        raw = [w.encode() for w in islice(self.words, self.known, None)]
        found = [solved.get(w) for w in raw]
        fold, long_at = [], []
        for i, ids in enumerate(found):
            if ids is None:
                if len(raw[i]) > FOLD_BYTES:
                    long_at.append(i)
                else:
                    fold.append(raw[i])
        known = [ids or b"" for ids in found]
        counts = np.fromiter(map(len, known), np.int32, len(known)) // 4

        def one(values, kind):
            values = pa.array(values, kind) if not isinstance(values, pa.Array) else values
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        return pa.RecordBatch.from_arrays([
            one(pa.concat_arrays(self.ids), None),
            one(np.concatenate(self.sizes).astype(np.int32), pa.int32()),
            one(np.concatenate(self.codes), pa.int32()), pa.array([self.known == 0]),
            one(counts, pa.int32()),
            one(np.frombuffer(b"".join(known), "<i4"), pa.int32()), one(octet_lists(fold), None),
            one(long_at, pa.int32()), one([raw[i] for i in long_at], pa.binary()),
        ], [f.split()[0] for f in BLOCKS.split(", ")])


def octet_lists(words: list[bytes]) -> pa.ListArray:
    """The bytes of each word as integers."""
    ends = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(ends), pa.array(np.frombuffer(b"".join(words), np.uint8).astype(np.int32)))


def _pack(block_bytes: int, most_pieces: int, solved):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = {}
        block, known = _Block(words), solved.value
        for batch in small_batches(batches, "text", SLICE_BYTES):
            block.add(batch.column(0), pc.fill_null(batch.column(1), ""))
            if block.bytes >= block_bytes:
                yield block.row(known)
                if len(words) >= most_pieces:
                    words = {}
                block = _Block(words)
                pa.default_memory_pool().release_unused()
        if block.ids:
            yield block.row(known)
        del block
        pa.default_memory_pool().release_unused()

    return run


def encode_blocks(docs: DataFrame, ranks: dict[bytes, int], block_bytes: int = BLOCK_BYTES,
                  most_pieces: int = MOST_PIECES) -> DataFrame:
    """Blocks of texts with the ids of each piece that is new in its task."""
    prepare(docs.sparkSession)
    bound_arrow_batches(docs.sparkSession, 2 * BLOCK_BYTES)
    solved = {word: rank.to_bytes(4, "little") for word, rank in ranks.items()}
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(solved)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(context.defaultParallelism, -(-size // TASK_BYTES))
    fold = merge_fold(None, F.col("octets"), ranks)
    # An estimate for a plan with joins may be huge; more tasks than there are change nothing.
    return id_text(docs).coalesce(min(tasks, 1 << 30)).mapInArrow(
        _pack(block_bytes, most_pieces, shared), BLOCKS).select(
        "doc_ids", "sizes", "codes", "fresh", "counts", "solved", "long_at", "long_words",
        fold.alias("encoded"))


def texts_of_blocks(blocks: DataFrame, ranks: dict[bytes, int], emit, schema: str) -> DataFrame:
    """Rows ``emit(doc_id, ids, decoded bytes)`` of every text; ids are unsigned 32-bit integers."""
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    shared = blocks.sparkSession.sparkContext.broadcast((ranks, pieces))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts = shared.value
        for batch in batches:
            for r in range(batch.num_rows):
                ids, sizes, codes, fresh, new_counts, solved, long_at, long_words, encoded = (
                    getattr(batch.column(i)[r], "values", batch.column(i)[r]) for i in range(9))
                if fresh.as_py():
                    begins = counts = np.zeros(0, np.int64)
                    flat = np.zeros(0, np.int32)
                new_counts = np.array(new_counts, np.int64)
                new_begins = np.cumsum(new_counts) - new_counts
                at = np.asarray(encoded.offsets).astype(np.int64)
                # Pieces without ids were folded, in their order; long ones come after them.
                open_at = np.setdiff1d(np.flatnonzero(new_counts == 0), np.asarray(long_at), True)
                new_begins[open_at] = len(solved) + at[:-1] - at[0]
                new_counts[open_at] = np.diff(at)
                new = [np.asarray(solved), np.asarray(encoded.flatten())]
                end = sum(map(len, new))
                for i, word in zip(long_at.to_pylist(), long_words.to_pylist(), strict=True):
                    found = merge_heap(word, known)
                    new_begins[i], new_counts[i] = end, len(found)
                    new.append(np.array(found, np.int32))
                    end += len(found)
                begins = np.concatenate([begins, new_begins + len(flat)])
                counts = np.concatenate([counts, new_counts])
                flat = np.concatenate([flat, *new]).astype(np.int32)
                codes, out, lo = np.asarray(codes), [], 0
                for doc_id, size in zip(ids.to_pylist(), sizes.to_pylist(), strict=True):
                    c = codes[lo:lo + size]
                    lo += size
                    n = counts[c]
                    shift = begins[c] - (np.cumsum(n) - n)
                    tokens = flat[np.repeat(shift, n) + np.arange(n.sum())]
                    out.append(emit(doc_id, tokens.astype("<u4"),
                                    b"".join(map(parts.__getitem__, tokens.tolist()))))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(names, x, strict=True)) for x in out], arrow_schema)
                # Blocks are large; an idle worker should not hold on to what they took.
                pa.default_memory_pool().release_unused()

    arrow_schema = pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in schema.split(", ")])
    return blocks.mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(),
          "array<int>": pa.list_(pa.int32())}


def _hashes(doc_id, ids: np.ndarray, decoded: bytes) -> tuple:
    return doc_id, len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encoding_report(docs: DataFrame, ranks: dict[bytes, int], block_bytes: int = BLOCK_BYTES,
                    most_pieces: int = MOST_PIECES) -> DataFrame:
    """doc_id, n_tokens and the sha256 of the ids and of the decoded bytes.

    With more pieces a task folds fewer of them again and needs more memory.
    """
    return texts_of_blocks(encode_blocks(docs, ranks, block_bytes, most_pieces), ranks, _hashes,
                           "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_texts(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, ids and the decoded bytes of every text."""
    return texts_of_blocks(
        encode_blocks(docs, ranks), ranks,
        lambda doc_id, ids, decoded: (doc_id, ids.astype(np.int32), decoded),
        "doc_id long, ids array<int>, decoded binary")
