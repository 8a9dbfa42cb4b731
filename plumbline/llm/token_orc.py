"""Operator 1: token ids in ORC files.

Every text is encoded with a ``tokenizers`` file and written, in ascending id order, to ORC:
integer run-length encoding holds the ids, row indexes and a Bloom filter on ``doc_id`` let a
reader skip stripes and row groups, and stripes are read in parallel.

The file's added tokens, such as ``<|endoftext|>``, are found in texts as the library finds them
by default: one that stands in a text is the one id of the token, and what lies between them is
encoded alone.

Edge cases: a null text is encoded as the empty one and holds the end id alone; a null id sorts
first; rows that share an id follow each other in the order of the hash of their texts, equal
rows arbitrarily; an empty table gives no file and reads back as no row; columns other than the
id and the text are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.chunks import cut, gather
from plumbline.llm.common import id_text, prepare, shuffle_partitions, small_batches

SCHEMA = "shard int, doc_id long, shard_start long, n_tokens int, ids array<int>"

_CACHE_LIMIT = 900_000
_encoders: dict[str, ChunkEncoder] = {}


def _byte_letters() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class ChunkEncoder(dict):
    """Ids of chunks as little-endian unsigned 32-bit integers, by the chunk without its space.

    A chunk that is not held yet is cut into pieces and each piece given to the model of the
    ``tokenizers`` file. What is held is bounded; it only saves work.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        strict = [t.content for t in added.values() if t.lstrip or t.rstrip or t.single_word]
        if strict:
            raise ValueError(f"added tokens that look at their neighbours are unknown: {strict}")
        self.added = {t.content: i for i, t in added.items()}
        # The longest of those that start at one place counts.
        longest = sorted(self.added, key=len, reverse=True)
        self.any_added = "|".join(map(re.escape, longest))
        self.split_added = re.compile(f"({self.any_added})").split
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.marks = {m: self._piece(m) for m in ".,;:!?"}

    def _model(self, shown: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._model(piece.encode().decode("latin-1").translate(self.letters))

    def _chunk(self, rest: str) -> bytes:
        word, mark = rest, b""
        if rest[-1:] in self.marks:
            word, mark = rest[:-1], self.marks[rest[-1]]
        # Letters up to here are the same in every Unicode version.
        if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
            if mark:
                return self[word] + mark
            return self._piece(" " + word)
        return b"".join(map(self._piece, self.pieces.findall(" " + rest)))

    def __missing__(self, rest: str) -> bytes:
        ids = self._chunk(rest)
        self[rest] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array without nulls, and how many each text has."""
        marked = pc.match_substring_regex(texts, self.any_added) if self.added else None
        if marked is None or not pc.any(marked).as_py():
            return self._encode_plain(texts)
        # Texts between added tokens, and the token after each but the last of a text.
        parts = [self.split_added(t) if has else [t]
                 for t, has in zip(texts.to_pylist(), marked.to_pylist(), strict=True)]
        plain = pa.array([s for p in parts for s in p[::2]], pa.string())
        after = [i for p in parts for i in (*map(self.added.get, p[1::2]), -1)]
        after = np.array(after, np.int64)
        flat, counts = self._encode_plain(plain)
        has = after >= 0
        flat = np.insert(flat, np.cumsum(counts)[has], after[has].astype(flat.dtype))
        firsts = np.cumsum([0, *(len(p[::2]) for p in parts[:-1])])
        return flat, np.add.reduceat(counts + has, firsts)

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without added tokens."""
        if len(self) > _CACHE_LIMIT:
            self.clear()
        chunks = cut(texts)
        words = chunks.values.dictionary_encode()
        codes = np.array(words.indices, np.int64)
        held = [self[w] for w in words.dictionary.to_pylist()]
        at = np.asarray(chunks.offsets, np.int64)
        # The first chunk of a text has no space before it.
        codes[at[:-1]] = len(held) + np.arange(len(texts))
        held += [b"".join(map(self._piece, self.pieces.findall(c)))
                 for c in chunks.values.take(chunks.offsets[:-1]).to_pylist()]
        flat, sizes = gather(held, codes)
        ends = np.r_[0, np.cumsum(sizes)]
        return flat, ends[at[1:]] - ends[at[:-1]]


def _encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, start = _encoder(path), TaskContext.get().partitionId(), 0
        for batch in small_batches(batches, "text"):
            flat, counts = encoder.encode(pc.fill_null(batch.column(1), ""))
            ends = np.cumsum(counts)
            flat = np.insert(flat, ends, end_id)
            counts = counts + 1
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(counts), shard, np.int32)), batch.column(0),
                pa.array(start + ends - counts), pa.array(counts.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)),
                                         pa.array(flat.astype(np.int32))),
            ], ["shard", "doc_id", "shard_start", "n_tokens", "ids"])
            start += int(ends[-1])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0,
                      shards: int | None = None, stripe_bytes: int = 16 << 20,
                      index_stride: int = 1000) -> None:
    """Write the ids of every text, ``end_id`` appended, to ORC files below ``path``.

    File ``shard`` holds one range of ids; within it rows ascend by id. ``shard_start`` counts
    the ids before a row in its file.
    """
    spark = docs.sparkSession
    prepare(spark)
    (id_text(docs)
     .repartitionByRange(shards or shuffle_partitions(spark), "doc_id", F.xxhash64("text"))
     .sortWithinPartitions("doc_id", F.xxhash64("text"))
     .mapInArrow(_encode(tokenizer, end_id), SCHEMA)
     .write.option("orc.compress", "ZSTD").option("orc.stripe.size", stripe_bytes)
     .option("orc.create.index", "true").option("orc.row.index.stride", index_stride)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .orc(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files: doc_id, start (ids of all documents before it), n_tokens, ids.

    The starts of files come from the sums of a column-pruned read, one row per file.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    sizes = rows.groupBy("shard").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(starts), "shard").select(
        "doc_id", (F.col("base") + F.col("shard_start")).alias("start"),
        F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few ids: stripe statistics and Bloom filters prune what is read."""
    return (spark.read.schema(SCHEMA).orc(path).filter(F.col("doc_id").isin(doc_ids))
            .select("doc_id", "n_tokens", "ids"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        flat = np.asarray(ids.values, np.uint32).astype("<u4", copy=False)
        at = np.asarray(ids.offsets)
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_file_report(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids of rows that were read back."""
    prepare(rows.sparkSession)
    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        _checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")
