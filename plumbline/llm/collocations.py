"""Operator 13: phrase collocation mining by SON partitioning.

Documents are dealt to ``SHARDS`` shards by a hash of their text. A phrase that has the support in
the whole language must have its proportional part of it, rounded up, in some shard; each shard is
mined completely at that lowered support, the phrases that are frequent in any shard are united,
and all of them are counted exactly over all shards. Shards are logical: many tasks count one
shard, and a shard has no more than its share of the words. Mining goes level by level, and a
phrase is counted only if both its parts are frequent.

The counts of one phrase in all shards meet in one place of one exchange, so the local test and
the exact count of what passes it need no second reading of the texts. Before that exchange tasks
count whole blocks of texts, with words as integers.

Frequent parts are known to tasks by a bit table of fixed size, filled from the level before. It
never misses one; where it is too small for a corpus, more phrases are counted than needed and the
result stays the same.

Edge cases: null texts are empty and have no word; a null language is ``und``, together with rows
of that name; repeated rows count each; ids are not read; a text may be of any length, it is cut
at the ends of pieces inside the task; equal scores rank by count, then by the bytes of the
phrase; of equal cuts the first counts; an empty table gives no row; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.coded import Vocabulary, slices
from plumbline.llm.common import prepare, small_batches, stored, utf8_values

SUPPORT = 10
SHARDS = 4
BLOCK_BYTES = 8 << 20
_SLICE = 1 << 20
_SALTS = 64
RANKS = 2000
INSIDE_PERCENT = 50
FILTER_BITS = {1: 1 << 25, 2: 1 << 26}
_PROBES = 3
# A-Z become a-z, tabs blanks, and ends of pieces a byte that no UTF-8 text has.
_END = b"\xff"
_TEXT = bytes(255 if i in b".,;:!?\n\x0b\x0c\r" else 32 if i == 9 else i + 32 if 65 <= i < 91 else i
              for i in range(256))
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


# Hashes of phrases and the bit table of frequent ones

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def joined_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two neighbours from theirs."""
    return _mixed(left * _MIX[0] + right)


def _slots(lang: np.ndarray | np.uint64, phrase: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    key = _mixed(phrase + lang)
    for i in range(_PROBES):
        yield ((key >> np.uint64(20 * i)) ^ (key * _MIX[i])) % np.uint64(bits)


class FrequentParts:
    """Which phrases may be frequent, as a bit table of fixed size."""

    def __init__(self, table: np.ndarray):
        self.table, self.bits = table, len(table) * 8

    def may_hold(self, lang: str, phrase: np.ndarray) -> np.ndarray:
        out = np.ones(len(phrase), bool)
        for slot in _slots(word_hashes([lang.encode()])[0], phrase, self.bits):
            byte = self.table[(slot >> np.uint64(3)).astype(np.int64)]
            out &= (byte >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def frequent_parts(phrases: DataFrame, bits: int) -> FrequentParts:
    """The bit table of the rows (lang, phrase); at most bits / 64 numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = word_hashes(list(utf8_values(batch.column(0))))
            words = [p.split(b" ") for p in utf8_values(batch.column(1))]
            phrase = word_hashes([w[0] for w in words])
            for i in range(1, len(words[0])):
                phrase = joined_hashes(phrase, word_hashes([w[i] for w in words]))
            slot = np.concatenate(list(_slots(lang, phrase, bits)))
            at, mask = (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63))
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[order][first]),
                 pa.array(np.bitwise_or.reduceat(mask[order], first).view(np.int64))], ["at", "mask"])

    found = phrases.select("lang", "phrase").mapInArrow(run, "at long, mask long").groupBy("at").agg(
        F.expr("bit_or(mask)").alias("mask")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[np.asarray(found["at"])] = np.asarray(found["mask"])
    return FrequentParts(table.view(np.uint8))


# Counting inside tasks

class _Block:
    """The words of some texts by language, as codes with their shards; -1 ends a piece."""

    def __init__(self):
        self.vocabulary = Vocabulary()
        self.end = int(self.vocabulary.code([_END])[0])
        self.codes: dict[str, list[tuple[int, np.ndarray]]] = {}
        self.bytes = 0

    def add(self, lang: str, shard: int, raw: bytes) -> None:
        into = self.codes.setdefault(lang, [])
        for part in slices(raw.translate(_TEXT), _END, _SLICE):
            codes = self.vocabulary.code((part + _END).replace(_END, b" " + _END + b" ").split()).astype(np.int32)
            codes[codes == self.end] = -1
            into.append((shard, codes))
        self.bytes += len(raw)

    def counts(self, length: int, parts: FrequentParts | None, shards: int) -> Iterator[pa.RecordBatch]:
        words = self.vocabulary.array()
        hashes = word_hashes(self.vocabulary.words()) if parts else None
        for lang, listed in self.codes.items():
            codes = np.concatenate([c for _, c in listed])
            shard = np.repeat(np.array([s for s, _ in listed], np.int32), [len(c) for _, c in listed])
            here = _starts(codes, length, lang, hashes, parts)
            found, n = _counted(codes, here, length, shard[here], shards)
            for lo in range(0, len(n), 1 << 16):
                some = slice(lo, lo + (1 << 16))
                text = [words.take(pa.array(c[some])) for c in found]
                phrase = text[0] if length == 1 else pc.binary_join_element_wise(*text, b" ")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]).take(pa.array(np.zeros(len(phrase), np.int8))),
                     phrase.cast(pa.string()), *[pa.array(x) for x in n[some].T]],
                    ["lang", "phrase", *_columns(shards)])


def _columns(shards: int) -> list[str]:
    return [f"n{i}" for i in range(shards)]


def _starts(codes: np.ndarray, length: int, lang: str, hashes: np.ndarray | None,
            parts: FrequentParts | None) -> np.ndarray:
    """Where phrases start whose parts, without the last or the first word, may be frequent."""
    if length == 1:
        return np.flatnonzero(codes >= 0)
    if length == 2:
        known = np.unique(codes[codes >= 0])
        good = np.zeros(max(1, codes.max(initial=0) + 1) + 1, bool)  # the last is the end, at -1
        good[known] = parts.may_hold(lang, hashes[known])
        return np.flatnonzero(good[codes[:-1]] & good[codes[1:]])
    pairs = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
    good = np.zeros(len(codes), bool)
    good[pairs] = parts.may_hold(lang, joined_hashes(hashes[codes[pairs]], hashes[codes[pairs + 1]]))
    return np.flatnonzero(good[:-1] & good[1:])


def _counted(codes: np.ndarray, here: np.ndarray, length: int, shard: np.ndarray,
             shards: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct phrases, as one array of codes for each word, and their counts by shard."""
    size = int(codes.max(initial=0)) + 1
    if size ** length * shards < 1 << 63:
        key = codes[here].astype(np.int64)
        for i in range(1, length):
            key = key * size + codes[here + i]
    else:  # too many words for one number: number the beginnings first
        heads, key = codes[here].astype(np.int64), None
        if length == 3:
            heads, key = np.unique(heads * size + codes[here + 1], return_inverse=True)
        key = (heads if key is None else key) * size + codes[here + length - 1]
    both, n = np.unique(key * shards + shard, return_counts=True)
    key = both // shards
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else key
    out = np.zeros((len(first), shards), np.int64)
    row = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)])) if len(key) else key
    out[row, both % shards] = n
    key, words = key[first], []
    if size ** length * shards >= 1 << 63 and length == 3:
        words, key = [key % size], heads[key // size]
        length = 2
    for _ in range(length - 1):
        words.append(key % size)
        key = key // size
    return [key, *words[::-1]], out


def shard_counts(docs: DataFrame, length: int, parts: FrequentParts | None = None,
                 shards: int = SHARDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """lang, phrase and its count in each shard, of phrases of ``length`` words; several rows for each."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known = _Block(), shared.value
        for batch in small_batches(batches, "text"):
            for lang, shard, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                        utf8_values(batch.column(2)), strict=True):
                block.add(lang, shard, raw)
                if block.bytes >= block_bytes:
                    yield from block.counts(length, known, shards)
                    block = _Block()
        if block.bytes:
            yield from block.counts(length, known, shards)

    text = docs["text"].cast("string")
    rows = docs.filter(text.isNotNull()).select(
        F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"),
        F.pmod(F.xxhash64(text, F.lit("shard")), F.lit(shards)).cast("int").alias("shard"),
        text.alias("text"))
    return rows.mapInArrow(run, ", ".join(
        ["lang string", "phrase string", *[f"{c} long" for c in _columns(shards)]]))


# Shards

def _shard_columns(counts: DataFrame) -> list[str]:
    return _columns(len(counts.columns) - 2)


def all_shards(counts: DataFrame) -> DataFrame:
    """One row for each phrase with its counts in all shards."""
    return counts.groupBy("lang", "phrase").agg(
        *[F.sum(c).alias(c) for c in _shard_columns(counts)])


def local_supports(words: DataFrame, support: int = SUPPORT) -> DataFrame:
    """lang, n (its words), sizes and least: by shard its words and the support times its share of
    the words, rounded up."""
    sums = words.groupBy("lang").agg(*[F.sum(c).alias(c) for c in _shard_columns(words)])
    n = sum((F.col(c) for c in _shard_columns(words)), F.lit(0).cast("long"))

    def least(c: str) -> Column:
        return F.ceil(F.col(c).cast("decimal(20,0)") * F.lit(support).cast("decimal(10,0)") / n).cast("long")

    return sums.filter(n > 0).select(
        "lang", n.alias("n"), F.array(*_shard_columns(words)).alias("sizes"),
        F.array(*[least(c) for c in _shard_columns(words)]).alias("least"))


def locally_frequent(counts: DataFrame, supports: DataFrame) -> DataFrame:
    """lang, phrase, frequent (in some shard at its local support) and n over all shards."""
    columns = _shard_columns(counts)
    known = supports.select("lang", "least")
    some = F.lit(False)
    for i, c in enumerate(columns):
        some = some | ((F.col(c) > 0) & (F.col(c) >= F.col("least")[i]))
    return counts.join(known, "lang").select(
        "lang", "phrase", some.alias("frequent"), sum((F.col(c) for c in columns), F.lit(0)).alias("n"))


def frequent_phrases(counts: DataFrame, supports: DataFrame, support: int = SUPPORT) -> DataFrame:
    """lang, phrase, n: the union of what the shards hold frequent, counted over all of them."""
    return locally_frequent(counts, supports).filter("frequent").filter(
        F.col("n") >= support).select("lang", "phrase", "n")


def mine(docs: DataFrame, support: int = SUPPORT, shards: int = SHARDS) -> tuple[DataFrame, list[DataFrame]]:
    """The local supports, and the frequent phrases of one, two and three words."""
    words = stored(all_shards(shard_counts(docs, 1, None, shards)), "collocation-words")
    supports = stored(local_supports(words, support), "collocation-supports")
    levels = [stored(frequent_phrases(words, supports, support), "collocation-1")]
    for length in (2, 3):
        parts = frequent_parts(levels[-1], FILTER_BITS[length - 1])
        found = all_shards(shard_counts(docs, length, parts, shards))
        levels.append(stored(frequent_phrases(found, supports, support), f"collocation-{length}"))
    return supports, levels


# Scores

def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 * a * a / (left * right)), exact for counts of 15 digits."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    return F.call_function("div", (a * a).cast("decimal(30,0)") * F.lit(1_000_000).cast("decimal(7,0)"),
                           (left * right).cast("decimal(30,0)"))


def _head(n: int) -> Column:
    return F.substring_index("phrase", " ", n)


def _tail(n: int) -> Column:
    return F.substring_index("phrase", " ", -n)


def scored_candidates(levels: list[DataFrame]) -> DataFrame:
    """lang, phrase, a, l, r and score of every phrase of two or three frequent words."""
    words, pairs, triples = levels

    def cut(rows: DataFrame, left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        for side, table in (("left", left), ("right", right)):
            known = table.select("lang", F.col("phrase").alias(side), F.col("n").alias(f"{name}_{side}"))
            rows = rows.join(known, ["lang", side])
        return rows.drop("left", "right")

    two = cut(pairs.withColumns({"left": _head(1), "right": _tail(1)}), words, words, "one").select(
        "lang", "phrase", F.col("n").alias("a"), F.col("one_left").alias("l"),
        F.col("one_right").alias("r"), _score(F.col("n"), F.col("one_left"), F.col("one_right")).alias("score"))
    both = cut(triples.withColumns({"left": _head(1), "right": _tail(2)}), words, pairs, "one")
    both = cut(both.withColumns({"left": _head(2), "right": _tail(1)}), pairs, words, "two")
    cuts = [F.struct(_score(F.col("n"), F.col(f"{k}_left"), F.col(f"{k}_right")).alias("score"),
                     F.lit(i).alias("at"), F.col(f"{k}_left").alias("l"), F.col(f"{k}_right").alias("r"))
            for i, k in enumerate(("one", "two"))]
    three = both.select("lang", "phrase", F.col("n").alias("a"), F.least(*cuts).alias("c")).select(
        "lang", "phrase", "a", "c.l", "c.r", "c.score")
    return two.unionByName(three)


def inside_longer(triples: DataFrame) -> DataFrame:
    """lang, phrase, longest: pairs that stand in a phrase of three words, with its largest count."""
    return triples.select("lang", "n", F.explode(F.array(_head(2), _tail(2))).alias("phrase")).groupBy(
        "lang", "phrase").agg(F.max("n").alias("longest"))


def collocations(docs: DataFrame, support: int = SUPPORT, ranks: int = RANKS,
                 shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases."""
    supports, levels = mine(docs, support, shards)
    sizes = supports.select("lang", "n")
    rows = scored_candidates(levels).join(inside_longer(levels[2]), ["lang", "phrase"], "left").filter(
        F.coalesce(100 * F.col("longest") < INSIDE_PERCENT * F.col("a"), F.lit(True)))
    # A language's candidates are cut down in many parts before they meet.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))
    near = rows.withColumn("_part", part).withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= ranks)
    best = near.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= ranks)
    return best.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
