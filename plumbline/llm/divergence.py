"""Operator 12: how far the sources of a language diverge, by a frequent-pattern tree of term rows.

Each kept term of a language has a row: its counts in the sources where it occurs, in the order of
the sources. Rows go into a prefix tree whose nodes are (source, count) with multiplicities, so
terms with a common beginning share a path. For two sources the divergence is a sum over all kept
terms. It is put together from three parts: every term as if both sources lacked it, one
correction for each distinct count of one source, and one for each pair of a node and an ancestor,
times the node's multiplicity. No row is made for a term and a pair of sources.

The tree is walked in sorted order: rows are dealt by ranges of paths and each task builds the
nodes of its range, one block at a time. A node that two blocks share is counted in both with the
multiplicity that it has there, which adds up.

All numbers are 64-bit integers. A share is one billionth at least and the shares of a source add
up to about 10^9, so no sum over terms passes 64 bits for up to 2 * 10^9 kept terms. Counts of one
term are exact up to 9 * 10^15 terms of a source.

Edge cases: null text, language and source are empty strings, and an empty language or source is
a group like others; empty texts have no term but their group stays; a text may be of any length
(it is cut between words inside the task) and its terms count one document; repeated rows and ids
count as documents of their own; equal values rank by the bytes of the item; a language without
kept terms gives pairs of value 0; one source gives no pairs; an empty table gives no row; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.coded import BLOCK_BYTES, Vocabulary, added, slices
from plumbline.llm.common import prepare, small_batches, stored, utf8_values

LEAST_DOCS = 3
TERM_RANKS = 200
UNIT = 1_000_000_000
# Everything but letters and bytes of other characters becomes a blank; A-Z become a-z.
_TERMS = bytes(32 if i < 65 or 91 <= i < 97 or 123 <= i < 128 else
               i + 32 if i < 91 else i for i in range(256))
_PAIRS_AT_ONCE = 1 << 21


# Counting

class _Counts:
    """Counts and document counts of (language, source, term) over one block of texts."""

    def __init__(self):
        self.vocabulary, self.groups = Vocabulary(), {}
        self.codes, self.docs, self.group_of, self.bytes = [], [], [], 0

    def add(self, lang: str, source: str, raw: bytes) -> None:
        group = self.groups.setdefault((lang, source), len(self.groups))
        found = [self.vocabulary.code(s.split()) for s in slices(raw.translate(_TERMS))]
        code, n = np.unique(np.concatenate(found), return_counts=True)
        self.codes.append(code)
        self.docs.append(n)
        self.group_of.append(np.full(len(code), group, np.int64))
        self.bytes += len(raw) + 1

    def batches(self) -> Iterator[pa.RecordBatch]:
        if not self.codes:
            return
        size = max(1, len(self.vocabulary))
        code, n = np.concatenate(self.codes), np.concatenate(self.docs)
        key, n, docs = added(np.concatenate(self.group_of) * size + code, n, np.ones_like(n))
        words, names = self.vocabulary.array(), list(self.groups)
        langs, sources = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
        for lo in range(0, len(key), 1 << 16):
            part = key[lo:lo + (1 << 16)]
            group = pa.array(part // size)
            yield pa.RecordBatch.from_arrays(
                [langs.take(group), sources.take(group),
                 words.take(pa.array(part % size)).cast(pa.string()),
                 pa.array(n[lo:lo + (1 << 16)]), pa.array(docs[lo:lo + (1 << 16)])],
                ["lang", "source", "term", "n", "docs"])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _Counts()
    for batch in small_batches(batches, "text"):
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, raw in zip(langs, sources, utf8_values(batch.column(2)), strict=True):
            block.add(lang, source, raw)
            if block.bytes >= BLOCK_BYTES:
                yield from block.batches()
                block = _Counts()
    yield from block.batches()


def named_texts(docs: DataFrame) -> DataFrame:
    """lang, source and text with nulls as empty strings."""
    return docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
                         for c in ("lang", "source", "text")])


def term_rows(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, total and found, the counts by source, of the terms in enough documents."""
    prepare(docs.sparkSession)
    counted = named_texts(docs).mapInArrow(
        _count_terms, "lang string, source string, term string, n long, docs long")
    by_source = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return by_source.groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("docs").alias("_docs"),
        F.collect_list(F.struct("source", "n")).alias("found")).filter(
        F.col("_docs") >= least_docs).drop("_docs")


def share(count: Column, whole: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / whole) by long division in steps of 1000."""
    left, out = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + _div(left * 1000, whole)
        left = (left * 1000) % whole
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return _div((p - q) * (p - q), q)


def group_table(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, whole (occurrences and kept terms), lang_whole, n_kept, absent (the share of a
    term that is missing there) and place, its position in paths; one row for each group."""
    found = terms.select("lang", F.explode("found").alias("f")).select("lang", "f.source", "f.n")
    sums = found.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("n_terms"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("n_kept"), F.sum("total").alias("lang_n"))
    groups = (named_texts(docs).select("lang", "source").distinct()
              .join(sums, ["lang", "source"], "left").join(kept, "lang", "left")
              .na.fill(0, ["n", "n_terms", "n_kept", "lang_n"]))
    order = Window.partitionBy("lang").orderBy(F.desc("n_terms"), "source")
    whole = F.col("n") + F.col("n_kept")
    return groups.select(
        "lang", "source", "n_kept", whole.alias("whole"),
        (F.col("lang_n") + F.col("n_kept")).alias("lang_whole"),
        F.when(F.col("n_kept") > 0, share(F.lit(0).cast("long"), whole)).alias("absent"),
        F.row_number().over(order).cast("long").alias("place"))


def occurrences(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, term, source, place, p and absent for each source in which a term occurs; q of its language."""
    rows = terms.select("lang", "term", "total", F.explode("found").alias("f")).select(
        "lang", "term", "total", "f.source", "f.n")
    return rows.join(groups, ["lang", "source"]).select(
        "lang", "term", "source", "place", "absent", share(F.col("n"), F.col("whole")).alias("p"),
        share(F.col("total"), F.col("lang_whole")).alias("q"))


# The tree

class _Sums:
    """Sums by (language, source, source) that are brought together whenever they grow large."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, key: np.ndarray, there: np.ndarray, back: np.ndarray) -> None:
        self.parts.append((key, there, back))
        self.size += len(key)
        if self.size > _PAIRS_AT_ONCE:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3
        return added(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _both(p, p0, q, q0) -> np.ndarray:
    """What two counts add beyond what each adds alone."""
    return _far(p, q) - _far(p, q0) - _far(p0, q) + _far(p0, q0)


def _walk(lang: np.ndarray, at: np.ndarray, place: np.ndarray, p: np.ndarray, absent: np.ndarray,
          m: np.ndarray, width: int, sums: _Sums) -> None:
    """Add the pairs of each node and its ancestors over sorted rows; row i is ``at[i]:at[i + 1]``."""
    length = np.diff(at)
    same = np.r_[False, lang[1:] == lang[:-1]]  # as far as the row before goes the same way
    rows = np.flatnonzero(length > 0)
    for depth in range(int(length.max(initial=0))):
        rows = rows[length[rows] > depth]
        here = at[rows] + depth
        follows = np.zeros(len(rows), bool)
        near = np.flatnonzero(rows[1:] == rows[:-1] + 1) + 1
        a, b = here[near], here[near - 1]
        follows[near] = same[rows[near]] & (place[a] == place[b]) & (p[a] == p[b])
        same[rows] = follows
        if not depth:
            continue
        first = np.flatnonzero(~follows)
        times = np.add.reduceat(m[rows], first)
        for lo in range(0, len(first), max(1, _PAIRS_AT_ONCE // depth)):
            some = slice(lo, lo + max(1, _PAIRS_AT_ONCE // depth))
            node, n = here[first[some]][:, None], times[some][:, None]
            up = at[rows[first[some]]][:, None] + np.arange(depth)
            key = (lang[rows[first[some]]][:, None] * width + place[up]) * width + place[node]
            sums.add(key.ravel(), (n * _both(p[up], absent[up], p[node], absent[node])).ravel(),
                     (n * _both(p[node], absent[node], p[up], absent[up])).ravel())


def _pair_corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        named = batch.column(0).dictionary_encode()
        lang = np.asarray(named.indices, np.int64)
        flat = batch.column(1).flatten()
        at = np.asarray(batch.column(1).offsets, np.int64)
        place, p, absent = (np.asarray(flat.field(i), np.int64) for i in range(3))
        width, sums = int(place.max(initial=0)) + 1, _Sums()
        _walk(lang, at - at[0], place, p, absent, np.asarray(batch.column(2), np.int64), width, sums)
        key, there, back = sums.total()
        a, b = key // width % width, key % width
        lang = named.dictionary.take(pa.array(key // width // width))
        for one, two, value in ((a, b, there), (b, a, back)):
            yield pa.RecordBatch.from_arrays([lang, pa.array(one), pa.array(two), pa.array(value)],
                                             ["lang", "place", "other", "value"])


def tree_corrections(found: DataFrame) -> DataFrame:
    """lang, place, other and the part of their value that terms with both sources add."""
    prepare(found.sparkSession)
    step = F.struct("place", "p", "absent")
    paths = (found.groupBy("lang", "term").agg(F.sort_array(F.collect_list(step)).alias("path"))
             .groupBy("lang", "path").agg(F.count("*").alias("m")))
    return paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").mapInArrow(
        _pair_corrections, "lang string, place long, other long, value long")


# Reports

def pair_values(groups: DataFrame, found: DataFrame) -> DataFrame:
    """lang, source, item, value for each ordered pair of two sources of a language."""
    left = groups.select("lang", "source", "place", "absent", "n_kept")
    right = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("other"),
                          F.col("absent").alias("other_absent"))
    pairs = left.join(right, "lang").filter(F.col("place") != F.col("other"))
    zero = F.lit(0).cast("long")
    base = pairs.select("lang", "place", "other", F.coalesce(
        F.col("n_kept") * distance(F.col("absent"), F.col("other_absent")), zero).alias("value"),
        "source", "item")
    counts = found.groupBy("lang", "place", "p").agg(F.count("*").alias("m"))
    p, p0, q0 = F.col("p"), F.col("absent"), F.col("other_absent")
    alone = pairs.join(counts, ["lang", "place"]).groupBy("lang", "place", "other").agg(
        F.sum(F.col("m") * (distance(p, q0) - distance(p0, q0))).alias("there"),
        F.sum(F.col("m") * (distance(q0, p) - distance(q0, p0))).alias("back"))
    none = F.lit(None).cast("string")
    single = alone.select("lang", F.inline(F.array(
        F.struct("place", "other", F.col("there").alias("value")),
        F.struct(F.col("other").alias("place"), F.col("place").alias("other"),
                 F.col("back").alias("value")))))
    parts = [d.withColumns({"source": none, "item": none}) for d in (single, tree_corrections(found))]
    return base.unionByName(parts[0]).unionByName(parts[1]).groupBy("lang", "place", "other").agg(
        F.sum("value").alias("value"), F.max("source").alias("source"), F.max("item").alias("item")
    ).select("lang", "source", "item", "value")


def term_values(found: DataFrame) -> DataFrame:
    """lang, source, item, value of the terms that a source has more often than its language."""
    return found.filter(F.col("p") > F.col("q")).select(
        "lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS,
                  term_ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank."""
    terms = stored(term_rows(docs, least_docs), "divergence-terms")
    groups = stored(group_table(docs, terms), "divergence-groups")
    found = occurrences(terms, groups)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value",
                           F.row_number().over(order).alias("rank"))

    return ranked(pair_values(groups, found), "pair").unionByName(
        ranked(term_values(found), "term").filter(F.col("rank") <= term_ranks))
