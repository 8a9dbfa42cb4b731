"""Quoted CSV records that may span lines, read by many tasks per file.

A record ends at a line break outside quotes. Whether a split of a file starts inside quotes is
the parity of the quotes before it: they are counted per split, and a running sum over the splits
of a file gives each its start. Lines of a split are then put together to records where they lie;
only the pieces of records that a split border cuts, at most two of a split, meet elsewhere.

Quotes have to be balanced, with quotes inside a field doubled, as the CSV writers of Spark and
spreadsheets do; a file that ends inside quotes is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_WHOLE, _HEAD, _MIDDLE, _TAIL = range(4)
_PLACE = "_file string, _block long, _row long"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _block, _at, _line): physical lines with the place of their split.

    A split is read from its start by one task, so ``_at`` ascends in it.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"), F.col("value").alias("_line"))


def _split_starts(lines: DataFrame) -> DataFrame:
    """(_file, _block, _open): whether a split starts inside quotes; fails at an unbalanced file."""
    quotes = F.length("_line") - F.length(F.replace("_line", F.lit('"')))
    counts = lines.groupBy("_file", "_block").agg(F.sum(quotes).alias("_q"))
    of_file = Window.partitionBy("_file")
    before = of_file.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.sum("_q").over(of_file) % 2 == 1
    is_open = F.coalesce(F.sum("_q").over(before), F.lit(0)) % 2 == 1
    return counts.select("_file", "_block", F.when(odd, F.raise_error(F.concat(
        F.lit("quotes are not balanced in "), F.col("_file")))).otherwise(is_open).alias("_open"))


class _Split:
    """Puts the lines of one split together to records and cut pieces."""

    def __init__(self, inside: bool):
        self.inside, self.continued = inside, inside
        self.held: list[str] = []

    def add(self, line: str) -> tuple[int, str] | None:
        """What a line completes: a record, or the end of one that an earlier split began."""
        self.held.append(line)
        if line.count('"') % 2:
            self.inside = not self.inside
        if self.inside:
            return None
        kind, text = (_HEAD if self.continued else _WHOLE), "\n".join(self.held)
        self.held, self.continued = [], False
        return kind, text

    def rest(self) -> tuple[int, str] | None:
        if not self.held:
            return None
        return (_MIDDLE if self.continued else _TAIL), "\n".join(self.held)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_file", "_block", "_row", "_kind", "_text"]
    place, split, row, out = None, None, 0, []

    def emit(found) -> None:
        nonlocal row
        if found is not None:
            out.append((*place, row, *found))
            row += 1

    def batch_of(rows) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        files, blocks, opened, lines = (batch.column(i).to_pylist() for i in range(4))
        for file, block, inside, line in zip(files, blocks, opened, lines, strict=True):
            if (file, block) != place:
                if split is not None:
                    emit(split.rest())
                place, split, row = (file, block), _Split(inside), 0
            emit(split.add(line))
        if out:
            yield batch_of(out)
            out = []
    if split is not None:
        emit(split.rest())
    if out:
        yield batch_of(out)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _block, _row, _text): every record of every file below ``path``, blank ones left out.

    Ordered by the three place columns, records of a file have their order in it.
    """
    lines = _lines(spark, path)
    # Sorted again, as the join may deal the lines of a split anew; never more than one split at a time.
    rows = lines.join(_split_starts(lines), ["_file", "_block"]).sortWithinPartitions(
        "_file", "_block", "_at").select("_file", "_block", "_open", "_line")
    parts = rows.mapInArrow(_assemble, f"{_PLACE}, _kind int, _text string")
    whole = parts.filter(F.col("_kind") == _WHOLE).drop("_kind")
    return whole.unionByName(_joined(parts.filter(F.col("_kind") != _WHOLE))).select(
        "_file", "_block", "_row", F.regexp_replace("_text", "\r$", "").alias("_text")).filter(
        F.trim("_text") != "")


def _joined(pieces: DataFrame) -> DataFrame:
    """Records that split borders cut: a tail, pieces between, and a head."""
    order = Window.partitionBy("_file").orderBy("_block", "_row")
    number = F.sum((F.col("_kind") == _TAIL).cast("long")).over(order)
    piece = F.struct("_block", "_row", "_text")
    return pieces.withColumn("_record", number).groupBy("_file", "_record").agg(
        F.sort_array(F.collect_list(piece)).alias("_pieces")).select(
        "_file", F.col("_pieces._block")[0].alias("_block"), F.col("_pieces._row")[0].alias("_row"),
        F.array_join("_pieces._text", "\n").alias("_text"))


def place() -> Column:
    """The position of a record in its source: file, split, place in the split."""
    return F.struct("_file", "_block", "_row")


def parsed(rows: DataFrame, columns: list[str], separator: str, header: bool) -> DataFrame:
    """The place columns and one text column for each field; the first record of a file goes with
    ``header``."""
    if header:
        rows = rows.filter((F.col("_block") > 0) | (F.col("_row") > 0))
    # Names may hold anything, so fields are parsed by number.
    fields = ", ".join(f"c{i} string" for i in range(len(columns)))
    options = {"sep": separator, "quote": '"', "escape": '"', "emptyValue": "", "multiLine": "true",
               "maxCharsPerColumn": "-1"}
    body = F.from_csv("_text", fields, options).alias("_fields")
    return rows.select("_file", "_block", "_row", body).select(
        "_file", "_block", "_row", *[F.col(f"_fields.c{i}").alias(c) for i, c in enumerate(columns)])
