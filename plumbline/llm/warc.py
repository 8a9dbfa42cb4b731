"""Operator 9: WARC archives through a chunked record table.

Writing: each page becomes a record; of equal payloads of at least ``min_bytes`` the one with
the largest page id is a response and the others are revisits that name it. Records are gzip
members; an archive counts only once the manifest names it, so a repeated task leaves no doubt.
Reading: archives are streamed block by block into rows (record id, chunk number, bytes) with the
digest state carried from chunk to chunk, so no record has to fit in memory.

Edge cases: a null html is an empty payload; pages with a null id take part like others, a null
being smaller than any id; pages that share an id are ordered by a hash of their url, and rows
equal to the largest in both are all responses; an empty table gives no archive and reads back as no row; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import prepare, scratch, shuffle_partitions, stored

CHUNK = 256 << 10
MANIFEST = "archive string, records long"
CHUNKS = ("archive string, record long, page_id long, record_type string, refers_to long, "
          "payload_digest string, payload_bytes long, chunk_no int, last boolean, chunk binary, "
          "running_sha1 string")


def plan_records(pages: DataFrame, min_bytes: int = 1000, salts: int = 32) -> DataFrame:
    """Pages with payload digest and the response that each revisit refers to.

    Digests are grouped with map-side combine. The join back meets a payload that fills a third
    of the table in ``salts`` parts.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
        pages["html"].cast("string").alias("html")).withColumns({
            "payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha1(payload),
            "_sha": F.unhex(F.sha2(payload, 256)),
            "_rank": F.struct(F.col("page_id"), F.xxhash64("page_id", "url"))})
    large = rows.filter(F.col("payload_bytes") >= min_bytes)
    winners = (large.groupBy("_sha").agg(F.max("_rank").alias("_best"), F.count("*").alias("_n"))
               .filter("_n > 1")
               .select("_sha", "_best", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
                       .alias("_salt")))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    joined = salted.join(winners.hint("shuffle_hash"), ["_sha", "_salt"], "left")
    revisit = F.col("_best").isNotNull() & ~F.col("_rank").eqNullSafe(F.col("_best"))
    return joined.select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "payload_bytes",
        "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_best.page_id")).alias("refers_to"))


def _header(page_id, url, kind, refers_to, digest, size, length) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page_id}>"),
              ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
              ("WARC-Date", "1970-01-01T00:00:00Z"),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", size)]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", length)]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name, count, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for at in range(batch.num_rows):
                page_id, url, size, digest, kind, refers_to = (
                    batch.column(i)[at].as_py() for i in (0, 1, 3, 4, 5, 6))
                payload = b""
                if kind == "response":
                    payload = memoryview(batch.column(2)[at].as_buffer() or b"")
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(packer.compress(
                    _header(page_id, url, kind, refers_to, digest, size, len(payload))))
                for lo in range(0, len(payload), CHUNK):
                    out.write(packer.compress(payload[lo:lo + CHUNK]))
                out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                count += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())],
                                             ["archive", "records"])

    return run


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write planned records to ``folder``, one archive per task; the manifest has a row for each."""
    spark = records.sparkSession
    prepare(spark)
    return stored(records.select("page_id", "url", "html", "payload_bytes", "payload_digest",
                                 "record_type", "refers_to")
                  .mapInArrow(_write(folder), MANIFEST), "warc-manifest")


def _page(value: str) -> int | None:
    found = value.removeprefix("<urn:page:").removesuffix(">")
    return None if found == "None" else int(found)


class _Member:
    """The bytes of one gzip member after another, read in blocks."""

    def __init__(self, stream):
        self.stream, self.raw, self.plain, self.packer = stream, b"", bytearray(), None

    def start(self) -> bool:
        """Go to the next member; False at the end of the archive."""
        if self.packer is not None and not self.packer.eof:
            self.drain()
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
        self.packer, self.plain = zlib.decompressobj(31), bytearray()
        return bool(self.raw)

    def fill(self) -> bool:
        if self.packer.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
        if not self.raw:
            raise ValueError("an archive ends inside a record")
        self.plain += self.packer.decompress(self.raw, CHUNK)
        self.raw = self.packer.unused_data if self.packer.eof else self.packer.unconsumed_tail
        return True

    def drain(self) -> None:
        while self.fill():
            self.plain.clear()

    def header(self) -> dict[str, str]:
        while (end := self.plain.find(b"\r\n\r\n")) < 0:
            if not self.fill():
                raise ValueError("a record has no header")
        lines = bytes(self.plain[:end]).decode().split("\r\n")[1:]
        del self.plain[:end + 4]
        return dict(line.split(": ", 1) for line in lines)

    def take(self, size: int) -> bytes:
        while len(self.plain) < size:
            if not self.fill():
                raise ValueError("a payload is shorter than its header says")
        part = bytes(self.plain[:size])
        del self.plain[:size]
        return part


def record_chunks(stream) -> Iterator[tuple]:
    """Rows of one archive without its name; a record without payload gives one empty chunk."""
    member, record = _Member(stream), 0
    while member.start():
        head = member.header()
        left, number, state = int(head["Content-Length"]), 0, hashlib.sha1()
        refers = head.get("WARC-Refers-To")
        fixed = (record, _page(head["WARC-Record-ID"]), head["WARC-Type"],
                 _page(refers) if refers else None,
                 head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]))
        while True:
            part = member.take(min(left, CHUNK))
            left -= len(part)
            state.update(part)
            yield (*fixed, number, left == 0, part, state.copy().hexdigest())
            number += 1
            if not left:
                break
        member.drain()
        record += 1


def _read(folder: str, with_bytes: bool):
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(),
             pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]
    names = [f.split()[0] for f in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)

        def packed(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{base}/{archive}", compression=None) as stream:
                    for row in record_chunks(stream):
                        held += len(row[8]) if with_bytes else 200
                        rows.append((archive, *(row if with_bytes else (*row[:8], None, row[9]))))
                        if held > 4 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return run


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame,
                  with_bytes: bool = True) -> DataFrame:
    """The chunked record table of the archives that the manifest names."""
    prepare(spark)
    return (manifest.select("archive").repartition(shuffle_partitions(spark), "archive")
            .mapInArrow(_read(folder, with_bytes), CHUNKS))


def record_report(chunks: DataFrame) -> DataFrame:
    """One row per record. A response whose bytes do not match its header raises an error."""
    final = chunks.filter("last")
    sound = (F.col("record_type") == "revisit") | (F.col("running_sha1") == F.col("payload_digest"))
    return final.filter(F.assert_true(sound, "a payload differs from its digest").isNull()).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archive_pages(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Write the pages to archives below the shared folder and report what is read back."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    manifest = write_archives(plan_records(pages, min_bytes), folder)
    return record_report(read_archives(spark, folder, manifest, with_bytes=False))
