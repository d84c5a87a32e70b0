"""WARC archives: a record per page, payloads that occur again stored once; reading by verified chains of records.

The reader takes every place that looks like a record as a candidate with the offset where its successor must start.
Pointer jumping from the start of the file marks the candidates that a chain of records reaches; a mark that stands in a
payload is reached by none and is no record.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
MARK, LINE, GAP = b"WARC/1.0\r\n", "\r\n", "\r\n\r\n"
#: Payloads under so many bytes are stored with every page.
SMALLEST_SHARED = 100
#: Records per file: a file is read by one task, whole.
RECORDS_PER_FILE = 10_000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d{1,18})[ \t]*(?=\r\n|$)", re.I)
_FIELD = re.compile(rb"\r\n([A-Za-z-]+):[ \t]*([^\r\n]*)")


def _urn(c: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """Write one record per row to gzip files in ``folder``; other columns are ignored.

    A null body is an empty payload, a null address has no target line, line breaks in an address become spaces. Of rows
    with equal payloads of ``SMALLEST_SHARED`` bytes or more, the one with the smallest id is the response and the others
    revisit it; rows with that same id, or with none, are responses too.
    """
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body")).select("*", F.sha2("body", 256).alias("digest"), F.octet_length("body").alias("size"))
    # only digests travel to find what occurs again; the equal digests of a task are one row
    again = rows.where((F.col("size") >= SMALLEST_SHARED) & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(again, "digest", "left").withColumn("revisit", F.coalesce((F.col("size") >= SMALLEST_SHARED) & (F.col("id") != F.col("first")), F.lit(False)))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(LINE))

    none = F.lit("")
    stored = F.when(F.col("revisit"), none).otherwise(F.col("body"))
    record = F.concat(
        F.lit(MARK.decode()),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _urn(F.col("id"))),
        F.coalesce(line("WARC-Target-URI", F.translate("url", "\r\n", "  ")), none),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Length", F.col("size").cast("string")),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(F.col("first"))))).otherwise(none),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(stored).cast("string")),
        F.lit(LINE),
        stored,
    )
    # the writer ends every value with the gap that ends a record
    rows.select(record.alias("value")).write.option("lineSep", GAP).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def candidates(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, payload's offset, successor's offset) of whatever looks like a record's head; its end may lie past the file."""
    found, at = [], data.find(MARK)
    while at >= 0:
        head = data.find(b"\r\n\r\n", at)
        length = _LENGTH.search(data, at, head) if head >= 0 else None
        if length:
            found.append((at, head + 4, head + 4 + int(length[1]) + 4))
        at = data.find(MARK, at + 1)
    rows = np.array(found, np.int64).reshape(-1, 3)
    return rows[:, 0], rows[:, 1], rows[:, 2]


def reached(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """True for candidates on the chain that starts at offset 0, by pointer jumping."""
    n = len(offsets)
    marks = np.zeros(n + 1, bool)
    if n == 0 or offsets[0] != 0:
        return marks[:n]
    at = np.searchsorted(offsets, successors)
    jump = np.append(np.where((at < n) & (offsets[np.minimum(at, n - 1)] == successors), at, n), n)
    marks[0] = True
    for _ in range(n.bit_length()):
        marks[jump[marks]] = True
        jump = jump[jump]
    return marks[:n]


def _unpacked(data: bytes) -> bytes:
    """All members of a gzip file; of a member that the file ends in, what can be read. Bytes after the last member are no member."""
    parts = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        parts.append(member.decompress(data))
        data = member.unused_data.lstrip(b"\0")  # files may be padded
    return b"".join(parts)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, offset, record_type, page_id, url, refers_to, digest, length, payload)`` of every record of the archives.

    ``digest`` and ``length`` are the head's, ``payload`` the stored bytes. Records that the file ends in are left out. Files
    may be gzip, of any number of members, or plain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = ["file", "offset", "record_type", "page_id", "url", "refers_to", "digest", "length", "payload"]

        def number(urn: bytes | None) -> int | None:
            found = re.fullmatch(rb"<urn:page:(-?\d+)>", urn or b"")
            return int(found[1]) if found else None

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                data = content.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = _unpacked(data)
                offset, payload, successor = candidates(data)
                good = reached(offset, successor) & (successor <= len(data))
                out, size = [], 0
                for a, p, s in zip(offset[good].tolist(), payload[good].tolist(), successor[good].tolist()):
                    head = {k.lower(): v for k, v in _FIELD.findall(data, a, p - 2)}
                    url, length = head.get(b"warc-target-uri"), head.get(b"x-payload-length")
                    out.append(
                        (path, a, head.get(b"warc-type", b"").decode(), number(head.get(b"warc-record-id")), None if url is None else url.decode("utf-8", "replace"), number(head.get(b"warc-refers-to")),
                         head.get(b"warc-payload-digest", b"").decode().removeprefix("sha256:"), int(length) if length else None, data[p : s - 4])
                    )
                    size += s - a
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, "file string, offset bigint, record_type string, page_id bigint, url string, refers_to bigint, digest string, length bigint, payload binary")
