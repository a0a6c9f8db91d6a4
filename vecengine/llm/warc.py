"""A content-addressed web archive.

Payload bytes are stored once under their SHA-256; the exact header bytes of each record are
stored apart.  Records are rebuilt by joining the two.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Payloads below so many bytes are never revisited.
REVISIT_BYTES = 100
NO_TIME = "1970-01-01T00:00:00Z"


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines, of those pairs whose value is not null, and the empty line."""
    lines = [F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")) for k, v in pairs]
    return F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit("\r\n"))


def _urn(digest: Column, page_id: Column) -> Column:
    return F.concat(F.lit("<urn:sha256:"), F.sha2(F.concat_ws("|", digest, page_id.cast("string")), 256), F.lit(">"))


def _packed(pages: DataFrame) -> DataFrame:
    """``(page_id, url, digest, bytes, packed)``: the payload's SHA-256 and length, and it compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = [x or b"" for x in part.column(2).cast(pa.binary()).to_pylist()]
                told = [[hashlib.sha256(x).hexdigest() for x in raw], pa.array(map(len, raw), pa.int64()), [press(x) for x in raw]]
                yield pa.RecordBatch.from_arrays(part.columns[:2] + [pa.array(x) for x in told], ["page_id", "url", "digest", "bytes", "packed"])

    return pages.mapInArrow(run, "page_id long, url string, digest string, bytes long, packed binary")


def _checked(rows: DataFrame) -> DataFrame:
    """``(header, digest, block)`` with payloads unpacked; one that is missing or has another digest fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                blocks = []
                for digest, packed in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if packed is None:
                        raise ValueError(f"no payload has digest {digest}")
                    blocks.append(plain(packed))
                    if hashlib.sha256(blocks[-1]).hexdigest() != digest:
                        raise ValueError(f"the payload of digest {digest} was altered")
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(blocks, pa.binary())], ["header", "digest", "block"])

    return rows.mapInArrow(run, "header binary, digest string, block binary")


def archive(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = NO_TIME
) -> tuple[DataFrame, DataFrame]:
    """``(payloads, headers)`` for every row of ``pages``, written to the shared folder.

    payloads: ``(digest, packed)``, one row a distinct payload, compressed by itself.  headers: ``(page_id, digest,
    header)``, one row a record.  The html in UTF-8 is the payload (null: empty).  Of records with
    equal payloads of REVISIT_BYTES or more, those with the least id are responses and the others
    revisit records, which carry no payload of their own; smaller ones are all responses.  Null
    ids come last and a group of null ids only has responses; a repeated row is a response as the
    row it repeats is.  Line breaks in a url are percent-encoded; a null url leaves out its line.
    """
    raw = _packed(
        pages.select(
            F.col(id_col).cast("long").alias("page_id"),
            F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A").alias("url"),
            F.col(html_col).alias("html"),
        )
    )
    records = raw.select("page_id", "url", "digest", "bytes")
    firsts = records.groupBy("digest").agg(F.min("page_id").alias("first"))
    told = records.join(firsts, "digest")
    again = (F.col("bytes") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first"))
    kind = F.when(again, "revisit").otherwise("response")
    target = F.when(again, F.col("first"))
    urn = _urn(F.col("digest"), F.col("page_id"))
    header = _lines(
        ("WARC-Type", kind),
        ("WARC-Record-ID", urn),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        ("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", F.when(again, _urn(F.col("digest"), target))),
        ("X-Page-ID", F.col("page_id").cast("string")),
        ("X-Refers-To-Page-ID", target.cast("string")),
        ("X-Payload-Length", F.col("bytes").cast("string")),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    )
    headers = stored(told.select("page_id", "digest", header.cast("binary").alias("header")), "warc-headers")
    # equal digests must come with equal lengths and checksums; partial sums keep a hot payload to one row a task
    seen = F.struct("bytes", F.xxhash64("packed").alias("x"))
    once = raw.groupBy("digest").agg(F.any_value("packed").alias("packed"), F.min(seen).alias("lo"), F.max(seen).alias("hi"))
    clash = F.raise_error(F.concat(F.lit("two payloads have digest "), F.col("digest")))
    payloads = stored(once.select("digest", F.when(F.col("lo") == F.col("hi"), F.col("packed")).otherwise(clash).alias("packed")), "warc-payloads")
    return payloads, headers


def records(payloads: DataFrame, headers: DataFrame) -> DataFrame:
    """``(header, digest, block, record)``: the records as they stand in a WARC file.

    A response's block is its payload, joined on the digest; a revisit's is empty.  Every payload
    is checked against its digest as it is read; one that is missing or altered fails the job.
    """
    revisit = F.col("header").cast("string").contains("\r\nWARC-Profile: ")
    own = _checked(headers.where(~revisit).join(payloads, "digest", "left").select("header", "digest", "packed"))
    every = own.union(headers.where(revisit).select("header", "digest", F.lit(b"").alias("block")))
    return every.withColumn("record", F.concat("header", "block", F.lit(b"\r\n\r\n")))


def parse(records: DataFrame, record_col: str = "record") -> DataFrame:
    """``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, block)`` from record bytes.

    The block is cut by Content-Length; a record that is cut short fails the job.
    """
    text = F.col(record_col).cast("string")
    end = F.instr(text, "\r\n\r\n")
    head = F.left(text, end + 1)
    at = F.octet_length(head) + 3

    def line(name: str) -> Column:
        got = F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
        return F.when(got != "", got)

    cut = records.select(
        line("X-Page-ID").cast("long").alias("page_id"),
        line("WARC-Target-URI").alias("url"),
        line("X-Payload-Length").cast("long").alias("payload_bytes"),
        F.regexp_replace(line("WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"),
        line("WARC-Type").alias("record_type"),
        line("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        line("Content-Length").cast("int").alias("n"),
        F.substring(F.col(record_col), at, line("Content-Length").cast("int")).alias("block"),
    )
    whole = F.octet_length("block") == F.col("n")
    return cut.withColumn("block", F.when(whole, F.col("block")).otherwise(F.raise_error(F.lit("a record is cut short")))).drop("n")
