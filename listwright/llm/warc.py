"""A content-addressed WARC archive: payload bytes once, exact record headers apart, records put together by joins.

``write_archive`` leaves two tables: ``payloads`` (sha256, zlib-packed bytes) and ``headers`` (page_id, sha256, whether the
record has the payload as its block, the header's bytes). ``records`` joins them and checks each payload's digest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.common import Buffer, column, in_arrow
from listwright.session import materialise, shared_folder

LEAST_REVISIT = 1000  # bytes
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
PAYLOADS, HEADERS = "payloads", "headers"


def _pack(batches) -> Iterator[pa.RecordBatch]:
    out = Buffer(pa.schema([("sha256", pa.string()), ("packed", pa.binary())]))
    for batch in batches:
        for digest, payload in zip(column(batch, "sha256"), column(batch, "payload")):
            packed = zlib.compress(payload)
            yield from out.add((digest, packed), len(packed))
    yield from out.flush()


def _line(name: str, value) -> object:
    return F.concat(F.lit(f"{name}: "), value, F.lit(END))


def _urn(page_id) -> object:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) under ``path``.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least 1000 bytes, the one with the
    largest page_id is a response and the others revisit it; smaller ones are all responses. Rows that repeat the largest id
    are responses too; rows without an id revisit like others, or are responses if their payload has no row with one. Null
    urls are empty; control characters and spaces in urls are percent-encoded, as a header line cannot hold them.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha256", F.sha2("payload", 256))
    packed = in_arrow(rows.select("sha256", "payload"), _pack, "sha256 string, packed binary")
    packed.dropDuplicates(["sha256"]).write.parquet(f"{path}/{PAYLOADS}")

    thin = rows.select(
        "page_id", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n")
    )
    largest = (
        thin.filter(F.col("n") >= LEAST_REVISIT).groupBy(F.col("sha256").alias("same")).agg(F.max("page_id").alias("kept"))
    )
    thin = thin.join(largest, F.col("sha256") == F.col("same"), "left")
    is_revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    for code in [*range(0x21), 0x7F]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"),
        F.when(is_revisit, F.lit(f"WARC-Type: revisit{END}")).otherwise(F.lit(f"WARC-Type: response{END}")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Target-URI", url),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(
            is_revisit, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _urn(F.col("kept"))))
        ).otherwise(F.lit("")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(is_revisit, F.lit(0)).otherwise(F.col("n")).cast("string")),
        F.lit(END),
    )
    thin.select("page_id", "sha256", (~is_revisit).alias("has_block"), header.cast("binary").alias("header")).write.parquet(
        f"{path}/{HEADERS}"
    )


def _join_up(batches) -> Iterator[pa.RecordBatch]:
    out = Buffer(pa.schema([("page_id", pa.int64()), ("record", pa.binary())]))
    for batch in batches:
        names = ("page_id", "sha256", "header", "packed")
        for page_id, digest, header, packed in zip(*(column(batch, name) for name in names)):
            payload = b"" if packed is None else zlib.decompress(packed)
            if packed is not None and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"the payload of page {page_id} has not the digest {digest}")
            record = header + payload + 2 * END.encode()
            yield from out.add((page_id, record), len(record))
    yield from out.flush()


def records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): each record's exact bytes, header, block and end, put together again."""
    headers, payloads = spark.read.parquet(f"{path}/{HEADERS}"), spark.read.parquet(f"{path}/{PAYLOADS}")
    blocks = headers.filter("has_block").join(payloads, "sha256").select("page_id", "sha256", "header", "packed")
    bare = headers.filter("NOT has_block").select("page_id", "sha256", "header", F.lit(None).cast("binary").alias("packed"))
    return in_arrow(blocks.unionByName(bare), _join_up, "page_id long, record binary")


_READ = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def _number(urn: str) -> int | None:
    held = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(held) if held else None


def _read(batches) -> Iterator[pa.RecordBatch]:
    """Parse records; what they say of their blocks must hold."""
    out = Buffer(_READ)
    for batch in batches:
        for record in column(batch, "record"):
            head, _, rest = record.partition(2 * END.encode())
            version, *lines = head.decode().split(END)
            fields = dict(line.split(": ", 1) for line in lines)
            size, digest = int(fields["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
            block, end = rest[:size], rest[size:]
            if version != "WARC/1.1" or len(block) != size or end != 2 * END.encode():
                raise ValueError(f"broken record {fields['WARC-Record-ID']}")
            kind = fields["WARC-Type"]
            found = hashlib.sha1(block).hexdigest()
            if kind == "response" and found != digest:
                raise ValueError(f"record {fields['WARC-Record-ID']} has not the digest {digest}")
            target = _number(fields["WARC-Refers-To"]) if kind == "revisit" else None
            row = (_number(fields["WARC-Record-ID"]), kind, target, size if kind == "response" else None, digest)
            yield from out.add(row)
    yield from out.flush()


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, payload_bytes, payload_digest) of each record, from its bytes; a revisit has no size of its own."""
    return in_arrow(
        records(spark, path), _read, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"
    )


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the archive, under a new folder of the shared one by default, and read it back: a row per row of ``pages``."""
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    parsed = materialise(read_archive(spark, path), "warc-read")
    # Only what a revisit needs of its response, each once.
    sizes = (
        parsed.filter(f"record_type = 'response' AND payload_bytes >= {LEAST_REVISIT} AND page_id IS NOT NULL")
        .groupBy(F.col("page_id").alias("target"), F.col("payload_digest").alias("target_digest"))
        .agg(F.max("payload_bytes").alias("target_bytes"))
    )
    same = (F.col("refers_to") == F.col("target")) & (F.col("payload_digest") == F.col("target_digest"))
    return parsed.join(sizes, same, "left").select(
        "page_id", F.coalesce("payload_bytes", "target_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )
