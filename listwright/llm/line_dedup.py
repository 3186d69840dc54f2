"""Line dedup: a repeated line stays in the first document only; the answer is a keep bitmap per document.

Line keys are dealt by ranges of (key hash, document), so that one very common line spans several
tasks; each task sorts its range and streams it. Only the runs at the edges of ranges may go on in
a neighbour: two summary rows a range settle those.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.common import Buffer, column, fresh, in_arrow, texts
from listwright.session import materialise

LEAST_KEY = 10  # code points
SPACE = b" \t\n\r\x0b\x0c"

_LINES = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("pos", pa.int32())])
_MARKS = pa.schema([*_LINES, ("kind", pa.string()), ("first_doc", pa.int64())])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _text_hash():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash")


def line_keys(body: bytes) -> list[bytes | None]:
    """The key of each line; None for one too short to count."""
    keys = [line.strip(SPACE).lower() for line in body.split(b"\n")]
    return [k if len(k) >= LEAST_KEY and len(k.decode()) >= LEAST_KEY else None for k in keys]


def _lines(batches) -> Iterator[pa.RecordBatch]:
    """A row for each line with a key, of documents with an id."""
    out = Buffer(_LINES, 20_000)
    for batch in batches:
        for doc_id, text_hash, body in zip(column(batch, "doc_id"), column(batch, "text_hash"), column(batch, "body")):
            if doc_id is None:
                continue
            for pos, key in enumerate(line_keys(body)):
                if key is not None:
                    high, low = divmod(xxhash.xxh3_128_intdigest(key), 1 << 64)
                    yield from out.add((_signed(high), _signed(low), doc_id, text_hash, pos))
    yield from out.flush()


def _mark(batches) -> Iterator[pa.RecordBatch]:
    """Stream a sorted range. ``drop``: a line that an earlier document of the same run holds.

    ``head``: any line of the range's first run, which may have begun in an earlier range.
    ``edge``: a summary of the first and the last run (their key and first document).
    """
    out = Buffer(_MARKS, 20_000)
    run = first = None
    head = True
    for batch in batches:
        for row in zip(*(column(batch, name) for name in _LINES.names)):
            key, doc_id = row[:2], row[2]
            if key != run:
                head = run is None
                run, first = key, doc_id
                if head:
                    yield from out.add((*row, "edge", first))
            if head or doc_id != first:
                yield from out.add((*row, "head" if head else "drop", first))
    if run is not None:
        yield from out.add((*run, None, None, None, "edge", first))
    yield from out.flush()


def _bitmaps(batches) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())])
    out = Buffer(schema)
    for batch in batches:
        for doc_id, text_hash, dropped in zip(column(batch, "doc_id"), column(batch, "text_hash"), column(batch, "dropped")):
            keep = np.ones(max(dropped) // 8 * 8 + 8, bool)  # whole bytes: lines beyond the last dropped one stay
            keep[dropped] = False
            packed = zlib.compress(np.packbits(keep).tobytes())
            yield from out.add((doc_id, text_hash, len(dropped), packed), len(packed))
    yield from out.flush()


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_dropped, keep) of each document that loses lines.

    A line's key is the line without spaces at its ends, A-Z lower-cased; keys of fewer than ten code
    points never count. Of the documents that hold a key, the one with the least id keeps all its lines
    with it, all others lose theirs. ``keep`` is a zlib-packed bitmap, a bit a line; lines beyond its end
    stay. Null or empty texts have one empty line. Documents without an id neither hold nor lose lines.
    Rows that share an id count as one holder; each text has a bitmap of its own (``text_hash``).
    """
    lines = in_arrow(texts(docs, _text_hash()), _lines, "high long, low long, doc_id long, text_hash long, pos int")
    order = ["high", "low", "doc_id", "text_hash", "pos"]
    ranged = lines.repartitionByRange("high", "low", "doc_id").sortWithinPartitions(*order)
    marks = in_arrow(
        ranged, _mark, "high long, low long, doc_id long, text_hash long, pos int, kind string, first_doc long"
    )
    marks = materialise(marks, "line-marks", "kind")
    edges = marks.filter("kind = 'edge'").groupBy("high", "low").agg(F.min("first_doc").alias("true_first"))
    # At most two edges a range: the number of shuffle partitions bounds what is broadcast.
    heads = marks.filter("kind = 'head'").join(F.broadcast(edges), ["high", "low"]).filter("doc_id <> true_first")
    dropped = marks.filter("kind = 'drop'").select("doc_id", "text_hash", "pos")
    dropped = dropped.unionByName(heads.select("doc_id", "text_hash", "pos"))
    by_doc = dropped.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    return in_arrow(by_doc, _bitmaps, "doc_id long, text_hash long, n_dropped long, keep binary")


def kept_lines(body: bytes, keep: bytes | None) -> list[bytes]:
    lines = body.split(b"\n")
    if keep is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))
    return [line for i, line in enumerate(lines) if i >= len(bits) or bits[i]]


def with_bitmaps(docs: DataFrame, keep: str = "_keep") -> DataFrame:
    """``docs`` with the column ``keep``: null where a document loses nothing."""
    doc, text = fresh(docs, "_doc", "_hash")
    keeps = keep_bitmaps(docs).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text), F.col("keep").alias(keep))
    same = (docs["doc_id"] == keeps[doc]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == keeps[text])
    return docs.join(keeps, same, "left").drop(doc, text)


def _digests(batches) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])
    out = Buffer(schema)
    for batch in batches:
        for doc_id, body, keep in zip(column(batch, "doc_id"), column(batch, "body"), column(batch, "_keep")):
            kept = kept_lines(body, keep)
            n = body.count(b"\n") + 1
            yield from out.add((doc_id, n, n - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    yield from out.flush()


def line_digests(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: its lines, how many of them go, and the hash of what stays."""
    marked = with_bitmaps(docs.select("doc_id", "text"))
    return in_arrow(texts(marked, "_keep"), _digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def _rewritten(keep_name: str):
    def rewritten(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            new = [
                text if keep is None else b"\n".join(kept_lines(text.encode(), keep)).decode()
                for text, keep in zip(column(batch, "text"), column(batch, keep_name))
            ]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            yield batch.drop_columns([keep_name])

    return rewritten


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with the lines gone from ``text``."""
    (keep,) = fresh(docs, "_keep")
    return in_arrow(with_bitmaps(docs, keep), _rewritten(keep), docs.schema)
