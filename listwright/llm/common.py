"""What the operators share: Arrow maps that carry their code along, words, small table helpers."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import listwright

# Bytes of one Arrow batch: bounds what a Python worker holds at a time, whatever the texts' lengths.
BATCH_BYTES = 8 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes; executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(listwright)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text's UTF-8 bytes (null: empty) and ``more`` columns."""
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body")
    return docs.select("doc_id", body, *more)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put behind those that ``df`` has."""
    taken = {name.lower() for name in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of whole numbers without nulls."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type, from_pandas=False) for values, field in zip(columns, schema)], schema=schema
    )


class Buffer:
    """Rows gathered into record batches of at most ``most`` rows or about ``BATCH_BYTES``."""

    def __init__(self, schema: pa.Schema, most: int = 8192):
        self.schema, self.most = schema, most
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, row: tuple, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size
        if len(self.rows) >= self.most or self.bytes >= BATCH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield record_batch(self.schema, *map(list, zip(*self.rows)))
            self.rows, self.bytes = [], 0


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgets all when it holds ``most`` words."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def hashed_rows(rows) -> np.ndarray:
    """A 64-bit hash of each column of some rows of word hashes, the first row's words first."""
    out = rows[0] + np.uint64(len(rows))
    with np.errstate(over="ignore"):
        for row in rows[1:]:
            out = (out ^ (out >> np.uint64(29))) * _MIX + row
        out ^= out >> np.uint64(32)
        out *= _MIX
        out ^= out >> np.uint64(29)
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` words, in order; of the whole, if it has fewer words."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(width, n)
    return hashed_rows([words[i : n - width + 1 + i] for i in range(width)])


def words_of(body: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: bytes.split() splits at just these characters."""
    return body.split()


_PARTS = pa.schema([("part", pa.int32()), ("bits", pa.binary())])
_PARTS_SQL = "part int, bits binary"


_BITS, _BIT_PARTS = 24, 16


def _bit_cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - _BITS)).astype(np.int64)


def _bits_of_task(batches) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << _BITS, bool)
    for batch in batches:
        bits[_bit_cells(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))] = True
    if bits.any():
        for part, some in enumerate(np.split(np.packbits(bits), _BIT_PARTS)):
            yield record_batch(_PARTS, [part], [zlib.compress(some.tobytes(), 1)])


def _bits_united(batches) -> Iterator[pa.RecordBatch]:
    whole: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, bits in zip(column(batch, "part"), column(batch, "bits")):
            some = np.frombuffer(zlib.decompress(bits), np.uint8)
            whole[part] = whole[part] | some if part in whole else some
    for part, some in whole.items():
        yield record_batch(_PARTS, [part], [zlib.compress(some.tobytes(), 1)])


def bitmap(hashes: DataFrame) -> bytes:
    """Which of a fixed number of cells the 64-bit hashes of a column of longs fall to: two megabytes, packed, whatever the
    column's size. It is made by tasks and united by parts."""
    parts = in_arrow(hashes, _bits_of_task, _PARTS_SQL).repartition(_BIT_PARTS, "part")
    whole = np.zeros((_BIT_PARTS, (1 << _BITS) // 8 // _BIT_PARTS), np.uint8)
    for row in in_arrow(parts, _bits_united, _PARTS_SQL).collect():
        whole[row["part"]] |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return zlib.compress(whole.tobytes(), 1)


def in_bitmap(packed: bytes) -> Callable[[np.ndarray], np.ndarray]:
    """Tells which of some hashes may be in the column; those it denies are not."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8)).astype(bool)
    return lambda hashes: bits[_bit_cells(hashes)]
